"""Each query of the domain engine against its SQL."""

import os

import duckdb
import pytest

from metrolex.plans.oracle import ORACLE
from metrolex.plans.queries import QUERIES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in ("lineitem", "orders", "part", "events", "customer"):
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def test_all_have_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    got = QUERIES[name](spark, DATA)
    want = db.sql(ORACLE[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    a = sorted(map(str, (tuple(r[c] for c in cols) for r in got.collect())))
    b = sorted(map(str, db.sql(f"select {', '.join(f'"{c}"' for c in cols)} from ({ORACLE[name]})").fetchall()))
    assert a == b and a
