"""The workbook source: rows come back as they went, failed tasks leave nothing, a small reader of the format agrees."""

import datetime as dt
import decimal
import io
import os
import zipfile

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metrolex.sources import exports, xlsx

DATA = "/root/testdata/sf0.001"
UTC = dt.timezone.utc


def _plain(path):
    """Cells of the first sheets, by string search alone."""
    out = []
    for f in sorted(os.listdir(path)):
        if f.endswith(".xlsx"):
            with zipfile.ZipFile(f"{path}/{f}") as z:
                assert z.testzip() is None and {"[Content_Types].xml", "_rels/.rels", "xl/workbook.xml", "xl/_rels/workbook.xml.rels", "xl/styles.xml"} <= set(z.namelist())
                text = z.read("xl/worksheets/sheet1.xml").decode()
            for row in text.split("<row ")[2:]:
                out.append([c.split("preserve\">")[1].split("</t>")[0] if "inlineStr" in c else c.split("<v>")[1].split("</v>")[0] for c in row.split("<c ")[1:]])
    return out


def test_orders_come_back(spark, tmp_path):
    orders = spark.read.parquet(f"{DATA}/orders.parquet")
    path = str(tmp_path / "orders")
    exports.export(orders.repartition(3), path, "xlsx")
    again = exports.read_export(spark, path, "xlsx", orders.schema)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, orders.collect()))
    assert len([f for f in os.listdir(path) if f.endswith(".xlsx")]) == 3 and os.path.exists(f"{path}/_SUCCESS") and not os.path.exists(f"{path}/_temporary")
    assert sorted(int(r[0]) for r in _plain(path)) == sorted(r["o_orderkey"] for r in orders.collect())
    assert exports.read_export(spark, path, "xlsx").columns == orders.columns
    with pytest.raises(ValueError):
        exports.export(orders, path, "xlsx")
    exports.export(orders.limit(5), path, "xlsx", "overwrite")
    exports.export(orders.limit(2), path, "xlsx", "append")
    assert exports.read_export(spark, path, "xlsx", orders.schema).count() == 7


def test_types_and_odd_values(spark, tmp_path):
    schema = "s string, b boolean, i int, l long, d double, x decimal(38,10), day date, at timestamp"
    rows = [
        ("plain", True, 1, 2, 0.1, decimal.Decimal("1.5"), dt.date(2024, 2, 29), dt.datetime(2024, 1, 1, 23, 59, 59, 999999)),
        (None,) * 8,
        ("", False, -(2**31), 2**63 - 1, float("inf"), decimal.Decimal("12345678901234567890.0123456789"), dt.date(1582, 1, 1), dt.datetime(1850, 1, 1, 0, 0, 0, 1)),
        (' <&> "\n\t _x0041_ \x00\x01￾ 😀 ', None, 0, 2**53 + 1, -0.0, decimal.Decimal("-0.0000000001"), dt.date(9999, 1, 1), dt.datetime(2077, 12, 31, 1, 2, 3, 456789)),
        ("\r\n", True, 5, -(2**53), 1e-300, decimal.Decimal(0), dt.date(1900, 3, 1), dt.datetime(1900, 3, 1)),
    ]
    df = spark.createDataFrame(rows, schema).coalesce(1)
    xlsx.register(spark)
    df.write.format("xlsx").mode("append").option("most_rows", 3).save(str(tmp_path / "t"))  # three sheets
    got = spark.read.format("xlsx").schema(df.schema).load(str(tmp_path / "t"))
    assert [tuple(r) for r in got.collect()] == [tuple(r) for r in df.collect()]
    none = df.limit(0)
    none.write.format("xlsx").mode("append").save(str(tmp_path / "none"))
    assert spark.read.format("xlsx").schema(df.schema).load(str(tmp_path / "none")).count() == 0


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    path = tmp_path / "failed"
    df = spark.range(100, numPartitions=4).select("id", F.when(F.col("id") == 77, F.raise_error(F.lit("no"))).otherwise(F.lit(1)).cast("int").alias("x"))
    with pytest.raises(Exception, match="no"):
        exports.export(df, str(path), "xlsx")
    assert not [f for _, _, names in os.walk(path) for f in names]
    exports.export(spark.range(3), str(path), "xlsx", "append")
    with pytest.raises(Exception, match="32767"):
        exports.export(spark.range(1).select(F.repeat(F.lit("x"), 40000).alias("long")), str(path), "xlsx", "overwrite")
    assert exports.read_export(spark, str(path), "xlsx", T.StructType([T.StructField("id", T.LongType())])).count() == 3  # the old export stands
    with pytest.raises(Exception, match="no cells"):
        exports.export(spark.range(1).select(F.array("id").alias("nested")), str(path), "xlsx", "append")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.text(max_size=30), st.integers(-(2**63), 2**63 - 1), st.floats()), max_size=8), st.integers(2, 5))
def test_any_text_and_number(rows, most):
    out = io.BytesIO()
    cols = list(zip(*rows)) if rows else [[], [], []]
    batch = pa.record_batch([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], names=["s", "i", "f"])
    assert xlsx.write_workbook(out, ["s", "i", "f"], iter([batch]), most) == len(rows)
    kinds = (T.StringType(), T.LongType(), T.DoubleType())
    got = [tuple(xlsx.value(r.get(n), k) for n, k in zip("sif", kinds)) for r in xlsx.read_workbook(io.BytesIO(out.getvalue()))]
    assert str(got) == str([(s, i, float(f)) for s, i, f in rows])


def test_columns():
    assert [xlsx.column_name(i) for i in (0, 25, 26, 701, 702, 16383)] == ["A", "Z", "AA", "ZZ", "AAA", "XFD"]
    assert all(xlsx.column_index(xlsx.column_name(i) + "7") == i for i in range(2000))
