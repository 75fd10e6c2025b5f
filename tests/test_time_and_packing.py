"""Packing, joins in time, merging sketches, against plain loops."""

import bisect
import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from metrolex.operators import packing, sketches, timejoin

T0 = dt.datetime(2024, 1, 1)


def _one_by_one(sizes, window):
    rooms, into = [], {}
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        for w, room in enumerate(rooms):
            if room >= sizes[i]:
                break
        else:
            rooms.append(window)
            w = len(rooms) - 1
        rooms[w] -= sizes[i]
        into[i] = w
    return [into[i] for i in range(len(sizes))]


def test_first_fit_is_first_fit():
    r = random.Random(6)
    for _ in range(200):
        window = r.randrange(1, 40)
        sizes = np.array([r.randrange(1, window + 1) for _ in range(r.randrange(60))], np.int64)
        assert packing.first_fit(sizes, window)[0].tolist() == _one_by_one(sizes.tolist(), window)


@pytest.mark.parametrize("shard_tokens", [packing.SHARD_TOKENS, 500])
def test_packing_keeps_every_token(spark, shard_tokens):
    r = random.Random(7)
    rows = [(f"s{i}", [f"t{i}.{j}" for j in range(n)], [f"l{j % 3}" for j in range(n)]) for i, n in enumerate([r.choice([0, 1, 5, 17, 31, 32, 33, 64, 100]) for _ in range(200)])]
    rows += [rows[0], rows[5], (None, ["x"], ["O"]), ("none", None, None)]
    df = spark.createDataFrame(rows, "sid string, tokens array<string>, labels array<string>").repartition(3)
    got = packing.packed(df, 32, shard_tokens).collect()
    assert all(len(w["tokens"]) == len(w["labels"]) == len(w["segments"]) == len(w["positions"]) == w["n_tokens"] <= 32 for w in got)
    seen, whole = [], {}
    for w in got:
        assert sorted(set(w["segments"])) == list(range(1, len(w["sids"]) + 1)) and list(w["segments"]) == sorted(w["segments"])
        for s, sid in enumerate(w["sids"], 1):
            at = [i for i, x in enumerate(w["segments"]) if x == s]
            assert [w["positions"][i] for i in at] == list(range(len(at)))
            seen += [(sid, w["tokens"][i], w["labels"][i]) for i in at]
            whole.setdefault(sid, []).append(len(at))
    assert sorted(seen) == sorted((s, t, la) for s, ts, ls in rows if s is not None and ts for t, la in zip(ts, ls))
    assert all(len([x for x in n if x < 32]) <= sum(1 for r_ in rows if r_[0] == sid) for sid, n in whole.items())  # cut only where it must be
    assert len({(w["shard"], w["window"]) for w in got}) == len(got) and sum(w["n_tokens"] for w in got) > (0.95 if shard_tokens > 500 else 0.85) * 32 * len(got)
    assert packing.packed(df.limit(0), 32).count() == 0


@pytest.mark.parametrize("pieces, tolerance", [(timejoin.PIECES, None), (1, None), (7, "40 minutes"), (3, None)])
def test_asof(spark, pieces, tolerance):
    """One user holds half of the rows; ties, nulls and rows before the first order."""
    r = random.Random(8)
    user = lambda: 1 if r.random() < 0.5 else r.choice([2, 3, 4, None])
    at = lambda: None if r.random() < 0.03 else T0 + dt.timedelta(minutes=r.randrange(600))
    left = [(i, user(), at()) for i in range(300)] + [(7, 1, T0)] * 2
    right = [(1000 + i, user(), at()) for i in range(120)]
    a, b = spark.createDataFrame(left, "id long, u long, ts timestamp").repartition(3), spark.createDataFrame(right, "oid long, c long, day timestamp")
    got = timejoin.asof_join(a, b, "u", "c", "ts", "day", tolerance, pieces)
    assert got.columns == ["id", "u", "ts", "oid", "c", "day"]
    want = []
    for i, u, t in left:
        rows = sorted((d, o) for o, c, d in right if c == u and c is not None and d is not None)
        k = bisect.bisect_right(rows, (t, 10**9)) if t is not None else 0
        d, o = rows[k - 1] if k else (None, None)
        if tolerance and d is not None and d < t - dt.timedelta(minutes=40):
            d = o = None
        want.append((i, u, t, o, u if o is not None else None, d))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert timejoin.asof_join(a, b.limit(0), "u", "c", "ts", "day").where("oid is not null").count() == 0 and timejoin.asof_join(a.limit(0), b, "u", "c", "ts", "day").count() == 0
    with pytest.raises(ValueError):
        timejoin.asof_join(a, a, "u", "u", "ts", "ts")


@pytest.mark.parametrize("how, width", [("inner", 600), ("left", 3600), ("inner", 7)])
def test_intervals(spark, how, width):
    r = random.Random(9)
    left = [(i, r.choice([1, 1, 2, None]), T0 + dt.timedelta(seconds=r.randrange(3000))) for i in range(80)] + [(99, 1, None)]
    right = [(i, r.choice([1, 1, 2, None]), T0 + dt.timedelta(seconds=(s := r.randrange(-100, 3000))), T0 + dt.timedelta(seconds=s + r.choice([0, 1, 60, 900, -5]))) for i in range(60)]
    a, b = spark.createDataFrame(left, "id long, u long, ts timestamp"), spark.createDataFrame(right, "oid long, c long, lo timestamp, hi timestamp")
    got = timejoin.interval_join(a, b, "u", "c", "ts", "lo", "hi", width, how).select("id", "oid").collect()
    want = [(i, o) for i, u, t in left for o, c, lo, hi in right if u is not None and u == c and t is not None and lo <= t < hi]
    if how == "left":
        want += [(i, None) for i, *_ in left if i not in {x for x, _ in want}]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_sketches_unite_to_one_pass(spark):
    df = spark.range(60_000).select((F.col("id") % 7).alias("g"), (F.col("id") % 30).alias("day"), F.when(F.col("id") % 11 != 0, F.pmod(F.xxhash64("id"), F.lit(9000))).alias("v"))
    days = sketches.sketched(df, "v", ["g", "day"])
    got = {r["g"]: r for r in sketches.estimated(sketches.united(days, ["g"])).collect()}
    once = {r["g"]: r["n_distinct"] for r in sketches.estimated(sketches.sketched(df, "v", ["g"])).collect()}
    exact = {r["g"]: (r["d"], r["n"]) for r in df.groupBy("g").agg(F.countDistinct("v").alias("d"), F.count("*").alias("n")).collect()}
    assert all(abs(got[g]["n_distinct"] / d - 1) < 0.03 and abs(got[g]["n_distinct"] - once[g]) <= 0.005 * d and got[g]["n"] == n for g, (d, n) in exact.items())
    halves = [sketches.sketched(df.where(x), "v", ["g"]) for x in ("day < 15", "day >= 15")]
    later = {r["g"]: (r["n_distinct"], r["n"]) for r in sketches.estimated(sketches.added(*halves, ["g"])).collect()}
    assert all(later[g][1] == n and abs(later[g][0] / d - 1) < 0.03 for g, (d, n) in exact.items())
    assert sketches.estimated(sketches.sketched(df.where("false"), "v", ["g"])).count() == 0


def test_packing_shuffles_no_tokens(spark):
    df = spark.range(0, 3000, 1, 3).selectExpr("cast(id as string) sid", "array_repeat('t', cast(1 + id % 40 as int)) tokens", "array_repeat('O', cast(1 + id % 40 as int)) labels")
    got = packing.packed(df, 32)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert sum(r["n_tokens"] for r in got.collect()) == sum(1 + i % 40 for i in range(3000))
