"""Joins in time: the last row at or before (as-of), and rows within an interval. Both split a hot key by time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Pieces of time that one key's rows are split into.
PIECES = 64


def _micros(df: DataFrame, time: str) -> Column:
    """Microseconds since 1970; local times count as if in UTC, so clocks never go back."""
    if isinstance(df.schema[time].dataType, T.TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), F.col(time))
    return F.unix_micros(F.col(time).cast("timestamp"))


def _pieces(df: DataFrame, time: str, pieces: int) -> Column:
    """The piece of time that a row falls into; pieces have about equally many of df's rows."""
    if pieces < 2:
        return F.lit(0)
    seconds = _micros(df, time).cast("double")
    cuts = sorted(set(df.select(seconds.alias("s")).approxQuantile("s", [i / pieces for i in range(1, pieces)], 0.25 / pieces)))  # at most so many numbers
    return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= seconds)) if cuts else F.lit(0)


def asof_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, left_time: str, right_time: str, tolerance: str | None = None, pieces: int = PIECES) -> DataFrame:
    """left with the right row of its key whose time is last at or before its own; null columns where there is none, or none within `tolerance` (an interval such as `2 days`).

    Both sides are one table, ordered by time within (key, piece of time); the last right row runs on over the frame up to each row. What a piece lacks comes as
    a carry from the key's earlier pieces, of which there are at most `pieces`. So a key with half of all rows is worked out by many tasks. Of right rows at one time
    the greatest (column by column, in right's order) counts. Null keys and times match nothing; repeated left rows stay. Columns of both sides must have different names.
    """
    clash = {c.lower() for c in left.columns} & {c.lower() for c in right.columns}
    if clash:
        raise ValueError(f"both sides have {', '.join(sorted(clash))}")
    no_left, no_right = F.lit(None).cast(left.schema), F.lit(None).cast(right.schema)
    right = right.where(F.col(right_key).isNotNull() & F.col(right_time).isNotNull())
    a = left.select(F.col(left_key).alias("__k"), F.col(left_time).alias("__t"), F.lit(1).alias("__side"), F.struct(*left.columns).alias("__l"), no_right.alias("__r"))
    b = right.select(F.col(right_key).alias("__k"), F.col(right_time).alias("__t"), F.lit(0).alias("__side"), no_left.alias("__l"), F.struct(*right.columns).alias("__r"))
    both = a.unionByName(b).withColumn("__p", _pieces(a.unionByName(b).where("__t is not null"), "__t", pieces))
    order = Window.partitionBy("__k", "__p").orderBy("__t", "__side", "__r").rowsBetween(Window.unboundedPreceding, 0)
    near = both.withColumn("__near", F.last("__r", ignorenulls=True).over(order)).where("__side = 1")
    ends = both.groupBy("__k", "__p").agg(F.max_by("__r", F.when(F.col("__r").isNotNull(), F.struct("__t", "__r"))).alias("__end"))
    before = Window.partitionBy("__k").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select("__k", "__p", F.last("__end", ignorenulls=True).over(before).alias("__carry")).where("__carry is not null")
    found = near.join(carry, ["__k", "__p"], "left").select("__l", "__t", F.when(F.col("__t").isNotNull(), F.coalesce("__near", "__carry")).alias("__r"))
    if tolerance is not None:
        found = found.withColumn("__r", F.when(F.col(f"__r.{right_time}") >= F.col("__t") - F.expr(f"interval {tolerance}"), F.col("__r")))
    return found.select("__l.*", *(F.col("__r")[c].alias(c) for c in right.columns))


def interval_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, left_time: str, begin: str, end: str, width: int, how: str = "inner") -> DataFrame:
    """Pairs of rows of one key with begin <= left_time < end; how: inner or left.

    Time is cut into bins of `width` seconds, an interval goes to each bin that it touches, and rows meet by key and bin: an equi join, which splits a hot key by time. Choose the width
    about as long as usual intervals. Empty intervals and null keys, times and bounds match nothing.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"how is inner or left, not {how}")
    bin_of = lambda df, c: F.floor(_micros(df, c) / F.lit(width * 1_000_000))
    good = right.where((F.col(begin) < F.col(end)) & F.col(right_key).isNotNull())
    dealt = good.withColumn("__bin", F.explode(F.sequence(bin_of(good, begin), bin_of(good, end)))).withColumnRenamed(right_key, "__k")
    rows = left.withColumn("__lbin", bin_of(left, left_time))
    same = (F.col(left_key) == F.col("__k")) & (F.col("__lbin") == F.col("__bin")) & (F.col(left_time) >= F.col(begin)) & (F.col(left_time) < F.col(end))
    return rows.join(dealt, same, how).withColumn(right_key, F.col("__k")).drop("__bin", "__lbin", "__k")
