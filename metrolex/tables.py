"""The vocabulary as DataFrames. Literal rows become local relations, so Catalyst knows their size when it picks a join."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import data
from .storage import stored


def literal(x) -> str:
    """A Spark SQL literal."""
    if x is None:
        return "null"
    if isinstance(x, bool):
        return str(x).lower()
    if isinstance(x, str):
        return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return repr(x)


def table(spark: SparkSession, rows: list[tuple], columns: str) -> DataFrame:
    """rows under a schema `name type, ...`; no rows give an empty table."""
    names = [c.split()[0] for c in columns.split(",")]
    if not rows:
        return spark.createDataFrame([], columns)
    body = ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows)
    casts = ", ".join(f"cast({n} as {c.split(None, 1)[1].strip()}) as {n}" for n, c in zip(names, columns.split(",")))
    return spark.sql(f"select {casts} from values {body} as t({', '.join(names)})")


def lexicon(spark: SparkSession) -> DataFrame:
    return table(spark, data.lexicon(), "entity_type string, ord int, term string, section string")


def templates(spark: SparkSession) -> DataFrame:
    return table(spark, data.templates(), "tpl_id int, family string, text string")


def labels(spark: SparkSession) -> DataFrame:
    return table(spark, list(enumerate(data.LABELS)), "id int, label string")


def property_table(spark: SparkSession) -> DataFrame:
    return table(spark, data.PROPERTY_TABLE, "property string, symbol string, unit string, source string, data_range string, hp int, cp int, all_ int, category string")


def terms(spark: SparkSession, kind: str, column: str) -> DataFrame:
    """(n, column): the distinct terms of a type, numbered from 0."""
    return table(spark, list(enumerate(data.distinct_terms(kind))), f"n int, {column} string")


def numbered(spark: SparkSession, items: list[str], column: str) -> DataFrame:
    return table(spark, list(enumerate(items)), f"n int, {column} string")


def ranked_rows(df: DataFrame, order: str) -> tuple[DataFrame, int]:
    """df with n, its place (from 0) in the order of a column without repeats, and the number of rows. Ranges of the order are numbered apart, so no task sees all rows."""
    ranges = stored(df.repartitionByRange(order).withColumn("__range", F.spark_partition_id()))
    sizes = sorted((r["__range"], r["count"]) for r in ranges.groupBy("__range").count().collect())  # a row a partition
    before, total = [], 0
    for i, size in sizes:
        before.append((i, total))
        total += size
    offsets = table(df.sparkSession, before, "__range int, __before long")
    at = F.row_number().over(Window.partitionBy("__range").orderBy(order)) - 1
    return ranges.withColumn("n", at).join(offsets, "__range").withColumn("n", (F.col("n") + F.col("__before")).cast("int")).drop("__range", "__before"), total


@dataclass
class Vocabulary:
    """A lexicon (entity_type, ord, term, section) and templates (tpl_id, family, text): the defaults, or a user's own from files (sources.vocabulary)."""

    lexicon: DataFrame
    templates: DataFrame
    own: bool = True

    @classmethod
    def default(cls, spark: SparkSession) -> Vocabulary:
        return cls(lexicon(spark), templates(spark), False)

    def terms(self, kind: str, column: str) -> tuple[DataFrame, int]:
        """(n, column) of a type's distinct terms in the order of their first ord, and how many there are."""
        if not self.own:
            return terms(self.lexicon.sparkSession, kind, column), len(data.distinct_terms(kind))
        distinct = self.lexicon.where((F.col("entity_type") == kind) & (F.col("term") != "")).groupBy("term").agg(F.min("ord").alias("first"))
        rows, n = ranked_rows(distinct.select(F.struct("first", "term").alias("place"), F.col("term").alias(column)), "place")
        return rows.select("n", column), n

    def sentences(self) -> tuple[DataFrame, int]:
        """(n, tpl_id, family, text), numbered in the order of tpl_id, which must be distinct."""
        if not self.own:
            return self.templates.withColumn("n", F.col("tpl_id")), len(data.templates())
        return ranked_rows(self.templates, "tpl_id")
