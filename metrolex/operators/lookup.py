"""Canonical names, sections, required keys: equi joins against small tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import data
from ..functions.text import heading, tokens
from ..tables import literal, numbered, table


def last_wins(pairs: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """One row a key: the value that came last."""
    return pairs.groupBy(key).agg(F.max_by(value, order).alias(value))


def canonical_map(spark: SparkSession, pairs: list[tuple[str, str]]) -> DataFrame:
    rows = [(i, k, v) for i, (k, v) in enumerate(pairs)]
    return last_wins(table(spark, rows, "ord int, surface string, canonical string"), "surface", "canonical", "ord")


def canonicalise(df: DataFrame, surface_col: str, pairs: list[tuple[str, str]], out: str = "canonical") -> DataFrame:
    """df with the canonical name, or the surface where there is none. One hop: the property map has a cycle."""
    names = canonical_map(df.sparkSession, pairs).select(F.col("surface").alias("__s"), F.col("canonical").alias("__c"))
    return df.join(names, F.col(surface_col) == F.col("__s"), "left").withColumn(out, F.coalesce("__c", surface_col)).drop("__s", "__c")


def classify_headings(df: DataFrame, heading_col: str) -> DataFrame:
    """df with the section of a heading, once for each section that lists it (null: none)."""
    words = table(df.sparkSession, [(s, w) for s, ws in data.SECTION_WORDS.items() for w in ws], "section string, __w string").distinct()
    return df.join(words, heading(F.col(heading_col)) == F.col("__w"), "left").drop("__w")


def content_markers(text_col: str):
    """Sorted distinct markers among a text's lower-cased tokens."""
    return F.array_sort(F.array_intersect(tokens(F.lower(text_col)), F.expr("array(" + ", ".join(map(literal, data.CONTENT_MARKERS)) + ")")))


def missing_keys(spark: SparkSession, present: list[str], required: list[str] = data.REQUIRED_ENV) -> DataFrame:
    """(name): required keys that are not present."""
    return numbered(spark, required, "name").join(numbered(spark, present, "name"), "name", "left_anti").select("name")


def missing_by(holders: DataFrame, present: DataFrame, by: str, required: list[str] = data.REQUIRED_ENV) -> DataFrame:
    """(by, name): required keys that a holder lacks among its (by, name) rows."""
    wanted = holders.select(by).distinct().withColumn("name", F.explode(F.array(*map(F.lit, required))))
    return wanted.join(present, [by, "name"], "left_anti")


def environment(spark: SparkSession, names: list[str] = data.REQUIRED_ENV) -> DataFrame:
    """(name, present) of this process's environment; values are not read into any table."""
    return table(spark, [(n, n in os.environ) for n in names], "name string, present boolean")


def excluded(df: DataFrame, col: str, terms: list[str]) -> DataFrame:
    """df without rows whose value is one of the terms (authors, non-properties)."""
    return df.join(numbered(df.sparkSession, terms, "__t"), F.col(col) == F.col("__t"), "left_anti")


def overlap(lexicon: DataFrame, a: str, b: str) -> DataFrame:
    """(term) in both types."""
    of = lambda k: lexicon.where((F.col("entity_type") == k) & (F.col("term") != "")).select("term")
    return of(a).intersect(of(b))


def inverted(pairs: DataFrame, key: str, value: str) -> DataFrame:
    """One row: the mapping key -> value and its inverse."""
    m = F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, value))))
    return pairs.agg(m.alias("mapping")).withColumn("inverse", F.map_from_entries(F.transform(F.map_entries("mapping"), lambda e: F.struct(e["value"], e["key"]))))
