"""Labelled sentences from templates, vocabularies and the keys of fact tables.

The picks are equi joins on key modulo table size against small local relations, so a corpus of any size is a
chain of broadcast hash joins over one scan, with no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import data, tables
from ..functions.text import render
from ..sources.vocabulary import read_vocabulary, write_lexicon, write_templates
from ..storage import fresh_path


#: Bytes of a file's split, from which on a core has one of its own.
_SPLIT = 16 << 20


def picked(df: DataFrame, small: DataFrame, key: Column, size: int) -> DataFrame:
    """df with the row of `small` (numbered by n) that the key picks."""
    return df.withColumn("__n", F.pmod(key, F.lit(size)).cast("int")).join(small.withColumnRenamed("n", "__n"), "__n").drop("__n")


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where its files have fewer splits than there are cores (small files of one row group); larger inputs are not shuffled."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())  # of the files, as Catalyst knows it
    return df.repartition(cores) if size < cores * _SPLIT else df


def term(df: DataFrame, kind: str, column: str, key: Column) -> DataFrame:
    return picked(df, tables.terms(df.sparkSession, kind, column), key, len(data.distinct_terms(kind)))


def sentences(spark: SparkSession, sf_dir: str, vocabulary: tables.Vocabulary | None = None) -> DataFrame:
    """(sid, tpl_id, family, polymer, property, symbol, unit, value, sentence), one for each line item; line items alike in all keys make one sentence with one sid.

    vocabulary: the terms and templates to render with. A type without terms leaves its slots as they are.
    """
    words = vocabulary or tables.Vocabulary.default(spark)
    k, i = F.col("l_orderkey"), F.col("l_linenumber")
    df = spread(spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")).withColumn("value", F.col("l_quantity").cast("long").cast("string"))
    for kind, key in (("polymer", F.col("l_partkey")), ("property", k + i), ("symbol", F.col("l_suppkey")), ("unit", F.col("l_suppkey") + i)):
        rows, n = words.terms(kind, kind)
        df = picked(df, rows, key, n) if n else df.withColumn(kind, F.lit("{" + kind + "}"))
    templates, n = words.sentences()
    df = picked(df, templates, k, n)  # last, as long texts need not go through a join that shuffles
    fills = {s: F.col(s) for s in ("polymer", "property", "symbol", "unit", "value")}
    sid = F.concat_ws("-", *(F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "value")))
    return df.select(sid.alias("sid"), "tpl_id", "family", *fills, render(F.col("text"), fills).alias("sentence"))


def valued(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(l_orderkey, l_linenumber, polymer, told): a sentence for each line item with a number in one of its written forms."""
    k, i = F.col("l_orderkey"), F.col("l_linenumber")
    df = spread(spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    df = picked(df, tables.numbered(spark, data.VALUE_FORMS, "form"), k + i, len(data.VALUE_FORMS))
    df = term(df, "polymer", "polymer", F.col("l_partkey"))
    df = term(df, "unit", "unit", F.col("l_suppkey"))
    return df.select("l_orderkey", "l_linenumber", "polymer", F.concat(F.lit("At last "), "polymer", F.lit(" reached "), "form", F.lit(" "), "unit", F.lit(", as told.")).alias("told"))


#: Code points as scanned text has them, beside the fixed ones; a choice of ours.
SCANNED_CODES = ["u+03B1", "U+2126", "u+00B5", "u+2212", "u03C3", "u+00b2"]


def scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(l_orderkey, l_linenumber, scanned): a sentence for each line item, with code points and names of Greek letters where characters should stand."""
    codes = [c for c, _ in data.OCR_CODES] + SCANNED_CODES
    names = [f(n) for n in data.GREEK_NAMES for f in (str.lower, str.capitalize)]
    df = spread(spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    df = picked(df, tables.numbered(spark, codes, "code"), F.col("l_partkey"), len(codes))
    df = picked(df, tables.numbered(spark, names, "letter"), F.col("l_orderkey") + F.col("l_linenumber"), len(names))
    df = term(df, "polymer", "polymer", F.col("l_suppkey"))
    return df.select("l_orderkey", "l_linenumber", F.concat(F.lit("unused "), "letter", F.lit("-form of "), "polymer", F.lit(" ("), "letter", F.lit("2, "), "letter", F.lit("ine): "), F.col("l_linenumber").cast("string"), F.lit(" "), "code", F.lit(" at u+").cast("string")).alias("scanned"))


def complex_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(o_orderkey, sentence) with two measurements."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    df = spread(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey"))
    df = picked(df, tables.numbered(spark, data.COMPLEX_TEMPLATES, "text"), k, len(data.COMPLEX_TEMPLATES))
    picks = {"polymer": ("polymer", c), "polymer1": ("polymer", c + 1), "polymer2": ("polymer", c + 2), "property": ("property", k), "property1": ("property", k + 1), "property2": ("property", k + 2), "unit": ("unit", c), "unit1": ("unit", c + 1), "unit2": ("unit", c + 2), "material": ("material", k)}
    for column, (kind, key) in picks.items():
        df = term(df, kind, column, key)
    fills = {s: F.col(s) for s in picks} | {"value1": F.pmod(k, F.lit(97)).cast("string"), "value2": F.pmod(c, F.lit(89)).cast("string")}
    return df.select("o_orderkey", render(F.col("text"), fills).alias("sentence"))


def negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(o_orderkey, kind, sentence, distractor): sentences whose look misleads; the distractor is what must not be labelled."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    df = spread(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey"))
    df = picked(df, tables.table(spark, [(i, *t) for i, t in enumerate(data.NEGATIVE_TEMPLATES)], "n int, kind string, text string"), k, len(data.NEGATIVE_TEMPLATES))
    df = picked(df, tables.numbered(spark, data.AUTHOR_NAMES, "author_name"), c, len(data.AUTHOR_NAMES))
    df = picked(df, tables.numbered(spark, data.NON_PROPERTIES, "non_property"), c, len(data.NON_PROPERTIES))
    df = term(df, "polymer", "polymer", c)
    df = term(df, "unit", "unit", k)
    df = picked(df, tables.numbered(spark, WRONG_UNITS, "wrong_unit"), k + c, len(WRONG_UNITS))
    fills = {s: F.col(s) for s in ("author_name", "non_property", "polymer", "unit", "wrong_unit")} | {"value": F.pmod(k, F.lit(97)).cast("string")}
    distractor = F.when(F.col("kind") == "author", F.col("author_name")).when(F.col("kind") == "wrong_unit", F.col("wrong_unit")).otherwise(F.col("non_property"))
    return df.select("o_orderkey", "kind", render(F.col("text"), fills).alias("sentence"), distractor.alias("distractor"))


#: Templates of a user's own, as own_vocabulary() writes them to a file.
OWN_TEMPLATES = [(11, "pair", "{polymer} beside {polymer}: {symbol} = {value} {unit}"), (25, "plain", "Of {polymer}, {property} is {value}{unit}."), (7, "plain", "{value} {unit} for {polymer}"), (40, "none", "nothing to tell")]


def own_vocabulary(spark: SparkSession, sf_dir: str) -> tables.Vocabulary:
    """A vocabulary from files, as a user brings it: parts are the polymers, so it grows with the tables."""
    lexicon, templates = fresh_path(spark, "lexicon"), fresh_path(spark, "templates")
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    names = part.select(F.lit("polymer").alias("entity_type"), F.col("p_partkey").cast("int").alias("ord"), F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string")).alias("term"), F.col("p_brand").alias("section"))
    write_lexicon(names.unionByName(tables.lexicon(spark).where("entity_type != 'polymer'")), lexicon)
    write_templates(tables.table(spark, OWN_TEMPLATES, "tpl_id int, family string, text string"), templates)
    return read_vocabulary(spark, lexicon, templates)


#: Units that no temperature has; a choice of ours.
WRONG_UNITS = ["MPa", "g/mol", "eV", "bar", "%"]
