"""Vocabularies and templates from files, in place of the short defaults."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import Vocabulary


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated (entity_type, ord, term, section), with a header."""
    return spark.read.schema("entity_type string, ord int, term string, section string").csv(path, sep="\t", header=True, quote="", emptyValue="", nullValue="\0")


def read_templates(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated (tpl_id, family, text), with a header."""
    return spark.read.schema("tpl_id int, family string, text string").csv(path, sep="\t", header=True, quote="")


def read_documents(spark: SparkSession, path: str, row_tag: str = "row", schema: str | None = None) -> DataFrame:
    """Rows of XML files by tag, for text that other tools have extracted."""
    reader = spark.read.format("xml").option("rowTag", row_tag)
    return (reader.schema(schema) if schema else reader).load(path)


def read_vocabulary(spark: SparkSession, lexicon: str, templates: str) -> Vocabulary:
    """A user's own vocabulary, for plans.corpus.sentences and operators.mentions."""
    return Vocabulary(read_lexicon(spark, lexicon), read_templates(spark, templates))


def write_lexicon(df: DataFrame, path: str) -> None:
    """(entity_type, ord, term, section) as read_lexicon takes it; a term with a tab or line break is an error."""
    _write(df.select("entity_type", "ord", "term", "section"), "term", path)


def write_templates(df: DataFrame, path: str) -> None:
    """(tpl_id, family, text) as read_templates takes it."""
    _write(df.select("tpl_id", "family", "text"), "text", path)


def _write(df: DataFrame, column: str, path: str) -> None:
    held = F.when(F.col(column).rlike(r"[\t\r\n]"), F.raise_error(F.lit(f"a {column} holds a tab or a line break")).cast("string")).otherwise(F.col(column))
    df.withColumn(column, held).write.csv(path, sep="\t", header=True, quote="", emptyValue="", nullValue="\0")
