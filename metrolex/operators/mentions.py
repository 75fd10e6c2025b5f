"""Vocabulary matching: overlap resolution, BIO labels and back.

A `contains` join would be a nested loop, and a join on first tokens makes rows of every token and has to bring
the matches of a sentence together again (joined() does that). So sentences are matched where they are: Arrow batches of token arrays meet the vocabulary's automata
(operators.automaton) and come back with their mentions, without a shuffle, whatever the vocabulary's size.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import data
from ..functions.text import tokens
from . import automaton

_KEY = 3
_SPANS = "array<struct<st:int,en:int,entity:string,term:string>>"


def _priority(kind: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, data.TYPE_PRIORITY)), kind)


def _listed(lexicon: DataFrame) -> DataFrame:
    """(entity, term) of the non-empty terms, as often as they are listed."""
    return lexicon.where("term != ''").select(F.upper("entity_type").alias("entity"), "term")


def compiled(lexicon: DataFrame) -> DataFrame:
    """(entity, term, toks, n, key, k) of the distinct, non-empty terms."""
    toks = _listed(lexicon).distinct().withColumn("toks", tokens(F.col("term")))
    return toks.withColumn("n", F.size("toks")).withColumn("k", F.least("n", F.lit(_KEY))).withColumn("key", F.array_join(F.slice("toks", F.lit(1), F.col("k")), " "))


def candidates(sentences: DataFrame, lexicon: DataFrame, id_col: str = "sid", text_col: str = "sentence") -> DataFrame:
    """(id, st, en, entity, term, prio): every match on token boundaries; st and en are 0-based tokens, en exclusive.

    Runs of digits are values. A unit must follow a value. Other terms of one character must stand beside a value or `=`.
    """
    toks = sentences.select(F.col(id_col).alias("sid"), tokens(F.col(text_col)).alias("t"))
    at = toks.select("sid", "t", F.posexplode("t").alias("st", "tok"))
    keys = at.withColumn("k", F.explode(F.sequence(F.lit(1), F.least(F.lit(_KEY), F.size("t") - F.col("st"))))).withColumn("key", F.array_join(F.slice("t", F.col("st") + 1, F.col("k")), " "))
    found = keys.join(compiled(lexicon), ["k", "key"]).where((F.col("n") == F.col("k")) | (F.slice("t", F.col("st") + 1, F.col("n")) == F.col("toks")))
    before, after = F.get("t", F.col("st") - 1), F.get("t", F.col("st") + F.col("n"))
    number = lambda c: F.coalesce(c.rlike(r"^\p{N}+$"), F.lit(False))
    beside = number(before) | number(after) | F.coalesce(before == "=", F.lit(False)) | F.coalesce(after == "=", F.lit(False))
    ok = F.when(F.col("entity") == "UNIT", number(before)).when(F.length("term") == 1, beside).otherwise(True)
    terms = found.where(ok).select("sid", "st", (F.col("st") + F.col("n")).alias("en"), "entity", "term")
    values = at.where(number(F.col("tok"))).select("sid", "st", (F.col("st") + 1).alias("en"), F.lit("VALUE").alias("entity"), F.col("tok").alias("term"))
    return terms.unionByName(values).withColumn("prio", _priority(F.col("entity")).cast("int"))


def resolved(found: DataFrame) -> DataFrame:
    """(sid, spans): leftmost, then longest, then by type priority; no overlaps. Sentences are short, so a row holds its matches."""
    s = F.array_sort(F.collect_set(F.struct("st", (-F.col("en")).alias("ne"), "prio", "entity", "term")))
    none = F.expr("cast(array() as array<struct<st:int,en:int,entity:string,term:string>>)")
    keep = lambda a, x: F.when(x["st"] >= F.coalesce(F.element_at(a, -1)["en"], F.lit(0)), F.array_append(a, F.struct(x["st"].alias("st"), (-x["ne"]).alias("en"), x["entity"].alias("entity"), x["term"].alias("term")))).otherwise(a)
    grouped = found.groupBy("sid").agg(s.alias("s"))
    return grouped.select("sid", F.aggregate("s", none, lambda a, x: F.when(F.size(a) == 0, F.array(F.struct(x["st"].alias("st"), (-x["ne"]).alias("en"), x["entity"].alias("entity"), x["term"].alias("term")))).otherwise(keep(a, x))).alias("spans"))


def _prepared(sentences: DataFrame, lexicon: DataFrame, id_col: str, text_col: str, part_terms: int = automaton.PART_TERMS, sent_bytes: int = automaton.SENT_BYTES) -> tuple[DataFrame, Callable[[], automaton.Automaton]]:
    """(sid, tokens) of every sentence, and what gives tasks the automaton."""
    none = F.expr("cast(array() as array<string>)")
    toks = sentences.select(F.col(id_col).alias("sid"), F.coalesce(tokens(F.col(text_col)), none).alias("tokens"))
    terms = _listed(lexicon).withColumn("toks", tokens(F.col("term"))).where(F.size("toks") > 0).select("toks", _priority(F.col("entity")).cast("int").alias("prio"), "entity", "term")
    return toks, automaton.built(terms, part_terms, sent_bytes)


def _met(sentences: DataFrame, lexicon: DataFrame, id_col: str = "sid", text_col: str = "sentence", labelled: bool = False, **sizes) -> DataFrame:
    """(sid, tokens, spans) of every sentence, or (sid, tokens, labels)."""
    toks, given = _prepared(sentences, lexicon, id_col, text_col, **sizes)

    def run(batches):
        for b in batches:
            found = automaton.spans(b.column(1), given())
            yield pa.RecordBatch.from_arrays([*b.columns, automaton.labels(b.column(1), found) if labelled else found], names=["sid", "tokens", name])

    name, kind = ("labels", "array<string>") if labelled else ("spans", _SPANS)
    return toks.mapInArrow(run, T.StructType([*toks.schema.fields, T.StructField(name, T._parse_datatype_string(kind))]))


def matched(sentences: DataFrame, lexicon: DataFrame, id_col: str = "sid", text_col: str = "sentence", **sizes) -> DataFrame:
    """(sid, tokens, spans) of every sentence; spans: array<struct<st, en, entity, term>>."""
    return _met(sentences, lexicon, id_col, text_col, **sizes)


def joined(sentences: DataFrame, lexicon: DataFrame, id_col: str = "sid", text_col: str = "sentence") -> DataFrame:
    """What matched() gives, in joins on the first one to three tokens; for tables that no Python worker may touch. Sentences are shuffled by id, so ids must be distinct."""
    toks = sentences.select(F.col(id_col).alias("sid"), tokens(F.col(text_col)).alias("tokens"))
    spans = resolved(candidates(sentences, lexicon, id_col, text_col))
    return toks.join(spans, "sid", "left").select("sid", "tokens", F.coalesce("spans", F.expr(f"cast(array() as {_SPANS})")).alias("spans"))


def mentions(sentences: DataFrame, lexicon: DataFrame, id_col: str = "sid", text_col: str = "sentence", **sizes) -> DataFrame:
    """(sid, st, en, entity, term)."""
    return matched(sentences, lexicon, id_col, text_col, **sizes).select("sid", F.inline("spans"))


def counts(sentences: DataFrame, lexicon: DataFrame, by: str, text_col: str = "sentence", **sizes) -> DataFrame:
    """(by, entity, term, n): mentions in the sentences of each value of a column, added up within a batch; a group may have many rows."""
    toks, given = _prepared(sentences, lexicon, by, text_col, **sizes)

    def run(batches):
        for b in batches:
            found = automaton.spans(b.column(1), given())
            _, _, entity, term = found.flatten().flatten()
            t = pa.table([b.column(0).take(pc.list_parent_indices(found)), entity, term], names=["by", "entity", "term"])
            yield from t.group_by(["by", "entity", "term"], use_threads=False).aggregate([([], "count_all")]).select(["by", "entity", "term", "count_all"]).rename_columns(names).to_batches()

    names = [by, "entity", "term", "n"]
    return toks.mapInArrow(run, T.StructType([T.StructField(by, toks.schema["sid"].dataType), *T._parse_datatype_string("entity string, term string, n long").fields]))


def bio(sentences: DataFrame, lexicon: DataFrame, id_col: str = "sid", text_col: str = "sentence", **sizes) -> DataFrame:
    """(sid, tokens, labels): B- on a mention's first token, I- on its others, O elsewhere."""
    return _met(sentences, lexicon, id_col, text_col, **sizes, labelled=True)


def decode_bio(labelled: DataFrame) -> DataFrame:
    """(sid, st, en, entity) of the mentions that (sid, tokens, labels) encode; an I- without its B- begins one. A batch of rows at once; null labels are outside."""
    rows = labelled.select("sid", "labels")

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays(automaton.decoded(b.column(0), b.column(1)), names=["sid", "st", "en", "entity"])

    return rows.mapInArrow(run, T.StructType([rows.schema["sid"], *T._parse_datatype_string("st int, en int, entity string").fields]))


def span_scores(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """(entity, tp, fp, fn) of exact spans; an addition of ours."""
    key = ["sid", "st", "en", "entity"]
    both = truth.select(*key).distinct().withColumn("t", F.lit(1)).join(predicted.select(*key).distinct().withColumn("p", F.lit(1)), key, "full")
    return both.groupBy("entity").agg(F.count(F.when(F.expr("t = 1 and p = 1"), 1)).alias("tp"), F.count(F.when(F.expr("t is null"), 1)).alias("fp"), F.count(F.when(F.expr("p is null"), 1)).alias("fn"))


def token_windows(labelled: DataFrame, size: int = 128, stride: int = 96) -> DataFrame:
    """(sid, window, tokens, labels): overlapping windows for a model's input; an addition of ours."""
    begins = F.sequence(F.lit(0), F.greatest(F.size("tokens") - 1, F.lit(0)), F.lit(stride))
    rows = labelled.withColumn("__b", F.explode(begins)).where((F.col("__b") == 0) | (F.col("__b") + size - stride < F.size("tokens")))
    return rows.select("sid", (F.col("__b") / stride).cast("int").alias("window"), F.slice("tokens", F.col("__b") + 1, F.lit(size)).alias("tokens"), F.slice("labels", F.col("__b") + 1, F.lit(size)).alias("labels"))
