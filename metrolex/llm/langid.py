"""Language ID: bit-sliced Bloom filters over character n-grams.

One array of language bitmasks serves all languages: an n-gram's probes read masks whose AND has
a bit for each language that holds the n-gram. Summed over a text this gives a popcount for each
language; the share that chance alone would give (fill of the language's slice to the power of
probes) is taken out, and the largest share, relative to what the language's own texts reach, decides.

Fitting reads about `most_docs` documents of each language, those with the least hashes of id and text (so no language is
left out, however few or alike its documents are; rows alike in id and text count once); n-grams are counted over whole texts in Spark. An
n-gram belongs to a language if LEAST_SHARE of the documents read hold it, and to every such language: no language takes
an n-gram from another. What a language's own texts reach is drawn towards the average over languages where few documents tell it.
Prediction reads nothing but the text.

Cases. Text null or without a letter: `und`, score 0. Nothing learned: `und`. Ties: the language
first in alphabetical order. Rows are independent; empty tables give empty results; other columns pass
by unread.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import U, constants, mix, stored, texts, sliced

SIZES = (2, 3, 4)
MOST_DOCS = 4000
#: An n-gram belongs to a language if this share of its documents hold it.
LEAST_SHARE = 0.02
#: Documents as which the average over languages counts in what a language's texts reach.
DRAWN = 8
PROBES = 3
MOST_CELLS = 1 << 22
PIECE = 1 << 18
_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def _codes(text: str) -> np.ndarray:
    """Lower-cased letters; each run of other characters is one blank, also at both ends."""
    raw = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _is_letter()[raw]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first of a run of others stands for the run
    out = np.where(letter, raw, 32)[keep]
    if not len(out):
        return out
    return np.concatenate([[np.uint32(32)], out] + ([[np.uint32(32)]] if out[-1] != 32 else [])).astype(np.uint32)


def ngrams(codes: np.ndarray) -> np.ndarray:
    """Hashes of all n-grams of SIZES."""
    wide, out = codes.astype(U), []
    with np.errstate(over="ignore"):
        for n in SIZES:
            if len(wide) >= n:
                c = constants(97 + n, n)
                h = np.full(len(wide) - n + 1, U(n))
                for j in range(n):
                    h += wide[j : len(wide) - n + 1 + j] * c[j]
                out.append(mix(h))
    return np.concatenate(out) if out else np.zeros(0, U)


def _pieces(codes: np.ndarray):
    """Pieces of a long text; n-grams across a cut are in the earlier piece."""
    for i in range(0, max(len(codes) - 1, 1), PIECE):
        yield codes[i : i + PIECE + max(SIZES) - 1]


def _cells(h: np.ndarray, cells: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        step = (h >> U(32)) | U(1)
        return np.stack([((h + step * U(i)) & U(cells - 1)).astype(np.int64) for i in range(PROBES)])


@dataclass
class LanguageFilters:
    """masks: (planes, cells), 8 languages a plane. typical: the corrected share that a language's own texts reach."""

    langs: list[str]
    masks: np.ndarray
    typical: np.ndarray

    def shares(self, codes: np.ndarray) -> np.ndarray:
        """Popcount of each language over the n-grams, corrected for false positives, as a share."""
        n, hits = 0, np.zeros(len(self.langs))
        for piece in _pieces(codes):
            h = ngrams(piece)
            n += len(h)
            at = _cells(h, self.masks.shape[1])
            for p, plane in enumerate(self.masks):
                found = plane[at[0]]
                for i in at[1:]:
                    found = found & plane[i]
                counts = np.bincount(found, minlength=256)
                for bit in range(min(8, len(self.langs) - 8 * p)):
                    hits[8 * p + bit] += counts[_BITS[bit]].sum()
        if not n:
            return hits
        return np.clip((hits / n - self.chance) / (1 - self.chance), 0, 1)

    def __post_init__(self):
        fill = np.array([(self.masks[i // 8] >> (i % 8) & 1).mean() for i in range(len(self.langs))])
        self.chance = np.minimum(fill**PROBES, 0.999)

    def predict(self, text: str) -> tuple[str, float]:
        codes = _codes(text)
        if not self.langs or not len(codes):
            return "und", 0.0
        share = self.shares(codes)
        best = int(np.argmax(share / self.typical))
        return self.langs[best], float(min(1.0, share[best] / self.typical[best]))


_BITS = [np.flatnonzero(np.arange(256) >> b & 1) for b in range(8)]


def _sample(rows: DataFrame, most_docs: int) -> DataFrame:
    """About most_docs rows of each language, at least one: those with the least hashes. rows: (id, text, lang)."""
    key = F.xxhash64("id", "text")
    u = F.pmod(F.xxhash64(key, F.lit(3)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    keyed = rows.withColumn("key", key).withColumn("u", u)
    n = {r["lang"]: r["n"] for r in keyed.groupBy("lang", "key").agg(F.lit(1).alias("one")).groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not n:
        return rows
    widest = {k: min(1.0, 4 * most_docs / m) for k, m in n.items()}
    of = lambda d: F.element_at(F.create_map(*[F.lit(x) for k, v in sorted(d.items()) for x in (k, float(v))]), F.col("lang"))
    near = keyed.where(F.col("u") <= of(widest)).withColumn("bucket", F.least(F.floor(F.col("u") / of(widest) * 64), F.lit(63)))
    limit: dict[str, int] = {}
    total: dict[str, int] = {}
    for r in near.select("lang", "key", "bucket").distinct().groupBy("lang", "bucket").count().orderBy("lang", "bucket").collect():
        if total.get(r["lang"], 0) < most_docs:
            limit[r["lang"]], total[r["lang"]] = r["bucket"], total.get(r["lang"], 0) + r["count"]
    return near.where(F.col("bucket") <= of(limit)).groupBy("lang", "key").agg(F.first("text").alias("text")).select("text", "lang")


def fit(docs: DataFrame, id_col: str | None = "doc_id", text_col: str = "text", lang_col: str = "lang", most_docs: int = MOST_DOCS) -> LanguageFilters:
    """Learns from the rows whose text and language are not null. Without an id, equal texts of a language count once."""
    own = F.col(id_col).cast("string") if id_col is not None and id_col in docs.columns else F.lit(None).cast("string")
    rows = docs.select(own.alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null")
    sample = stored(_sample(rows, most_docs).select("text", "lang"))
    total = {r["lang"]: r["n"] for r in sample.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(total)
    if not langs:
        return LanguageFilters([], np.zeros((1, 16), np.uint8), np.ones(0))
    index = {k: i for i, k in enumerate(langs)}

    def count(batches):
        for b in sliced(batches):
            own: dict[int, list[np.ndarray]] = {}
            for t, k in zip(texts(b.column(0)), b.column(1)):
                i = index[k.as_py()]
                codes = _codes(t.as_py())
                own.setdefault(i, []).append(np.unique(np.concatenate([np.unique(ngrams(p)) for p in _pieces(codes)]) if len(codes) else np.zeros(0, U)))
            for i, found in own.items():
                h, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), i, np.int32)), pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "h", "n"])

    seen = sample.mapInArrow(count, "lang int, h long, n long").groupBy("lang", "h").agg(F.sum("n").alias("n"))
    least = F.element_at(F.array(*[F.lit(LEAST_SHARE * total[k]) for k in langs]), F.col("lang") + 1)
    held = stored(seen.where(F.col("n") >= least).select("h", "lang"))
    cells, n = 1 << 12, held.select("h").distinct().count()
    while cells < min(24 * n, MOST_CELLS):
        cells *= 2

    def place(batches):
        for b in batches:
            lang = np.asarray(b.column(1)).astype(np.int64)
            at = _cells(np.asarray(b.column(0)).view(U), cells)
            for row in at:
                yield pa.RecordBatch.from_arrays([pa.array(lang // 8), pa.array(row), pa.array(np.left_shift(1, lang % 8))], names=["plane", "cell", "mask"])

    got = held.mapInArrow(place, "plane long, cell long, mask long").groupBy("plane", "cell").agg(F.bit_or("mask").alias("mask")).toArrow()
    masks = np.zeros(((len(langs) + 7) // 8, cells), np.uint8)
    if got.num_rows:
        masks[np.asarray(got.column("plane")), np.asarray(got.column("cell"))] = np.asarray(got.column("mask")).astype(np.uint8)
    made = LanguageFilters(langs, masks, np.ones(len(langs)))

    def own_share(batches):
        for b in sliced(batches):
            k = [index[x.as_py()] for x in b.column(1)]
            s = [float(made.shares(_codes(t.as_py()))[i]) for i, t in zip(k, texts(b.column(0)))]
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(s, pa.float64())], names=["lang", "share"])

    reached = {r["lang"]: r["share"] for r in sample.mapInArrow(own_share, "lang int, share double").groupBy("lang").agg(F.avg("share").alias("share")).collect()}
    mean = sum(reached[i] * total[k] for i, k in enumerate(langs)) / sum(total.values())
    made.typical[:] = [max((reached[i] * total[k] + mean * DRAWN) / (total[k] + DRAWN), 0.01) for i, k in enumerate(langs)]
    return made


def predict(docs: DataFrame, model: LanguageFilters, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score for every row; the model (a few megabytes, MOST_CELLS at most) goes to every task."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in sliced(batches):
            got = [sent.value.predict(t.as_py()) for t in texts(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64())], names=["id", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 4 == 2


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return predict(docs, fit(docs.where(~held_out()))).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
