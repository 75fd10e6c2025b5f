"""Quality classifier: co-training of a text view and a metadata view.

Text view: words of the text, their first bytes (PREFIXES) and binned word statistics. Metadata view: language, source and length as
the table's columns give them, and the page's layout (characters a word, shares of symbols, digits, capitals and marks, lines); it
knows no word. Each view is a logistic regression, calibrated on labelled rows it was not fitted on. In each round each view names, for
either class, the rows of an unlabelled pool that it is surest of; they join the other view's training rows with that class, weighted by how sure the
calibrated view is. At the end a third regression on the two calibrated log-odds gives the score of every document; it starts from
their sum (two independent witnesses) and leaves it as far as the held-out rows ask for, so neither view is switched off for want of
evidence. A text-view classifier for the toxic label, if there is one, is fitted beside it.

Fitting reads at most `most_labelled` labelled ids and `most_pool` others, those with the least hashes, and one row of each (the one whose text has the
largest hash), so what reaches the driver is bounded and does not depend on partitions; words are chosen by chi-square over those rows
in Spark. Scoring reads every whole text.

Cases. Null or empty text: statistics of no words. Null language or source: a value of its own; unseen values
weigh nothing. A document labelled more than once counts by its least quality and largest toxicity; null labels and ids
are not learned from. Without labels of both classes a score is the share of good labels (1 if none). Rows are independent;
repeated rows get equal scores. Empty tables give empty results. Other columns pass unread; a column that has a result's name
(`score` takes the names) is replaced.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import _IS_SPACE, U, fresh, grams, sliced, steps, texts, words

MOST_LABELLED, MOST_POOL, MOST_WORDS = 6000, 6000, 3000
ROUNDS, BINS = 3, 20
#: The share of the pool that a view may label in one round.
SHARE = 0.15
#: What a pseudo-label of full certainty weighs beside a label.
WEIGHT = 0.4
PREFIXES = (4, 5)
#: Places of the text view's statistics (words; shares of distinct words, of distinct word triples, of the commonest word) and of the layout.
WORDING, LAYOUT = (0, 6, 7, 8), (1, 2, 3, 4, 5, 9, 10)
#: Pairs of the text view's statistics that are also binned together: the number of words with each share.
CROSSED = ((0, 1), (0, 2), (0, 3))
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[:128] = [ord(c.lower()) if (c := chr(i)).isalpha() else 32 for i in range(128)]
_CLASS = np.zeros((5, 256), np.int64)  # symbols, digits, capitals, marks, line ends
for _i, _chars in enumerate(("#*$%&|<>~^=+@\\/_", "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ".,;:!?", "\n")):
    _CLASS[_i, [ord(c) for c in _chars]] = 1


def text_view(column: pa.Array):
    """(statistics, sorted distinct hashes of words and word beginnings) of each text."""
    for lo, hi, data, offsets in steps(column):
        starts, ends, raw = words(data, offsets[:-1], lower=True)
        letters = _PLAIN[data]
        plain = [words(letters, offsets[:-1], clip=c) for c in (None, *PREFIXES)]
        at, plain_at = np.searchsorted(starts, offsets), np.searchsorted(plain[0][0], offsets)
        counts = np.zeros((6, len(data) + 1), np.int64)
        for i in range(5):
            np.cumsum(_CLASS[i][data], out=counts[i, 1:])
        np.cumsum(~_IS_SPACE[data], out=counts[5, 1:])
        for i in range(hi - lo):
            own, s, e = raw[at[i] : at[i + 1]], offsets[i], offsets[i + 1]
            n, k = len(own), counts[:, e] - counts[:, s]
            g = grams(own, 3)
            solid, most = max(1, int(k[5])), 0.0
            if n:
                distinct, times = np.unique(own, return_counts=True)
                most = times.max() / n
            stats = [np.log1p(n), solid / max(1, n), k[0] / max(1, n), k[1] / solid, k[2] / solid, k[3] / max(1, n), len(distinct) / n if n else 0.0, len(np.unique(g)) / max(1, len(g)), most, np.log1p(k[4]), n / (k[4] + 1)]
            yield stats, np.unique(np.concatenate([h[plain_at[i] : plain_at[i + 1]] for _, _, h in plain]))


@dataclass
class Logistic:
    """Over binary features, given as index arrays."""

    weights: np.ndarray
    bias: float
    scale: float = 1.0
    shift: float = 0.0

    def odds(self, rows: list[np.ndarray]) -> np.ndarray:
        raw = np.array([self.weights[r].sum() for r in rows]) + self.bias
        return self.scale * raw + self.shift

    @classmethod
    def fit(cls, rows: list[np.ndarray], y: np.ndarray, sample_weight: np.ndarray, n: int, rate: float = 0.15, passes: int = 160, decay: float = 2e-4, start: Logistic | None = None) -> Logistic:
        """Full-batch Adam from zero, or from an earlier fit: the same rows always give the same weights."""
        flat = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)
        of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        w, b, m, v = np.zeros(n) if start is None else start.weights, 0.0 if start is None else start.bias, np.zeros(n + 1), np.zeros(n + 1)
        total = max(sample_weight.sum(), 1e-9)
        for t in range(1, passes + 1):
            z = np.bincount(of, w[flat], len(rows)) + b
            g = sample_weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / total
            grad = np.append(np.bincount(flat, g[of], n) + decay * w, g.sum())
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
            step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
            w, b = w - step[:-1], b - step[-1]
        return cls(w, float(b))

    def calibrated(self, rows: list[np.ndarray], y: np.ndarray) -> Logistic:
        """Platt scaling on rows that were not fitted on."""
        a, c = _line(np.stack([Logistic(self.weights, self.bias).odds(rows)], 1), y)
        return Logistic(self.weights, self.bias, float(a[0]), c)


def _line(x: np.ndarray, y: np.ndarray, toward: tuple[float, float] | None = None) -> tuple[np.ndarray, float]:
    """Logistic regression on a few numbers by Newton's method; slopes are not negative. toward: slope and bias that it is drawn to, each as if known to within 1/2."""
    if len(y) == 0 or y.min() == y.max():
        return np.ones(x.shape[1]) / x.shape[1], 0.0
    centre, pull = (np.zeros(x.shape[1] + 1), 1e-3) if toward is None else (np.r_[np.full(x.shape[1], toward[0]), toward[1]], 4.0)
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    z = np.column_stack([np.clip(x, -30, 30), np.ones(len(x))])
    w = centre.copy()
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p) + 1e-6)[:, None]).T @ z + pull * np.eye(len(w))
        step = np.linalg.solve(h, z.T @ (p - target) + pull * (w - centre))
        w = w - np.clip(step, -2, 2)
    if (bad := np.flatnonzero(w[:-1] < 0)).size and x.shape[1] > 1:
        rest = np.delete(np.arange(x.shape[1]), bad)
        out = np.zeros(x.shape[1])
        if not len(rest):
            return out, float(np.log(target.mean() / (1 - target.mean())))
        out[rest], bias = _line(x[:, rest], y, toward)
        return out, bias
    return np.maximum(w[:-1], 0), float(w[-1])


@dataclass
class QualityModel:
    vocabulary: np.ndarray  # sorted hashes
    cuts: list[np.ndarray]  # of each statistic
    values: dict[str, int]  # of metadata
    text: Logistic | None = None
    meta: Logistic | None = None
    toxic: Logistic | None = None
    mix: tuple[np.ndarray, float] = field(default_factory=lambda: (np.ones(2), 0.0))
    exchanged: list[tuple[int, int]] = field(default_factory=list)  # in each round: labels from text to metadata, from metadata to text
    prior: float = 1.0
    bins: int = BINS

    def _bins(self, stats: list[float], which: tuple[int, ...]) -> list[int]:
        return [int(np.searchsorted(self.cuts[i], stats[i])) for i in which] if self.cuts else []

    def text_row(self, stats: list[float], own: np.ndarray) -> np.ndarray:
        base, side = len(self.vocabulary), self.bins + 1
        bins = self._bins(stats, WORDING)
        out = [base + i * side + b for i, b in enumerate(bins)]
        base_of_pairs = base + len(bins) * side
        out += [base_of_pairs + (k * side + bins[i]) * side + bins[j] for k, (i, j) in enumerate(CROSSED) if j < len(bins)]
        if base and len(own):
            at = np.minimum(np.searchsorted(self.vocabulary, own), base - 1)
            return np.concatenate([at[self.vocabulary[at] == own], out]).astype(np.int64)
        return np.array(out, np.int64)

    @property
    def text_size(self) -> int:
        return len(self.vocabulary) + len(WORDING) * (self.bins + 1) + len(CROSSED) * (self.bins + 1) ** 2

    def meta_row(self, keys: list[str], stats: list[float]) -> np.ndarray:
        side = self.bins + 1
        return np.array([*(self.values[k] for k in keys if k in self.values), *(len(self.values) + i * side + b for i, b in enumerate(self._bins(stats, LAYOUT)))], np.int64)

    @property
    def meta_size(self) -> int:
        return len(self.values) + len(LAYOUT) * (self.bins + 1)

    def scores(self, t: list[np.ndarray], m: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Probability of good quality and of toxic."""
        p = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        good = np.full(len(t), self.prior)
        if self.text is not None:
            both = np.column_stack([self.text.odds(t), self.meta.odds(m)])
            good = p(both @ self.mix[0] + self.mix[1])
        return good, p(self.toxic.odds(t)) if self.toxic is not None else np.zeros(len(t))


def metadata(docs: DataFrame, text_col: str = "text", categories: tuple[str, ...] = ("lang", "source"), length_col: str | None = "n_chars"):
    """Array of the metadata view's values of a row; columns that the table lacks are left out."""
    parts = [F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("\0"))) for c in categories if c in docs.columns]
    length = F.col(length_col).cast("double") if length_col in docs.columns else F.length(text_col).cast("double")
    return F.array(*parts, F.concat(F.lit("length="), F.floor(F.log2(F.greatest(F.coalesce(length, F.lit(0.0)), F.lit(1.0)))).cast("string")))


def _sampled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, most_labelled: int, most_pool: int, toxic_col: str | None) -> DataFrame:
    """(id, text, meta, y, t): one row of each chosen id; pool rows have null labels."""
    toxic = F.max(F.col(toxic_col)) if toxic_col in labels.columns else F.lit(None)
    one = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min("quality").cast("int").alias("y"), toxic.cast("int").alias("t")).where("y is not null")
    own = F.col(id_col).cast("long").alias("id")
    ids = docs.select(own).where("id is not null")
    near = F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1 << 30))
    unlabelled = ids.join(one, "id", "left_anti")
    n = unlabelled.agg(F.approx_count_distinct("id")).first()[0]
    few = unlabelled.where(near < int(min(1.0, 2 * most_pool / max(1, n)) * (1 << 30)))  # about twice as many as wanted, then the first of them by hash
    pool = few.distinct().orderBy(near, "id").limit(most_pool).select("id", F.lit(None).cast("int").alias("y"), F.lit(None).cast("int").alias("t"))
    chosen = one.join(ids, "id", "left_semi").orderBy(F.xxhash64("id"), "id").limit(most_labelled).unionByName(pool)  # at most most_labelled + most_pool rows of three numbers
    rows = docs.select(own, F.col(text_col).alias("text"), metadata(docs, text_col).alias("meta")).join(F.broadcast(chosen), "id")
    r = F.max_by(F.struct("text", "meta", "y", "t"), F.xxhash64("text")).alias("r")
    return rows.groupBy("id").agg(r).select("id", "r.*")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_labelled: int = MOST_LABELLED, most_pool: int = MOST_POOL, toxic_col: str | None = "toxic", rounds: int = ROUNDS) -> QualityModel:
    from .shared import stored

    def view(batches):
        for b in sliced(batches):
            stats, own = zip(*text_view(texts(b.column(1)))) if b.num_rows else ((), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([list(map(float, s)) for s in stats], pa.list_(pa.float64())), pa.array([o.view(np.int64) for o in own], pa.list_(pa.int64())), b.column(2), b.column(3), b.column(4)], names=["id", "stats", "words", "meta", "y", "t"])

    sample = _sampled(docs, labels, id_col, text_col, most_labelled, most_pool, toxic_col)
    rows = stored(sample.mapInArrow(view, "id long, stats array<double>, words array<long>, meta array<string>, y int, t int"))
    known = rows.where("y is not null")
    n, good, bad = known.agg(F.count("*"), F.sum("y"), F.sum("t")).first()
    model = QualityModel(np.zeros(0, U), [], {}, prior=(good or 0) / n if n else 1.0, bins=min(BINS, max(4, (n or 0) // 60)))  # few rows fill few bins
    if not n or not 0 < good < n:
        return model

    def chi(a, total):  # of a word's presence and a label, from the word's count and its count with the label
        e = F.col("df") * F.lit(float(total) / n)
        return (F.col(a) - e) * (F.col(a) - e) / (e * (1 - F.lit(float(total) / n)) * (1 - F.col("df") / n) + 1e-9)

    each = known.select(F.explode("words").alias("w"), "y", F.coalesce("t", F.lit(0)).alias("t")).groupBy("w").agg(F.count("*").cast("double").alias("df"), F.sum("y").alias("a"), F.sum("t").alias("b")).where("df >= 4")
    ranked = each.withColumn("chi", F.greatest(chi("a", good), chi("b", bad) if bad else F.lit(0.0))).orderBy(F.desc("chi"), "w").limit(MOST_WORDS)
    model.vocabulary = np.sort(np.array([r["w"] for r in ranked.select("w").collect()], np.int64).view(U))
    got = rows.select("id", "stats", "words", "meta", "y", "t").mapInArrow(_only(model.vocabulary), "id long, stats array<double>, words array<long>, meta array<string>, y int, t int").orderBy("id").toArrow()
    stats = np.array(got.column("stats").to_pylist(), float).reshape(got.num_rows, -1)
    y = np.array([-1 if v is None else v for v in got.column("y").to_pylist()])
    tox = np.array([0 if v is None else v for v in got.column("t").to_pylist()])
    is_known = y >= 0
    model.cuts = [np.unique(np.quantile(stats[is_known, i], np.arange(1, model.bins) / model.bins)) for i in range(stats.shape[1])]
    metas = got.column("meta").to_pylist()
    values, counts = np.unique([k for r in metas for k in r], return_counts=True)
    model.values = {str(k): i for i, k in enumerate(values[counts >= 3])}
    own = got.column("words").combine_chunks()
    flat, ends = np.asarray(own.values).view(U), np.asarray(own.offsets)
    t_rows = [model.text_row(s, flat[a:b]) for s, a, b in zip(stats, ends, ends[1:])]
    m_rows = [model.meta_row(k, s) for k, s in zip(metas, stats)]
    fold = np.arange(got.num_rows) % 10 < 3
    held, train, pool = np.flatnonzero(is_known & fold), np.flatnonzero(is_known & ~fold), np.flatnonzero(~is_known)
    take = lambda r, i: [r[j] for j in i]
    sizes, views, share = (model.text_size, model.meta_size), (t_rows, m_rows), y[train].mean()
    given: list[dict[int, tuple[int, float]]] = [{}, {}]  # pseudo-labels (class, weight) for the text view and for the metadata view

    def fitted(v: int, last: bool = False) -> Logistic:
        more = sorted(given[v])
        label = np.r_[y[train], [given[v][i][0] for i in more]].astype(float)
        weight = np.r_[np.ones(len(train)), [given[v][i][1] for i in more]]
        before = both[v] if both and not last else None
        return Logistic.fit(take(views[v], [*train, *more]), label, weight, sizes[v], passes=160 if before is None else 40, rate=0.15 if before is None else 0.05, start=before).calibrated(take(views[v], held), y[held])

    both: list[Logistic] = []
    both = [fitted(0), fitted(1)]
    for turn in range(rounds):
        for v in (0, 1):
            left = np.array([i for i in pool if i not in given[1 - v]], np.int64)
            p = 1 / (1 + np.exp(-np.clip(both[v].odds(take(views[v], left)), -30, 30)))
            for label, sure, part in ((1, p, share), (0, 1 - p, 1 - share)):  # as many of either class as the labels have
                most = math.ceil(SHARE * len(pool) * part)
                for j in np.argsort(-sure, kind="stable")[:most]:
                    if sure[j] > 0.5:
                        given[1 - v].setdefault(int(left[j]), (label, WEIGHT * (2 * float(sure[j]) - 1)))
        model.exchanged.append((len(given[1]), len(given[0])))
        both = [fitted(v, turn == rounds - 1) for v in (0, 1)]
    model.text, model.meta = both
    prior = math.log(y[held].mean() / (1 - y[held].mean())) if 0 < y[held].mean() < 1 else 0.0
    model.mix = _line(np.column_stack([b.odds(take(r, held)) for b, r in zip(both, views)]), y[held], toward=(1.0, -prior))
    if bad and bad < n:
        model.toxic = Logistic.fit(take(t_rows, train), tox[train].astype(float), np.ones(len(train)), sizes[0]).calibrated(take(t_rows, held), tox[held])
    return model


def _only(vocabulary: np.ndarray):
    """Keeps the words that are in the vocabulary."""

    def run(batches):
        for b in sliced(batches):
            own = []
            for x in b.column(2):
                w = x.values.to_numpy().view(U)
                at = np.minimum(np.searchsorted(vocabulary, w), max(len(vocabulary) - 1, 0))
                own.append(w[vocabulary[at] == w].view(np.int64) if len(vocabulary) else w[:0].view(np.int64))
            cols = [*b.columns]
            cols[2] = pa.array(own, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(cols, names=["id", "stats", "words", "meta", "y", "t"])

    return run


def score(docs: DataFrame, model: QualityModel, text_col: str = "text", quality: str = "quality_score", toxic: str = "toxic_score") -> DataFrame:
    """docs with the probabilities of good quality and of toxic in columns of the names given; the model's size is bounded by MOST_WORDS."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop(quality, toxic)
    meta = fresh("meta", docs)
    df = docs.withColumn(meta, metadata(docs, text_col))
    at = df.columns.index(text_col)

    def run(batches):
        m = sent.value
        for b in sliced(batches):
            seen = list(text_view(texts(b.column(at))))
            good, bad = m.scores([m.text_row(s, own) for s, own in seen], [m.meta_row(k, s) for k, (s, _) in zip(b.column(b.num_columns - 1).to_pylist(), seen)])
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(good, pa.float64()), pa.array(bad, pa.float64())], names=[*b.schema.names[:-1], quality, toxic])

    return df.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(quality, T.DoubleType()), T.StructField(toxic, T.DoubleType())]))


def accepted(least: float = 0.5, most_toxic: float = 0.5, quality: str = "quality_score", toxic: str = "toxic_score"):
    return (F.col(quality) >= least) & (F.col(toxic) < most_toxic)


def keep_good(docs: DataFrame, model: QualityModel, text_col: str = "text") -> DataFrame:
    """docs without the rows that the model rejects; all columns stay as they are."""
    names = fresh("quality", docs), fresh("toxic", docs)
    return score(docs, model, text_col, *names).where(accepted(quality=names[0], toxic=names[1])).select(*docs.columns)


def op4_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = score(docs, fit(docs, labels))
    return out.select("doc_id", F.round("quality_score", 6).alias("quality_score"), F.round("toxic_score", 6).alias("toxic_score"), accepted().alias("kept"))
