"""Quality rules: learned decision lists, in DataFrame operations only.

Text statistics are column expressions. A decision list is learned by sequential covering: a rule
is a conjunction of thresholds on statistics, grown on two thirds of the labelled rows by FOIL gain,
pruned on the other third, kept if it is precise there; rows it covers are set aside and the next rule
is grown. Each step asks Spark for the counts by (statistic, bin, label), a few hundred rows whatever
the input is. The list becomes one conditional expression, tested in order.

The list is fitted on at most `most_labelled` labelled rows, chosen by a hash of the id; their ids are what is
broadcast. A document labelled more than once counts by its least quality. Without labels of both classes
the list is empty and rejects nothing.

Cases. Null text has no words and so fails the base rule. A null id is never a labelled row. Rows are
independent: repeated rows give repeated results. Empty tables give empty results. Other columns pass
unread; the statistics stand in one struct column, and columns of the results' names (__q, __base_failed, __kept) are replaced.
A list has at most MOST_RULES rules of at most MOST_CONDITIONS conditions.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import SPACES, fresh, stored

_SYMBOLS = "#*$%&|<>"
_GAP = r"[\x20\x09-\x0D]+"
MOST_LABELLED = 20_000
BINS, MOST_RULES, MOST_CONDITIONS, LEAST_PRECISION, LEAST_COVER = 24, 16, 4, 0.8, 4


def _gone(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def with_statistics(docs: DataFrame, text_col: str = "text", out: str = "__q") -> DataFrame:
    """docs with a struct column of text statistics."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    bare = F.btrim(text, F.lit(SPACES))
    w_, lines_, g_ = (fresh(x, docs) for x in ("words", "lines", "triples"))
    docs = docs.drop(out)
    df = docs.withColumn(w_, F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, _GAP, -1)))
    df = df.withColumn(lines_, F.filter(F.split(text, "\n", -1), lambda x: F.length(_gone(x, SPACES)) > 0))
    last = F.size(w_) - 3
    grams = F.when(last < 0, F.array().cast("array<struct<h:bigint,i:int>>")).otherwise(F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(F.xxhash64(F.get(w_, i), F.get(w_, i + 1), F.get(w_, i + 2)).alias("h"), i.alias("i"))))
    df = df.withColumn(g_, F.sort_array(grams))
    at = F.sort_array(F.filter(g_, lambda x, i: (F.get(g_, i - 1)["h"] == x["h"]) | (F.get(g_, i + 1)["h"] == x["h"]))["i"])
    none = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate(at, none, lambda a, i: F.struct((i + 3).alias("end"), (a["n"] + i + 3 - F.greatest(i, a["end"])).cast("long").alias("n")))["n"]
    letters = "abcdefghijklmnopqrstuvwxyz"
    size = lambda c: F.size(c).cast("long")
    without = lambda chars: (F.length(text) - F.length(_gone(text, chars))).cast("long")
    made = {
        "n_words": size(w_),
        "word_chars": F.length(_gone(text, SPACES)).cast("long"),
        "n_symbols": without(_SYMBOLS),
        "n_dup_lines": (F.size(lines_) - F.size(F.array_distinct(lines_))).cast("long"),
        "n_repeat_words": covered,
        "n_lines": size(lines_),
        "n_upper": without(letters.upper()),
        "n_digits": without("0123456789"),
        "n_distinct": size(F.array_distinct(w_)),
        "n_marks": without(".,;:!?"),
    }
    # a generator of one row: no filter on a statistic is pushed below it, where it would be worked out again for each use
    return df.withColumn(out, F.explode(F.array(F.struct(*(c.alias(k) for k, c in made.items()))))).drop(w_, lines_, g_)


def features(q: str = "__q") -> dict[str, Column]:
    """What the rules may test; ratios, so that they mean the same for short and long texts."""
    c = lambda k: F.col(f"{q}.{k}").cast("double")
    over = lambda a, b: c(a) / F.greatest(c(b), F.lit(1.0))
    return {
        "words": c("n_words"), "mean_word_chars": over("word_chars", "n_words"), "symbols_per_word": over("n_symbols", "n_words"), "dup_line_share": over("n_dup_lines", "n_lines"), "repeat_word_share": over("n_repeat_words", "n_words"),
        "words_per_line": over("n_words", "n_lines"), "upper_share": over("n_upper", "word_chars"), "digit_share": over("n_digits", "word_chars"), "distinct_share": over("n_distinct", "n_words"), "marks_per_word": over("n_marks", "n_words"),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self, of: dict[str, Column]) -> Column:
        return of[self.feature] > self.threshold if self.above else of[self.feature] <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:g}"


@dataclass
class DecisionList:
    """Ordered rules (conditions, precision on the pruning rows); the first that holds rejects the document."""

    rules: list[tuple[list[Condition], float]] = field(default_factory=list)

    def rejects(self, of: dict[str, Column]) -> Column:
        out = F.lit(False)
        for conditions, _ in reversed(self.rules):
            both = conditions[0].column(of)
            for c in conditions[1:]:
                both = both & c.column(of)
            out = F.when(both, F.lit(True)).otherwise(out)
        return out

    def __str__(self) -> str:
        return "\n".join(f"reject if {' and '.join(map(str, c))}  ({p:.3f})" for c, p in self.rules)


def labelled(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most_labelled: int = MOST_LABELLED) -> DataFrame:
    """(__id, text, __y) of at most most_labelled labelled ids, one row of each (the one whose text has the largest hash); __y 1: reject."""
    one = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("__id")).agg((F.min(label_col) == 0).cast("int").alias("__y"))
    chosen = one.orderBy(F.xxhash64("__id"), "__id").limit(most_labelled)  # most_labelled rows of two numbers bound the broadcast
    rows = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias(text_col)).join(F.broadcast(chosen), "__id")
    return rows.groupBy("__id").agg(F.max_by(F.struct(text_col, "__y"), F.xxhash64(text_col)).alias("r")).select("__id", "r.*")


def learn(rows: DataFrame) -> DecisionList:
    """rows: statistics in __q, label in __y."""
    of = features()
    names = list(of)
    rows = stored(rows.select(*(c.alias(k) for k, c in of.items()), F.col("__y"), (F.pmod(F.xxhash64("__id", F.lit(9)), F.lit(3)) == 0).alias("__prune")))
    cuts = rows.agg(*(F.percentile(k, F.array(*[F.lit(i / BINS) for i in range(1, BINS)])).alias(k) for k in names)).first()
    if cuts[names[0]] is None:
        return DecisionList()
    edges = {k: sorted(set(cuts[k])) for k in names}
    bin_of = lambda k: F.size(F.filter(F.array(*map(F.lit, edges[k])), lambda e: e < F.col(k)))  # noqa: E731  edges[b - 1] < value <= edges[b]
    binned = stored(rows.select("__y", "__prune", F.array(*map(bin_of, names)).alias("b")))
    test = lambda c: (F.get("b", F.lit(names.index(c.feature))) > edges[c.feature].index(c.threshold)) if c.above else (F.get("b", F.lit(names.index(c.feature))) <= edges[c.feature].index(c.threshold))
    left, out = F.lit(True), DecisionList()

    def holds(conditions):
        both = F.lit(True)
        for c in conditions:
            both = both & test(c)
        return both

    while len(out.rules) < MOST_RULES:
        rule: list[Condition] = []
        p0 = n0 = None
        while len(rule) < MOST_CONDITIONS:
            counts = binned.where(left & ~F.col("__prune") & holds(rule)).select("__y", F.posexplode("b").alias("f", "b")).groupBy("f", "b", "__y").count().collect()
            by = {k: [[0, 0] for _ in range(len(edges[k]) + 1)] for k in names}
            for r in counts:
                by[names[r["f"]]][r["b"]][r["__y"]] += r["count"]
            n0, p0 = (sum(x[y] for x in by[names[0]]) for y in (0, 1))
            if not p0 or not n0:
                break
            best = (0.0, None)
            for k in names:
                n = p = 0
                for e, (nb, pb) in zip(edges[k], by[k]):
                    n, p = n + nb, p + pb
                    for above, (pc, nc) in ((False, (p, n)), (True, (p0 - p, n0 - n))):
                        if pc >= LEAST_COVER:
                            gain = pc * (math.log2(pc / (pc + nc)) - math.log2(p0 / (p0 + n0)))
                            best = max(best, (gain, Condition(k, above, e)), key=lambda x: x[0])
            if best[1] is None or best[0] < 1e-6 or best[1] in rule:
                break
            rule.append(best[1])
        if not rule:
            break
        tried = [rule[: i + 1] for i in range(len(rule))]
        sums = [F.sum((holds(t) & (F.col("__y") == y)).cast("long")).alias(f"s{i}_{y}") for i, t in enumerate(tried) for y in (0, 1)]
        r = binned.where(left & F.col("__prune")).agg(*sums).first()
        worth = [((r[f"s{i}_1"] or 0), (r[f"s{i}_0"] or 0)) for i in range(len(tried))]
        i = max(range(len(tried)), key=lambda i: ((worth[i][0] - worth[i][1]) / max(1, sum(worth[i])), -i))
        p, n = worth[i]
        if p + n == 0 or p / (p + n) < LEAST_PRECISION:
            break
        out.rules.append((tried[i], p / (p + n)))
        left = left & ~holds(tried[i])
    return out


def judged(docs: DataFrame, rules: DecisionList, text_col: str = "text") -> DataFrame:
    """docs with __q (statistics), __base_failed and __kept."""
    df = with_statistics(docs, text_col)
    n, repeated = F.col("__q.n_words"), F.col("__q.n_repeat_words")
    base = (n < 50) | (100 * repeated > 50 * n)
    return df.withColumn("__base_failed", base).withColumn("__kept", ~F.col("__base_failed") & ~rules.rejects(features()))


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.select("doc_id", "text")
    rules = learn(with_statistics(labelled(docs, labels)))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judged(docs, rules).select("doc_id", *(F.col(f"__q.{k}").alias(k) for k in names), F.col("__base_failed").alias("base_failed"), F.col("__kept").alias("kept"))
