"""Source divergence audit: how far the sources of a language stand apart in their words, term by term and exactly.

Every number is an integer. A group is a (language, source); a kept term is one that stands in at least `least_docs` documents of the
language. A group or language gives a kept term p = 1 + floor(10^9 (count + 2) / (N + 2 V)); two of them differ at a term
by f = floor((p - q)^2 / (p + q)). The floor stands inside the sum over terms, so no product of matrices gives it.

The sum over a pair's terms is split by how many groups hold a term. With p0 what a group gives a term that it lacks, a term that neither
group holds adds f(p0, q0); so the sum is V f(p0, q0) plus corrections of terms that one of the two holds. Heavy
terms (in more than an eighth of the language's groups, MOST_LIGHT at least) are laid out as dense tiles of groups by terms, where numpy works
out f for a group against all others at once. Light terms stay postings: each posting first counts as if the other group lacked
the term (postings with equal p are worked out once), and each pair of postings of one term then corrects that. Both partial sums are whole numbers and are added.

Terms are dealt by hash into tiles of about TILE terms and sources into blocks of about BLOCK, so a task holds two blocks of one tile, whatever
the corpus is; a language of up to BLOCK sources is one block. Term counts are combined in the tasks that read texts, so a frequent term or a
large source meets as a row a task.

Cases. Null text, language and source are empty. A group without terms counts as a group; a language without kept terms has pairs of value 0. A language of one source
has no pairs. Repeated rows are separate documents. Ties are ordered by the item's UTF-8 bytes. An empty table gives no rows. Other columns are not read. Numbers are exact
while N + 2 V stays under 9 * 10^15.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocks import coded, firsts, lowered, spans, strings
from .shared import steps, stored, texts

LEAST_DOCS, TOP = 10, 10
#: Bytes of text whose terms are counted at once; about so many terms in a tile, sources in a block.
STEP, TILE, BLOCK = 8 << 20, 2048, 192
#: A term in no more groups than this is never heavy.
MOST_LIGHT = 8
#: Letters A-Z, a-z and all characters beyond ASCII make terms.
_NO_TERM = np.array([not (65 <= b <= 90 or 97 <= b <= 122 or b >= 128) for b in range(256)])


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", step: int = STEP) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents, one row or more for each (lang, source, term), from each task."""

    def count(batches):
        for b in batches:
            column = texts(b.column(0))
            (lang, langs), (source, sources) = (coded(texts(b.column(i))) for i in (1, 2))
            group = lang.astype(np.int64) * max(len(sources), 1) + source
            for lo, hi, data, offsets in steps(column, step):
                data = lowered(data)
                starts, ends = spans(data, offsets, _NO_TERM)
                code, terms = coded(strings(data, _NO_TERM, starts, ends))
                order = np.argsort(group[lo:hi], kind="stable")  # documents of a group get neighbouring places
                place = np.empty(hi - lo, np.int64)
                place[order] = np.arange(hi - lo)
                key = code.astype(np.int64) * (hi - lo) + place[np.searchsorted(offsets, starts, "right") - 1]
                key.sort()
                one = firsts(key)  # of each term and document
                times, term, of = np.diff(np.r_[one, len(key)]), key[one] // (hi - lo), group[lo:hi][order][key[one] % (hi - lo)]
                at = firsts(term, of)
                if len(at):
                    n, n_docs = np.add.reduceat(times, at), np.diff(np.r_[at, len(term)])
                    of, term = of[at], term[at]
                    yield pa.RecordBatch.from_arrays([langs.take(pa.array(of // len(sources))), sources.take(pa.array(of % len(sources))), terms.take(pa.array(term)), pa.array(n), pa.array(n_docs)], names=["lang", "source", "term", "n", "docs"])

    columns = docs.select(F.col(text_col).cast("string"), F.col(lang_col).cast("string"), F.col(source_col).cast("string"))
    return columns.mapInArrow(count, "lang string, source string, term string, n long, docs long")


def postings(docs: DataFrame, least_docs: int = LEAST_DOCS, **columns) -> DataFrame:
    """(lang, term, source, n, groups, n_lang, lead) of kept terms: groups that hold the term, its count in the language, whether the row is the term's first."""
    whole = Window.partitionBy("lang", "term")
    counts = term_counts(docs, **columns).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    seen = counts.select("lang", "term", "source", "n", F.sum("docs").over(whole).alias("docs"), F.count("*").over(whole).alias("groups"), F.sum("n").over(whole).alias("n_lang"), (F.min("source").over(whole) == F.col("source")).alias("lead"))
    return seen.where(F.col("docs") >= least_docs).drop("docs")


def groups_of(docs: DataFrame, kept: DataFrame, lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, n_group, terms, n_all, sources) of every group: its count of kept terms, the language's kept terms, their count, its sources."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    every = docs.select(blank(lang_col).alias("lang"), blank(source_col).alias("source")).distinct()
    by_group = kept.groupBy("lang", "source").agg(F.sum("n").alias("n_group"))
    by_lang = kept.groupBy("lang").agg(F.sum(F.col("lead").cast("long")).alias("terms"), F.sum("n").alias("n_all"))
    some = every.join(by_group, ["lang", "source"], "left").join(by_lang, "lang", "left").na.fill(0, ["n_group", "terms", "n_all"])
    return some.join(every.groupBy("lang").agg(F.count("*").alias("sources")), "lang")


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (count + 2) / (total + 2 terms)), by long division in steps that stay within 64 bits."""
    below, rest, out = F.greatest(total + 2 * terms, F.lit(1)), count + 2, F.lit(0).cast("long")
    for _ in range(3):
        out, rest = (out + F.call_function("div", rest, below)) * 1000, (rest % below) * 1000
    return out + F.call_function("div", rest, below) + 1


def apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // (p + q)


def tile_sums(p: np.ndarray, q: np.ndarray, rows: tuple[np.ndarray, ...], same: bool) -> np.ndarray:
    """What a tile's terms add to V f(p, q) for each group of two blocks.

    p, q: what the groups of either block give a term that they lack. rows: (term, side, group in its block, p, heavy), sorted by term;
    same: both blocks are one, whose rows have side 0.
    """
    absent = _f(p[:, None], q[None, :])
    out = np.zeros_like(absent)
    term, side, at, value, heavy = rows
    left, right = side == 0, (side == 0) if same else (side == 1)
    codes = np.unique(term[heavy], return_inverse=True)[1]
    n = int(codes.max()) + 1 if len(codes) else 0
    if n:  # the dense tile
        dense = [np.repeat(base[:, None], n, 1) for base in (p, q)]
        for wide, own in zip(dense, (left, right)):
            wide[at[heavy & own], codes[own[heavy]]] = value[heavy & own]
        for i in range(len(p)):
            out[i] += _f(dense[0][i], dense[1]).sum(axis=1) - n * absent[i]
    for own, far, sums, none in ((~heavy & left, q, out, absent), (~heavy & right, p, out.T, absent.T)):  # light: as if the other group lacked the term
        each, times = np.unique(np.stack([at[own], value[own]]), axis=1, return_counts=True)
        for lo in range(0, each.shape[1], 4096):
            g, v = each[:, lo : lo + 4096]
            np.add.at(sums, g, times[lo : lo + 4096, None] * (_f(v[:, None], far[None, :]) - none[g]))
    light = np.flatnonzero(~heavy)
    far = 1
    while far < len(light):  # pairs of postings of one term
        i, j = light[:-far], light[far:]
        both = term[i] == term[j]
        if not both.any():
            break
        i, j = i[both], j[both]
        for a, b in ((i, j), (j, i)):
            ok = left[a] & right[b]
            g, h, v, w = at[a[ok]], at[b[ok]], value[a[ok]], value[b[ok]]
            np.add.at(out, (g, h), _f(v, w) - _f(v, q[h]) - _f(p[g], w) + absent[g, h])
        far += 1
    return out


def _tile(key, left: pa.Table, right: pa.Table) -> pa.Table:
    lang, lo, hi, _ = (k.as_py() for k in key)
    number = lambda t, c: np.asarray(t.column(c).combine_chunks())
    right = right.sort_by("source")
    block = number(right, "block")
    names = [right.column("source").combine_chunks().filter(pa.array(block == b)) for b in (lo, hi)]
    p0 = [number(right, "p0")[block == b] for b in (lo, hi)]
    side = (number(left, "block") != lo).astype(np.int64)
    place = [pc.fill_null(pc.index_in(left.column("source"), n), 0).combine_chunks() for n in names]
    at = np.where(side == 0, *(np.asarray(x) for x in place)).astype(np.int64)
    term = coded(left.column("term").combine_chunks())[0]
    order = np.argsort(term, kind="stable")
    heavy = left.column("heavy").combine_chunks().to_numpy(zero_copy_only=False).astype(bool)
    sums = tile_sums(*p0, tuple(x[order] for x in (term, side, at, number(left, "p"), heavy)), lo == hi)
    sums += int(right.column("base")[0].as_py()) * _f(p0[0][:, None], p0[1][None, :])
    g, h = np.indices(sums.shape).reshape(2, -1)
    if lo == hi:
        g, h = g[(x := g != h)], h[x]
    one, two, value = names[0].take(pa.array(g)), names[1].take(pa.array(h)), sums[g, h]
    if lo != hi:
        one, two, value = pa.concat_arrays([one, two]), pa.concat_arrays([two, one]), np.r_[value, value]
    return pa.table({"lang": pa.array([lang] * len(value), pa.string()), "source": one, "item": two, "value": value})


def pair_sums(kept: DataFrame, groups: DataFrame, tile: int = TILE, block: int = BLOCK, most_light: int = MOST_LIGHT) -> DataFrame:
    """(lang, source, item, value): for each pair of a language's sources the sum of f over its kept terms."""
    up = lambda a, b: F.greatest(F.ceil(F.col(a) / b), F.lit(1)).cast("long")
    g = groups.withColumns({"blocks": up("sources", block), "tiles": up("terms", tile)}).withColumn("block", F.pmod(F.xxhash64("source"), "blocks"))
    both = {"lo": F.least("block", "x"), "hi": F.greatest("block", "x")}
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("x")
    rows = kept.join(g, ["lang", "source"]).select("lang", "source", "term", "block", other, F.pmod(F.xxhash64("term"), "tiles").alias("tile"), share(F.col("n"), F.col("n_group"), F.col("terms")).alias("p"), (F.col("groups") > F.greatest(F.lit(most_light), F.floor(F.col("sources") / 8))).alias("heavy"))
    absent = g.select("lang", "source", "block", "tiles", "terms", other, share(F.lit(0).cast("long"), F.col("n_group"), F.col("terms")).alias("p0"))
    absent = absent.withColumn("tile", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))).withColumn("base", F.when(F.col("tile") == 0, F.col("terms")).otherwise(0))
    key = ["lang", "lo", "hi", "tile"]
    rows, absent = (x.withColumns(both).select(*(F.col(c).alias(c) for c in (*key, *rest))) for x, rest in ((rows, ("term", "source", "block", "p", "heavy")), (absent, ("source", "block", "p0", "base"))))
    tiles = rows.groupBy(*key).cogroup(absent.groupBy(*key)).applyInArrow(_tile, "lang string, source string, item string, value long")
    return tiles.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def top_terms(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value): the kept terms that a group gives more than its language does."""
    p, q = share(F.col("n"), F.col("n_group"), F.col("terms")), share(F.col("n_lang"), F.col("n_all"), F.col("terms"))
    both = kept.join(groups, ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q"))
    return both.where("p > q").select("lang", "source", "item", apart(F.col("p"), F.col("q")).alias("value"))


def ranked(df: DataFrame) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, tile: int = TILE, block: int = BLOCK, most_light: int = MOST_LIGHT) -> DataFrame:
    """(lang, source, part, item, value, rank): all pairs of sources, and the first `top` terms of each group."""
    docs = docs.select("text", "lang", "source")
    kept = stored(postings(docs, least_docs))
    groups = stored(groups_of(docs, kept))
    terms = ranked(top_terms(kept, groups)).where(F.col("rank") <= top)
    parts = [(ranked(pair_sums(kept, groups, tile, block, most_light)), "pair"), (terms, "term")]
    pair, term = (df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank") for df, part in parts)
    return pair.unionByName(term)


def op11_source_divergence(spark, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_P = "(1 + (1000000000::hugeint * ({c} + 2)) // ({n} + 2 * v))::hugeint"
OP11_SQL = rf"""
with d as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as x from documents),
  t as (select r, lang, source, unnest(regexp_extract_all(x, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
  kept as (select lang, term, count(*) as c_lang from t group by all having count(distinct r) >= 10),
  langs as (select lang, sum(c_lang) as n_lang, count(*) as v from kept group by lang),
  counts as (select lang, source, term, count(*) as c from t group by all),
  g as (select distinct lang, source from d),
  cells as (select g.lang, g.source, kept.term, coalesce(c, 0) as c, c_lang from g join kept using (lang) left join counts using (lang, source, term)),
  sums as (select lang, source, sum(c) as n from cells group by all),
  p as (select lang, source, term, c, {_P.format(c="c", n="n")} as p, {_P.format(c="c_lang", n="n_lang")} as q from cells join sums using (lang, source) join langs using (lang)),
  same as (select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
  pairs as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0)::bigint as value from g a join g b on a.lang = b.lang and a.source <> b.source left join same on same.lang = a.lang and same.source = a.source and same.item = b.source),
  terms as (select lang, source, 'term' as part, term as item, (((p - q) * (p - q)) // (p + q))::bigint as value from p where c > 0 and p > q),
  ranks as (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from (from pairs union all from terms))
select lang, source, part, item, value, rank::int as rank from ranks where part = 'pair' or rank <= 10"""
