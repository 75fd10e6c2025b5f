"""Phrase collocation mining by hierarchical pair naming.

A frequent word gets a name, a whole number that no other word of any language has. Two neighbouring names that are
frequent together get a name of their own, which stands for two words; two neighbouring names of k - 1 words (they overlap in k - 2) make one of k
words. A phrase is frequent only if both its parts are, so each level counts pairs of names that the level before left. The pair that a
name stands for points to its parents, the phrase without its last and the one without its first word: following them gives the count of either
side of every cut, and a phrase is inside a longer candidate only if it is a parent of one.

Texts are read once, into blocks of one language: a dictionary of the block's words, and the text as codes into it. A level counts each block's
distinct pairs in the block, brings equal pairs of all blocks together, names the frequent ones (the least place among their
dictionary rows, so names need no counter) and sends each block the names of its own rows. So a frequent word is a row a block, not a row an occurrence,
and what crosses the network is dictionaries.

Cases. A null text is empty; a null language is `und`. Repeated rows are separate texts. Words hold any characters but blanks, tabs and the
marks that end a piece. No phrase crosses pieces or rows. Ties: the smallest cut, then score, count and phrase decide. A text without frequent words
and an empty table give no rows. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import coded, gaps, let_go, lowered, packed, spans, strings, unpacked
from .shared import discard, steps, stored, texts

LEAST, MOST_WORDS, TOP = 10, 3, 2000
#: Bytes of text in a block, words in one; a longer text is cut between pieces.
BLOCK, BLOCK_WORDS, STEP = 16 << 20, 3 << 20, 4 << 20
#: Parts of a language that are cut to the first `top` before they meet.
PARTS = 32
#: Bits of a place that hold the code.
_LOW = 31
_PIECE = gaps(".,;:!?\n\x0b\x0c\r")
_GAP = _PIECE | gaps(" \t")


def pieces(column: pa.Array, step: int = STEP):
    """(words, whether a word begins a piece) of runs of texts."""
    for _, _, data, offsets in steps(column, step):
        data = lowered(data)
        starts, ends = spans(data, offsets, _GAP)
        mark = np.cumsum(_PIECE[data], dtype=np.int32)[starts]
        begins = np.ones(len(starts), bool)
        begins[1:] = mark[1:] != mark[:-1]
        texts_at = np.searchsorted(starts, offsets[:-1])
        begins[texts_at[texts_at < len(starts)]] = True
        yield strings(data, _GAP, starts, ends), begins


def _parts(begins: np.ndarray, most: int):
    """Ranges of about `most` words, cut where a piece begins."""
    at, lo = np.flatnonzero(begins), 0
    while lo < len(begins):
        i = int(np.searchsorted(at, lo + most, "right")) - 1
        hi = at[i] if at[i] > lo else at[i + 1] if i + 1 < len(at) else len(begins)
        hi = len(begins) if len(begins) - lo <= most else int(hi)
        yield lo, hi
        lo = hi


def word_blocks(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", block: int = BLOCK, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(place, lang, word, n, codes): dictionary rows of each block, and a row with n = 0 and its text as codes, -1 before each piece.

    place: the block's number above the low 31 bits, the word's code in them.
    """

    def make(batches):
        held: dict[str, list] = {}
        size, number = 0, TaskContext.get().partitionId() << 12
        last = number + 4095

        def flush():
            nonlocal number
            for lang, parts in held.items():
                words, begins = pa.chunked_array([w for w, _ in parts]), np.concatenate([b for _, b in parts])
                for lo, hi in _parts(begins, block_words):
                    if number > last:
                        raise ValueError("too many blocks in one partition; read smaller partitions")
                    code, distinct = coded(words.slice(lo, hi - lo))
                    n, k = np.bincount(code, minlength=len(distinct)), len(distinct)
                    yield pa.RecordBatch.from_arrays([pa.array((number << _LOW) + np.arange(k)), pa.repeat(lang, k), distinct, pa.array(n), pa.nulls(k, pa.binary())], names=names)
                    codes = packed(np.insert(code.astype(np.int32), np.flatnonzero(begins[lo:hi]), -1))
                    yield pa.RecordBatch.from_arrays([pa.array([number << _LOW]), pa.array([lang]), pa.nulls(1, pa.large_string()), pa.array([0]), pa.array([codes], pa.binary())], names=names)
                    number += 1
            held.clear()
            let_go()

        for b in batches:
            column, lang, langs = texts(b.column(0)), *coded(b.column(1))
            for i, name in enumerate(langs.to_pylist()):
                for words, begins in pieces(column.filter(pa.array(lang == i))):
                    held.setdefault(name, []).append((words, begins))
                    size += sum(x.size for x in words.buffers() if x)
                    if size > 2 * block:  # words with their offsets
                        yield from flush()
                        size = 0
        yield from flush()

    names = ["place", "lang", "word", "n", "codes"]
    columns = docs.select(F.col(text_col).cast("string"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")))
    return columns.mapInArrow(make, "place long, lang string, word string, n long, codes binary")


def named(rows: DataFrame, *key: str, least: int = LEAST) -> DataFrame:
    """Dictionary rows of the frequent keys, with `total` and `id`, the least of the key's places."""
    whole = Window.partitionBy(*key)
    seen = rows.where("n > 0").select("place", *key, F.sum("n").over(whole).alias("total"), F.min("place").over(whole).alias("id"))
    return seen.where(F.col("total") >= least)


def phrases_of(names: DataFrame, *key: str) -> DataFrame:
    """(id, total, key) once for each name."""
    return names.where("place = id").select("id", "total", *key)


def _paired(key, left: pa.Table, right: pa.Table, last: bool) -> pa.Table:
    """A block's codes with the names of its frequent codes: its pairs of neighbouring names; last: no codes for a next level."""
    block, place = key[0].as_py() << _LOW, np.asarray(right.column("place").combine_chunks())
    code, ids = place & ((1 << _LOW) - 1), np.asarray(right.column("id").combine_chunks())
    rows: list[pa.Table] = [_NO_PAIRS]
    for text in left.column("codes").to_pylist():
        codes = unpacked(text)
        own = np.full(max(int(codes.max(initial=-1)) + 2, 1), -1, np.int32)
        own[code] = np.arange(len(code))  # the last place stays -1 and stands for code -1
        at = own[codes]
        both = np.flatnonzero((at[:-1] >= 0) & (at[1:] >= 0)).astype(np.int32)
        some = max(len(code), 1)
        pairs = at[both].astype(np.int64)
        pairs *= some
        pairs += at[both + 1]
        del at
        pair, code2, n = np.unique(pairs, return_inverse=True, return_counts=True)
        del pairs
        rows.append(pa.table({"place": block + np.arange(len(pair)), "left": ids[pair // some], "right": ids[pair % some], "n": n, "codes": pa.nulls(len(pair), pa.binary())}))
        if not last:
            codes2 = np.full(max(len(codes) - 1, 0), -1, np.int32)
            codes2[both] = code2
            del code2, both
            rows.append(pa.table({"place": [block], "left": [0], "right": [0], "n": [0], "codes": pa.array([packed(codes2)], pa.binary())}))
    let_go()
    return pa.concat_tables(rows)


_NO_PAIRS = pa.table({"place": pa.array([], pa.int64()), "left": pa.array([], pa.int64()), "right": pa.array([], pa.int64()), "n": pa.array([], pa.int64()), "codes": pa.array([], pa.binary())})


def pair_blocks(blocks: DataFrame, names: DataFrame, last: bool = False) -> DataFrame:
    """(place, left, right, n, codes): blocks of the next level."""
    block = F.shiftright("place", _LOW).alias("block")
    text = blocks.where("n = 0").select(block, "codes").groupBy("block")
    return text.cogroup(names.select(block, "place", "id").groupBy("block")).applyInArrow(lambda k, a, b: _paired(k, a, b, last), "place long, left long, right long, n long, codes binary")


def levels(docs: DataFrame, least: int = LEAST, most_words: int = MOST_WORDS, **sizes) -> tuple[DataFrame, list[DataFrame]]:
    """(lang, n) of all words, and for each number of words up to most_words (id, lang, words, total, heads, tails, left, right).

    heads, tails: counts of the first and of the last 1, 2, ... words.
    """
    none = F.array().cast("array<bigint>")
    blocks = stored(word_blocks(docs, **sizes))
    counts = stored(blocks.where("n > 0").groupBy("lang").agg(F.sum("n").alias("n")))
    names = stored(named(blocks, "lang", "word", least=least))
    at = F.lit(None).cast("long")
    out = [stored(phrases_of(names, "lang", "word").select("id", "lang", F.array("word").alias("words"), "total", none.alias("heads"), none.alias("tails"), at.alias("left"), at.alias("right")))]
    for k in range(2, most_words + 1):
        used = [blocks, names]
        blocks = pair_blocks(blocks, names, k == most_words)
        if k < most_words:
            blocks = stored(blocks)
            names = stored(named(blocks, "left", "right", least=least))
            new = phrases_of(names, "left", "right")
        else:
            new = blocks.groupBy("left", "right").agg(F.sum("n").alias("total")).where(F.col("total") >= least).withColumn("id", F.lit(None).cast("long"))
        a = out[-1].select(F.col("id").alias("left"), "lang", F.col("words").alias("w1"), F.array_append("heads", F.col("total")).alias("heads"))
        b = out[-1].select(F.col("id").alias("right"), F.element_at("words", -1).alias("w2"), F.array_append("tails", F.col("total")).alias("tails"))
        new = new.join(a, "left").join(b, "right")
        out.append(stored(new.select("id", "lang", F.array_append("w1", F.col("w2")).alias("words"), "total", "heads", "tails", "left", "right")))
        discard(*used)  # what is left stands in tables of its own
    return counts, out


def scored(level: DataFrame) -> DataFrame:
    """(id, lang, phrase, a, l, r, score) by the lowest-scoring cut, the first of equals."""
    whole = lambda c: c.cast("decimal(38,0)")

    def cut(k):
        l, r = F.element_at("heads", k), F.element_at("tails", -k)
        score = F.call_function("div", whole(F.lit(1_000_000)) * whole(F.col("total")) * whole(F.col("total")), whole(l) * whole(r))
        return F.struct(score.alias("score"), k.alias("k"), l.alias("l"), r.alias("r"))

    least = F.array_min(F.transform(F.sequence(F.lit(1), F.size("heads")), cut))
    return level.select("id", "lang", F.array_join("words", " ").alias("phrase"), F.col("total").alias("a"), least.alias("cut")).select("id", "lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def collocations(docs: DataFrame, least: int = LEAST, most_words: int = MOST_WORDS, inside: int = 50, top: int = TOP, **sizes) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's first `top` phrases of 2 to most_words words.

    inside: a phrase goes if a longer candidate around it has at least so many hundredths of its count; a longer one's count is at most
    that of what it is made of, so candidates one word longer decide.
    """
    counts, found = levels(docs, least, most_words, **sizes)
    kept = None
    for k, level in enumerate(found[1:], 2):
        rows = scored(level)
        if k < most_words:
            longer = found[k]
            most = longer.select(F.col("left").alias("id"), "total").unionByName(longer.select(F.col("right").alias("id"), "total")).groupBy("id").agg(F.max("total").alias("around"))
            rows = rows.join(most, "id", "left").where(F.col("around").isNull() | (100 * F.col("around") < inside * F.col("a"))).drop("around")
        rows = rows.drop("id")
        kept = rows if kept is None else kept.unionByName(rows)
    order = [F.desc("score"), F.desc("a"), "phrase"]
    first = lambda df, *by: df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= top)
    best = first(first(kept.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))), "lang", "part").drop("part", "rank"), "lang")
    return best.join(counts, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_phrases(spark, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang"))


OP13_SQL = r"""
with d as (select row_number() over () as r, coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as x from documents),
  p as (select r, lang, unnest(regexp_split_to_array(x, '[.,;:!?\x0A-\x0D]')) as piece, unnest(range(len(regexp_split_to_array(x, '[.,;:!?\x0A-\x0D]')))) as p from d),
  w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as t from p),
  i as (select lang, t, unnest(range(1, len(t) + 1)) as i from w),
  f1 as (select lang, t[i] as phrase, count(*) as a from i group by all),
  f2 as (select lang, t[i] as w1, t[i + 1] as w2, count(*) as a from i where i + 1 <= len(t) group by all having count(*) >= 10),
  f3 as (select lang, t[i] as w1, t[i + 1] as w2, t[i + 2] as w3, count(*) as a from i where i + 2 <= len(t) group by all having count(*) >= 10),
  n as (select lang, sum(a)::bigint as n from f1 group by lang),
  c as (
    select f2.lang, w1 || ' ' || w2 as phrase, f2.a, x.a as l, y.a as r, 1 as k from f2 join f1 x on x.lang = f2.lang and x.phrase = w1 join f1 y on y.lang = f2.lang and y.phrase = w2
      where not exists (select 1 from f3 where f3.lang = f2.lang and f3.w1 = f2.w1 and f3.w2 = f2.w2 and 100 * f3.a >= 50 * f2.a) and not exists (select 1 from f3 where f3.lang = f2.lang and f3.w2 = f2.w1 and f3.w3 = f2.w2 and 100 * f3.a >= 50 * f2.a)
    union all select f3.lang, f3.w1 || ' ' || f3.w2 || ' ' || w3, f3.a, x.a, y.a, 1 from f3 join f1 x on x.lang = f3.lang and x.phrase = f3.w1 join f2 y on y.lang = f3.lang and y.w1 = f3.w2 and y.w2 = f3.w3
    union all select f3.lang, f3.w1 || ' ' || f3.w2 || ' ' || w3, f3.a, y.a, x.a, 2 from f3 join f1 x on x.lang = f3.lang and x.phrase = f3.w3 join f2 y on y.lang = f3.lang and y.w1 = f3.w1 and y.w2 = f3.w2),
  s as (select *, ((1000000::hugeint * a * a) // (l::hugeint * r))::bigint as score from c),
  o as (select * from s qualify row_number() over (partition by lang, phrase order by score, k) = 1)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score from o join n using (lang) qualify rank <= 2000"""
