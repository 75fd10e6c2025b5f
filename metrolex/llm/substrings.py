"""Substring dedup: prefix-partitioned suffix trees over the passages that can repeat.

A repeat is a window of `window` consecutive words that starts anywhere else as well.

1. Each window has a lead: of its PREFIX-word sequences the one with the smallest hash, so equal
   windows have equal leads at equal places. Consecutive windows with one lead make a piece. A lead
   that occurs once belongs to no repeat; only pieces with repeated leads go on.
2. Equal pieces are one content with a number of occurrences; contents are dealt out by their lead. In
   each group a suffix tree is grown over the suffixes that start at the contents' windows; a leaf weighs what its content occurs.
   Nodes as deep as a window that weigh two or more are the repeats: what follows below them only says how much longer the
   repeat is, and the neighbouring windows say that too, so that together the marked windows cover each maximal repeat.
3. A lead whose contents have more than GROUP suffixes is dealt anew by the suffixes' own prefixes, equal suffixes being
   one leaf first: by PREFIX words, and where that leaves more than GROUP, by STEP words more, and so on.
   At the length of a window a group holds one suffix, so this ends, and no group is too large for memory.
4. The marks go back to the documents; every word that a marked window covers is removed.

Bloom filters of at most BLOOM_BITS bits keep what cannot repeat out of the shuffles; beyond that number of keys the tables are joined instead.

Cases. Words are [^\\x20\\x09-\\x0D]+, unchanged; null text has none. A text without a window loses
nothing. Repeated rows are repeats of one another, also under one id; their marks are kept once. A null id passes. Empty tables give
empty results. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import U, _power, bloom_has, constants, grams, mix, runs, sliced, small_bloom, steps, stored, texts, whole, words

WINDOW, PREFIX = 35, 12
#: Suffixes that one tree may hold, and words by which a prefix is lengthened.
GROUP, STEP = 4096, 4
#: Bits up to which a Bloom filter is made.
BLOOM_BITS = 1 << 27
_EDGE = 5
_C = constants(4711, 4)


def _cumulated(values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values) + 1, U)
    np.cumsum(values, out=out[1:])
    return out


def pieces(column: pa.Array, window: int = WINDOW, prefix: int = PREFIX):
    """Arrays (row, position of the first window, windows, lead, c1, c2) and the bytes (start, end) of each piece, by runs of rows."""
    for lo, hi, data, offsets in steps(column):
        starts, ends, hashes = words(data, offsets[:-1])
        if len(hashes) < window:
            continue
        first = np.searchsorted(starts, offsets)
        row_of = np.repeat(np.arange(hi - lo), np.diff(first))
        g = grams(hashes, prefix, 3)
        span = window - prefix + 1
        for at in range(0, len(hashes) - window + 1, 1 << 17):  # in blocks: a piece may be cut, which only adds a content
            n = min(1 << 17, len(hashes) - window + 1 - at)
            lead = np.lib.stride_tricks.sliding_window_view(g[at : at + n + span - 1], span).argmin(1) + np.arange(at, at + n)
            rows = row_of[at : at + n]
            whole = rows == row_of[at + window - 1 : at + window - 1 + n]
            new = np.r_[True, (lead[1:] != lead[:-1]) | (rows[1:] != rows[:-1])] & whole
            begin = np.flatnonzero(new)
            if not len(begin):
                continue
            # a run ends where the next begins or where windows stop being whole
            stop = np.flatnonzero(whole & ~np.r_[whole[1:] & ~new[1:], False]) + 1
            size, b = stop - begin, begin + at
            e = b + size + window - 1
            base = at
            local = hashes[base : at + n + window - 1]
            with np.errstate(over="ignore"):
                c = []
                for mult in _C[:2]:
                    total = _cumulated(mix(local * mult) * _power("up", len(local))[: len(local)])
                    c.append(mix((total[e - base] - total[b - base]) * _power("down", len(local))[b - base] + (e - b).astype(U)))
            yield lo + row_of[b], b - first[row_of[b]], size, g[lead[begin]], c[0], c[1], (data, starts[b], ends[e - 1])


def deep_nodes(suffixes: list[tuple[int, ...]], weights: list[int], depth: int) -> list[list[int]]:
    """Leaves below each node at `depth` words of the suffix tree that weighs more than one; its edges carry up to _EDGE words."""
    out, open_ = [], [(list(range(len(suffixes))), 0)]
    while open_ and suffixes:
        group, d = open_.pop()
        if d >= depth:
            out.append(group)
            continue
        if len(group) == 1:
            out += [group] * (weights[group[0]] > 1)
            continue
        branches: dict[tuple[int, ...], list[int]] = {}
        end = min(d + _EDGE, depth)
        for i in group:
            branches.setdefault(suffixes[i][d:end], []).append(i)
        for b in branches.values():
            if len(b) > 1:
                open_.append((b, end))
            elif weights[b[0]] > 1:  # a leaf: no branch can follow
                out.append(b)
    return out


def _hashes(slices: pa.Array) -> list[np.ndarray]:
    out = []
    for lo, hi, data, offsets in steps(texts(slices)):
        starts, _, h = words(data, offsets[:-1])
        first = np.searchsorted(starts, offsets)
        out += [h[first[i] : first[i + 1]] for i in range(hi - lo)]
    return out


def _longs(*arrays) -> list[pa.Array]:
    return [pa.array(np.ascontiguousarray(a).view(np.int64) if a.dtype == U else a.astype(np.int64)) for a in arrays]


def repeated_in_contents(contents: DataFrame, window: int, group: int) -> DataFrame:
    """(c1, c2, bits): which windows of each content repeat. contents: (lead, c1, c2, n, size, slice)."""

    def trees(batches):
        for r in whole(batches):
            lead, n, bits = np.asarray(r.column(0)), r.column(3).to_pylist(), [0] * r.num_rows
            hashes = [h.tolist() for h in _hashes(r.column(4))]
            cuts = (np.flatnonzero(lead[1:] != lead[:-1]) + 1).tolist()
            for lo, hi in zip([0, *cuts], [*cuts, r.num_rows]):
                of = [(i, j) for i in range(lo, hi) for j in range(len(hashes[i]) - window + 1)]
                for leaves in deep_nodes([tuple(hashes[i][j : j + window]) for i, j in of], [n[i] for i, _ in of], window):
                    for x in leaves:
                        bits[of[x][0]] |= 1 << of[x][1]
            keep = pa.array([i for i, x in enumerate(bits) if x], pa.int64())
            yield pa.RecordBatch.from_arrays([r.column(1).take(keep), r.column(2).take(keep), pa.array([x for x in bits if x], pa.int64())], names=["c1", "c2", "bits"])

    def suffixes_of(batches):
        for b in sliced(batches):
            for i, h in enumerate(_hashes(b.column(4))):
                m = len(h) - window + 1
                own = [np.full(m, b.column(j)[i].as_py()) for j in (1, 2, 3)]
                words_ = [h[j : j + window].tobytes() for j in range(m)]
                yield pa.RecordBatch.from_arrays([*_longs(grams(h, window, 5), grams(h, window, 6), *own, np.left_shift(1, np.arange(m))), pa.array(words_, pa.binary())], names=["w1", "w2", "c1", "c2", "n", "bit", "words"])

    total = contents.groupBy("lead").agg(F.sum("n").alias("n"), F.sum("size").alias("m")).where("n > 1").select("lead", "m")
    dealt = contents.join(total, "lead").select("lead", "c1", "c2", "n", "slice", "m")
    found = dealt.where(F.col("m") <= group).drop("m").repartition("lead").sortWithinPartitions("lead").mapInArrow(trees, "c1 long, c2 long, bits long")
    if not (hot := stored(dealt.where(F.col("m") > group).drop("m"))).head(1):
        return found
    suffixes = stored(hot.mapInArrow(suffixes_of, "w1 long, w2 long, c1 long, c2 long, n long, bit long, words binary"))
    leaves = stored(suffixes.groupBy("w1", "w2").agg(F.sum("n").alias("n"), F.first("words").alias("words")))

    def keyed(length):
        def run(batches):
            for b in sliced(batches):
                h = np.frombuffer(b"".join(x.as_py() for x in b.column(3)), U).reshape(-1, window)
                key = np.array([grams(x[:length], length, 8)[0] for x in h], U)
                yield pa.RecordBatch.from_arrays([*_longs(key), *b.columns], names=["key", "w1", "w2", "n", "words"])

        return run

    def subtrees(batches):
        for r in runs(batches):
            h = np.frombuffer(b"".join(x.as_py() for x in r.column(4)), U).reshape(-1, window)
            deep = np.array(sorted(x for leaves in deep_nodes([tuple(x) for x in h.tolist()], r.column(3).to_pylist(), window) for x in leaves), np.int64)
            yield r.select(["w1", "w2"]).take(pa.array(deep))

    deep = None
    for length in [*range(min(PREFIX, window), window, STEP), window]:
        level = leaves.select("w1", "w2", "n", "words").mapInArrow(keyed(length), "key long, w1 long, w2 long, n long, words binary")
        large = stored(level.groupBy("key").count().where(F.col("count") > group).select("key"))
        own = level.join(large, "key", "left_anti").repartition("key").sortWithinPartitions("key").mapInArrow(subtrees, "w1 long, w2 long")
        deep = own if deep is None else deep.unionByName(own)
        if not large.head(1):
            break
        leaves = stored(level.join(large, "key", "left_semi").drop("key"))
    return found.unionByName(suffixes.join(deep, ["w1", "w2"]).groupBy("c1", "c2").agg(F.bit_or("bit").alias("bits")))


def marks(docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX, group: int = GROUP, bloom_bits: int = BLOOM_BITS) -> DataFrame:
    """(row, spans): for each row key, (position, bits) of repeated windows: bit j stands for the window at position + j. docs: (row, text)."""

    def leads(batches):
        for b in sliced(batches):
            for _, _, _, lead, *_ in pieces(texts(b.column(1)), window, prefix):
                h, n = np.unique(lead, return_counts=True)
                yield pa.RecordBatch.from_arrays(_longs(h, n), names=["k", "n"])

    often = stored(docs.mapInArrow(leads, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).where("n > 1").select("k"))
    sent = small_bloom(often, bloom_bits)

    def occurrences(batches):
        """Pieces; the first of a content in a batch brings the text."""
        for b in sliced(batches):
            key = np.asarray(b.column(0))
            for row, at, size, lead, c1, c2, (data, s, e) in pieces(texts(b.column(1)), window, prefix):
                keep = np.flatnonzero(bloom_has(sent.value, lead)) if sent is not None else np.arange(len(lead))
                first = np.zeros(len(keep), bool)
                first[np.unique(c1[keep], return_index=True)[1]] = True
                slices = [data[s[i] : e[i]].tobytes() if new else None for i, new in zip(keep, first)]
                yield pa.RecordBatch.from_arrays([*_longs(*(x[keep] for x in (key[row], at, size, lead, c1, c2))), pa.array(slices, pa.binary())], names=["row", "at", "size", "lead", "c1", "c2", "slice"])

    found = docs.mapInArrow(occurrences, "row long, at long, size long, lead long, c1 long, c2 long, slice binary")
    found = stored(found if sent is not None else found.join(often.select(F.col("k").alias("lead")), "lead", "left_semi"))
    contents = stored(found.groupBy("c1", "c2").agg(F.count("*").alias("n"), F.first("lead").alias("lead"), F.first("size").alias("size"), F.first("slice", True).cast("string").alias("slice")).select("lead", "c1", "c2", "n", "size", "slice"))
    flagged = stored(repeated_in_contents(contents, window, group))  # a table, so that the join below reads two plain shuffles and a hot content can be split
    marked = found.select("row", "at", "size", "c1", "c2").join(flagged, ["c1", "c2"]).select("row", F.struct("at", "size", "bits").alias("s"))
    return stored(marked.groupBy("row").agg(F.collect_set("s").alias("spans")))


def covered(n_words: int, spans: list[dict], window: int) -> np.ndarray:
    """Which words the marked windows cover."""
    begins = np.zeros(n_words + 1, bool)
    for s in spans:
        bits, at = s["bits"], s["at"]
        for j in range(s["size"]):
            if bits >> j & 1:
                begins[at + j] = True
    edge = np.zeros(n_words + 1, np.int64)
    at = np.flatnonzero(begins)
    np.add.at(edge, at, 1)
    np.add.at(edge, np.minimum(at + window, n_words), -1)
    return np.cumsum(edge)[:n_words] > 0


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, prefix: int = PREFIX, group: int = GROUP, bloom_bits: int = BLOOM_BITS) -> DataFrame:
    """(id, n_words, n_removed, text): the words that are left, joined by one space."""
    assert prefix < window and window - prefix + 1 <= 63
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.xxhash64(F.col(id_col), F.coalesce(F.col(text_col), F.lit(""))).alias("row"), F.col(text_col).alias("text"), F.col(id_col).alias("id"))
    spans = marks(rows.select("row", "text"), window, prefix, group, bloom_bits)
    sent = small_bloom(spans.select(F.col("row").alias("k")), bloom_bits)
    schema = f"id {kind}, n_words long, n_removed long, text string"

    def finished(b: pa.RecordBatch) -> pa.RecordBatch:
        n, gone, out = [], [], []
        marked = b.schema.get_field_index("spans")
        for i, t in enumerate(texts(b.column(b.schema.get_field_index("text")))):
            w = t.as_py().encode().split()  # bytes.split() cuts at exactly \x20 and \x09-\x0D
            own = b.column(marked)[i].as_py() if marked >= 0 else None
            drop = covered(len(w), own, window) if own else None
            n.append(len(w))
            gone.append(0 if drop is None else int(drop.sum()))
            out.append(b" ".join(w if drop is None else [x for x, d in zip(w, drop) if not d]).decode())
        return pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("id")), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(out, pa.string())], names=["id", "n_words", "n_removed", "text"])

    def marked_rows(b: pa.RecordBatch) -> np.ndarray:
        return bloom_has(sent.value, np.asarray(b.column(0)).view(U))

    def untouched(batches):
        for b in sliced(batches):
            yield finished(b.filter(pa.array(~marked_rows(b))))

    def touched(batches):
        for b in sliced(batches):
            yield b.filter(pa.array(marked_rows(b)))

    if sent is None:
        return rows.join(spans, "row", "left").mapInArrow(lambda batches: map(finished, sliced(batches)), schema).withColumnRenamed("id", id_col)
    hit = rows.mapInArrow(touched, f"row long, text string, id {kind}").join(spans, "row", "left").mapInArrow(lambda batches: map(finished, sliced(batches)), schema)
    return rows.mapInArrow(untouched, schema).unionByName(hit).withColumnRenamed("id", id_col)


def op10_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


OP10_SQL = r"""
with d as (select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
win as (select r, unnest(range(1, len(w) - 33)) as i, unnest(list_transform(range(1, len(w) - 33), lambda i: md5(array_to_string(w[i : i + 34], ' ')))) as h from d where len(w) >= 35),
rep as (select h from win group by h having count(*) > 1),
hit as (select r, i from win where h in (select h from rep)),
gone as (select distinct r, unnest(range(i, i + 35)) as p from hit),
tok as (select r, unnest(w) as word, unnest(range(1, len(w) + 1)) as p from d),
left_ as (select t.r, count(g.p) as n_removed, string_agg(t.word, ' ' order by t.p) filter (where g.p is null) as kept from tok t left join gone g on g.r = t.r and g.p = t.p group by t.r)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(l.n_removed, 0)::bigint as n_removed, sha256(coalesce(l.kept, '')) as kept_sha256 from d left join left_ l using (r)
"""
