"""Benchmark decontamination: size-partitioned MinHash containment search.

Documents fall into classes by their number of distinct shingles, items too. For each pair of
classes a document is sketched by the minima of so many hash bins that an item with the asked
containment shares a minimum with it but for a chance below MISS; where no number of bins can
promise that (tiny items), every shingle is its own bin. Items that share a minimum are candidates
and are verified by exact containment on the full shingle sets.

Items are sent to the tasks in blocks of BLOCK_CHARS characters at most (one longer item stands
alone), one pass over the documents a block, so no size of the benchmark makes a large broadcast.

Cases. Words are [^\\x20\\x09-\\x0D]+ with A-Z lower-cased. A text of fewer than k words is one
shingle; without words, or null, it has none and matches nothing. Items with null id are ignored; rows
repeating an item_id are separate items of that id, the best containment of a pair is told. Repeated
document rows give one result. Empty tables give empty results. Other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import U, bytes_of, grams, mix, steps, texts, words, sliced

WORDS, CONTAINMENT, MISS = 5, 0.8, 1e-9
BLOCK_CHARS = 8 << 20


def shingle_sets(column: pa.Array, k: int):
    """(row, sorted distinct shingle hashes) of each text."""
    for lo, hi, data, offsets in steps(column):
        starts, _, hashes = words(data, offsets[:-1], lower=True)
        first = np.searchsorted(starts, offsets)
        for row in range(lo, hi):
            own = hashes[first[row - lo] : first[row - lo + 1]]
            if len(own) >= k:
                yield row, np.unique(grams(own, k))
            else:
                yield row, mix(grams(own, len(own), 7) + U(len(own))) if len(own) else np.zeros(0, U)


def bins_for(n: int, shared: int, miss: float = MISS) -> int:
    """Bits of the number of bins so that one of `shared` shingles of a document of n is its bin's minimum, but for `miss`; 64: each its own bin."""
    for bits in range(64):
        b = 2.0**bits
        p = b / n * -math.expm1(-n / b)
        if p >= 1 or (1 - p) ** shared <= miss:
            return bits
        if b > 64 * n:
            break
    return 64


class ItemBlock:
    """Shingles of a block of items, with an index from shingle to items for each size class."""

    def __init__(self, ids: list[int], sets: list[np.ndarray], containment: float):
        self.ids, self.sets, self.containment = ids, sets, containment
        by_class: dict[int, list[int]] = {}
        for i, s in enumerate(sets):
            if len(s):
                by_class.setdefault(len(s).bit_length(), []).append(i)
        self.classes = []
        for own in by_class.values():
            h = np.concatenate([sets[i] for i in own])
            of = np.concatenate([np.full(len(sets[i]), i) for i in own])
            order = np.argsort(h, kind="stable")
            h, of = h[order], of[order]
            first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            self.classes.append((h[first], np.r_[first, len(h)], of, math.ceil(containment * min(len(sets[i]) for i in own) - 1e-9), {}))

    def find(self, doc: np.ndarray) -> list[tuple[int, int, int]]:
        """(item id, shared shingles, item's shingles) of the items that the document contains; doc is sorted."""
        if not len(doc):
            return []
        size, out = len(doc).bit_length(), []
        for known, first, of, shared, bits_of in self.classes:
            if size not in bits_of:
                bits_of[size] = bins_for(1 << size, shared)
            if (bits := bits_of[size]) < 64:
                bin_ = doc >> U(64 - bits) if bits else np.zeros(len(doc), U)
                sketch = doc[np.r_[True, bin_[1:] != bin_[:-1]]]  # sorted, so a bin's first is its minimum
            else:
                sketch = doc
            at = np.minimum(np.searchsorted(known, sketch), len(known) - 1)
            hit = at[known[at] == sketch]
            for i in {int(x) for j in hit for x in of[first[j] : first[j + 1]]}:
                item = self.sets[i]
                where = np.minimum(np.searchsorted(doc, item), len(doc) - 1)
                both = int((doc[where] == item).sum())
                if both >= self.containment * len(item) - 1e-9:
                    out.append((self.ids[i], both, len(item)))
        return out


def blocks(items: DataFrame, item_id: str = "item_id", text_col: str = "text", k: int = WORDS, containment: float = CONTAINMENT, block_chars: int = BLOCK_CHARS):
    """The items as ItemBlocks, each read from Spark when its turn comes."""
    rows = items.select(F.col(item_id).cast("long").alias("i"), F.col(text_col).alias("t")).where("i is not null and t is not null")
    n = max(1, math.ceil((rows.agg(F.sum(F.length("t"))).first()[0] or 0) / (0.7 * block_chars)))
    for b in range(n):
        got = rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == b).toArrow()
        ids, column = got.column("i").to_pylist(), texts(got.column("t"))
        yield ItemBlock(ids, [s for _, s in shingle_sets(column, k)], containment)


def contained_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", k: int = WORDS, containment: float = CONTAINMENT, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item): items whose shingles a document holds to at least the containment."""
    out = None
    for block in blocks(items, item_id, item_text, k, containment, block_chars):
        found = docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(_search(docs.sparkSession.sparkContext.broadcast(block), k), "doc_id long, item_id long, n_shared long, n_item long")
        out = found if out is None else out.unionByName(found)
    best = F.max(F.struct((F.col("n_shared") / F.col("n_item")).alias("c"), F.col("n_shared"), F.col("n_item")))
    return out.groupBy("doc_id", "item_id").agg(best.alias("best")).select("doc_id", "item_id", "best.n_shared", "best.n_item")


def _search(sent, k: int):
    def run(batches):
        for b in sliced(batches):
            found = [[], [], [], []]
            for row, own in shingle_sets(texts(b.column(1)), k):
                for item, both, n in sent.value.find(own):
                    for column, x in zip(found, (b.column(0)[row].as_py(), item, both, n)):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["doc_id", "item_id", "n_shared", "n_item"])

    return run


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WORDS, containment: float = CONTAINMENT, block_chars: int = BLOCK_CHARS, **of_items) -> DataFrame:
    """docs without the rows that contain an item; all columns stay, no shuffle."""
    for block in blocks(items, k=k, containment=containment, block_chars=block_chars, **of_items):
        sent, own = docs.sparkSession.sparkContext.broadcast(block), docs.columns.index(text_col)

        def keep(batches, sent=sent):
            for b in sliced(batches):
                yield b.filter(pa.array([not sent.value.find(s) for _, s in shingle_sets(texts(b.column(own)), k)], pa.bool_()))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs


def op2_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Pairs of a document and a benchmark item that it contains."""
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return contained_items(docs, items).withColumn("containment", F.round(F.col("n_shared") / F.col("n_item"), 6))


OP2_SQL = r"""
with w as (select 'd' as kind, doc_id as id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents where doc_id is not null
  union all select 'i', item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') from benchmark where item_id is not null),
s as (select distinct kind, id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) end) as g from w),
n as (select id as item_id, count(*) as n_item from s where kind = 'i' group by id),
c as (select d.id as doc_id, i.id as item_id, count(*) as n_shared from s d join s i on d.g = i.g and d.kind = 'd' and i.kind = 'i' group by all)
select doc_id, item_id, n_shared, n_item, round(n_shared / n_item, 6) as containment from c join n using (item_id) where n_shared >= 0.8 * n_item - 1e-9
"""
