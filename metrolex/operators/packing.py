"""Packing of labelled token lists into windows of a fixed size, for a model's input.

Lists longer than a window are cut, others stay whole. Each task packs its pieces where they are, in shards of about SHARD_TOKENS, so no token is shuffled; a shard is packed on its own, first fit
decreasing. A task's last shard holds one to two times SHARD_TOKENS, or all that the task has, so about a window a task is left part empty. In a shard: the longest piece first, each into the first window with room. Pieces of one length are placed at once: a window with r free places takes r // n of
them, which is what placing them one by one would give.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARD_TOKENS = 1 << 20


def first_fit(sizes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Window of each piece, and its place among the window's pieces; first fit over pieces in falling order of size, equal ones in the order given."""
    order = np.argsort(-sizes, kind="stable")
    room = np.full(len(sizes), window)  # as many windows as pieces are enough
    held, into, place = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    lo = 0
    while lo < len(order):
        n = sizes[order[lo]]
        hi = lo + int(np.searchsorted(-sizes[order[lo:]], -n, "right"))
        k = hi - lo
        takes = room // n if n else np.full(len(room), k)
        ends = np.cumsum(takes)
        at = np.searchsorted(ends, np.arange(k), "right")
        into[order[lo:hi]] = at
        first = np.searchsorted(at, at)  # the first of this length in the same window
        place[order[lo:hi]] = held[at] + np.arange(k) - first
        counts = np.bincount(at, minlength=len(room))
        held += counts
        room -= counts * n
        lo = hi
    return into, place


def _pack(shard: int, table: pa.Table, window: int) -> pa.Table:
    table = table.sort_by([("sid", "ascending"), ("piece", "ascending")])  # equal tables are packed alike
    tokens, labels = (table.column(c).combine_chunks() for c in ("tokens", "labels"))
    sizes = np.diff(np.asarray(tokens.offsets)).astype(np.int64)
    into, place = first_fit(sizes, window)
    order = np.lexsort((place, into))
    tokens, labels, sizes, into = tokens.take(pa.array(order)), labels.take(pa.array(order)), sizes[order], into[order]
    begins = np.cumsum(sizes) - sizes
    windows, first = np.unique(into, return_index=True)
    total, pieces = np.r_[begins[first], sizes.sum()].astype(np.int32), np.r_[first, len(sizes)].astype(np.int32)
    segment = np.arange(len(sizes)) - np.repeat(first, np.diff(pieces)) + 1
    lists = lambda at, values: pa.ListArray.from_arrays(pa.array(at), values)
    ids = table.column("sid").combine_chunks().take(pa.array(order))
    return pa.table({
        "shard": np.full(len(windows), shard), "window": windows.astype(np.int64), "n_tokens": np.diff(total).astype(np.int64), "sids": lists(pieces, ids), "tokens": lists(total, tokens.flatten()), "labels": lists(total, labels.flatten()),
        "segments": lists(total, pa.array(np.repeat(segment, sizes).astype(np.int32))), "positions": lists(total, pa.array((np.arange(sizes.sum()) - np.repeat(begins, sizes)).astype(np.int32))),
    })


def pieces_of(labelled: DataFrame, window: int) -> DataFrame:
    """(sid, piece, tokens, labels): lists of more than `window` tokens cut into full pieces and a rest; empty lists have none."""
    cut = labelled.select(F.col("sid").cast("string").alias("sid"), F.posexplode(F.sequence(F.lit(0), F.greatest(F.size("tokens") - 1, F.lit(0)), F.lit(window))).alias("piece", "__b"), "tokens", "labels").where(F.size("tokens") > 0)
    part = lambda c: F.slice(c, F.col("__b") + 1, F.lit(window)).alias(c)
    return cut.select("sid", "piece", part("tokens"), part("labels"))


def packed(labelled: DataFrame, window: int = 128, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """(shard, window, n_tokens, sids, tokens, labels, segments, positions) from (sid, tokens, labels).

    segments numbers a window's pieces from 1, positions restart in each, so attention can be held within a piece. Tokens and labels of a row are equally many.
    Rows alike are separate lists; null ids and lists are left out. Which lists share a shard follows from the table's partitions.
    """
    pieces = pieces_of(labelled.where("sid is not null and tokens is not null"), window)

    def run(batches):
        shard, held, size = TaskContext.get().partitionId() << 32, [], 0
        for b in batches:
            ends, lo = np.cumsum(np.diff(np.asarray(b.column(2).offsets)).astype(np.int64)), 0
            while lo < b.num_rows:
                before = int(ends[lo - 1]) if lo else 0
                hi = min(int(np.searchsorted(ends, before + shard_tokens)) + 1, b.num_rows)
                held.append((b.slice(lo, hi - lo), int(ends[hi - 1]) - before))
                size, lo = size + held[-1][1], hi
                if size >= 2 * shard_tokens:
                    own, n = [], 0
                    while n < shard_tokens:
                        own.append(held[len(own)][0])
                        n += held[len(own) - 1][1]
                    held, size = held[len(own) :], size - n
                    yield from _pack(shard, pa.Table.from_batches(own), window).to_batches(max_chunksize=4096)
                    shard += 1
        if held:
            yield from _pack(shard, pa.Table.from_batches([x[0] for x in held]), window).to_batches(max_chunksize=4096)

    shape = "shard long, window long, n_tokens long, sids array<string>, tokens array<string>, labels array<string>, segments array<int>, positions array<int>"
    return pieces.mapInArrow(run, shape)
