"""What the operators share: vectorised word scanning, shared-folder tables, Bloom filters.

Everything that crosses partitions here has a fixed size or a checked one.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U = np.uint64
#: White space of every contract here: [\x20\x09-\x0D].
SPACES = " \t\n\x0b\x0c\r"
#: Bytes of text that one vectorised step handles; temporary arrays take about 40 times that.
STEP_BYTES = 1 << 20
NO_ID = -(2**63)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, elementwise."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def constants(seed: int, n: int) -> np.ndarray:
    """n odd 64-bit numbers that depend on seed alone."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed)) | U(1)


_BYTE = constants(11, 256)
_BASE = 0x9E3779B97F4A7C13  # 3 modulo 8: its powers keep the most low bits
_INVERSE = pow(_BASE, -1, 2**64)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[ord(c) for c in SPACES]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[str, np.ndarray] = {}


def _power(kind: str, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        base = np.full(max(n, STEP_BYTES + 1), _BASE if kind == "up" else _INVERSE, U)
        base[0] = 1
        have = _powers[kind] = np.cumprod(base)
    return have


def words(data: np.ndarray, breaks: np.ndarray, lower: bool = False, clip: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end (bytes) and 64-bit hash of each word [^\\x20\\x09-\\x0D]+ of UTF-8 bytes.

    breaks: sorted positions where a text begins; no word crosses them. clip: the hash is of the first so many bytes. Texts of any length
    are worked through in pieces of about STEP_BYTES, cut where no word is open.
    """
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, U)
    gap = _IS_SPACE[data]
    before = np.empty_like(gap)
    before[0], before[1:] = True, gap[:-1]
    before[breaks[breaks < len(data)]] = True
    starts = np.flatnonzero(~gap & before)
    after = np.empty_like(gap)
    after[-1], after[:-1] = True, gap[1:]
    inner = breaks[(breaks > 0) & (breaks <= len(data))]
    after[inner - 1] = True
    ends = np.flatnonzero(~gap & after) + 1
    hashes = np.empty(len(starts), U)
    i = 0
    with np.errstate(over="ignore"):
        while i < len(starts):
            base = starts[i]
            j = max(int(np.searchsorted(ends, base + STEP_BYTES, "right")), i + 1)
            piece = data[base : ends[j - 1]]
            total = np.empty(len(piece) + 1, U)
            total[0] = 0
            np.cumsum(_BYTE[_LOWER[piece] if lower else piece] * _power("up", len(piece))[: len(piece)], out=total[1:])
            s, e = starts[i:j] - base, ends[i:j] - base
            if clip is not None:
                e = np.minimum(e, s + clip)
            hashes[i:j] = mix((total[e] - total[s]) * _power("down", len(piece))[s] + (e - s).astype(U))
            i = j
    return starts, ends, hashes


def grams(hashes: np.ndarray, k: int, seed: int = 1) -> np.ndarray:
    """Hash of each k consecutive word hashes."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    c = constants(seed, k)
    with np.errstate(over="ignore"):
        out = hashes[:n] * c[0]
        for j in range(1, k):
            out += hashes[j : j + n] * c[j]
        return mix(out)


def texts(column: pa.Array) -> pa.Array:
    """The column as large_string without nulls (null: empty) and without an offset into its buffers."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = pc.fill_null(pc.cast(column, pa.large_string()), "")
    return pa.concat_arrays([column]) if column.offset else column


def sliced(batches, rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The batches in parts of a few rows, so that what a task makes of one part stays small."""
    for b in batches:
        for lo in range(0, b.num_rows, rows):
            yield b.slice(lo, rows)


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Data bytes and offsets (n + 1) of what texts() returns."""
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def steps(column: pa.Array, most: int = STEP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets from 0) over runs of rows of about `most` bytes; a longer text stands alone."""
    data, offsets = bytes_of(column)
    lo = 0
    while lo < len(column):
        hi = max(int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1, lo + 1)
        hi = min(hi, len(column))
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def word_counts(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Index of the first word of each row, with the number of words at the end (n + 1)."""
    return np.searchsorted(starts, offsets)


def fresh(name: str, *dfs: DataFrame) -> str:
    """A column name for a table's own use that none of the tables has, in any case of letters."""
    taken = {c.lower() for df in dfs for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see: Spark's checkpoint folder; a temporary one only where none is set and all runs on this machine, as in tests."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("on a cluster, name a shared folder in spark.checkpoint.dir")
            named = tempfile.mkdtemp(prefix="metrolex-")
            atexit.register(shutil.rmtree, named, True)
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """df written to the shared folder as a table and read again: it cuts the lineage and survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._path = path  # for discard()
    return out


def discard(*tables: DataFrame) -> None:
    """Removes tables that stored() gave. Only where nothing that is still to be worked out reads them."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(vars(df)["_path"])
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def bloom(keys: DataFrame, count: int, per_key: int = 12, most_bits: int = 1 << 27, probes: int = 4) -> np.ndarray:
    """Bloom filter over the long column `k` as 64-bit words; most_bits bounds it whatever the input is.

    Positions are folded together in Spark (bit_or by word), so the driver gets at most most_bits / 64 rows.
    """
    bits = 1 << 10
    while bits < min(per_key * max(count, 1), most_bits):
        bits *= 2

    def places(batches):
        for b in batches:
            at = bloom_places(np.asarray(b.column(0)).view(U), bits, probes).ravel()
            word, bit = (at >> U(6)).astype(np.int64), U(1) << (at & U(63))
            order = np.argsort(word, kind="stable")
            word, bit = word[order], bit[order]
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]]) if len(word) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(word[first]), pa.array((np.bitwise_or.reduceat(bit, first) if len(word) else bit).view(np.int64))], names=["w", "b"])

    got = keys.select(F.col("k").cast("long").alias("k")).where("k is not null").mapInArrow(places, "w long, b long").groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(bits // 64, U)
    out[np.asarray(got.column("w"))] = np.asarray(got.column("b")).view(U)
    return out


def small_bloom(keys: DataFrame, most_bits: int = 1 << 27, per_key: int = 12):
    """The filter of the long column `k` as a broadcast; None where it would take more than most_bits, so that the caller joins instead."""
    n = keys.count()
    return keys.sparkSession.sparkContext.broadcast(bloom(keys, n, per_key, most_bits)) if per_key * n <= most_bits else None


def bloom_places(keys: np.ndarray, bits: int, probes: int = 4) -> np.ndarray:
    with np.errstate(over="ignore"):
        a, b = mix(keys ^ U(0xA5A5A5A5)), mix(keys + U(0x51ED270B)) | U(1)
        return (a[:, None] + b[:, None] * np.arange(probes, dtype=U)[None, :]) & U(bits - 1)


def bloom_has(filter_: np.ndarray, keys: np.ndarray, probes: int = 4) -> np.ndarray:
    out = np.empty(len(keys), bool)
    for i in range(0, len(keys), 1 << 16):
        at = bloom_places(keys[i : i + (1 << 16)], len(filter_) * 64, probes)
        out[i : i + (1 << 16)] = ((filter_[(at >> U(6)).astype(np.int64)] >> (at & U(63))) & U(1)).all(axis=1)
    return out


def runs(batches, key: int = 0) -> Iterator[pa.RecordBatch]:
    """Whole groups of equal key (a long) from a stream that is sorted by it."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        k = np.asarray(b.column(key))
        cuts = np.flatnonzero(k[1:] != k[:-1]) + 1
        if held and np.asarray(held[-1].column(key))[-1] != k[0]:
            yield _joined(held)
            held = []
        for lo, hi in zip(np.r_[0, cuts], np.r_[cuts, len(k)]):
            held.append(b.slice(lo, hi - lo))
            if hi < len(k):
                yield _joined(held)
                held = []
    if held:
        yield _joined(held)


def whole(batches, key: int = 0) -> Iterator[pa.RecordBatch]:
    """Batches of whole groups of equal key from a stream that is sorted by it; many small groups stay together."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        k = np.asarray(b.column(key))
        other = np.flatnonzero(k != k[-1])
        cut = int(other[-1]) + 1 if len(other) else 0
        if cut:
            yield _joined([*held, b.slice(0, cut)])
            held = [b.slice(cut)]
        elif held and last != k[0]:
            yield _joined(held)
            held = [b]
        else:
            held.append(b)
        last = k[-1]
    if held:
        yield _joined(held)


def _joined(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]
