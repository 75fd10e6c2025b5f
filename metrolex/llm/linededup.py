"""Line dedup: sharded cuckoo filters in front of exact reference-count tables.

State. `refs`: one row (k1, k2, did, v) for each document that holds a key, and `gone`: (did, v) for deletions, both
only ever added to; a key's exact count and keeper follow from them after any insertion or deletion. `parts`: for each shard of
the keys one row with the frequent keys, their counts and keepers, and a cuckoo filter over them. An insertion or
deletion counts only the keys of its documents anew and rewrites only the shards in which a frequent key changed:
keys that became frequent are inserted into the stored filter, keys that ceased to be are deleted from it.

A line that misses its shard's filter needs no look at the exact table. Shards of up to LOCAL_KEYS keys in all go to every task. Beyond,
lines are dealt to the shards, SALTS ways each so that a hot line is spread, and meet filter and exact keys there; filters of
up to FILTER_BYTES in all still go to every task, to keep lines from being dealt at all.

Cases. Null or empty text: one empty line. Null doc_id: a document that keeps a line only if no
other holds it. Rows with the same doc_id count as one document; each such row is rewritten alike.
Empty tables give empty results. Only id and text columns are read by the index; other columns pass, but for columns named as the
counts that are added, which are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import NO_ID, SPACES, U, fresh, mix, sliced, stored, texts

MIN_CHARS, MIN_DOCS = 40, 5
#: Keys in one shard's filter, at most about twice that.
SHARD_KEYS = 1 << 15
#: Frequent keys (24 bytes each) and bytes of filters that may go to every task.
LOCAL_KEYS, FILTER_BYTES = 1 << 21, 64 << 20
#: Ways in which a shard's lines are dealt; versions of shards that lie side by side before they are written as one.
SALTS, MOST_PARTS = 16, 12
_UPPER = bytes(range(65, 91))
_FOLD = bytes.maketrans(_UPPER, _UPPER.lower())
_STRIP = SPACES.encode()


def line_key(line: bytes) -> bytes:
    return line.strip(_STRIP).translate(_FOLD)


def code_points(key: bytes) -> int:
    return len(key) if key.isascii() else len(key.decode())


def _eligible(text: str, least: int) -> list[tuple[int, bytes]]:
    return [(i, k) for i, line in enumerate(text.encode().split(b"\n")) if len(line) >= least and code_points(k := line_key(line)) >= least]


def _numbers(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), ">u8").astype(U).reshape(-1, 2)


class CuckooFilter:
    """Buckets of four 16-bit fingerprints; supports insertion, deletion and vectorised look-up of 64-bit hashes."""

    SLOTS, KICKS = 4, 500

    def __init__(self, buckets: int, table: np.ndarray | None = None):
        self.table = np.zeros((buckets, self.SLOTS), np.uint16) if table is None else table

    @classmethod
    def of(cls, hashes: np.ndarray, buckets: int = 16) -> CuckooFilter:
        """A filter over the hashes, with as many buckets as it takes."""
        while buckets * cls.SLOTS * 0.8 < len(hashes):
            buckets *= 2
        while True:
            made = cls(buckets)
            if all(made.insert(int(h)) for h in hashes):
                return made
            buckets *= 2

    @staticmethod
    def parts(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        print_ = (hashes >> U(48)).astype(np.uint16)
        print_[print_ == 0] = 1
        with np.errstate(over="ignore"):
            first = hashes & U(buckets - 1)
            other = first ^ (mix(print_.astype(U)) & U(buckets - 1))
        return print_, first.astype(np.int64), other.astype(np.int64)

    def insert(self, h: int) -> bool:
        p, a, b = (x[0] for x in self.parts(np.array([h], U), len(self.table)))
        for at in (a, b):
            if len(free := np.flatnonzero(self.table[at] == 0)):
                self.table[at, free[0]] = p
                return True
        at = a
        for kick in range(self.KICKS):
            p, self.table[at, kick % self.SLOTS] = self.table[at, kick % self.SLOTS], p
            with np.errstate(over="ignore"):
                at = int(U(at) ^ (mix(np.array([p], U)) & U(len(self.table) - 1))[0])
            if len(free := np.flatnonzero(self.table[at] == 0)):
                self.table[at, free[0]] = p
                return True
        return False

    def delete(self, h: int) -> bool:
        p, a, b = (x[0] for x in self.parts(np.array([h], U), len(self.table)))
        for at in (a, b):
            if len(found := np.flatnonzero(self.table[at] == p)):
                self.table[at, found[0]] = 0
                return True
        return False

    def has(self, hashes: np.ndarray) -> np.ndarray:
        p, a, b = self.parts(hashes, len(self.table))
        return (self.table[a] == p[:, None]).any(1) | (self.table[b] == p[:, None]).any(1)


def references(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """(k1, k2, did): each key of min_chars or more in each document, once a row of docs."""

    def keys(batches):
        for b in sliced(batches):
            ids, column = np.asarray(b.column(0)), texts(b.column(1))
            for lo in range(0, len(ids), 512):
                dids, digests = [], []
                for did, t in zip(ids[lo : lo + 512], column.slice(lo, 512)):
                    own = {k for _, k in _eligible(t.as_py(), min_chars)}
                    digests += [xxhash.xxh3_128_digest(k) for k in own]
                    dids += [did] * len(own)
                k = _numbers(digests).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(k[:, 0]), pa.array(k[:, 1]), pa.array(np.array(dids, np.int64))], names=["k1", "k2", "did"])

    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)), F.col(text_col)).mapInArrow(keys, "k1 long, k2 long, did long")


def counted(refs: DataFrame) -> DataFrame:
    """(k1, k2, n_docs, keeper). Counted in two steps, so that a key of very many documents is summed where its rows are."""
    return refs.groupBy("k1", "k2", "did").agg(F.lit(1).alias("one")).groupBy("k1", "k2").agg(F.count("*").alias("n_docs"), F.max("did").alias("keeper"))


_SHARD = "shard long, n long, filter binary, k1 binary, k2 binary, n_docs binary, keeper binary"
_COLUMNS = ("k1", "k2", "n_docs", "keeper")


def _merged(old, changes, min_docs: int):
    """The row of a shard after changes (k1, k2, n_docs, keeper) of some keys; old: the row before, if there was one."""
    import pandas as pd

    keys: dict[tuple[int, int], tuple[int, int]] = {}
    filter_ = CuckooFilter.of(np.zeros(0, U), _buckets(len(changes)))
    if len(old):
        k1, k2, n, keeper = (np.frombuffer(old[c].iloc[0], np.int64).tolist() for c in _COLUMNS)
        keys = dict(zip(zip(k1, k2), zip(n, keeper)))
        filter_ = CuckooFilter(0, np.frombuffer(old["filter"].iloc[0], np.uint16).reshape(-1, CuckooFilter.SLOTS).copy())
    full = False
    for k1, k2, n, keeper in zip(*(changes[c].tolist() for c in _COLUMNS)):
        if n >= min_docs:
            if (k1, k2) not in keys and not full:
                full = not filter_.insert(k1 & (2**64 - 1))
            keys[k1, k2] = (n, int(keeper))
        elif keys.pop((k1, k2), None) is not None and not full:
            filter_.delete(k1 & (2**64 - 1))
    own = np.array(sorted((*k, *v) for k, v in keys.items()), np.int64).reshape(-1, 4)
    if full:
        filter_ = CuckooFilter.of(own[:, 0].view(U) if len(own) else np.zeros(0, U), len(filter_.table))
    row = {"shard": [int((changes if len(changes) else old)["shard"].iloc[0])], "n": [len(own)], "filter": [filter_.table.tobytes()]}
    return pd.DataFrame(row | {c: [np.ascontiguousarray(own[:, i]).tobytes()] for i, c in enumerate(_COLUMNS)})


def _buckets(keys: int) -> int:
    buckets = 16
    while buckets * CuckooFilter.SLOTS * 0.6 < 1.3 * keys + 16:
        buckets *= 2
    return buckets


class LineIndex:
    """An index that documents are inserted into and deleted from; apply() rewrites documents by its present state. Updates give a new index that shares what did not change."""

    def __init__(self, refs: DataFrame | None, gone: DataFrame | None, parts: list[tuple[DataFrame, frozenset[int]]], shards: int, version: int, min_chars: int, min_docs: int, local_keys: int, filter_bytes: int):
        self.refs, self.gone, self.parts, self.shards, self.version = refs, gone, parts, shards, version
        self.min_chars, self.min_docs, self.local_keys, self.filter_bytes = min_chars, min_docs, local_keys, filter_bytes

    @classmethod
    def of(cls, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, keep_refs: bool = True, local_keys: int = LOCAL_KEYS, filter_bytes: int = FILTER_BYTES, shard_keys: int = SHARD_KEYS) -> LineIndex:
        """keep_refs: write the exact references too, which insert() and delete() need."""
        refs = references(docs, id_col, text_col, min_chars).withColumn("v", F.lit(0))
        refs = stored(refs) if keep_refs else refs
        often = stored(counted(refs).where(F.col("n_docs") >= min_docs))
        n, shards = often.count(), 1
        while shards * shard_keys < n:
            shards *= 2
        made = cls(refs if keep_refs else None, None, [], shards, 0, min_chars, min_docs, local_keys, filter_bytes)
        return made._with(often)

    def _shard(self):
        return F.shiftrightunsigned("k1", 32).bitwiseAND(F.lit(self.shards - 1)).alias("shard")

    def rows(self) -> DataFrame:
        """One row a shard: filter and exact table."""
        out = None
        for df, own in self.parts:
            part = df if len(own) == self.shards else df.where(F.col("shard").isin(sorted(own)))
            out = part if out is None else out.unionByName(part)
        return out

    def live(self) -> DataFrame:
        """References of documents that are in the index now."""
        if self.gone is None:
            return self.refs
        last = self.gone.groupBy("did").agg(F.max("v").alias("gone"))
        return self.refs.join(last, "did", "left").where("gone is null or gone < v").select("k1", "k2", "did", "v")

    def _with(self, changes: DataFrame) -> LineIndex:
        """The index with changed counts (k1, k2, n_docs, keeper), all of keys that are or were frequent."""
        changes = changes.select(self._shard(), *_COLUMNS)
        least = self.min_docs
        if not self.parts:
            made = stored(changes.groupBy("shard").applyInPandas(lambda x: _merged(x[:0], x, least), _SHARD))
            parts = [(made, frozenset(range(self.shards)))]
        else:
            changes = stored(changes)
            touched = frozenset(r["shard"] for r in changes.select("shard").distinct().collect())  # a number a shard
            if not touched:
                return self
            old = self.rows().where(F.col("shard").isin(sorted(touched)))
            made = stored(old.groupBy("shard").cogroup(changes.groupBy("shard")).applyInPandas(lambda o, c: _merged(o, c, least), _SHARD))
            parts = [(df, left) for df, own in self.parts if (left := own - touched)] + [(made, touched)]
        new = LineIndex(self.refs, self.gone, parts, self.shards, self.version, self.min_chars, self.min_docs, self.local_keys, self.filter_bytes)
        if len(parts) > MOST_PARTS:
            new.parts = [(stored(new.rows()), frozenset(range(self.shards)))]
        return new

    def _after(self, refs: DataFrame, gone: DataFrame | None) -> LineIndex:
        return LineIndex(refs, gone, self.parts, self.shards, self.version + 1, self.min_chars, self.min_docs, self.local_keys, self.filter_bytes)

    def insert(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LineIndex:
        added = stored(references(docs, id_col, text_col, self.min_chars).withColumn("v", F.lit(self.version + 1)))
        new = self._after(self.refs.unionByName(added), self.gone)
        now = counted(new.live().join(added.select("k1", "k2").distinct(), ["k1", "k2"], "left_semi"))
        return new._with(now.where(F.col("n_docs") >= self.min_docs))

    def delete(self, ids: DataFrame, id_col: str = "doc_id") -> LineIndex:
        """Takes the documents out again; lines that they alone made frequent come back."""
        gone = stored(ids.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("did")).distinct().withColumn("v", F.lit(self.version + 1)))
        lost = stored(counted(self.live().join(gone.select("did"), "did", "left_semi")).select("k1", "k2", F.col("n_docs").alias("lost")))
        new = self._after(self.refs, gone if self.gone is None else self.gone.unionByName(gone))
        now = lost.join(counted(new.live().join(lost, ["k1", "k2"], "left_semi")), ["k1", "k2"], "left").select("k1", "k2", F.coalesce("n_docs", F.lit(0)).cast("long").alias("n_docs"), F.coalesce("keeper", F.lit(0)).cast("long").alias("keeper"), "lost")
        return new._with(now.where(F.col("n_docs") + F.col("lost") >= self.min_docs).drop("lost"))

    def apply(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_lines: str = "n_lines", n_dropped: str = "n_dropped") -> DataFrame:
        """docs with text rewritten, and two columns with the numbers of lines and of dropped ones."""
        docs = docs.drop(n_lines, n_dropped)
        rows = self.rows()
        size = rows.agg(F.sum("n").alias("n"), F.sum(F.length("filter")).alias("bytes")).first()
        if (size["n"] or 0) <= self.local_keys:
            return self._local(docs, rows, id_col, text_col, n_lines, n_dropped)
        return self._dealt(docs, rows, (size["bytes"] or 0) <= self.filter_bytes, id_col, text_col, n_lines, n_dropped)

    def _filters(self, rows: list) -> list[CuckooFilter]:
        out = [CuckooFilter(16) for _ in range(self.shards)]
        for r in rows:
            out[r["shard"]] = CuckooFilter(0, np.frombuffer(r["filter"], np.uint16).reshape(-1, CuckooFilter.SLOTS))
        return out

    def _hits(self, state, text: str) -> tuple[list[int], np.ndarray]:
        """Positions and keys of the lines that the filters let through."""
        lines = _eligible(text, self.min_chars)
        k = _numbers([xxhash.xxh3_128_digest(k) for _, k in lines])
        at = [i for i, _ in lines]
        if state is None or not at:
            return at, k
        shard = (k[:, 0] >> U(32)) & U(len(state) - 1)
        found = np.zeros(len(k), bool)
        for s in np.unique(shard):
            own = shard == s
            found[own] = state[int(s)].has(k[own, 0])
        return [i for i, f in zip(at, found) if f], k[found]

    def _local(self, docs: DataFrame, rows: DataFrame, id_col: str, text_col: str, n_lines: str, n_dropped: str) -> DataFrame:
        got = rows.select("shard", "filter", "k1", "k2", "keeper").collect()  # at most local_keys keys
        keys = np.array([np.frombuffer(b"".join(r[c] for r in got), np.int64) for c in ("k1", "k2", "keeper")])
        sent = docs.sparkSession.sparkContext.broadcast((self._filters(got), keys[:, np.lexsort((keys[1], keys[0]))]))
        hits, own, which = _Hits(self.min_chars), docs.columns.index(text_col), docs.columns.index(id_col)

        def rewrite(batches):
            filters, (k1, k2, keeper) = sent.value
            for b in sliced(batches):
                ids, column = b.column(which), texts(b.column(own))
                out, n, gone = [], [], []
                for did, t in zip(ids, column):
                    text, did = t.as_py(), did.as_py()
                    at, k = hits(filters, text)
                    kept = _keepers(k.view(np.int64), k1, k2, keeper)
                    drop = {i for i, x in zip(at, kept) if x is not None and x != (NO_ID if did is None else did)}
                    n.append(text.count("\n") + 1)
                    gone.append(len(drop))
                    out.append("\n".join(x for i, x in enumerate(text.split("\n")) if i not in drop) if drop else text)
                cols = [*b.columns, pa.array(n, pa.int64()), pa.array(gone, pa.int64())]
                cols[own] = pa.array(out, pa.string())
                yield pa.RecordBatch.from_arrays(cols, names=[*b.schema.names, n_lines, n_dropped])

        return docs.mapInArrow(rewrite, _schema(docs, n_lines, n_dropped))

    def _dealt(self, docs: DataFrame, rows: DataFrame, screen: bool, id_col: str, text_col: str, n_lines: str, n_dropped: str) -> DataFrame:
        sent = docs.sparkSession.sparkContext.broadcast(self._filters(rows.select("shard", "filter").collect())) if screen else None
        hits, shards = _Hits(self.min_chars), self.shards
        id_ = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
        row = F.xxhash64(id_, F.coalesce(F.col(text_col), F.lit("")))

        def candidates(batches):
            for b in sliced(batches):
                for key, did, t in zip(b.column(0), b.column(1), texts(b.column(2))):
                    at, k = hits(sent.value if screen else None, t.as_py())
                    shard, n = ((k[:, 0] >> U(32)) & U(shards - 1)).astype(np.int64), len(at)
                    k = k.view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(shard), *(pa.array([x.as_py()] * n, pa.int64()) for x in (key, did)), pa.array(at, pa.int32()), pa.array(k[:, 0]), pa.array(k[:, 1])], names=["shard", "row", "did", "at", "a", "b"])

        def checked(batches):
            """A shard's row comes before its lines."""
            filter_ = k1 = k2 = keeper = None
            for batch in batches:
                kind = np.asarray(batch.column("kind"))
                cuts = np.r_[np.flatnonzero(kind == 0), len(kind)]
                for lo, hi in zip([0, *cuts[:-1]], cuts):
                    if hi > lo and kind[lo] == 0:
                        own = {c: batch.column(c)[int(lo)].as_py() for c in ("filter", "k1", "k2", "keeper")}
                        filter_ = CuckooFilter(0, np.frombuffer(own["filter"], np.uint16).reshape(-1, CuckooFilter.SLOTS))
                        k1, k2, keeper = (np.frombuffer(own[c], np.int64) for c in ("k1", "k2", "keeper"))
                        lo += 1
                    if hi > lo and filter_ is not None:
                        part = batch.slice(lo, hi - lo)
                        a, did = np.asarray(part.column("a")), np.asarray(part.column("did"))
                        maybe = np.flatnonzero(filter_.has(a.view(U)))
                        kept = _keepers(np.stack([a[maybe], np.asarray(part.column("b"))[maybe]], 1), k1, k2, keeper)
                        drop = pa.array([int(i) for i, x in zip(maybe, kept) if x is not None and x != did[i]], pa.int64())
                        yield part.select(["row", "at"]).take(drop)

        lines = docs.select(row, id_, F.col(text_col)).mapInArrow(candidates, "shard long, row long, did long, at int, a long, b long").withColumn("kind", F.lit(1)).withColumn("salt", F.pmod("row", F.lit(SALTS)).cast("int"))
        own = rows.select("shard", "filter", "k1", "k2", "keeper", F.lit(0).alias("kind"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        met = lines.unionByName(own, allowMissingColumns=True).repartition("shard", "salt").sortWithinPartitions("shard", "salt", "kind")
        drop, key = fresh("drop", docs), fresh("row", docs)
        drops = met.mapInArrow(checked, "row long, at int").groupBy(F.col("row").alias(key)).agg(F.collect_set("at").alias(drop))
        text, split = F.coalesce(F.col(text_col), F.lit("")), F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)
        kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col(drop)), lambda i: F.get(split, i))
        out = docs.withColumn(key, row).join(drops, key, "left").withColumn(n_lines, F.size(split).cast("long")).withColumn(n_dropped, F.coalesce(F.size(drop), F.lit(0)).cast("long"))
        return out.withColumn(text_col, F.when(F.col(drop).isNull(), text).otherwise(F.array_join(kept, "\n"))).select(*docs.columns, n_lines, n_dropped)


def _keepers(keys: np.ndarray, k1: np.ndarray, k2: np.ndarray, keeper: np.ndarray) -> list[int | None]:
    """The keeper of each key, None for one that the table (sorted by k1, k2) lacks."""
    out: list[int | None] = []
    for a, c in keys:
        j = int(np.searchsorted(k1, a))
        while j < len(k1) and k1[j] == a and k2[j] < c:
            j += 1
        out.append(int(keeper[j]) if j < len(k1) and k1[j] == a and k2[j] == c else None)
    return out


class _Hits:
    """LineIndex._hits without the index, to be sent to tasks."""

    def __init__(self, min_chars: int):
        self.min_chars = min_chars

    def __call__(self, state, text: str):
        return LineIndex._hits(self, state, text)


def _schema(docs: DataFrame, *longs: str):
    from pyspark.sql import types as T

    return T.StructType([*docs.schema.fields, *(T.StructField(x, T.LongType()) for x in longs)])


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_lines: str = "n_lines", n_dropped: str = "n_dropped", **of_index) -> DataFrame:
    """docs with repeated lines dropped except in the largest id that holds them, and the numbers of lines and of dropped ones."""
    return LineIndex.of(docs, id_col, text_col, keep_refs=False, **of_index).apply(docs, id_col, text_col, n_lines, n_dropped)


def op8_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP8_SQL = r"""
with docs as (select doc_id, coalesce(text, '') as text from documents),
lines as (select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as pos from docs),
keyed as (select doc_id, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k from lines),
often as (select k, max(doc_id) as keeper from keyed where length(k) >= 40 group by k having count(distinct doc_id) >= 5),
marked as (select d.doc_id, pos, line, keeper is not null and keeper <> d.doc_id as gone from keyed d left join often using (k))
select doc_id, count(*)::bigint as n_lines, (count(*) filter (where gone))::bigint as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from marked group by doc_id
"""
