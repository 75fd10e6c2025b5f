"""MinHash near-dedup: a chosen-path set similarity join, then connected components.

1. One pass makes, for each document, its set of word shingles, the set's fingerprint, a one-byte
   MinHash sketch, and its path in each of several independent trees: at each node the smallest
   token of the set under a hash that depends on the path so far. Equal sets become one class first.
2. A node of more than LEAF_ROWS classes (or LEAF_SHINGLES shingles) branches by the next token of
   the paths; a smaller one is a leaf. What is still larger at the last level is compared whole, in
   pairs of blocks. Two sets of similarity s stay together for d levels with probability s^d, so
   `trees` follows from the recall that is asked for.
3. In a leaf, sketches name the classes that have a possible partner; only their full sets are
   brought to the leaf, all their pairs are counted exactly, and a spanning forest of the links is
   returned, never all pairs.
4. Components by repeated contraction towards the smallest id, in Spark.

Cases. Words are [^\\x20\\x09-\\x0D]+ with A-Z lower-cased. Fewer than k words: the whole sequence is
one shingle. No words or null text: an empty set, linked with nothing. Null ids are linked with nothing and
their component is null; they are kept. Rows with one id are one document: what any of them links to,
all do. Empty tables give empty results. Other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .decontaminate import shingle_sets
from .shared import U, bloom, bloom_has, constants, fresh, mix, runs, sliced, stored, texts

DEPTH, SLOTS = 4, 64  # slots: a power of two; each tree carries a sketch a class, most of what is shuffled
LEAF_ROWS, LEAF_SHINGLES = 2048, 1 << 22
RECALL = 0.99999
#: How far below the asked similarity a sketch's estimate may lie: a link at 0.85 is missed less than once in five million (binomial tail over all slots).
SLACK = 0.26


def trees_for(percent: int, recall: float = RECALL) -> int:
    """Trees so that a pair at the threshold that goes two levels down is found with this probability."""
    return max(4, math.ceil(math.log(1 - recall) / math.log(1 - (percent / 100) ** 2)))


def _paths(own: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Node of each tree and level."""
    out = np.empty((len(seeds), DEPTH), U)
    with np.errstate(over="ignore"):
        for t, seed in enumerate(seeds):
            path = seed
            for d in range(DEPTH):
                token = own[np.argmin((own ^ path) * (path | U(1)))]
                path = mix(np.array([path * U(0x9E3779B97F4A7C15) + token], U))[0]
                out[t, d] = path
    return out


def _sketch(own: np.ndarray) -> np.ndarray:
    """Minimum of each of SLOTS bins, as a byte from 1; 0 for an empty bin."""
    h = mix(own ^ U(0x5851F42D4C957F2D))
    h.sort()
    bin_ = (h >> U(65 - SLOTS.bit_length())).astype(np.int64)
    first = np.r_[True, bin_[1:] != bin_[:-1]]
    out = np.zeros(SLOTS, np.uint8)
    out[bin_[first]] = (mix(h[first]) % U(255)).astype(np.uint8) + 1
    return out


def signatures(docs: DataFrame, k: int, trees: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, f1, f2, paths, sketch) of each row; paths and sketch are null for an empty set."""
    seeds = constants(2024, trees)

    def run(batches):
        for b in sliced(batches):
            n, prints, paths, sketches = [], [], [], []
            for _, own in shingle_sets(texts(b.column(1)), k):
                n.append(len(own))
                with np.errstate(over="ignore"):
                    prints.append((int(mix(own).sum(dtype=U)), int(np.bitwise_xor.reduce(mix(own + U(77))) if len(own) else 0)))
                paths.append(_paths(own, seeds).tobytes() if len(own) else None)
                sketches.append(_sketch(own).tobytes() if len(own) else None)
            f = np.array(prints, U).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(f[:, 0]), pa.array(f[:, 1]), pa.array(paths, pa.binary()), pa.array(sketches, pa.binary())], names=["id", "n", "f1", "f2", "paths", "sketch"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, n long, f1 long, f2 long, paths binary, sketch binary")


def leaves(reps: DataFrame, trees: int, leaf_rows: int = LEAF_ROWS, leaf_shingles: int = LEAF_SHINGLES) -> DataFrame:
    """(leaf, id): where each class is compared in each tree."""

    def spread(batches):
        for b in batches:
            p = np.frombuffer(b"".join(x.as_py() for x in b.column(2)), np.int64).reshape(-1, DEPTH)
            ids, n = (np.repeat(np.asarray(b.column(i)), trees) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n), *(pa.array(p[:, d]) for d in range(DEPTH))], names=["id", "n", *(f"p{d}" for d in range(DEPTH))])

    level = reps.select("id", "n", "paths").mapInArrow(spread, "id long, n long, " + ", ".join(f"p{d} long" for d in range(DEPTH)))
    out = []
    for d in range(DEPTH):
        big = stored(level.groupBy(f"p{d}").agg(F.count("*").alias("rows"), F.sum("n").alias("shingles")).where((F.col("rows") > leaf_rows) | (F.col("shingles") > leaf_shingles) & (F.col("rows") > 1)))
        if not big.head(1):
            return _union([*out, level.select(F.col(f"p{d}").alias("leaf"), "id")])
        out.append(level.join(big, f"p{d}", "left_anti").select(F.col(f"p{d}").alias("leaf"), "id"))
        level = level.join(big, f"p{d}", "left_semi") if d + 1 < DEPTH else level.join(big, f"p{d}")
    parts = F.greatest(F.ceil(F.col("rows") * 2 / leaf_rows), F.ceil(F.col("shingles") * 2 / leaf_shingles), F.lit(1))
    own = level.withColumn("parts", F.least(parts, F.col("rows"))).withColumn("own", F.pmod(F.xxhash64("id"), F.col("parts")))
    pairs = own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    return _union([*out, pairs.select(F.xxhash64(f"p{DEPTH - 1}", F.least("own", "other"), F.greatest("own", "other")).alias("leaf"), "id")])


def _union(dfs: list[DataFrame]) -> DataFrame:
    out = dfs[0]
    for df in dfs[1:]:
        out = out.unionByName(df)
    return out


def _hopeful(sketches: np.ndarray, n: np.ndarray, percent: int) -> np.ndarray:
    """Which rows have a partner that sizes and sketches allow."""
    out = np.zeros(len(n), bool)
    filled = sketches > 0
    each = filled.sum(1)
    least = percent / 100 - SLACK
    for i in range(len(n) - 1):
        fit = np.flatnonzero(100 * np.minimum(n[i], n[i + 1 :]) >= percent * np.maximum(n[i], n[i + 1 :])) + i + 1
        if not len(fit):
            continue
        rest = sketches[fit]
        same = np.count_nonzero((rest == sketches[i]) & filled[i], axis=1)
        both = np.count_nonzero(filled[fit] & filled[i], axis=1)
        good = fit[same >= least * (each[i] + each[fit] - both)]
        if len(good):
            out[i] = True
            out[good] = True
    return out


def _forest(ids: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """(larger id, smaller id) of links that span the components of one leaf; every pair is counted on full sets unless it is joined already."""
    n = len(ids)
    tokens, flat = np.unique(np.concatenate(sets), return_inverse=True)
    sizes = np.array([len(s) for s in sets])
    first = np.r_[0, np.cumsum(sizes)]
    mark = np.zeros(len(tokens), np.uint8)
    root, out = np.arange(n), []
    for i in range(n - 1):
        rest = np.flatnonzero(root[i + 1 :] != root[i]) + i + 1
        rest = rest[100 * np.minimum(sizes[i], sizes[rest]) >= percent * np.maximum(sizes[i], sizes[rest])]
        if not len(rest):
            continue
        own = flat[first[i] : first[i + 1]]
        mark[own] = 1
        if len(rest) * 4 < n - i:
            both = np.array([int(mark[flat[first[j] : first[j + 1]]].sum(dtype=np.int64)) for j in rest])
        else:
            both = np.add.reduceat(mark[flat[first[i + 1] :]].astype(np.int64), first[i + 1 : n] - first[i + 1])[rest - i - 1]
        mark[own] = 0
        for j in rest[100 * both >= percent * (sizes[i] + sizes[rest] - both)]:
            if root[i] != root[j]:
                out.append((max(ids[i], ids[j]), min(ids[i], ids[j])))
                a, b = min(root[i], root[j]), max(root[i], root[j])
                root[root == b] = a
    return out


def links(docs: DataFrame, reps: DataFrame, k: int, percent: int, trees: int, id_col: str, text_col: str, leaf_rows: int = LEAF_ROWS, leaf_shingles: int = LEAF_SHINGLES) -> DataFrame:
    """(c, p), p < c: links between classes that span their components."""

    def shared(batches):
        for r in runs(batches):
            if r.num_rows > 1:
                yield r

    at = leaves(reps, trees, leaf_rows, leaf_shingles).repartition("leaf").sortWithinPartitions("leaf").mapInArrow(shared, "leaf long, id long")

    def hopeful(batches):
        for r in runs(batches):
            sketches = np.frombuffer(b"".join(x.as_py() for x in r.column(3)), np.uint8).reshape(-1, SLOTS)
            if (keep := _hopeful(sketches, np.asarray(r.column(2)), percent)).any():
                ids = np.asarray(r.column(1))[keep]
                same = mix(mix(ids.view(U)).sum(dtype=U, keepdims=True)).view(np.int64)  # leaves of several trees that hold the same rows are one
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(same, len(ids))), pa.array(ids)], names=["leaf", "id"])

    near = at.join(reps.select("id", "n", "sketch"), "id").select("leaf", "id", "n", "sketch").repartition("leaf").sortWithinPartitions("leaf").mapInArrow(hopeful, "leaf long, id long")
    near = stored(near.distinct())
    wanted = near.select(F.col("id").alias("k")).distinct()
    sent = docs.sparkSession.sparkContext.broadcast(bloom(wanted, wanted.count()))

    def sets(batches):
        for b in sliced(batches):
            ids = np.asarray(b.column(0)).view(U)
            b = b.filter(pa.array(bloom_has(sent.value, ids)))
            got = [(b.column(0)[row].as_py(), own.tobytes()) for row, own in shingle_sets(texts(b.column(1)), k) if len(own)]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in got], pa.int64()), pa.array([x[1] for x in got], pa.binary())], names=["id", "tokens"])

    full = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null").mapInArrow(sets, "id long, tokens binary")

    def verified(batches):
        for r in runs(batches):
            tokens, ids = [np.frombuffer(x.as_py(), U) for x in r.column(2)], np.asarray(r.column(1))
            if len(ids) > 1:
                found = [x for x in _forest(ids, tokens, percent) if x[0] != x[1]]
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["c", "p"])

    return near.join(full, "id").select("leaf", "id", "tokens").repartition("leaf").sortWithinPartitions("leaf").mapInArrow(verified, "c long, p long").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, root): the smallest id reachable from each id that has a smaller one. edges: (c, p), p < c.

    A round points all parents of a node at its least one, then each node at its parent's least parent;
    path lengths halve, so rounds grow with the logarithm of a component's diameter.
    """
    edges = stored(edges)
    for _ in range(rounds):
        least = edges.groupBy("c").agg(F.min("p").alias("m"))
        moved = edges.join(least, "c")
        down = moved.select("c", F.col("m").alias("p")).unionByName(moved.where("p > m").select(F.col("p").alias("c"), F.col("m").alias("p"))).distinct()
        up = down.groupBy("c").agg(F.min("p").alias("m")).select(F.col("c").alias("p"), "m")
        edges = stored(down.join(up, "p", "left").select("c", F.coalesce("m", "p").alias("p"), F.col("m").isNotNull().alias("moved")).groupBy("c", "p").agg(F.max("moved").alias("moved")))
        twice = edges.groupBy("c").agg(F.count("*").alias("n"), F.max("moved").alias("moved")).where("n > 1 or moved")
        if not twice.head(1):
            return edges.select(F.col("c").alias("id"), F.col("p").alias("root"))
        edges = edges.select("c", "p")
    raise RuntimeError("components did not settle")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text", leaf_rows: int = LEAF_ROWS, leaf_shingles: int = LEAF_SHINGLES) -> DataFrame:
    """(id, n_shingles, component_id, kept) of each row of docs; links are Jaccard similarities of at least percent / 100."""
    trees = trees_for(percent, recall)
    rows = stored(signatures(docs, k, trees, id_col, text_col))
    classes = stored(rows.where("n > 0 and id is not null").groupBy("f1", "f2", "n").agg(F.min("id").alias("rep")))
    chosen = rows.where("n > 0").join(classes.select(F.col("rep").alias("id"), "f1", "f2", "n"), ["id", "f1", "f2", "n"], "left_semi").dropDuplicates(["id", "f1", "f2"])
    found = links(docs, chosen.select("id", "n", "paths", "sketch"), k, percent, trees, id_col, text_col, leaf_rows, leaf_shingles)
    same_id = rows.where("n > 0 and id is not null").join(classes, ["f1", "f2", "n"]).groupBy("id").agg(F.min("rep").alias("p"), F.max("rep").alias("c")).where("p < c").select("c", "p")
    roots = components(found.unionByName(same_id))
    of_class = classes.join(roots.withColumnRenamed("id", "rep"), "rep", "left").select("f1", "f2", "n", F.coalesce("root", "rep").alias("root"))
    out = rows.select("id", "n", "f1", "f2").join(of_class, ["f1", "f2", "n"], "left")
    component = F.when(F.col("id").isNotNull(), F.least(F.coalesce("root", "id"), F.col("id")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows whose component has a smaller id; all columns stay."""
    name = fresh("gone", docs)
    gone = near_duplicates(docs.select(id_col, text_col), k, percent, id_col=id_col, text_col=text_col).where("not kept").select(F.col(id_col).alias(name)).distinct()
    return docs.join(gone, F.col(id_col) == F.col(name), "left_anti")


def op6_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), k=3, percent=85)


OP6_SQL = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i : i + 2], ' ')) end) as g from w),
n as (select doc_id, count(*) as n from s group by doc_id),
c as (select a.doc_id as x, b.doc_id as y, count(*) as common from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by all),
e as (select x, y from c join n p on p.doc_id = x join n q on q.doc_id = y where 100 * common >= 85 * (p.n + q.n - common)),
r(doc_id, to_id) as (select doc_id, doc_id from documents union select r.doc_id, e.y from r join e on e.x = r.to_id)
select d.doc_id, coalesce(n.n, 0) as n_shingles, min(r.to_id) as component_id, d.doc_id = min(r.to_id) as kept
from documents d left join n using (doc_id) join r using (doc_id) group by d.doc_id, n.n
"""
