"""SentencePiece encoding and decoding by a max-plus scan over chunks.

A segmentation is a path of pieces; its weight is the sum of its edges' weights, -inf where an edge is
not allowed. For a unigram model an edge weighs the piece's score, so the best path is the model's. For a
BPE model an edge weighs 0 if the two pieces, merged by rank on their own, come out as these two, else -inf:
exactly one path is left, the one that merging the whole text gives.

A text is cut into chunks at any position. The states of a cut are the pieces that may lie over it, known from the
characters beside it alone. A chunk yields its transfer matrix from the states of its left cut to those of its
right cut. Matrices combine associatively under (max, +): those of a block of chunks become one, the scan over a document's blocks gives
the states at their borders, the scan inside each block those at its cuts, and each chunk is then traced back on its own between its two states. A document of one chunk has one
state at either end. Where no piece can cross (before a blank, or between a letter and a mark, in the usual vocabularies), all states meet in one; the
stretches between such places are remembered, with a bounded memory.

Models: identity normalisation, a blank put before the text, blanks kept (else ValueError). Characters outside the
vocabulary become their UTF-8 bytes, or one unknown piece for a run where the model has no bytes.

Cases. Null or empty text: no ids; decoding no ids (or null) gives the empty text. Rows are independent: repeated rows,
null ids and other columns pass. Empty tables give empty results. The literal character U+2581 decodes to a blank, as the
format has it.
"""

from __future__ import annotations

import functools
import hashlib
import math
import pickle
import re
from array import array
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import let_go
from .shared import fresh, texts

#: Characters of a chunk; a longer document is spread over tasks.
CHUNK = 1 << 16
#: Chunks whose matrices one task combines to one; the scan goes over blocks, then inside each.
BLOCK = 64
#: Stretches and pairs that one task remembers.
MEMORY = 140_000
BLANK = "▁"
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
NEVER = -math.inf


@dataclass
class Pieces:
    """What encoding and decoding need of a model; its size is the vocabulary's."""

    ids: dict[str, int]
    scores: dict[str, float]
    bytes_: dict[int, int]
    unknown: int
    decoded: list[bytes]
    unigram: bool
    longest: int = 0
    resets: bool = True  # no piece has a blank after another character
    seen: dict[str, bytes] = field(default_factory=dict)
    older: dict[str, bytes] = field(default_factory=dict)
    pairs: dict[tuple[str, str], bool] = field(default_factory=dict)

    @classmethod
    def load(cls, model_file: str) -> Pieces:
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(model_file, "rb") as f:
            model.ParseFromString(f.read())
        norm = model.normalizer_spec
        if model.trainer_spec.model_type not in (1, 2) or norm.precompiled_charsmap or not norm.add_dummy_prefix or norm.remove_extra_whitespaces or any(p.type == 4 for p in model.pieces):
            raise ValueError("only unigram and BPE models with identity normalisation, a leading blank and no user-defined symbols are supported")
        normal = [(i, p) for i, p in enumerate(model.pieces) if p.type == 1]
        decoded = [p.piece.replace(BLANK, " ").encode() if p.type == 1 else bytes([int(p.piece[3:5], 16)]) if p.type == 6 else b"" if p.type == 3 else " ⁇ ".encode() for p in model.pieces]
        return cls.of([(p.piece, i, p.score) for i, p in normal], {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == 6}, next(i for i, p in enumerate(model.pieces) if p.type == 2), decoded, model.trainer_spec.model_type == 1)

    @classmethod
    def of(cls, pieces: list[tuple[str, int, float]], bytes_: dict[int, int], unknown: int, decoded: list[bytes], unigram: bool) -> Pieces:
        ids = {p: i for p, i, _ in pieces}
        return cls(ids, {p: s for p, _, s in pieces}, bytes_, unknown, decoded, unigram, max(map(len, ids), default=1), not any(BLANK in p.lstrip(BLANK) for p in ids))

    def merged(self, s: str) -> list[str]:
        """BPE of a short string by the models' rule: best score first, leftmost of equals."""
        parts = list(s)
        while len(parts) > 1:
            best = max(((self.scores.get(a + b, NEVER), -i) for i, (a, b) in enumerate(zip(parts, parts[1:]))), default=(NEVER, 0))
            if best[0] == NEVER:
                break
            i = -best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def weight(self, before: str, piece: str) -> float:
        """Of the edge to `piece` from a path that ends in `before` (empty at the start of the text)."""
        if self.unigram:
            return self.scores.get(piece, self.floor)
        got = self.pairs.get((before, piece))
        if got is None:
            if len(self.pairs) > MEMORY:
                self.pairs.clear()
            got = self.pairs[before, piece] = self.merged(before + piece) == ([before, piece] if before else [piece])
        return 0.0 if got else NEVER

    @property
    def cutter(self) -> re.Pattern:
        if not hasattr(self, "_cutter"):
            first: dict[str, str] = {}  # of the characters that pieces join, each points towards one of its group

            def group(c: str) -> str:
                while first.setdefault(c, c) != c:
                    c = first[c]
                return c

            for p in self.ids:
                joined = p.lstrip(BLANK)
                for x, y in zip(joined, joined[1:]):
                    first[group(x)] = group(y)
            groups: dict[str, list[str]] = {}
            for c in sorted(first):
                groups.setdefault(group(c), []).append(re.escape(c))
            runs = [f"[{''.join(g)}]+" for g in sorted(groups.values(), key=len, reverse=True)]
            self._cutter = re.compile(f"{BLANK}*(?:{'|'.join([*runs[:1], f'[^{BLANK}{"".join(map(re.escape, sorted(first)))}]', *runs[1:]])})|{BLANK}+")
        return self._cutter

    @property
    def floor(self) -> float:
        if not hasattr(self, "_floor"):
            self._floor = min(self.scores.values(), default=0.0) - 10
        return self._floor

    def ending_at(self, text: str, end: int, least: int = 0) -> list[str]:
        """Pieces that may end at `end`: those of the vocabulary, and a single character outside it."""
        out = [p for j in range(max(least, end - self.longest), end) if (p := text[j:end]) in self.ids]
        return out if out and len(out[-1]) == 1 else [*out, text[end - 1 : end]]

    def states(self, text: str, cut: int) -> list[tuple[int, str]]:
        """(end, piece) of the pieces that may cover the character before the cut; (0, '') at the start."""
        if cut == 0:
            return [(0, "")]
        return [(e, p) for e in range(cut, min(len(text), cut + self.longest - 1) + 1) for p in self.ending_at(text, e) if e - len(p) < cut]

    def own(self, path: list[str]) -> list[int]:
        out: list[int] = []
        for p in path:
            if p in self.ids:
                out.append(self.ids[p])
            elif self.bytes_:
                out += [self.bytes_[b] for b in p.encode("utf-8", "surrogatepass")]
            elif not (out and out[-1] == self.unknown):
                out.append(self.unknown)
        return out

    def stretch(self, s: str) -> bytes:
        """Ids (int32) of a stretch between two places that no piece crosses."""
        got = self.seen.get(s)
        if got is None:
            got = self.older.pop(s, None) or array("i", self.own(self._single(s))).tobytes()
            if len(s) <= 64:
                if len(self.seen) > MEMORY:
                    self.older, self.seen = self.seen, {}  # what is met again comes back
                self.seen[s] = got
        return got

    def _single(self, s: str) -> list[str]:
        """The scan with one state at either end."""
        return self._best_path(s) if self.unigram else self._only_path(s)

    def _best_path(self, s: str) -> list[str]:
        n, ids = len(s), self.ids
        last = [""] * (n + 1)
        best = [0.0] + [NEVER] * n
        for end in range(1, n + 1):
            for j in range(max(0, end - self.longest), end):
                if (p := s[j:end]) in ids or j == end - 1:
                    w = best[j] + self.weight("", p)
                    if w > best[end]:
                        best[end], last[end] = w, p
        out, at = [], n
        while at:
            out.append(last[at])
            at -= len(last[at])
        return out[::-1]

    def _only_path(self, s: str) -> list[str]:
        """With weights 0 and -inf a place is reached by one path at most, so the scan may go depth first, longest piece first; a place that led nowhere is not tried again."""
        n, trie, pairs = len(s), self.trie, self.pairs
        dead = bytearray(n + 1)
        path: list[str] = []
        open_: list[list[int]] = []
        at, before = 0, ""
        while at < n:
            node, found = trie, [at + 1]
            for k in range(at, n):
                node = node.get(s[k])
                if node is None:
                    break
                if "" in node and k > at:
                    found.append(k + 1)
            open_.append(found)
            while True:
                if found:
                    end = found.pop()
                    if dead[end]:
                        continue
                    p = s[at:end]
                    ok = pairs.get((before, p))
                    if ok if ok is not None else self.weight(before, p) > NEVER:
                        path.append(p)
                        at, before = end, p
                        break
                else:
                    dead[at] = 1
                    open_.pop()
                    at -= len(path.pop())
                    before = path[-1] if path else ""
                    found = open_[-1]
        return path

    @property
    def trie(self) -> dict:
        """Nested by character; the key '' marks a piece."""
        if not hasattr(self, "_trie"):
            self._trie: dict = {}
            for p in self.ids:
                node = self._trie
                for c in p:
                    node = node.setdefault(c, {})
                node[""] = True
        return self._trie


def stretches(text: str, m: Pieces) -> list[str]:
    """The text cut before each blank that follows another character, and between characters that no chain of pieces joins."""
    return m.cutter.findall(text) if m.resets else [text]


@dataclass
class Transfer:
    """A chunk's nodes (end, piece) with their best weight from each state of the left cut, and the edges behind them."""

    starts: list[tuple[int, str]]
    ends: list[tuple[int, str]]
    matrix: np.ndarray
    nodes: dict[tuple[int, str], list[float]]
    back: dict[tuple[int, str], list[tuple[tuple[int, str], float]]]
    jumps: dict[tuple[int, str], tuple[tuple[int, str], bytes]]


def transfer(m: Pieces, text: str, lo: int, hi: int, last: bool) -> Transfer:
    """From the states at lo to those at hi; text holds m.longest characters more on either side, where there are any.

    The last chunk of a document has one state at its end: where all paths stop.
    """
    starts = m.states(text, lo)
    final = (hi, "\0end")
    ends = [final] if last else m.states(text, hi)
    nodes: dict[tuple[int, str], list[float]] = {s: [0.0 if i == k else NEVER for k in range(len(starts))] for i, s in enumerate(starts)}
    at: dict[int, list[tuple[int, str]]] = {}
    for s in starts:
        at.setdefault(s[0], []).append(s)
    back: dict = {}
    jumps: dict = {}

    def reach(node, before, w):
        new = [x + w for x in nodes[before]]
        if node in nodes:
            nodes[node] = [max(a, b) for a, b in zip(nodes[node], new)]
        else:
            nodes[node] = new
            at.setdefault(node[0], []).append(node)
        back.setdefault(node, []).append((before, w))

    e = lo
    stop = hi if last else hi + m.longest - 1
    while e < min(stop, len(text)):
        e += 1
        # a place that no piece crosses: all nodes meet, and the next stretch, if it lies inside, is taken whole
        here = e - 1
        if m.resets and lo < here < hi and text[here] == BLANK and text[here - 1] != BLANK and at.get(here):
            meet = (here, "")
            for node in list(at[here]):
                reach(meet, node, 0.0)
            at[here] = [meet]
            nxt = here
            while nxt < hi and text[nxt] == BLANK:
                nxt += 1
            nxt = text.find(BLANK, nxt, hi)
            if nxt > 0:
                after = (nxt, "")
                nodes[after] = list(nodes[meet])
                jumps[after] = (meet, m.stretch(text[here:nxt]))
                at[nxt] = [after]
                e = nxt
                continue
        for p in m.ending_at(text, e):
            j = e - len(p)
            if j < hi:
                for before in at.get(j, ()):
                    if j >= lo and (w := m.weight(before[1], p)) > NEVER:
                        reach((e, p), before, w)
    if last:
        for node in list(at.get(hi, ())):
            reach(final, node, 0.0)
    matrix = np.array([[nodes[e][i] if e in nodes else NEVER for e in ends] for i in range(len(starts))])
    return Transfer(starts, ends, matrix, nodes, back, jumps)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of two transfer matrices under (max, +)."""
    return (a[:, :, None] + b[None, :, :]).max(1)


def scan(matrices: list[np.ndarray]) -> list[int]:
    """States at the cuts 0..n on the best path through the matrices, whose first has one row and whose last one column."""
    vectors = [np.zeros((1, 1))]
    for m in matrices:
        vectors.append(product(vectors[-1], m))
    state, out = 0, [0]
    for m, v in zip(matrices[::-1], vectors[-2::-1]):
        state = int(np.argmax(v[0] + m[:, state]))
        out.append(state)
    return out[::-1]


def trace(m: Pieces, t: Transfer, start: int, end: int) -> list[int]:
    """Ids of the pieces that begin in the chunk, on the path from one state to another."""
    node, out = t.ends[end], []
    path: list[str] = []
    while True:
        if node in t.jumps:
            out.append(m.own(path[::-1]))
            path = []
            node, ids = t.jumps[node]
            out.append(array("i", ids).tolist())
        elif node == t.starts[start] and t.nodes[node][start] == 0.0 and node not in t.back:
            break
        elif node in t.back:
            target = t.nodes[node][start]
            before = next(b for b, w in t.back[node] if t.nodes[b][start] + w == target and t.nodes[b][start] > NEVER)
            if node[1] not in ("", "\0end"):
                path.append(node[1])
            node = before
        else:
            break
    out.append(m.own(path[::-1]))
    return [i for part in reversed(out) for i in part]


def encode_bytes(m: Pieces, text: str) -> bytes:
    """Ids (int32) of a document of one chunk."""
    if not text:
        return b""
    seen, stretch = m.seen, m.stretch  # seen may become m.older meanwhile; what it tells stays right
    out = b"".join([seen.get(s) or stretch(s) for s in stretches(BLANK + text.replace(" ", BLANK), m)])
    return out if m.bytes_ else array("i", _mend(m, array("i", out).tolist())).tobytes()


def encode_text(m: Pieces, text: str) -> list[int]:
    return array("i", encode_bytes(m, text)).tolist()


def encode_chunked(m: Pieces, text: str, chunk: int) -> list[int]:
    """The distributed scheme on one text, in this process."""
    if not text:
        return []
    chunks = list(_cut(m, text, chunk))
    made = [transfer(m, *c) for c in chunks]
    states = scan([t.matrix for t in made])
    return _mend(m, [i for k, t in enumerate(made) for i in trace(m, t, states[k], states[k + 1])])


def _mend(m: Pieces, ids: list[int]) -> list[int]:
    """Runs of the unknown piece that a cut divided are one."""
    return ids if m.bytes_ else [x for i, x in enumerate(ids) if x != m.unknown or i == 0 or ids[i - 1] != m.unknown]


def _cut(m: Pieces, text: str, chunk: int):
    """(text with context, lo, hi, last) of each chunk."""
    s = BLANK + text.replace(" ", BLANK)
    for lo in range(0, len(s), chunk):
        hi, left = min(lo + chunk, len(s)), max(0, lo - m.longest)
        yield s[left : hi + m.longest], lo - left, hi - left, hi == len(s)


def _lists(rows: list[bytes]) -> pa.Array:
    """array<int> from int32 bytes."""
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(r) // 4 for r in rows)]), pa.int32()), pa.array(np.frombuffer(b"".join(rows), np.int32)))


_last: list[tuple[bytes, Pieces]] = []


def _kept(pickled: bytes) -> Pieces:
    """The model with what this worker process remembers of earlier tasks."""
    key = hashlib.blake2b(pickled).digest()
    if not _last or _last[0][0] != key:
        _last[:] = [(key, pickle.loads(pickled))]
    return _last[0][1]


def encode(docs: DataFrame, model: Pieces | str = DEFAULT_MODEL, text_col: str = "text", out: str = "ids", chunk: int = CHUNK) -> DataFrame:
    """docs with the column `out`: array<int> of piece ids of the whole text; a column of that name is replaced."""
    docs = docs if out.lower() == text_col.lower() else docs.drop(out)
    model = Pieces.load(model) if isinstance(model, str) else model
    sent = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    own: list[Pieces] = []

    def get() -> Pieces:
        if not own:
            own.append(_kept(sent.value))
        return own[0]

    long = F.coalesce(F.length(text_col), F.lit(0)) > chunk
    at = docs.columns.index(text_col)

    def whole(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                yield pa.RecordBatch.from_arrays([*part.columns, _lists([encode_bytes(get(), t.as_py()) for t in texts(part.column(at))])], names=[*part.schema.names, out])
            let_go()

    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType()))])
    short = docs.where(~long).mapInArrow(whole, schema)

    key = F.xxhash64(F.col(text_col))
    row_key, ids_key = fresh("row", docs), fresh("own_ids", docs)
    giants = docs.where(long).withColumn(row_key, key)

    def chunks(batches):
        for b in batches:
            for row, t in zip(b.column(0), texts(b.column(1))):
                for i, (s, lo, hi, last) in enumerate(_cut(get(), t.as_py(), chunk)):
                    yield pa.RecordBatch.from_pylist([{"row": row.as_py(), "i": i, "s": s, "lo": lo, "hi": hi, "last": last}], schema=pa.schema([("row", pa.int64()), ("i", pa.int64()), ("s", pa.string()), ("lo", pa.int64()), ("hi", pa.int64()), ("last", pa.bool_())]))

    cut = giants.select(F.col(row_key).alias("row"), F.col(text_col).alias("text")).dropDuplicates(["row"]).mapInArrow(chunks, "row long, i long, s string, lo long, hi long, last boolean").repartition("row", "i")

    def matrices(batches):
        for b in batches:
            for r in b.to_pylist():
                t = transfer(get(), r["s"], r["lo"], r["hi"], r["last"])
                yield pa.RecordBatch.from_pylist([{"row": r["row"], "i": r["i"], "shape": list(t.matrix.shape), "m": t.matrix.astype(np.float64).tobytes()}], schema=pa.schema([("row", pa.int64()), ("i", pa.int64()), ("shape", pa.list_(pa.int64())), ("m", pa.binary())]))

    made = cut.mapInArrow(matrices, "row long, i long, shape array<bigint>, m binary").withColumn("block", F.floor(F.col("i") / BLOCK))
    square = lambda pdf: [np.frombuffer(m).reshape([int(x) for x in s]) for m, s in zip(pdf["m"], pdf["shape"])]

    def combined(pdf):
        """A block's matrices to one."""
        pdf = pdf.sort_values("i")
        m = functools.reduce(product, square(pdf))
        return pd.DataFrame({"row": pdf["row"][:1], "i": pdf["block"].to_numpy()[:1], "shape": [list(m.shape)], "m": [np.ascontiguousarray(m).tobytes()]})

    def borders(pdf):
        """States at the borders of a document's blocks."""
        pdf = pdf.sort_values("i")
        states = scan(square(pdf))
        return pd.DataFrame({"row": pdf["row"].to_numpy(), "block": pdf["i"].to_numpy(), "a": states[:-1], "b": states[1:]})

    def inner(pdf):
        """States at the cuts inside a block, between those at its borders."""
        pdf = pdf.sort_values("i")
        a, b, ms = int(pdf["a"].iloc[0]), int(pdf["b"].iloc[0]), square(pdf)
        ms[0] = ms[0][a : a + 1]
        ms[-1] = ms[-1][:, b : b + 1]
        states = scan(ms)
        states[0], states[-1] = a, b
        return pd.DataFrame({"row": pdf["row"].to_numpy(), "i": pdf["i"].to_numpy(), "a": states[:-1], "b": states[1:]})

    at_borders = made.groupBy("row", "block").applyInPandas(combined, "row long, i long, shape array<bigint>, m binary").groupBy("row").applyInPandas(borders, "row long, block long, a long, b long")
    states = made.join(at_borders, ["row", "block"]).groupBy("row", "block").applyInPandas(inner, "row long, i long, a long, b long")

    def traced(batches):
        for b in batches:
            for r in b.to_pylist():
                m = get()
                ids = trace(m, transfer(m, r["s"], r["lo"], r["hi"], r["last"]), r["a"], r["b"])
                yield pa.RecordBatch.from_arrays([pa.array([r["row"]], pa.int64()), pa.array([r["i"]], pa.int64()), _lists([array("i", ids).tobytes()])], names=["row", "i", "part"])

    parts = cut.join(states, ["row", "i"]).mapInArrow(traced, "row long, i long, part array<int>").groupBy("row").agg(F.sort_array(F.collect_list(F.struct("i", "part"))).alias("parts"))
    ids = F.flatten(F.col("parts")["part"])
    if not model.bytes_:
        ids = F.filter(F.transform(ids, lambda x, i: F.when((x == model.unknown) & (i > 0) & (F.get(ids, i - 1) == model.unknown), F.lit(-1)).otherwise(x)), lambda x: x >= 0)
    joined = giants.join(parts.select(F.col("row").alias(row_key), ids.alias(ids_key)), row_key, "left").select(*docs.columns, F.col(ids_key).alias(out))
    return short.unionByName(joined)


def decode_ids(m: Pieces, ids: list[int]) -> str:
    s = b"".join([m.decoded[i] for i in ids]).decode("utf-8", "replace")
    return s[1:] if s.startswith(" ") else s


def decode(df: DataFrame, model: Pieces | str = DEFAULT_MODEL, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """df with the column `out`: the text that the ids stand for; a column of that name is replaced."""
    df = df if out.lower() == ids_col.lower() else df.drop(out)
    model = Pieces.load(model) if isinstance(model, str) else model
    sent, at = df.sparkSession.sparkContext.broadcast(model.decoded), df.columns.index(ids_col)

    def run(batches):
        table = sent.value
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                rows = []
                for x in part.column(at):
                    s = b"".join([table[i] for i in (x.values.to_numpy().tolist() if x.is_valid else ())]).decode("utf-8", "replace")
                    rows.append(s[1:] if s.startswith(" ") else s)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(rows, pa.string())], names=[*part.schema.names, out])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.StringType())]))


def op3_sentencepiece(spark, sf_dir: str, model_file: str = DEFAULT_MODEL) -> DataFrame:
    """Digest of the ids of each whole text, and whether decoding gives the text back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = Pieces.load(model_file)
    out = decode(encode(docs, model), model)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))
