"""LM scoring: a causal self-attention model over subword ids, trained and applied in numpy.

Words are cut into subwords of a public vocabulary, each on its own; an id of no piece ends a text and stands before its first. A window is
2 S ids: queries are the last S, keys and values all up to the query's own place, so windows overlap by S ids and each id is scored
once, with S to 2 S ids before it. Queries, keys and values are tables over ids (one layer reads nothing but ids), places count by
a bias for each distance. What attention brings, added to the last id's own vector, goes through tanh and meets the vectors of the nodes on the next id's
path in a Huffman tree: the sum of the log sigmoids along the path is the log probability, so all ids together have probability one.

The tree and its nodes' biases come from counts over all training texts: words are counted in dictionaries of blocks, which are dealt by the words' hashes, cut into subwords once, and a word's count goes
to its subwords. Attention starts from that unigram model and is trained by gradient steps (Adagrad) in the tasks, on every training text, each in one of the rounds
(`share` above 1 takes fewer); what the tasks' models changed is averaged by their numbers of ids after each round, in whole numbers, so in any order of tasks. What
reaches the driver and goes back to tasks has the vocabulary's size.

The base score takes words as units: log10((c + 1) / (N + V + 1)) summed over a text's words and its end, c, N and V counted over all training texts.

Cases. Null and empty texts are an end alone. A null id is scored, never learned from. Repeated rows are separate texts. Without training texts
all counts are 0 and all ids alike. A text of any length is scored whole. Empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

import base64
import heapq
import math
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import WHITE, coded, firsts, let_go, lowered, packed, spans, strings, unpacked
from .shared import U, bytes_of, steps, stored, texts, words

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Ids that a window scores, as many stand before; sizes of queries and of vectors.
S, KEYS, WIDTH = 16, 8, 16
#: One in so many training documents is trained on, over so many rounds, each with documents of its own: all are, unless a caller asks for less.
SHARE, ROUNDS = 1, 2
RATE = 0.24
#: Windows of a step: the least, at first, and the most, once eight times as many are done.
LEAST, BATCH = 64, 256
#: Windows scored at once; bytes of text in a block of words; parameters in a row when models are averaged.
STEP, BLOCK, ROW = 256, 24 << 20, 1 << 14
#: Training texts for each shelf of words, so that what a task counts at once stays small.
PER_SHELF = 2000
#: Nodes of the tree whose logits are worked out for all at once: most steps of most paths.
UPPER = 64
_FIXED = 1 << 24
_encodings: dict[int, object] = {}


def read_vocabulary(path: str = VOCABULARY) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def subwords(words: pa.Array | list[str], ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words, each with a blank before it, and where each word's begin (n + 1).

    Words hold no blank, so many are cut in one call: only the first subword of each begins with a blank.
    """
    import tiktoken

    if (own := _encodings.get(id(ranks))) is None:
        first = np.zeros(max(ranks.values(), default=-1) + 1, bool)
        first[[i for b, i in ranks.items() if b.startswith(b" ")]] = True
        own = _encodings[id(ranks)] = tiktoken.Encoding("words", pat_str=r" [^ ]*", mergeable_ranks=ranks, special_tokens={}), first
    encoding, first = own
    flat = [np.zeros(0, np.int32)]
    for lo in range(0, len(words), 1 << 14):  # lists of a few words at once
        part = words[lo : lo + (1 << 14)]
        flat.append(np.array(encoding.encode_ordinary(" " + " ".join(part if isinstance(part, list) else part.to_pylist())), np.int32))
    ids = np.concatenate(flat)
    return ids, np.append(np.flatnonzero(first[ids]), len(ids))


def ragged(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """begins[0], begins[0] + 1, ... sizes[0] of them, then those of the next."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(begins - ends + sizes, sizes)


@dataclass
class Tree:
    """A Huffman code: nodes and turns (1 or -1) of each id's path, from the root; the bias of each node."""

    nodes: np.ndarray
    turns: np.ndarray
    begins: np.ndarray
    sizes: np.ndarray
    bias: np.ndarray
    upper: np.ndarray  # nodes of each path that are among the heaviest, UPPER in all, which a path meets first

    @classmethod
    def of(cls, counts: np.ndarray) -> Tree:
        n = len(counts)
        weight = np.r_[counts.astype(np.float64) + 1, np.zeros(n - 1)]
        parent, turn, bias = np.zeros(2 * n - 1, np.int64), np.zeros(2 * n - 1, np.int8), np.zeros(max(n - 1, 1), np.float32)
        heap = [(w, i) for i, w in enumerate(weight[:n].tolist())]
        heapq.heapify(heap)
        for new in range(n, 2 * n - 1):
            (a, i), (b, j) = heapq.heappop(heap), heapq.heappop(heap)
            parent[i] = parent[j] = new
            turn[i], turn[j] = 1, -1
            bias[new - n] = math.log(a / b)
            weight[new] = a + b
            heapq.heappush(heap, (a + b, new))
        paths, turns, at, live = [], [], np.arange(n), np.arange(n)
        sizes = np.zeros(n, np.int64)
        while len(live):  # from the leaves up, all ids at once
            inner = at[live] != 2 * n - 2
            live = live[inner]
            paths.append((live, parent[at[live]] - n, turn[at[live]]))
            sizes[live] += 1
            at[live] = parent[at[live]]
        begins = np.cumsum(sizes) - sizes
        nodes, turns = np.zeros(int(sizes.sum()), np.int32), np.zeros(int(sizes.sum()), np.float32)
        for up, (ids, node, turned) in enumerate(paths):
            where = begins[ids] + sizes[ids] - 1 - up
            nodes[where], turns[where] = node, turned
        ends = np.r_[0, np.cumsum(nodes >= len(bias) - UPPER)]  # nodes are numbered by weight
        return cls(nodes, turns, begins, sizes, bias, ends[begins + sizes] - ends[begins])

    @cached_property
    def heads(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Upper nodes of each id's path, counted from the first upper one; turns; turned biases. Short rows are filled up with a node
        behind the last, which adds nothing; so is a last row of no id."""
        most, low = int(self.upper.max(initial=0)), max(len(self.bias) - UPPER, 0)
        inner = np.arange(most) < np.append(self.upper, 0)[:, None]
        at = np.where(inner, np.append(self.begins, 0)[:, None] + np.arange(most), 0)
        turns = np.where(inner, self.turns.take(at), np.float32(0))
        nodes = self.nodes.take(at)
        return np.where(inner, nodes.astype(np.int64) - low, len(self.bias) - low), turns, np.where(inner, turns * self.bias.take(nodes), np.float32(_SURE))

    @cached_property
    def tails(self) -> tuple[np.ndarray, np.ndarray]:
        """Where the nodes below the upper ones begin on each id's path, and how many there are; a last row of no id has none."""
        return np.append(self.begins + self.upper, 0), np.append(self.sizes - self.upper, 0)


def windows(ids: np.ndarray, sizes: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Inputs and targets (windows, S) of texts of so many ids, ends included; target -1 beyond a text; whether a window is its text's first; its text."""
    n = -(-sizes // S)
    first = np.cumsum(n) - n
    at = ragged(first * S, sizes)
    x, y = np.full(int(n.sum()) * S, end, np.int32), np.full(int(n.sum()) * S, -1, np.int32)
    y[at] = ids
    inner = np.ones(len(at), bool)
    inner[np.cumsum(sizes) - sizes] = False
    x[at[inner]] = ids[np.flatnonzero(inner) - 1]
    begins = np.zeros(int(n.sum()), bool)
    begins[first] = True
    return x.reshape(-1, S), y.reshape(-1, S), begins, np.repeat(np.arange(len(sizes)), n)


#: Distance of each key of a window from each query; keys behind the query's own place are out.
_DISTANCE = S + np.arange(S)[:, None] - np.arange(2 * S)[None, :]
_IN = (_DISTANCE >= 0).astype(np.float32)
_DISTANCE = np.maximum(_DISTANCE, 0)
#: Logits are held within these, so that no exponential overflows.
_LOGITS = np.float32(60)
#: A turned logit whose sigmoid is 1 to the last digit; exponents are held within it.
_SURE = 80


class Model:
    """Parameters by name, as float32 arrays."""

    def __init__(self, tree: Tree, parameters: dict[str, np.ndarray]):
        self.tree, self.p = tree, parameters

    @classmethod
    def fresh(cls, counts: np.ndarray, keys: int = KEYS, width: int = WIDTH, seed: int = 1) -> Model:
        """A model that gives ids their share of the counts, whatever stands before."""
        r, n = np.random.default_rng(seed), len(counts)
        some = lambda *shape: (r.standard_normal(shape) / math.sqrt(shape[0] if shape[0] < n else 4)).astype(np.float32)
        p = {"ids": some(n, width), "query": some(width, keys), "key": some(width, keys), "value": some(width, width), "own": some(width, width), "place": np.zeros(2 * S, np.float32), "nodes": np.zeros((max(n - 1, 1), width), np.float32)}
        return cls(Tree.of(counts), p)

    def tables(self) -> np.ndarray:
        """Query, key, value and own vector of each id, beside each other."""
        p = self.p
        scale = np.float32(1 / math.sqrt(p["query"].shape[1]))
        return np.ascontiguousarray(np.concatenate([p["ids"] @ (p["query"] * scale), p["ids"] @ p["key"], p["ids"] @ p["value"], p["ids"] @ p["own"]], axis=1))

    def attend(self, rows: np.ndarray, begins: np.ndarray):
        """Masked attention of windows. rows: tables' rows of the ids of the window before the first, and of all; gives h and what led to it."""
        k, w = self.p["query"].shape[1], self.p["own"].shape[0]
        n = len(begins)
        pair = lambda a: np.lib.stride_tricks.as_strided(a, (n, 2 * S, a.shape[1]), (S * a.strides[0], *a.strides))
        q, own = rows[S:, :k].reshape(n, S, k), rows[S:, 2 * k + w :]
        keys, values = pair(rows[:, k : 2 * k]), pair(rows[:, 2 * k : 2 * k + w])
        a = q @ keys.transpose(0, 2, 1)
        np.clip(a, -_LOGITS, _LOGITS, out=a)
        np.exp(a, out=a)
        a *= np.exp(self.p["place"])[_DISTANCE] * _IN
        a[begins, :, :S] = 0
        total = (a.reshape(-1, 2 * S) @ np.ones(2 * S, np.float32)).reshape(n, S, 1)
        mixed = a @ values
        mixed /= total
        h = mixed.reshape(n * S, w) + own
        return np.tanh(h, out=h), a, total, mixed, q, keys, values

    def slopes(self, h: np.ndarray, y: np.ndarray):
        """Gradients of the log probability of the ids y (-1: none) after h: that of h, and (nodes, gradients) for the upper nodes and for those below.

        Upper nodes are met by most steps, so theirs are products of whole matrices. Steps below are worked out by their place on
        the paths, and ids with most of them come first: those that have a step of some place are then a run from the first on.
        """
        t, low = self.tree, max(len(self.tree.bias) - UPPER, 0)
        begins, sizes = t.tails
        below = sizes.take(y)
        order = np.argsort((len(t.bias) - below).astype(_least(len(t.bias))), kind="stable")
        h, y, below = h.take(order, 0), y.take(order), below.take(order)
        top = self._top(low)
        node, turn, bias = (x.take(y, 0) for x in t.heads)
        node += np.arange(0, len(y) * len(top), len(top))[:, None]
        g = h @ top.T
        z = g.ravel().take(node)
        z *= turn
        z += bias
        g.fill(0)
        g.ravel()[node] = self._pull(z, turn)
        dh, above = g @ top, (g.T @ h)[:-1]
        with_ = len(y) - np.cumsum(np.bincount(below))[:-1]  # ids with more than 0, 1, ... steps
        of = ragged(np.zeros(len(with_), np.int64), with_)
        at = begins.take(y).take(of)
        at += np.repeat(np.arange(len(with_)), with_)
        node, turn = t.nodes.take(at), t.turns.take(at)
        own, rows = self.p["nodes"].take(node, 0), h.take(of, 0)
        z = np.einsum("ij,ij->i", own, rows)
        z += t.bias.take(node)
        z *= turn
        steep = self._pull(z, turn)[:, None]
        own *= steep
        rows *= steep
        lo = 0
        for n in with_.tolist():
            dh[:n] += own[lo : lo + n]
            lo += n
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return dh.take(back, 0), (slice(low, low + len(top) - 1), above), _summed(node, rows, len(t.bias))

    def _top(self, low: int) -> np.ndarray:
        """Vectors of the upper nodes, and of the one behind the last that fills paths up."""
        nodes = self.p["nodes"][low : len(self.tree.bias)]
        return np.concatenate([nodes, np.zeros_like(nodes[:1])])

    def _pull(self, z: np.ndarray, turn: np.ndarray) -> np.ndarray:
        """Slope of the log sigmoids of turned logits, in their place."""
        np.minimum(z, _SURE, out=z)
        np.exp(z, out=z)
        z += 1
        return np.divide(turn, z, out=z)

    def surprise(self, h: np.ndarray, y: np.ndarray) -> np.ndarray:
        """-log probability of each of the ids y (-1: none, 0) after h."""
        t, low = self.tree, max(len(self.tree.bias) - UPPER, 0)
        top = self._top(low)
        node, turn, bias = (x.take(y, 0) for x in t.heads)
        node += np.arange(0, len(y) * len(top), len(top))[:, None]
        z = (h @ top.T).ravel().take(node)
        z *= turn
        z += bias
        out = self._cost(z) @ np.ones(z.shape[1], np.float32)
        begins, sizes = t.tails
        below = sizes.take(y)
        of = np.repeat(np.arange(len(y)), below)
        at = ragged(begins.take(y), below)
        node = t.nodes.take(at)
        z = np.einsum("ij,ij->i", self.p["nodes"].take(node, 0), h.take(of, 0))
        z += t.bias.take(node)
        z *= t.turns.take(at)
        return out + np.bincount(of, self._cost(z), len(y))

    def _cost(self, z: np.ndarray) -> np.ndarray:
        """-log sigmoid of turned logits, in their place."""
        np.negative(np.maximum(z, -_SURE, out=z), out=z)
        np.exp(z, out=z)
        z += 1
        return np.log(z, out=z)

    def score(self, ids: np.ndarray, sizes: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """log10 probability of each text."""
        x, y, begins, text = windows(ids, sizes, len(tables) - 1)
        out = np.zeros(len(sizes))
        before = np.full(S, len(tables) - 1, np.int32)
        for lo in range(0, len(x), STEP):
            part = slice(lo, lo + STEP)
            rows = tables.take(np.r_[before, x[part].ravel()], 0)
            before = x[part][-1]
            of = text[part]
            cuts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
            out[of[cuts]] -= np.add.reduceat(self.surprise(self.attend(rows, begins[part])[0], y[part].ravel()), cuts * S)
        return out / math.log(10)

    def train(self, ids: np.ndarray, sizes: np.ndarray, grown: dict[str, np.ndarray], rate: float = RATE) -> None:
        """Gradient steps over all windows of the texts; grown: sums of squared gradients."""
        p, shared = self.p, ["query", "key", "value", "own"]
        k, w = p["query"].shape[1], p["own"].shape[0]
        cuts = np.cumsum([k, k, w])
        scale = np.repeat(np.array([1 / math.sqrt(k), 1], np.float32), [k, k + 2 * w])
        weights, squares = (np.concatenate([x[name] for name in shared], axis=1) for x in (p, grown))
        x, y, begins, _ = windows(ids, sizes, len(p["ids"]) - 1)
        before = np.full(S, len(p["ids"]) - 1, np.int32)
        lo = 0
        while lo < len(x):
            part = slice(lo, lo := lo + min(BATCH, max(LEAST, lo // 8)))
            own = np.concatenate([before, x[part].ravel()])
            before = x[part][-1]
            e, scaled = p["ids"].take(own, 0), weights * scale
            h, a, total, mixed, q, keys, values = self.attend(e @ scaled, begins[part])
            dh, above, below = self.slopes(h, y[part].ravel())
            h *= h
            dh *= np.subtract(1, h, out=h)
            do = dh.reshape(mixed.shape)
            mixed *= do
            do = do / total
            da = do @ values.transpose(0, 2, 1)
            da -= (mixed.reshape(-1, w) @ np.ones(w, np.float32)).reshape(total.shape) / total
            da *= a
            rows = np.empty((len(own), 2 * k + 2 * w), h.dtype)
            rows[:S] = 0
            inner = rows[S:].reshape(len(a), S, -1)
            np.matmul(da, keys, out=inner[:, :, :k])
            of_keys = np.empty((len(a), 2 * S, k + w), h.dtype)
            np.matmul(da.transpose(0, 2, 1), q, out=of_keys[:, :, :k])
            np.matmul(a.transpose(0, 2, 1), do, out=of_keys[:, :, k:])
            inner[:, :, k : 2 * k + w] = of_keys[:, S:]
            inner[:, :, 2 * k + w :] = dh.reshape(do.shape)
            rows[:-S].reshape(inner.shape)[:, :, k : 2 * k + w] += of_keys[:, :S]
            far = np.bincount(_DISTANCE.ravel(), da.sum(axis=0).ravel(), 2 * S).astype(np.float32)
            _step(weights, squares, ..., (e.T @ rows) * scale, rate)
            for name, at, d in (("nodes", *above), ("nodes", *below), ("ids", *_summed(own, rows @ scaled.T, len(p["ids"]))), ("place", ..., far)):
                _step(p[name], grown[name], at, d, rate)
        for name, new, sums in zip(shared, np.split(weights, cuts, axis=1), np.split(squares, cuts, axis=1)):
            p[name], grown[name] = np.ascontiguousarray(new), np.ascontiguousarray(sums)


def _step(p: np.ndarray, grown: np.ndarray, at, d: np.ndarray, rate: float) -> None:
    """A step of Adagrad at some rows, in place; d: their gradients."""
    d = np.clip(d, -8, 8)
    sums = grown[at] + d * d
    grown[at] = sums
    sums += 1e-6
    d *= rate
    d /= np.sqrt(sums)
    p[at] += d


def _least(most: int):
    """The unsigned type for numbers up to `most`: numpy sorts two bytes by digits."""
    return np.uint16 if most < 1 << 16 else np.uint32


def _summed(at: np.ndarray, rows: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct `at`, all under `most`, and the sums of the rows of each."""
    if not len(at):
        return at, rows[:0]
    order = np.argsort(at.astype(_least(most)), kind="stable")
    at = at.take(order)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return at.take(first), np.add.reduceat(rows.take(order, 0), first)


def text_blocks(docs: DataFrame, ranks, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, share: int = SHARE, rounds: int = ROUNDS, shelves: int = 16) -> DataFrame:
    """(block, code, n, words, ends, counts, codes, sizes, ids, held, turns, given, lengths): the block's dictionary on shelves by the words' hashes, and a row with code -1 for the texts themselves.

    A shelf (its number is code) holds words' bytes one after another, their lengths, codes, and counts in training texts, whose sum is n.
    Training texts are those whose crc32(id as text) mod 7 is not 2; texts of that remainder are held out. turns: the round that trains on a text, or -1.
    given, lengths: subwords of the dictionary's words, so that words are cut once.
    """

    def make(batches):
        number = TaskContext.get().partitionId() << 12
        last, parts, size = number + 4095, [], 0

        def flush():
            nonlocal number, parts, size
            if not parts:
                return
            if number > last:
                raise ValueError("too many blocks in one partition; read smaller partitions")
            own, distinct = coded(pa.concat_arrays([x[1] for x in parts]))  # dictionaries of steps become one
            first = np.cumsum([0, *(len(x[1]) for x in parts)])
            code = np.concatenate([own[at + x[0]] for at, x in zip(first, parts)])
            sizes, part, turns = (np.concatenate([x[i] for x in parts]) for i in (2, 4, 5))
            ids = pa.concat_arrays([x[3] for x in parts])
            parts, size, k = [], 0, len(distinct)
            n = np.bincount(code[np.repeat(part == 0, sizes)], minlength=k)
            data, at = bytes_of(texts(distinct))
            shelf = words(data, at)[2] % U(shelves) if k else np.zeros(0, U)
            order = np.argsort(shelf.astype(np.uint16 if shelves <= 1 << 16 else np.uint32), kind="stable")
            first = firsts(shelf[order])
            cuts, size_, kept = np.append(first, k), np.diff(at)[order].astype(np.int32), distinct.take(pa.array(order))
            sums = np.add.reduceat(n[order], first) if k else n
            columns = [*(_shelved(x, cuts) for x in (size_, order.astype(np.int32), n[order].astype(np.int64)))]
            held_ = _shelved(bytes_of(texts(kept))[0], np.append(0, np.cumsum(size_, dtype=np.int64))[cuts])
            none = [pa.nulls(len(first), t) for t in (pa.binary(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.binary(), pa.binary(), pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(first), number)), pa.array(shelf[order][first].astype(np.int32)), pa.array(sums.astype(np.int64)), held_, columns[0], columns[2], columns[1], *none], names=names)
            del n, columns, held_, kept, none
            given, begins = subwords(distinct, ranks.value)
            lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (ids, pa.array(part == 1))]
            kept = [pa.array([x], pa.binary()) for x in (turns.astype(np.int32).tobytes(), packed(given), packed(np.diff(begins)))]
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([-1], pa.int32()), pa.array([0]), *(pa.nulls(1, pa.binary()) for _ in range(3)), pa.array([packed(code)], pa.binary()), pa.array([sizes.astype(np.int64).tobytes()], pa.binary()), *lists, *kept], names=names)
            number += 1

        for b in batches:
            column, ids, part, turns = texts(b.column(0)), b.column(1), np.asarray(b.column(2)), np.asarray(b.column(3))
            for lo, hi, data, offsets in steps(column, 4 << 20):
                data = lowered(data)
                starts, ends = spans(data, offsets, WHITE)
                parts.append((*coded(strings(data, WHITE, starts, ends)), np.diff(np.searchsorted(starts, offsets)), ids.slice(lo, hi - lo), part[lo:hi], turns[lo:hi]))
                size += len(data)
                if size > block:
                    yield from flush()
        yield from flush()
        let_go()

    names = ["block", "code", "n", "words", "ends", "counts", "codes", "sizes", "ids", "held", "turns", "given", "lengths"]
    rest = F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(7))
    picked, dealt = F.xxhash64(id_col, F.lit(12)), F.xxhash64(id_col, F.lit(13))
    turn = F.when((rest != 2) & (F.pmod(picked, F.lit(share)) == 0), F.pmod(dealt, F.lit(rounds))).otherwise(-1)
    columns = docs.select(F.col(text_col).cast("string"), F.col(id_col).cast("long"), F.when(rest == 2, 1).when(rest.isNull(), 2).otherwise(0).cast("int"), turn.cast("int"))
    return columns.mapInArrow(make, "block long, code int, n long, words binary, ends binary, counts binary, codes binary, sizes binary, ids array<bigint>, held array<boolean>, turns binary, given binary, lengths binary")


def _shelved(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """The values between each two cuts as bytes."""
    at, values = pa.py_buffer(cuts.astype(np.int64) * values.itemsize), np.ascontiguousarray(values)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts) - 1, [None, at, pa.py_buffer(values)]).cast(pa.binary())


def word_counts(blocks: DataFrame) -> DataFrame:
    """(block, codes, c, v): for each shelf of a block, its words' codes and counts in all training texts; v, on one row of a shelf: how many words have any."""

    def count(shelf: pa.Table) -> pa.Table:
        data, ends, n = (pa.concat_arrays([c.cast(pa.large_binary()) for c in shelf.column(x).chunks]) for x in ("words", "ends", "counts"))
        sizes, n = (np.frombuffer(b"".join(x.to_pylist()), t) for x, t in ((ends, np.int32), (n, np.int64)))
        at = np.append(0, np.cumsum(sizes, dtype=np.int64))
        code, distinct = coded(pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(at), pa.py_buffer(b"".join(data.to_pylist()))))
        total = np.zeros(len(distinct), np.int64)
        np.add.at(total, code, n)
        cuts = np.append(0, np.cumsum([len(x) // 4 for x in ends.to_pylist()]))
        v = np.zeros(len(cuts) - 1, np.int64)
        v[:1] = np.count_nonzero(total)
        return pa.table({"block": shelf.column("block"), "codes": shelf.column("codes"), "c": _shelved(total[code], cuts), "v": v})

    kept = blocks.where("code >= 0").select("code", "block", "words", "ends", "counts", "codes")
    return kept.groupBy("code").applyInArrow(count, "block long, codes binary, c binary, v long")


def subword_counts(blocks: DataFrame, n_ids: int) -> np.ndarray:
    """How often each id stands in the training texts, ends left out."""

    def count(batches):
        total = np.zeros(n_ids, np.int64)
        for b in batches:
            for i in range(b.num_rows):
                ids, held = b.column("ids")[i].values, np.asarray(b.column("held")[i].values)
                sizes, code, lengths = np.frombuffer(b.column("sizes")[i].as_py(), np.int64), unpacked(b.column("codes")[i].as_py()), unpacked(b.column("lengths")[i].as_py())
                n = np.bincount(code[np.repeat(~held & np.asarray(ids.is_valid()), sizes)], minlength=len(lengths))
                np.add.at(total, unpacked(b.column("given")[i].as_py()), np.repeat(n, lengths))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["id", "n"])

    whole = blocks.where("code < 0").select("codes", "sizes", "ids", "held", "given", "lengths")
    got = whole.mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(n_ids, np.int64)
    out[np.asarray(got.column("id"))] = np.asarray(got.column("n"))
    return out


def _of_block(codes: bytes, sizes: bytes, given: bytes, lengths: bytes, end: int, wanted: np.ndarray | None = None, most: int = 1 << 17):
    """(ids, sizes) of a block's wanted texts in their order, about `most` words at once."""
    code, sizes, ids, at = unpacked(codes), np.frombuffer(sizes, np.int64), unpacked(given), np.r_[0, np.cumsum(unpacked(lengths), dtype=np.int64)]
    if wanted is not None:
        code, sizes = code[np.repeat(wanted, sizes)], sizes[wanted]
    first, lo = np.r_[0, np.cumsum(sizes)], 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(first, first[lo] + most, "right")) - 1)
        yield _expanded(code[first[lo] : first[hi]], sizes[lo:hi], ids, at, end)
        lo = hi


def _ids_of(column: pa.Array, ranks: dict[bytes, int], end: int):
    """(ids, sizes) of runs of texts, ends included."""
    for _, _, data, offsets in steps(column):
        data = lowered(data)
        starts, ends = spans(data, offsets, WHITE)
        code, distinct = coded(strings(data, WHITE, starts, ends))
        yield _expanded(code, np.diff(np.searchsorted(starts, offsets)), *subwords(distinct, ranks), end)


def _expanded(code: np.ndarray, sizes: np.ndarray, ids: np.ndarray, at: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of texts given as codes of words, with an end after each, and how many each has."""
    ids, at = np.r_[ids, np.int32(end)], np.r_[at, at[-1] + 1]
    code = np.insert(code.astype(np.int64), np.cumsum(sizes), len(at) - 2)
    lengths = np.diff(at)[code]
    total = np.r_[0, np.cumsum(lengths)]
    places = np.r_[0, np.cumsum(sizes + 1)]
    return ids[ragged(at[code], lengths)], np.diff(total[places])


def trained(model: Model, sample: DataFrame, ranks, rounds: int = ROUNDS) -> Model:
    """The model after `rounds` rounds over (text, round), each averaged over tasks."""

    def read(batches, end: int):
        for b in batches:
            yield from _ids_of(texts(b.column(0)), ranks.value, end)

    for turn in range(rounds):
        model = averaged(model, sample.where(F.col("round") == turn).select("text"), read)
    return model


def averaged(model: Model, part: DataFrame, read) -> Model:
    """The model after steps over a table in tasks, averaged over them; read(batches, end) gives (ids, sizes) of runs of texts."""
    names = list(model.p)
    sent = part.sparkSession.sparkContext.broadcast(model)

    def local(batches):
        old = sent.value.p
        own = Model(sent.value.tree, {k: v.copy() for k, v in old.items()})
        grown, seen = {k: np.zeros_like(v) for k, v in own.p.items()}, 0
        for ids, sizes in read(batches, len(own.p["ids"]) - 1):
            own.train(ids, sizes, grown)
            seen += len(ids)
        if seen:
            flat = np.rint(np.concatenate([own.p[k].ravel().astype(np.float64) - old[k].ravel() for k in names]) * _FIXED).astype(np.int64)
            rows = range(0, len(flat), ROW)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int64()), pa.array([seen] * len(rows)), pa.array([_planes(flat[i : i + ROW]) for i in rows], pa.binary())], names=["row", "n", "v"])
        let_go()

    def fold(batches):
        sums: dict[int, list] = {}  # a partition's rows of parameters; their number is bounded by the model
        for b in batches:
            for row, n, v in zip(*(c.to_pylist() for c in b.columns)):
                s = sums.setdefault(row, [0, 0])
                high, low = np.divmod(_whole(v), 1 << 20)
                s[0] += n
                s[1] = s[1] + np.stack([high, low]).astype(np.int64) * n
        for row, (n, (high, low)) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([row]), pa.array([((high * float(1 << 20) + low) / n / _FIXED).tobytes()], pa.binary())], names=["row", "v"])

    moved = part.mapInArrow(local, "row long, n long, v binary")
    got = moved.repartition("row").mapInArrow(fold, "row long, v binary").toArrow()  # the size of one model
    if not got.num_rows:
        return model
    flat = np.concatenate([np.frombuffer(v, np.float64) for _, v in sorted(zip(got.column("row").to_pylist(), got.column("v").to_pylist()))])
    cuts = np.cumsum([model.p[k].size for k in names])[:-1]
    sent.unpersist()
    return Model(model.tree, {k: (model.p[k] + x.reshape(model.p[k].shape)).astype(np.float32) for k, x in zip(names, np.split(flat, cuts))})


def _planes(values: np.ndarray) -> bytes:
    """Whole numbers as compressed bytes, the eight bytes of each apart: most are small."""
    return len(values).to_bytes(8, "little") + pa.compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T).tobytes(), "zstd", asbytes=True)


def _whole(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(pa.decompress(data[8:], 8 * n, "zstd", asbytes=True), np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).view(np.int64).reshape(n)


def scores(docs: DataFrame, vocabulary: str = VOCABULARY, share: int = SHARE, rounds: int = ROUNDS, block: int = BLOCK) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document; held_out is false for a null id."""
    spark = docs.sparkSession
    read = read_vocabulary(vocabulary)
    end = max(read.values(), default=-1) + 1
    ranks = spark.sparkContext.broadcast(read)  # the vocabulary file
    docs = docs.select("doc_id", "text")
    n_texts = docs.where(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) != 2).count()
    blocks = stored(text_blocks(docs, ranks, block=block, share=share, rounds=rounds, shelves=1 + n_texts // PER_SHELF))
    counts = stored(word_counts(blocks))
    n_words, v_words = (df.agg(F.coalesce(F.sum(c), F.lit(0))).first()[0] for df, c in ((blocks, "n"), (counts, "v")))
    total, distinct = n_words + n_texts, v_words + (n_texts > 0)
    ids = subword_counts(blocks, end + 1)
    ids[end] = n_texts
    whole = blocks.where("code < 0")

    def training(turn: int):
        def read(batches, end: int):
            for b in batches:
                for i in range(b.num_rows):
                    *own, turns = (c[i].as_py() for c in b.columns)
                    yield from _of_block(*own, end, np.frombuffer(turns, np.int32) == turn)

        return read

    model = Model.fresh(ids)
    for turn in range(rounds):
        model = averaged(model, whole.select("codes", "sizes", "given", "lengths", "turns"), training(turn))
    model = spark.sparkContext.broadcast(model)

    def by_model(batches):
        m = model.value
        tables = m.tables()
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1)
                got = [m.score(*run, tables) for run in _of_block(*(row.column(c)[0].as_py() for c in ("codes", "sizes", "given", "lengths")), end)]
                score = pa.array(np.concatenate(got))
                yield pa.RecordBatch.from_arrays([*(row.column(c) for c in kept), pa.ListArray.from_arrays(pa.array([0, len(score)], pa.int32()), score)], names=[*kept, "scores"])
        let_go()

    def by_counts(key, left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for row in left.to_batches():
            for i in range(row.num_rows):
                code, sizes = unpacked(row.column("codes")[i].as_py()), np.frombuffer(row.column("sizes")[i].as_py(), np.int64)
                c = np.zeros(int(code.max(initial=-1)) + 2, np.int64)  # every code of a block stands in its texts
                for codes, of in zip(*(right.column(x).to_pylist() for x in ("codes", "c"))):
                    c[np.frombuffer(codes, np.int32)] = np.frombuffer(of, np.int64)
                c[-1] = n_texts
                each = np.log10((c + 1) / (total + distinct + 1))
                of = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
                base = np.bincount(of, each[code], len(sizes)) + each[-1]
                known = np.bincount(of[c[code] > 0], minlength=len(sizes)) + int(n_texts > 0)
                out.append(pa.table({"doc_id": row.column("ids")[i].values, "held_out": row.column("held")[i].values, "n_tokens": sizes + 1, "n_known": known, "train_tokens": np.full(len(sizes), total), "base_score": base, "score": row.column("scores")[i].values}))
        let_go()
        return pa.concat_tables(out)

    kept = ["block", "codes", "sizes", "ids", "held"]
    left = whole.select(*kept, "given", "lengths").mapInArrow(by_model, "block long, codes binary, sizes binary, ids array<bigint>, held array<boolean>, scores array<double>")
    return left.groupBy("block").cogroup(counts.select("block", "codes", "c").groupBy("block")).applyInArrow(by_counts, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op12_lm_scores(spark, sf_dir: str) -> DataFrame:
    return scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
