"""Secret scans: assignment-aware lexing of source and configuration text.

Base kinds are three patterns. The lexer adds kind `lex`: it reads name-literal pairs
(`name = "a" + B`, `name: literal`, `"name": "literal"`, `name := literal`), keeps the constants
it has seen as a graph, so that a literal is followed through names and concatenations to the name it
ends in, and scores it by how sensitive that name is and how random the constant looks. What a score reads
of a constant (length, counts of its characters, its first and last few) adds up along the graph, so the work is
linear in the text, also where constants double with each line.

Cases. Null text is empty and has no spans. Rows are independent, so repeated rows give repeated
results, in any order; a null id passes. Texts of any length are read whole. An empty table gives
an empty result. Other columns are not read. A span of the lexer inside a base span is not told twice.
"""

from __future__ import annotations

import functools
import itertools
import math
import re
from bisect import bisect_right
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import texts, sliced

KINDS = ("assign", "access", "hex", "lex")
_ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_MARK = re.compile(r":=|=>|[=:]")
#: A bare word ends before `=`, unless that is its padding; so the words that two marks may take never overlap.
_OPERAND = re.compile(r"""[ \t]*+(?:"((?:[^"\\\n]++|\\.)*+)"|'((?:[^'\\\n]++|\\.)*+)'|`([^`\n]*+)`|([A-Za-z0-9_$][A-Za-z0-9_$./+-]*+(?:={1,2}(?![A-Za-z0-9_$./+="'`-]))?))""")
_PLUS = re.compile(r"[ \t]*(?:\+|\.\.)[ \t]*(?=[\"'`A-Za-z_])")
_NAME = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_.-$")
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
#: How sensitive the words of a name make it.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "pass": 0.6, "secret": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.9, "credentials": 0.9,
    "auth": 0.6, "authorization": 0.8, "bearer": 0.8, "pin": 0.4, "private key": 1.0, "access key": 1.0, "api key": 1.0, "signing key": 1.0, "encryption key": 1.0, "account key": 0.9, "connection string": 0.8,
}
_PLACEHOLDER = re.compile(r"(?:x+|\*+|\.+|none|null|true|false|changeme|example|placeholder|your[_-].*|<.*>|\$\{.*\}|\{\{.*\}\})$", re.I)


@functools.lru_cache(4096)
def name_score(name: str) -> float:
    parts = [p.lower() for p in _PARTS.findall(name)]
    pairs = [" ".join(x) for x in zip(parts, parts[1:])]
    return max((SENSITIVE.get(x, 0.0) for x in (*parts, *pairs)), default=0.0)


@functools.lru_cache(4096)
def _kind(c: str) -> int:
    return c.islower() | c.isupper() << 1 | c.isdigit() << 2 | (not c.isalnum()) << 3


class Gist:
    """What the score of a constant needs; the gist of a concatenation follows from those of its parts, whatever their length."""

    __slots__ = ("counts", "flags", "head", "tail", "length")
    #: Characters of head kept: no placeholder word is longer. Lengths over MOST count as MOST.
    HEAD, MOST = 12, 2.0**60
    #: Entries up to which counts are a dictionary; beyond, an array over ASCII and one place for all else.
    FEW = 24

    def __init__(self, counts: dict[int, float] | np.ndarray, flags: int, head: str, tail: str, length: float):
        self.counts, self.flags, self.head, self.tail, self.length = counts, flags, head, tail, length

    @classmethod
    def of(cls, value: str) -> Gist:
        flags, counts = 0, {}
        for c, n in Counter(value).items():
            flags |= _kind(c)
            k = min(ord(c), 127)
            counts[k] = counts.get(k, 0.0) + n
        return cls(counts, flags, value[: cls.HEAD], value[-2:], float(len(value)))

    def dense(self) -> np.ndarray:
        if isinstance(self.counts, np.ndarray):
            return self.counts
        out = np.zeros(128)
        out[list(self.counts)] = list(self.counts.values())
        return out

    def __add__(self, other: Gist) -> Gist:
        length, few = self.length + other.length, len(self.counts) + len(other.counts) <= self.FEW
        if few:
            counts = dict(self.counts)
            for k, n in other.counts.items():
                counts[k] = counts.get(k, 0.0) + n
        else:
            counts = self.dense() + other.dense()
        if length > self.MOST:
            counts, length = {k: n * (self.MOST / length) for k, n in counts.items()} if few else counts * (self.MOST / length), self.MOST
        return Gist(counts, self.flags | other.flags, (self.head + other.head)[: self.HEAD], (self.tail + other.tail)[-2:], length)

    def score(self) -> float:
        """0 to 1: length and entropy; 0 for placeholders and prose."""
        if self.length < 6:
            return 0.0
        counts = {k: n for k, n in enumerate(self.counts.tolist()) if n} if isinstance(self.counts, np.ndarray) else self.counts
        if 32 in counts or self._placeholder(counts):
            return 0.0
        entropy = -sum(n / self.length * math.log2(n / self.length) for n in counts.values())
        return min(1.0, 0.25 + entropy / 8 + 0.1 * self.flags.bit_count())

    def _placeholder(self, counts: dict[int, float]) -> bool:
        if counts.keys() <= {120, 88} or counts.keys() in ({42}, {46}):  # x, X; *; .
            return True
        return _PLACEHOLDER.match(self.head if self.length <= self.HEAD else self.head + self.tail) is not None


def base_spans(text: str) -> list[tuple[int, int, str]]:
    out = [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20] if "AKIA" in text else []
    return out + [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]


def _name_before(text: str, at: int) -> str:
    """The name that ends before position `at`, over blanks, a closing quote or bracket."""
    i = at
    while i and text[i - 1] in " \t":
        i -= 1
    while i and text[i - 1] in "\"'`]":
        i -= 1
    j = i
    while j and text[j - 1] in _NAME:
        j -= 1
    return text[j:i]


class _Node:
    """A constant: a literal's place in the text, or the constants it was put together from."""

    __slots__ = ("at", "parts", "seen")

    def __init__(self, at: tuple[int, int] | None, parts: list[_Node] | None = None):
        self.at, self.parts, self.seen = at, parts, False


def lexed(text: str, least: float = 0.5) -> list[tuple[int, int, str, float]]:
    """(start, end, name, score) of literals that end in a sensitive name.

    Constants are a graph whose edges go from a name's value to its operands as they were then; values are never put
    together, only their gists. Each literal is told once, for the highest-scoring name it reaches. Time and memory are
    linear in the text.
    """
    known: dict[str, list] = {}  # name: [constant, its gist or None while nobody asked]
    longest = 0
    ends: list[tuple[float, int, str, _Node]] = []
    for mark in _MARK.finditer(text):
        if mark[0] == "=" and (text[mark.start() - 1 : mark.start()] in ("!", "<", ">", "=") or text[mark.end() : mark.end() + 1] == "="):
            continue
        name = _name_before(text, mark.start())
        if not name or not (name[0].isalpha() or name[0] in "_$"):
            continue
        parts: list[list] = []
        at, whole = mark.end(), True
        while m := _OPERAND.match(text, at):
            at, group = m.end(), m.lastindex
            s, e = m.span(group)
            constant = known.get(m[4]) if group == 4 and e - s <= longest else None
            if constant is None and group == 4 and (at < len(text) and text[at] in "([" or parts and text[s].isalpha()):
                whole = False  # a call, an index or an unknown name: not a constant
                break
            parts.append(constant or [_Node((s, e)), None])
            if not (plus := _PLUS.match(text, at)):
                break
            at = plus.end()
        if not parts or not whole:
            continue
        made = parts[0] if len(parts) == 1 else [_Node(None, [p[0] for p in parts]), functools.reduce(Gist.__add__, (_gist(text, p) for p in parts))]
        known[name], longest = made, max(longest, len(name))
        if (sensitive := name_score(name)) and (score := sensitive * _gist(text, made).score()) >= least:
            ends.append((-score, len(ends), name, made[0]))
    found = []
    for score, _, name, node in sorted(ends, key=lambda x: x[:2]):
        open_ = [node]
        while open_:
            node = open_.pop()
            if not node.seen:  # what was seen belongs to a name that scores as much
                node.seen = True
                if node.parts is not None:
                    open_ += node.parts
                elif node.at[1] > node.at[0]:
                    found.append((*node.at, name, -score))
    return found


def _gist(text: str, constant: list) -> Gist:
    if constant[1] is None:
        constant[1] = Gist.of(text[slice(*constant[0].at)])
    return constant[1]


def scan(text: str) -> list[tuple[int, int, str, str | None, float]]:
    """(start, end, kind, name, score) by start, then kind; base spans score 1."""
    base = sorted(base_spans(text))
    out = [(s, e, k, None, 1.0) for s, e, k in base]
    if "=" in text or ":" in text:
        starts, furthest = [s for s, *_ in base], list(itertools.accumulate((e for _, e, _ in base), max))
        for s, e, n, x in lexed(text):
            i = bisect_right(starts, s)
            if not i or furthest[i - 1] < e:
                out.append((s, e, "lex", n, x))
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("name", pa.string()), ("score", pa.float64())])


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and secrets: array<struct<start, end, kind, name, score>>; offsets are code points, end exclusive."""

    def run(batches):
        for b in sliced(batches):
            rows = [[dict(zip(("start", "end", "kind", "name", "score"), x)) for x in scan(t.as_py())] for t in texts(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(_SPAN))], names=["id", "secrets"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, secrets array<struct<start:bigint,end:bigint,kind:string,name:string,score:double>>").withColumnRenamed("id", id_col)


def op7_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, KINDS[:3]), F.sha2(written(F.filter("secrets", lambda s: s["kind"] != "lex")), 256).alias("base_sha256"), written(F.col("secrets")).alias("spans"), count("lex"))
