"""Words of many texts at once: exact strings and dictionary codes, for operators that count words of whole corpora.

A class of characters is a table over bytes, so it holds ASCII characters only, or all others together; UTF-8 keeps
the bytes of other characters above 0x7F, so no character is cut.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .shared import _LOWER, SPACES


def gaps(chars: str) -> np.ndarray:
    """Bytes that part words: the ASCII characters given."""
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


WHITE = gaps(SPACES)


def spans(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end (bytes) of each run without a gap byte; offsets: where texts begin, with the end of the last. No run crosses them."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    apart = gap[data]
    edge = np.empty(len(data) + 1, bool)
    edge[0], edge[-1] = True, True
    edge[1:-1] = apart[:-1]
    edge[offsets] = True
    starts = np.flatnonzero(~apart & edge[:-1])
    edge[1:-1] = apart[1:]
    edge[offsets] = True
    return starts, np.flatnonzero(~apart & edge[1:]) + 1


def strings(data: np.ndarray, gap: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The runs of spans() as strings: what is left of the bytes without gaps, cut by the runs' lengths."""
    at = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=at[1:])
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data[~gap[data]])))


def lowered(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z lower-cased."""
    return _LOWER[data]


def coded(words: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """Code of each word, and the distinct words in the order of their codes."""
    d = words.dictionary_encode()
    if isinstance(d, pa.ChunkedArray):
        if not d.num_chunks:
            return np.zeros(0, np.int32), pa.array([], words.type)
        return np.concatenate([np.asarray(c.indices) for c in d.chunks]), d.chunk(d.num_chunks - 1).dictionary
    return np.asarray(d.indices), d.dictionary


def firsts(*columns: np.ndarray) -> np.ndarray:
    """Where a run of equal rows begins in sorted columns."""
    n = len(columns[0])
    new = np.zeros(n, bool)
    if n:
        new[0] = True
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def packed(codes: np.ndarray) -> bytes:
    """Codes as compressed bytes, the four bytes of each apart: frequent words have small codes."""
    planes = np.ascontiguousarray(codes.astype(np.int32).view(np.uint8).reshape(-1, 4).T)
    return len(codes).to_bytes(8, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def unpacked(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(pa.decompress(data[8:], 4 * n, "zstd", asbytes=True), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view(np.int32).reshape(n)


def let_go() -> None:
    """Gives back what Arrow keeps for later; workers live on after a task."""
    pa.default_memory_pool().release_unused()
