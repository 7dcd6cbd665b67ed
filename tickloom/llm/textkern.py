"""Vectorised text kernels shared by the corpus operators.

Texts arrive as Arrow batches.  ``chunks`` cuts a batch into runs of rows of a
bounded number of bytes and exposes each run as one byte buffer with row
offsets, so words, lines and shingles of all its rows are found with a handful
of NumPy passes.  Nothing here keeps state between batches.

Null and empty texts are rows of zero bytes and have no words.  A text is
never cut: a row larger than the chunk size forms a chunk of its own.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 19
U = np.uint64

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_STEP = _rng.integers(1, 2**63, 64, dtype=np.uint64) * U(2) + U(1)
#: Spans up to this length are hashed by a sum over bytes with a random factor for each place, longer ones by BLAKE2b.
SHORT = 256
_PLACE = _rng.integers(1, 2**63, SHORT, dtype=np.uint64) * U(2) + U(1)


_release = getattr(ctypes.CDLL(None), "malloc_trim", None)


def trim() -> None:
    """Give freed memory back to the system, so that a worker holds what it uses and not the most it ever used."""
    pa.default_memory_pool().release_unused()
    if _release:
        _release(0)


def separators(pattern: str) -> np.ndarray:
    """Boolean table of the ASCII bytes that are no part of a word."""
    table = np.zeros(256, bool)
    if pattern == "space":  # words [^\x20\x09-\x0D]+
        table[[0x20, *range(0x09, 0x0E)]] = True
    elif pattern == "alnum":  # words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+, after lower-casing A-Z
        table[:0x80] = True
        table[0x30:0x3A] = False
        table[0x61:0x7B] = False
    else:
        raise ValueError(pattern)
    return table


SPACE, ALNUM = separators("space"), separators("alnum")
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (a bijection), so that all bits depend on all bits."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
        return h ^ (h >> U(31))


@dataclass
class Chunk:
    """Rows ``row .. row+n-1`` of a batch as one buffer."""

    row: int
    n: int
    buf: np.ndarray
    offsets: np.ndarray  # n + 1

    def span_hash(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hashes of data[start:end] for arrays of spans; spans of any length, no structure of a text makes them collide."""
        size = end - start
        short = size <= SHORT
        out = np.empty(len(start), np.uint64)
        n = size[short]
        stop = np.cumsum(n)
        total = int(stop[-1]) if len(n) else 0
        at = np.arange(total) - np.repeat(stop - n, n)
        sums = np.zeros(total + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(_BYTE[data[np.repeat(start[short], n) + at]] * _PLACE[at], out=sums[1:])
            out[short] = mix(sums[stop] - sums[stop - n] + n.astype(np.uint64))
        for i in np.flatnonzero(~short).tolist():
            out[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]], digest_size=8).digest(), "little")
        return out

    def words(self, sep: np.ndarray, lower: bool, hashes: bool = True) -> Words:
        data = LOWER[self.buf] if lower else self.buf
        inside = ~sep[data]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        cuts = self.offsets[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(data))]
        first[cuts] = inside[cuts]
        last[cuts - 1] = inside[cuts - 1]
        start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        bounds = np.searchsorted(start, self.offsets)
        doc = np.repeat(np.arange(self.n), np.diff(bounds))
        return Words(self, data, start, end, doc, bounds, self.span_hash(data, start, end) if hashes else None)


@dataclass
class Words:
    chunk: Chunk
    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    bounds: np.ndarray  # of each row's words
    hash: np.ndarray | None

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word, hash) of every window of k consecutive words of one row."""
        m = len(self.start) - k + 1
        if m <= 0:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        at = np.flatnonzero(self.doc[:m] == self.doc[k - 1 :])
        with np.errstate(over="ignore"):
            h = np.zeros(len(at), np.uint64)
            for j in range(k):
                h = mix(h ^ self.hash[at + j] * _STEP[j])
        return at, h

    def sets(self, k: int) -> list[np.ndarray]:
        """Each row's sorted distinct k-word shingle hashes; a row of fewer words, but not none, has its whole sequence as one."""
        at, h = self.windows(k)
        cut = np.searchsorted(at, self.bounds)
        out = []
        for i in range(self.chunk.n):
            a, b = self.bounds[i], self.bounds[i + 1]
            if b - a >= k:
                out.append(np.unique(h[cut[i] : cut[i + 1]]))
            elif b > a:
                with np.errstate(over="ignore"):
                    x = np.array([b - a], np.uint64)
                    for j in range(a, b):
                        x = mix(x ^ self.hash[j : j + 1] * _STEP[j - a + 32])
                out.append(x)
            else:
                out.append(np.empty(0, np.uint64))
        return out

    def text(self, i: int) -> str:
        return self.data[self.start[i] : self.end[i]].tobytes().decode("utf-8", "replace")


def code_points(buf: np.ndarray) -> np.ndarray:
    """True where a code point begins."""
    return (buf & 0xC0) != 0x80


def binary(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """The column as one array of strings or bytes without nulls; null becomes empty.  Copies only where there are nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    kind = column.type
    if not (pa.types.is_string(kind) or pa.types.is_large_string(kind) or pa.types.is_binary(kind) or pa.types.is_large_binary(kind)):
        column = column.cast(pa.large_string())
    return pc.fill_null(column, b"" if "binary" in str(column.type) else "") if column.null_count else column


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """The column in runs of rows of at most ``limit`` bytes, or one row; views of its buffers, no copies."""
    column = binary(column)
    n = len(column)
    if not n:
        return
    _, off, data = column.buffers()
    wide = str(column.type).startswith("large")
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    row = 0
    while row < n:
        to = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        to = min(n, max(row + 1, to))
        yield Chunk(row, to - row, whole[offsets[row] : offsets[to]], offsets[row : to + 1] - offsets[row])
        row = to
    if offsets[-1] - offsets[0] > limit:
        trim()


def per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many of the flags are set in each row's span."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]
