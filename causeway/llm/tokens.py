"""Words of whole texts as numpy arrays, a bounded number of bytes at a time.

A column of texts is cut into chunks of whole rows; a chunk holds about ``max_bytes`` bytes, or
one longer text. Words are byte ranges in the chunk, and a word's identity is a 64-bit hash of its
bytes. A null text has no words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 21
U64 = np.uint64
#: Bytes that belong to words. SPACED: all but ASCII white space; ALNUM: ASCII letters and digits and all of UTF-8's upper half.
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_BASE = U64(0x9E3779B97F4A7C15)
_BASE_INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, U64), np.ones(1, U64))


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed random-looking permutation of 64-bit integers (in a new array)."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + CHUNK_BYTES // 4)
        pair = []
        for base in (_BASE, _BASE_INVERSE):
            p = np.full(size, base, U64)
            p[0] = 1
            pair.append(np.cumprod(p))
        if n > 4 * CHUNK_BYTES:  # one very long text: not kept
            return pair[0], pair[1]
        _powers = (pair[0], pair[1])
    return _powers


@dataclass
class Chunk:
    """Rows ``lo`` to ``hi`` of a column: their bytes and the offset of each row in them."""

    lo: int
    hi: int
    data: np.ndarray
    offsets: np.ndarray


def chunks(column: pa.Array | pa.ChunkedArray, max_bytes: int = CHUNK_BYTES) -> Iterator[Chunk]:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        column = pc.fill_null(column, "").cast(pa.large_string()).cast(pa.large_binary())
    else:
        column = pc.fill_null(column, b"").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = int(np.searchsorted(offsets, offsets[lo] + max_bytes, side="right")) - 1
        hi = min(max(hi, lo + 1), len(column))
        yield Chunk(lo, hi, data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
        lo = hi


@dataclass
class Words:
    """``start``/``end``: byte range of each word; ``first[i]:first[i+1]``: the words of row i; ``row``: row of each word."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def hashes(self) -> np.ndarray:
        if not len(self.start):
            return np.zeros(0, U64)
        power, inverse = _tables(len(self.data) + 1)
        total = np.zeros(len(self.data) + 1, U64)
        terms = self.data.astype(U64)
        terms += U64(1)
        terms *= power[:len(terms)]
        np.cumsum(terms, out=total[1:])
        out = total[self.end]
        out -= total[self.start]
        out *= inverse[self.start]
        out += (self.end - self.start).astype(U64) * U64(0xD6E8FEB86659FD93)
        return mix(out)

    def text(self, i: int, j: int) -> bytes:
        """Words i to j - 1 of one row, joined by single spaces."""
        return b" ".join(self.data[self.start[k]:self.end[k]].tobytes() for k in range(i, j))


def words(chunk: Chunk, member: np.ndarray = SPACED, lower: bool = False) -> Words:
    data = LOWER[chunk.data] if lower else chunk.data
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(data, none, none, np.zeros(len(chunk.offsets), np.int64))
    inside = member[data]
    filled = np.diff(chunk.offsets) > 0
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    at = chunk.offsets[:-1][filled]
    begin[at] = inside[at]
    stop = inside.copy()
    stop[:-1] &= ~inside[1:]
    at = chunk.offsets[1:][filled] - 1
    stop[at] = inside[at]
    start = np.flatnonzero(begin)
    return Words(data, start, np.flatnonzero(stop) + 1, np.searchsorted(start, chunk.offsets))


def join(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of a sequence from the hashes of its two parts."""
    return mix(left * U64(0xFF51AFD7ED558CCD) + right)


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position on; n - 1 positions fewer than words, none if there are fewer than n."""
    if len(h) < n:
        return np.zeros(0, U64)
    out, done, power, span = None, 0, h, 1
    size = len(h) - n + 1
    while True:
        if n & span:
            part = power[done:done + size]
            out = part if out is None else join(out, part)
            done += span
        span *= 2
        if span > n:
            return out if out is not power else out.copy()
        power = join(power[:-(span // 2)], power[span // 2:])


def inside(first: np.ndarray, n: int, size: int) -> np.ndarray:
    """For the first ``size`` words: whether n words from there on lie in one row."""
    ends = np.repeat(first[1:], np.diff(first))[:size]
    return np.arange(size) + n <= ends


def batches(columns: dict[str, pa.Array | np.ndarray], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if not isinstance(columns[f.name], pa.Array)
                                       else columns[f.name].cast(f.type) for f in schema], schema=schema)
