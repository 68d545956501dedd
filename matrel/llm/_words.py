"""Vectorised work on the UTF-8 bytes of Arrow string columns: words, word hashes, shingles.

Nothing here builds a Python string: words are found and hashed with NumPy over
the column's own buffer, so the cost is a few nanoseconds a byte.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Odd, so that it has an inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_MASK = (1 << 64) - 1
_STEP = np.uint64(0xD6E8FEB86659FD93)
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: What ends a token of letters: every ASCII byte but letters and digits.
PUNCTUATED = np.ones(256, bool)
PUNCTUATED[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse for at least ``n`` places."""
    if len(_powers[0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        for k, b in enumerate((_BASE, _INVERSE)):
            t = np.full(size, b, np.uint64)
            t[0] = 1
            _powers[k] = np.multiply.accumulate(t)
    return _powers[0], _powers[1]


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values, so that all bits depend on all bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def string_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets (n + 1) and the bytes of a string column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, off, data = column.buffers()
    if len(column) == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    off = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return off - off[0], data[off[0] : off[-1]]


#: Text worked on at once, in bytes; the tables and arrays of a slice are some forty times as large.
SLICE = (1 << 19) - 16


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` that gives freed memory back to the system when a task ends: workers live on, and so would it."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return tidied


def release() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most ``most`` bytes of text each; a longer text stands alone, whole."""
    if batch.num_rows == 0:
        return
    off, _ = string_buffer(batch.column(column))
    start = 0
    while start < batch.num_rows:
        end = int(np.searchsorted(off, off[start] + most, side="right")) - 1
        end = min(max(end, start + 1), batch.num_rows)
        yield batch.slice(start, end - start)
        start = end


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of texts, A-Z lower-cased: their places, and a 64-bit hash of each.

    ``start``/``end`` are byte places in ``data``; ``first`` (n + 1) holds the first
    word of each text. Another ``separator`` table makes other words.
    """

    def __init__(self, off: np.ndarray, data: np.ndarray, lower: bool = True, separator: np.ndarray = _SEPARATOR):
        n = len(data)
        self.off, self.data = off, data
        inside = ~separator[data]
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        edges = np.unique(off[:-1][off[:-1] < n])
        begins[edges] = inside[edges]
        last = edges[edges > 0] - 1
        ends[last] = inside[last]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, off)
        low = _LOWER[data] if lower else data
        up, down = _power_tables(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((low.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
        self._total, self._down = total, down
        self.hash = self._hash_to(self.end)

    def _hash_to(self, end: np.ndarray) -> np.ndarray:
        length = (end - self.start).astype(np.uint64)
        return mix64((self._total[end] - self._total[self.start]) * self._down[self.start] + length * _STEP)

    def prefix_hash(self, size: int) -> np.ndarray:
        """Hashes of the words' first ``size`` bytes; 0 for words that have no more than these."""
        end = self.start + size
        longer = end < self.end
        return np.where(longer, self._hash_to(np.where(longer, end, self.end)) ^ np.uint64(size), np.uint64(0))

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def shingle_sets(words: Words, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Each text's set of shingle hashes: (first, hashes), ascending and distinct within a text.

    A text with fewer than ``size`` words has its whole sequence as its one
    shingle; a text without words has none.
    """
    h, first = words.hash, words.first
    n, docs = len(h), len(first) - 1
    count = np.diff(first)
    weights = [1]
    for k in range(size):
        weights.append(((weights[-1] * int(_STEP) + 2 * k) | 1) & _MASK)
    rolled = np.zeros(n, np.uint64)
    for k in range(min(size, n)):
        rolled[: n - k] += h[k:] * np.uint64(weights[k])
    made = np.where(count >= size, count - size + 1, np.minimum(count, 1))
    out_first = np.concatenate([[0], np.cumsum(made)])
    place = np.repeat(first[:-1] - out_first[:-1], made) + np.arange(out_first[-1])
    out = mix64(rolled[place] + np.uint64(size * int(_STEP) & _MASK))
    for m in range(1, size):
        few = np.flatnonzero(count == m)
        if len(few):
            total = np.zeros(len(few), np.uint64)
            for k in range(m):
                total += h[first[few] + k] * np.uint64(weights[k])
            out[out_first[few]] = mix64(total + np.uint64(m * int(_STEP) & _MASK))
    for a, b in zip(out_first[:-1].tolist(), out_first[1:].tolist(), strict=True):
        if b - a > 1:
            out[a:b].sort()
    fresh = np.ones(len(out), bool)
    fresh[1:] = out[1:] != out[:-1]
    fresh[out_first[:-1][made > 0]] = True
    sizes = np.zeros(docs + 1, np.int64)
    total = np.concatenate([[0], np.cumsum(fresh)])
    sizes[:] = total[out_first]
    return sizes, out[fresh]
