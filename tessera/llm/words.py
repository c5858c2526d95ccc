"""Vectorised word and shingle hashing over Arrow string columns (used inside tasks).

Words are maximal runs of bytes other than space and \\t \\n \\v \\f \\r, with A-Z lower-cased.
Rows are worked in slabs of about one megabyte so that memory does not follow the batch size;
one longer text makes a slab of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLAB = 1 << 20
WIDTH = 5

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_STEP = np.uint64(0xD1342543DE82EF95)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over 64 output bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        size = max(n, SLAB + (1 << 18))
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            row = np.full(size, base, np.uint64)
            row[0] = 1
            _powers[k] = np.multiply.accumulate(row)
    return _powers[0][:n], _powers[1][:n]


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data if data is not None else b"", np.uint8), off


def slabs(column: pa.Array, limit: int = SLAB) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of consecutive rows of about `limit` bytes."""
    data, off = text_buffers(column)
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def word_bounds(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and for each row the index of its first word (one more at the end)."""
    solid = ~_SPACE[data]
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    begins, ends = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1]
    ends[:-1] &= ~solid[1:]
    first = off[:-1][off[:-1] < n]
    begins[first] = solid[first]
    last = off[1:][off[1:] > 0] - 1
    ends[last] = solid[last]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(start, off)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each word: differences of a prefix sum of byte times power, moved to power 0."""
    if not len(start):
        return np.zeros(0, np.uint64)
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    bytes_ = (_LOWER[data] if lower else data).astype(np.uint64)
    bytes_ += np.uint64(1)
    bytes_ *= up[: len(data)]
    np.cumsum(bytes_, out=total[1:])
    return mix((total[end] - total[start]) * down[start])


def shingle_hashes(words: np.ndarray, first: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of `width` words of each row, and each row's offset among them.

    A row of fewer words has one shingle, its whole sequence; a row without words has none.
    """
    count = np.diff(first)
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(first), np.int64)
    stop = np.repeat(first[1:], count)
    place = np.arange(n)
    out = np.zeros(n, np.uint64)
    factor = np.uint64(1)
    padded = np.concatenate([words, np.zeros(width, np.uint64)])
    for k in range(width):
        out += np.where(place + k < stop, padded[k : k + n], np.uint64(0)) * factor
        factor = factor * _STEP
    keep = (place + width <= stop) | (place == np.repeat(first[:-1], count)) & (np.repeat(count, count) < width)
    out += np.minimum(np.repeat(count, count), width).astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
    sizes = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    return mix(out[keep]), np.concatenate([[0], np.cumsum(sizes)])


def shingles_of(column: pa.Array, width: int = WIDTH) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, shingle hashes, row offsets) for slab after slab."""
    with np.errstate(over="ignore"):
        for lo, hi, data, off in slabs(column):
            start, end, first = word_bounds(data, off)
            yield lo, hi, *shingle_hashes(word_hashes(data, start, end), first, width)


def word_counts(column: pa.Array) -> np.ndarray:
    """The number of words of each row."""
    out = np.zeros(len(column), np.int64)
    for lo, hi, data, off in slabs(column):
        out[lo:hi] = np.diff(word_bounds(data, off)[2])
    return out
