"""Vectorised word and shingle arithmetic on Arrow string columns.

The word law everywhere in this subpackage is ``[^\\x20\\x09-\\x0D]+``: a word is a maximal run of
characters other than space, tab, line feed, vertical tab, form feed and carriage return.  All
helpers read the UTF-8 bytes straight from the Arrow buffers (no Python string per row) and work in
slices of a bounded number of bytes; a slice always holds whole documents, so only a single very
long document can exceed the bound.  Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Bytes of text that one slice holds at most (a longer single document makes its own slice).
SLICE_BYTES = 1 << 20

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_TABLE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | _U(1)
_POW = np.ones(64, dtype=np.uint64)


def _powers(n: int) -> np.ndarray:
    """The first n powers of the odd base, modulo 2**64, grown by doubling."""
    global _POW
    if n > len(_POW):
        m = 1 << int(n - 1).bit_length()
        step = np.full(m, _BASE, dtype=np.uint64)
        step[0] = 1
        _POW = np.multiply.accumulate(step)
    return _POW[:n]


_powers(65)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    x = x ^ (x >> _U(31))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(32))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string column without copying; nulls become empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        kind = np.int32
    else:
        kind = np.int64
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if off is not None and len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offsets, raw


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts together hold about ``most`` bytes at most."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


class Words(NamedTuple):
    """Words of a slice: byte ranges in ``data`` (ASCII-lowered), owner row, and words per row."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    count: np.ndarray


def words(offsets: np.ndarray, raw: np.ndarray, i: int, j: int, lower: bool = True) -> Words:
    """Find the words of rows i to j."""
    base = offsets[i]
    data = raw[base : offsets[j]]
    n, rows = len(data), j - i
    if not n:
        z = np.zeros(0, np.int64)
        return Words(data, z, z, z, np.zeros(rows, np.int64))
    if lower:
        data = np.where((data - np.uint8(65)) < 26, data + np.uint8(32), data)
    ink = (data != 32) & ((data - np.uint8(9)) > 4)
    bounds = offsets[i : j + 1] - base
    first = np.zeros(n + 1, bool)
    first[bounds] = True
    begin = ink.copy()
    begin[1:] &= ~ink[:-1] | first[1:n]
    stop = ink.copy()
    stop[:-1] &= ~ink[1:] | first[1:n]
    start = np.flatnonzero(begin)
    end = np.flatnonzero(stop) + 1
    count = np.diff(np.searchsorted(start, bounds))
    return Words(data, start, end, np.repeat(np.arange(rows), count), count)


def word_hashes(w: Words) -> np.ndarray:
    """64-bit hash of each word's bytes."""
    if not len(w.start):
        return np.zeros(0, np.uint64)
    length = w.end - w.start
    total = int(length.sum())
    at = np.cumsum(length) - length
    inside = np.arange(total) - np.repeat(at, length)
    value = _TABLE[w.data[np.repeat(w.start, length) + inside]] * _powers(int(length.max()) + 1)[inside]
    return mix(np.add.reduceat(value, at) + length.astype(np.uint64))


def shingle_hashes(h: np.ndarray, count: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of k words per row: (row, hash), sorted by row and hash.

    A row with fewer words than k but at least one has its whole sequence as its one shingle; a row
    without words has none.
    """
    n = len(h)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    end = np.cumsum(count)
    begin = end - count
    rows = np.arange(len(count))
    made = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    row = np.repeat(rows, made)
    at = np.arange(len(row)) - np.repeat(np.cumsum(made) - made, made) + begin[row]
    left = np.minimum(count, k)[row]
    value = np.zeros(len(row), np.uint64)
    for d in range(k):
        step = mix(h[np.minimum(at + d, n - 1)] + value * _BASE + _U(d + 1))
        value = np.where(d < left, step, value)
    edge = np.cumsum(made).tolist()
    for lo, hi in zip([0, *edge[:-1]], edge, strict=True):
        if hi - lo > 1:
            value[lo:hi].sort()
    keep = np.ones(len(row), bool)
    keep[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return row[keep], value[keep]
