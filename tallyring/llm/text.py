"""Vectorised word splitting and hashing over Arrow string columns.

A batch's UTF-8 buffer is handled as one byte array: a lookup table tells word bytes,
prefix sums of a polynomial hash give every word's 64-bit hash, and further mixes give
hashes of consecutive words. Nothing here loops over characters or words in Python.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
GOLDEN = 0x9E3779B97F4A7C15
RADIX = 0xD1342543DE82EF95  # odd, so it has an inverse modulo 2**64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over 64 bits."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _lower() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


LOWER = _lower()
#: Bytes of words between white space: anything but 0x20 and 0x09 to 0x0D.
SPACED = np.ones(256, dtype=bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of words of letters and digits; bytes from 0x80 on belong to words.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = True
ALNUM[0x61:0x7B] = True
ALNUM[0x41:0x5B] = True
ALNUM[0x80:] = True

_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(GOLDEN))[LOWER]
_POW: dict[str, np.ndarray] = {}


def release() -> None:
    """Give memory that is free back to the system, as idle workers would keep it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _POW or len(_POW["p"]) < n:
        size = max(n, 1 << 18)
        inverse = pow(RADIX, -1, 1 << 64)
        for key, base in (("p", RADIX), ("i", inverse)):
            a = np.full(size, base, dtype=U64)
            a[0] = 1
            _POW[key] = np.multiply.accumulate(a)
    return _POW["p"][:n], _POW["i"][:n]


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows, from 0) of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    at = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of batches of about ``most`` bytes of text (one row at least), with its buffers. At the
    end free memory is released."""
    for batch in batches:
        data, at = buffers(batch.column(column))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, side="right")) - 1)
            yield batch.slice(lo, hi - lo), data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
            lo = hi
    release()


class Words:
    """Words of several texts: ``start`` and ``end`` in bytes, ``doc`` the row, ``first`` the
    index of each row's first word (one more than rows), ``hash`` of the lower-cased word."""

    def __init__(self, data: np.ndarray, at: np.ndarray, kind: np.ndarray) -> None:
        n = len(data)
        inside = np.zeros(n + 2, dtype=bool)
        inside[1:-1] = kind[data]
        opens = inside[1:] & ~inside[:-1]
        cut = at[1:-1]
        cut = cut[cut < n]
        opens[cut] |= inside[1:][cut]
        closes = inside[:-1] & ~inside[1:]
        joined = cut[cut > 0]
        closes[joined] |= inside[:-1][joined]
        self.start = np.flatnonzero(opens)
        self.end = np.flatnonzero(closes)
        self.data = data
        self.first = np.searchsorted(self.start, at)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(at) - 1), self.count)

    @property
    def hash(self) -> np.ndarray:
        p, inverse = _powers(len(self.data) + 1)
        sums = np.zeros(len(self.data) + 1, dtype=U64)
        np.cumsum(_BYTE[self.data] * p[:-1], out=sums[1:])
        h = (sums[self.end] - sums[self.start]) * inverse[self.start]
        return mix(h + (self.end - self.start).astype(U64) * U64(GOLDEN))


def sequences(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of every ``k`` consecutive entries (``len - k + 1`` of them)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=U64)
    h = np.full(n, k * GOLDEN % (1 << 64), dtype=U64)
    for j in range(k):
        h = mix(h * U64(RADIX) + hashes[j : j + n])
    return h
