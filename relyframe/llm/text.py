"""Words of Arrow text columns as numpy arrays of 64-bit hashes, without a Python object per word.

A word is a maximal run of bytes other than space and 0x09-0x0D, which are
single bytes in UTF-8, so everything is done on the column's own buffer.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Arrow's own pools keep what they once had; the system's gives it back.
pa.set_memory_pool(pa.system_memory_pool())
U64 = np.uint64
CHUNK_BYTES = 1 << 20
_BASE = U64(0x9E3779B97F4A7C15 | 1)
_FOLD = U64(0xD6E8FEB86659FD93)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_SYMBOL = np.random.default_rng(20240229).integers(1, 2**64 - 1, 256, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit over all others (splitmix64's finish)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(n, _BASE, dtype=np.uint64)
    down = np.full(n, U64(pow(int(_BASE), -1, 1 << 64)), dtype=np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2^64."""
    return _powers(max(CHUNK_BYTES, 1 << max(0, n - 1).bit_length()))


@dataclass
class Words:
    """Words of rows first..first+count-1; ``row`` is counted from ``first``, bytes from the buffer's piece."""

    first: int
    count: int
    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    bytes: np.ndarray
    offsets: np.ndarray

    def per_row(self) -> np.ndarray:
        return np.bincount(self.row, minlength=self.count)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets; a null row has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, offsets


def trim() -> None:
    """Give freed memory back to the system: Python workers are used again, and their memory counts as the executor's."""
    pa.default_memory_pool().release_unused()
    free = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if free:
        free(0)


def pieces(offsets: np.ndarray, limit: int = CHUNK_BYTES, rows: int = 1 << 31) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes and at most ``rows`` rows; a longer text is a range of its own."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), lo + rows, n)
        yield lo, hi
        lo = hi


def span_hash(symbols: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of symbols[start:end] for each pair, whatever its place in the array."""
    up, down = powers(len(symbols))
    total = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum(symbols * up[: len(symbols)], out=total[1:])
    h = (total[end] - total[start]) * down[np.minimum(start, len(down) - 1)]
    return mix(h ^ ((end - start).astype(np.uint64) * _FOLD))


def words(column: pa.Array, lower: bool = False, limit: int = CHUNK_BYTES) -> Iterator[Words]:
    data, offsets = buffers(column)
    for lo, hi in pieces(offsets, limit):
        base = offsets[lo]
        b = data[base : offsets[hi]]
        if lower:
            b = LOWER[b]
        cut = offsets[lo : hi + 1] - base
        space = SPACE[b]
        edge = np.zeros(len(b) + 1, bool)
        edge[cut] = True
        before = edge[:-1].copy()
        before[1:] |= space[:-1]
        after = edge[1:].copy()
        after[:-1] |= space[1:]
        start = np.flatnonzero(~space & before)
        end = np.flatnonzero(~space & after) + 1
        row = (np.searchsorted(cut, start, side="right") - 1).astype(np.int64)
        yield Words(lo, hi - lo, row, start, end, span_hash(_SYMBOL[b], start, end), b, cut)


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of h[i:i+k] for every i; k is part of the hash, so lengths never mix."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    s = h[:n].copy()
    for j in range(1, k):
        s *= _BASE
        s += h[j : j + n]
    return mix(s ^ U64(k * int(_FOLD) % 2**64))
