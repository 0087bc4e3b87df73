"""Vectorised text kernels that run inside Spark tasks.

They turn one Arrow column of texts into arrays of word hashes and n-gram
hashes. Work goes through slices of a few megabytes, so memory does not follow
the size of an Arrow batch. A single text is never cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over uint64: every input bit reaches every output bit."""
    x = x ^ (x >> _U(32))
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    return x


@lru_cache(maxsize=8)
def _letters(lower: bool) -> np.ndarray:
    codes = np.arange(256, dtype=np.uint64)
    if lower:
        codes[65:91] += _U(32)
    return mix(codes + _U(0x9E3779B97F4A7C15))


def _space() -> np.ndarray:
    table = np.zeros(256, bool)
    table[[32, *range(9, 14)]] = True
    return table


_SPACE = _space()
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**0..n and its inverses modulo 2**64; base is odd. Grown as needed."""
    if base not in _POWERS or len(_POWERS[base][0]) <= n:
        size = max(n + 1, SLICE_BYTES + 1)
        inverse = pow(base, -1, 1 << 64)
        up, down = np.full(size, base, _U), np.full(size, inverse, _U)
        up[0] = down[0] = 1
        _POWERS[base] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _POWERS[base]


_BYTE_BASE, _WORD_BASE = 0x5851F42D4C957F2D, 0x2545F4914F6CDD1D


def _ranges(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Polynomial hashes of values[start:end] for many ranges, from one prefix sum."""
    up, down = _powers(base, len(values))
    sums = np.zeros(len(values) + 1, _U)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


class Words(NamedTuple):
    """Words of consecutive rows: row r has words first[r]:first[r + 1]."""

    rows: range
    buf: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    hashes: np.ndarray

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each k consecutive words inside one row, and those words' first index."""
        if len(self.hashes) < k:
            return np.empty(0, _U), np.empty(0, np.int64)
        last = np.repeat(self.first[1:], np.diff(self.first))
        at = np.flatnonzero(np.arange(len(self.hashes)) + k <= last)
        return _ranges(self.hashes, at, at + k, _WORD_BASE + 2 * k), at

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, local row) of each row's k-word shingles; a shorter row is one shingle as a whole."""
        values, at = self.grams(k)
        rows = np.repeat(np.arange(len(self.rows)), np.diff(self.first))[at] if len(at) else np.empty(0, np.int64)
        sizes = np.diff(self.first)
        short = np.flatnonzero((sizes > 0) & (sizes < k))
        if len(short):
            whole = _ranges(self.hashes, self.first[short], self.first[short + 1], _WORD_BASE + 2 * k)
            whole = mix(whole + sizes[short].astype(_U))
            values, rows = np.concatenate([values, whole]), np.concatenate([rows, short])
        return values, rows


def sliced(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[range, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) of runs of rows with about `limit` bytes; null counts as empty."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    row = 0
    while row < len(texts):
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield range(row, stop), data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row]
        row = stop


def words(texts: pa.Array, lower: bool = False, limit: int = SLICE_BYTES, space: np.ndarray = _SPACE) -> Iterator[Words]:
    """Words are runs of bytes other than `space`, by default space and \\t \\n \\v \\f \\r; lower folds A-Z only."""
    for rows, buf, offsets in sliced(texts, limit):
        solid = ~space[buf]
        edge = np.zeros(len(buf) + 1, bool)
        edge[offsets] = True
        before, after = np.empty(len(buf), bool), np.empty(len(buf), bool)
        if len(buf):
            before[0], before[1:] = False, solid[:-1]
            after[-1], after[:-1] = False, solid[1:]
        starts = np.flatnonzero(solid & (~before | edge[:-1]))
        ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
        hashes = _ranges(_letters(lower)[buf], starts, ends, _BYTE_BASE) if len(starts) else np.empty(0, _U)
        yield Words(rows, buf, starts, ends, np.searchsorted(starts, offsets), hashes)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` consecutive values, by doubling."""
    have = 1
    while 2 * have <= width:
        values = np.minimum(values[:-have], values[have:])
        have *= 2
    rest = width - have
    return np.minimum(values[:-rest], values[rest:]) if rest else values


def unsigned(values: np.ndarray) -> np.ndarray:
    """uint64 bits as int64, the type that Spark has."""
    return values.view(np.int64)
