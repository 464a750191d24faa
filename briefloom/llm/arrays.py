"""Words and shingles of many texts at once, as numpy arrays over the bytes of an Arrow column.

A word is a run of letters, digits, underscores and of all bytes outside ASCII; everything else separates. Texts are
taken in slices of about ``SLICE`` bytes, so memory is bounded by a slice or by the longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE = 1 << 21
U = np.uint64
FACTOR = 0x9E3779B97F4A7C15
BASE = 0x5851F42D4C957F2D  # odd, so it has an inverse modulo 2**64
INVERSE = pow(BASE, -1, 1 << 64)
WORD = np.zeros(256, dtype=bool)
WORD[[*range(48, 58), *range(65, 91), 95, *range(97, 123), *range(128, 256)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_POWERS: dict[int, np.ndarray] = {}


def _powers(factor: int, n: int) -> np.ndarray:
    have = _POWERS.get(factor)
    if have is None or len(have) < n:
        with np.errstate(over="ignore"):
            steps = np.full(max(n, SLICE + 1), factor, dtype=U)
            steps[0] = 1
            have = np.multiply.accumulate(steps)
        if len(have) <= 4 * SLICE:  # a single huge text does not stay in memory
            _POWERS[factor] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def range_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each range of ``values`` that depends on the values and their order only."""
    n = len(values)
    sums = np.empty(n + 1, dtype=U)
    sums[0] = 0
    np.cumsum((values.astype(U) + U(1)) * _powers(BASE, n)[:n], out=sums[1:])
    h = (sums[ends] - sums[starts]) * _powers(INVERSE, n + 1)[starts]
    return mix(h + (ends - starts).astype(U) * U(FACTOR))


@dataclass
class Words:
    """Word hashes of a slice of rows; ``at[i]:at[i + 1]`` are those of row ``i``."""

    first: int  # number of the first row in the batch
    data: np.ndarray  # bytes of the rows
    offsets: np.ndarray  # of the rows in the bytes
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    at: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.at) - 1

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), np.diff(self.at))

    def whole(self) -> np.ndarray:
        """A hash per row of its words in order; of its bytes where it has no word."""
        h = range_hash(self.hashes, self.at[:-1], self.at[1:])
        none = self.at[:-1] == self.at[1:]
        if none.any():
            h[none] = range_hash(self.data, self.offsets[:-1][none], self.offsets[1:][none]) ^ U(FACTOR)
        return h

    def shingles(self, width: int, short: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of ``width`` words in a row, the row of each, and the number of its first word.

        With ``short``, a row of fewer words has one shingle of all of them. Sorted by row and position.
        """
        row, n = self.row_of(), len(self.hashes)
        if n >= width:
            h = self.hashes[:n - width + 1].copy()
            for k in range(1, width):
                h = mix(h * U(BASE) + self.hashes[k:n - width + 1 + k])
            keep = np.flatnonzero(row[:n - width + 1] == row[width - 1:])
            h, r, first = h[keep], row[keep], keep
        else:
            h, r, first = np.empty(0, U), np.empty(0, np.int64), np.empty(0, np.int64)
        counts = np.diff(self.at)
        few = np.flatnonzero((counts > 0) & (counts < width)) if short else []
        if len(few):
            extra = range_hash(self.hashes, self.at[few], self.at[few + 1])
            h, r, first = np.concatenate([h, extra]), np.concatenate([r, few]), np.concatenate([first, self.at[few]])
            order = np.argsort(first, kind="stable")
            h, r, first = h[order], r[order], first[order]
        return h, r, first


def words(column: pa.Array, lower: bool = False, size: int = SLICE, step: int = 1) -> Iterator[Words]:
    """The words of a text column without nulls, slice by slice. ``lower`` folds A-Z; other letters stay as they are.

    A slice holds a multiple of ``step`` rows.
    """
    raw = column.cast(pa.large_binary())
    if isinstance(raw, pa.ChunkedArray):
        raw = raw.combine_chunks()
    ends = np.frombuffer(raw.buffers()[1], dtype=np.int64)[raw.offset:raw.offset + len(raw) + 1]
    data = np.frombuffer(raw.buffers()[2], dtype=np.uint8) if raw.buffers()[2] is not None else np.empty(0, np.uint8)
    i = 0
    while i < len(raw):
        j = int(np.searchsorted(ends, ends[i] + size, "right")) - 1
        j = i + max(step, (j - i) // step * step)
        yield _split(i, data[ends[i]:ends[j]], ends[i:j + 1] - ends[i], lower)
        i = j


def _split(first: int, data: np.ndarray, offsets: np.ndarray, lower: bool) -> Words:
    n = len(data)
    inside = WORD[data]
    before = np.empty(n + 1, dtype=bool)
    before[0] = False
    before[1:] = inside
    after = np.append(inside, False)[1:] if n else inside.copy()
    bounds = offsets[1:-1]
    before[bounds] = False
    after[bounds[bounds > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before[:n])
    ends = np.flatnonzero(inside & ~after) + 1
    hashes = range_hash(LOWER[data] if lower else data, starts, ends)
    return Words(first, data, offsets, starts, ends, hashes, np.searchsorted(starts, offsets))


def counted(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (hash, row) with their number of occurrences."""
    if not len(h):
        return h, row, np.empty(0, np.int64)
    key = mix(h + row.astype(U) * U(FACTOR))
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    n = np.diff(np.append(first, len(key)))
    return h[order[first]], row[order[first]], n
