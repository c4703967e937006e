"""Vectorised hashes of byte ranges, words and word shingles of a text buffer.

A byte range hashes to a polynomial in an odd base modulo 2**64, taken as a difference of prefix sums and
then mixed, so any number of ranges costs one pass over the bytes.
"""

from __future__ import annotations

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        grown = np.full(max(n, 1 << 16), base, np.uint64)
        grown[0] = 1
        if n > 64 << 20:
            return np.multiply.accumulate(grown)
        _powers[name] = have = np.multiply.accumulate(grown)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class RangeHash:
    """Hashes of byte ranges of one buffer."""

    def __init__(self, buf: np.ndarray):
        n = len(buf)
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * _power("up", BASE, n), out=self.prefix[1:])
        self.down = _power("down", BASE_INVERSE, n + 1)

    def ranges(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.prefix[ends] - self.prefix[starts]) * self.down[starts])


def words(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row of the words ``[^\\x20\\x09-\\x0D]+`` of every text."""
    n = len(buf)
    inside = ~SPACES[buf]
    first = np.zeros(n + 1, bool)
    first[at] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | first[1:n]
    ends = inside
    ends = ends.copy()
    ends[:-1] &= ~inside[1:] | first[1:n]
    begin, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return begin, end, np.searchsorted(at, begin, side="right") - 1


def shingles(buf: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every run of ``size`` words; a text of 1 to size - 1 words has its whole word list
    as its only shingle, a text without words none. Rows ascend."""
    begin, end, row = words(buf, at)
    if not len(begin):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    word = RangeHash(buf).ranges(begin, end)
    salts = mix(np.arange(1, size + 1, dtype=np.uint64)) | np.uint64(1)
    n = len(word) - size + 1
    if n > 0:
        total = np.zeros(n, np.uint64)
        for k in range(size):
            total += mix(word[k : k + n] + salts[k]) * salts[k]
        full = row[:n] == row[size - 1 :]
        hashes, rows = mix(total[full]), row[:n][full]
    else:
        hashes, rows = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    counts = np.bincount(row, minlength=len(at) - 1)
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        firsts = np.searchsorted(row, short)
        extra = np.zeros(len(short), np.uint64)
        for k in range(size - 1):
            has = counts[short] > k
            extra[has] += mix(word[firsts[has] + k] + salts[k]) * salts[k]
        extra = mix(extra + counts[short].astype(np.uint64))
        rows = np.concatenate([rows, short])
        order = np.argsort(rows, kind="stable")
        hashes, rows = np.concatenate([hashes, extra])[order], rows[order]
    return hashes, rows


def unique_per_row(hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each row, sorted by row and hash."""
    order = np.lexsort((hashes, rows))
    hashes, rows = hashes[order], rows[order]
    keep = np.ones(len(hashes), bool)
    keep[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
    return hashes[keep], rows[keep]
