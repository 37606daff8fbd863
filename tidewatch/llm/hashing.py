"""Vectorised hashes of slices of bytes, of words and of word shingles."""

from __future__ import annotations

import functools

import numpy as np

ODD = np.uint64(0x9E3779B97F4A7C15)
BASES = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))
_TABLES = tuple(np.random.default_rng(s).integers(0, 1 << 64, 256, np.uint64) for s in (11, 23))
#: ASCII white space, as it parts words.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


@functools.lru_cache(2)
def powers(n: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of a base and of its inverse, modulo 2**64."""
    base = int(BASES[which])
    both = []
    for b in (base, pow(base, -1, 1 << 64)):
        x = np.full(max(n, 1), b, np.uint64)
        x[0] = 1
        both.append(np.cumprod(x))
    return both[0], both[1]


class Prefix:
    """Hashes of any slice of data: polynomials over tabulated bytes, modulo 2**64."""

    def __init__(self, data: np.ndarray, which: int):
        up, self.inverse = powers(1 << max(len(data), 1).bit_length(), which)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_TABLES[which][data] * up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.sums[end] - self.sums[start]) * self.inverse[start]
        h ^= h >> np.uint64(32)
        return (h * ODD).view(np.int64)


def word_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of each word of a text's bytes, in order."""
    space = np.r_[True, IS_SPACE[data], True]
    turn = np.flatnonzero(space[1:] != space[:-1])
    return Prefix(data, 0).of(turn[::2], turn[1::2]).view(np.uint64)


def shingles(data: np.ndarray, words: int) -> np.ndarray:
    """The distinct shingles of so many words, as sorted hashes. A text of fewer words is one shingle, of none nothing."""
    w = word_hashes(data)
    if not len(w):
        return w
    n = max(len(w) - words + 1, 1)
    h = np.full(n, min(len(w), words), np.uint64)
    for j in range(min(len(w), words)):
        h = (h ^ w[j : j + n]) * BASES[1]
        h ^= h >> np.uint64(31)
    return np.unique(h * ODD)
