"""Vectorised scanning of many UTF-8 texts at once: words, letter runs and rolling hashes in numpy."""

from __future__ import annotations

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
UPPER = np.zeros(256, bool)
UPPER[0x41:0x5B] = True
LETTER = np.zeros(256, bool)
LETTER[0x41:0x5B] = LETTER[0x61:0x7B] = LETTER[0x80:] = True
DIGIT = np.zeros(256, bool)
DIGIT[0x30:0x3A] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = np.asarray(x, np.uint64).copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
FOLDED_CODES = CODES[FOLD]


_POWERS: dict[bool, np.ndarray] = {}


def powers(n: int, inverse: bool) -> np.ndarray:
    """BASE**i, or its inverse modulo 2**64, for i up to n at least; one table of each kind is kept, the longest so far."""
    if inverse not in _POWERS or len(_POWERS[inverse]) <= n:
        base = int(BASE) if not inverse else pow(int(BASE), -1, 1 << 64)
        out = np.full(max(1 << 16, int(n) + (int(n) >> 3)) + 1, base, np.uint64)
        out[0] = 1
        _POWERS[inverse] = np.multiply.accumulate(out, out=out)
    return _POWERS[inverse]


class Hasher:
    """Hash of any range of a buffer of bytes, or of 64-bit tokens, in constant time after one pass."""

    def __init__(self, buf: np.ndarray, fold: bool = False):
        terms = buf.copy() if buf.dtype == np.uint64 else (FOLDED_CODES if fold else CODES)[buf]
        terms *= powers(len(buf), False)[: len(buf)]
        self.sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(terms, out=self.sums[1:])
        self.inverse = powers(len(buf), True)

    def raw(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.inverse[start]

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix(self.raw(start, end) + (end - start).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def runs(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of set positions that don't cross text boundaries."""
    if not len(mask):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begin, end = mask.copy(), mask.copy()
    begin[1:] &= ~mask[:-1]
    end[:-1] &= ~mask[1:]
    full = offsets[1:] > offsets[:-1]
    first, last = offsets[:-1][full], offsets[1:][full] - 1
    begin[first] = mask[first]
    end[last] = mask[last]
    return np.flatnonzero(begin), np.flatnonzero(end) + 1


def words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words `[^\\x20\\x09-\\x0D]+`."""
    return runs(~SPACE[buf], offsets)


def owner(offsets: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """Index of the text that holds each position."""
    return np.searchsorted(offsets, positions, "right") - 1


def per_text(mask_or_values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum over each text, in float64."""
    sums = np.zeros(len(mask_or_values) + 1)
    np.cumsum(mask_or_values, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]
