"""Vectorised UTF-8 scanning: words, their 64-bit hashes, and hashes of word k-grams.

Everything works on the bytes of an Arrow string column, so no Python object is
made per word. A word's hash is a polynomial over a random byte table modulo
2^64 followed by a bijective finaliser; equality of such hashes stands for
equality of words (a given pair of different words agrees with probability
about 2^-64).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_U = np.uint64
_PIECE = 1 << 20
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)
_GRAM = 0xD6E8FEB86659FD93 | 1
_pow: list[np.ndarray] = []

#: Classes of word bytes. SPACED: all but space and \x09-\x0D; ALNUM: digits, letters and all non-ASCII;
#: LETTERS: ASCII letters and all non-ASCII.
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
LETTERS = ALNUM.copy()
LETTERS[0x30:0x3A] = False
LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[0x41:0x5B] += 0x20
SAME = np.arange(256, dtype=np.uint8)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _pow or len(_pow[0]) < n:
        size = max(n, 1 << 18)
        _pow[:] = [np.cumprod(np.concatenate([[_U(1)], np.full(size - 1, _U(p))]), dtype=np.uint64) for p in (_P, _PINV)]
    return _pow[0], _pow[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser, in place."""
    x ^= x >> _U(33)
    x *= _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(29)
    x *= _U(0xC4CEB9FE1A85EC53)
    x ^= x >> _U(32)
    return x


@dataclass
class Words:
    """Words of consecutive rows: ``first[i]:first[i+1]`` are those of row i; byte bounds are optional."""

    hashes: np.ndarray
    first: np.ndarray
    begin: np.ndarray
    end: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def _bounds(is_word: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    before = np.empty_like(is_word)
    before[1:] = is_word[:-1]
    before[cuts] = False
    begin = np.flatnonzero(is_word & ~before)
    after = np.empty_like(is_word)
    after[:-1] = is_word[1:]
    after[-1] = False
    inner = cuts[cuts > 0] - 1
    after[inner] = False
    return begin, np.flatnonzero(is_word & ~after) + 1


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = SPACED, fold: np.ndarray = LOWERED) -> Words:
    """Words of the rows ``data[offsets[i]:offsets[i+1]]``; offsets start at 0. A word never spans two rows.

    Works through pieces of a MB cut at non-word bytes, so that a very long
    row needs 24 bytes a word and no array of its own length times eight.
    """
    n = int(offsets[-1])
    hashes, begins, ends = [], [], []
    value = _BYTE[fold]
    lo = 0
    while lo < n:
        hi = min(n, lo + _PIECE)
        while hi < n:
            gap = np.flatnonzero(~table[data[lo:hi]])
            row_cut = offsets[np.searchsorted(offsets, hi, "right") - 1]
            best = max(int(gap[-1]) + lo + 1 if len(gap) else 0, int(row_cut))
            if best > lo:
                hi = best
                break
            hi = min(n, hi + _PIECE)
        piece = data[lo:hi]
        cuts = np.unique(offsets[(offsets >= lo) & (offsets < hi)]) - lo
        b, e = _bounds(table[piece], np.union1d(cuts, [0]).astype(np.int64))
        power, inverse = _powers(len(piece) + 1)
        total = np.empty(len(piece) + 1, np.uint64)
        total[0] = 0
        terms = value[piece]
        terms *= power[: len(piece)]
        np.cumsum(terms, out=total[1:])
        hashes.append(mix((total[e] - total[b]) * inverse[b]))
        begins.append(b + lo)
        ends.append(e + lo)
        lo = hi
    join = lambda xs, t: np.concatenate(xs) if xs else np.zeros(0, t)
    begin = join(begins, np.int64)
    return Words(join(hashes, np.uint64), np.searchsorted(begin, offsets).astype(np.int64), begin, join(ends, np.int64))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive words (across rows too; callers mask those)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out *= _U(_GRAM)
        out += h[i : i + n]
    return mix(out)


def row_grams(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """k-gram hashes of each row and their offsets; a row of fewer than k words, but some, has all its words as one."""
    counts = w.counts
    full = np.maximum(counts - k + 1, 0)
    g = grams(w.hashes, k)
    row = np.repeat(np.arange(len(counts)), full)
    first = np.concatenate([[0], np.cumsum(full)])
    out = g[w.first[row] + np.arange(len(row)) - first[row]] if len(row) else np.zeros(0, np.uint64)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if not len(short):
        return out, first
    size = full.copy()
    size[short] = 1
    first2 = np.concatenate([[0], np.cumsum(size)])
    merged = np.empty(first2[-1], np.uint64)
    merged[first2[row] + np.arange(len(row)) - first[row]] = out
    for r in short:
        a, b = w.first[r], w.first[r + 1]
        merged[first2[r]] = grams(w.hashes[a:b], int(b - a))[0] ^ _U(b - a)
    return merged, first2


def distinct_sorted(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct values, ascending, with new offsets. Sorts ``values`` in place."""
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a > 1:
            values[a:b].sort()
    keep = np.ones(len(values), bool)
    keep[1:] = values[1:] != values[:-1]
    starts = first[:-1][first[:-1] < len(values)]
    keep[starts] = True
    total = np.concatenate([[0], np.cumsum(keep)])
    return values[keep], total[first]
