"""Vectorised words, word hashes and shingle hashes over the UTF-8 bytes of many texts at once."""

from __future__ import annotations

import numpy as np

U64 = np.uint64
#: Bytes hashed in one go, so that the running sums stay in the cache.
SPAN = 1 << 18
#: White space of the contracts: blank, and tab to carriage return.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the public splitmix64 constants)."""
    x = np.asarray(x, U64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


VALUE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
VALUE_LOWER = VALUE[LOWER]
BASE = 0x9E3779B97F4A7C15 | 1
_power = {}


def powers(base: int, n: int) -> np.ndarray:
    """1, base, base**2, ... modulo 2**64."""
    if len(_power.get(base, ())) < n:
        out = np.full(max(n, SPAN + 1), base, U64)
        out[0] = 1
        _power[base] = np.cumprod(out, dtype=U64)
    return _power[base][:n]


INVERSE = pow(BASE, -1, 1 << 64)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the number of words before each text."""
    n = data.size
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    word = ~IS_SPACE[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    before = np.zeros(n, bool)
    before[1:] = word[:-1]
    starts = np.flatnonzero(word & (~before | cut[:n]))
    after = np.zeros(n, bool)
    after[:-1] = word[1:]
    ends = np.flatnonzero(word & (~after | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets).astype(np.int64)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    """A 64-bit hash of each ascending, disjoint byte span."""
    value = VALUE_LOWER if lower else VALUE
    out = np.empty(len(starts), U64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + SPAN, "right")))
        lo, hi = int(starts[i]), int(ends[j - 1])
        total = np.zeros(hi - lo + 1, U64)
        np.cumsum(value[data[lo:hi]] * powers(BASE, hi - lo), out=total[1:])
        s = starts[i:j] - lo
        out[i:j] = (total[ends[i:j] - lo] - total[s]) * powers(INVERSE, hi - lo + 1)[s]
        i = j
    return mix(out + (ends - starts).astype(U64))


def shingles(words: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word windows of each text, in order, and where each text's start. A text with fewer words, one
    at least, has its whole sequence as one."""
    counts = np.diff(offsets)
    total = len(words)
    many = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    at = np.concatenate([[0], np.cumsum(many)])
    mult = powers(0xD6E8FEB86659FD93, k + 1)[1:]
    rolled = np.zeros(max(total - k + 1, 0), U64)
    for j in range(k):
        rolled += words[j : j + len(rolled)] * mult[j]
    out = np.empty(int(at[-1]), U64)
    first = np.repeat(offsets[:-1] - at[:-1], many) + np.arange(len(out))
    full = np.repeat(counts >= k, many)
    out[full] = mix(rolled[first[full]])
    for d in np.flatnonzero((counts > 0) & (counts < k)):
        w = words[offsets[d] : offsets[d + 1]]
        out[at[d]] = mix(np.sum(w * mult[: len(w)], dtype=U64) + U64(len(w)))
    return out, at
