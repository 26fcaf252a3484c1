"""Vectorised hashing of spans of code points or bytes (numpy).

Each value is hashed with its place in its span, and a span's hash is the mixed sum of these, so there is no
algebra between neighbours that structured texts could meet (a polynomial modulo 2**64 gives one hash to
the two Thue-Morse words of 4,096 letters). Sums run over the whole text, so beginnings of a span cost nothing more.
"""

from __future__ import annotations

import numpy as np

#: Values that are hashed together, so that they stay in a core's cache.
BLOCK = 1 << 14


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def prefix_sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Running sums of the values' hashes; a value's place counts from the last of the starts (ascending) at or before it."""
    n = len(values)
    out = np.zeros(n + 1, np.uint64)
    v, room = out[1:], np.empty(min(n, BLOCK), np.uint64)
    bounds = np.concatenate([[0], starts, [n]]).astype(np.int64)
    base = np.repeat(bounds[:-1], np.diff(bounds)).view(np.uint64)
    with np.errstate(over="ignore"):
        for a in range(0, n, BLOCK):
            w = v[a : a + BLOCK]
            x = room[: len(w)]
            np.subtract(np.arange(a, a + len(w), dtype=np.uint64), base[a : a + BLOCK], out=w)
            w <<= np.uint64(21)
            w += values[a : a + BLOCK]
            w += np.uint64(0x9E3779B97F4A7C15)
            w *= np.uint64(0xBF58476D1CE4E5B9)
            w ^= np.right_shift(w, np.uint64(29), out=x)
            w *= np.uint64(0x94D049BB133111EB)
            w ^= np.right_shift(w, np.uint64(32), out=x)
        np.cumsum(v, out=v)
    return out


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans that begin at the starts of the sums, equal for equal content wherever it stands."""
    with np.errstate(over="ignore"):
        return mix(sums[ends] - sums[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
