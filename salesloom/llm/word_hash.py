"""Hashes of words and word sequences of many texts at once, in numpy.

Words are runs of bytes other than the six ASCII white-space characters. A word's hash is a
polynomial of its bytes, taken from prefix sums over the whole buffer, then mixed; a sequence
of words is hashed the same way over its words' hashes. All arithmetic is modulo 2^64.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, _INVERSE):
        p = np.full(n, base, dtype=np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, index of each text's first word and the end)."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    n = len(data)
    up, down = _powers(1 << max(16, int(n).bit_length()))
    gap = _SPACE[data]
    before = np.empty_like(gap)
    before[0], before[1:] = True, gap[:-1]
    starts, ends = np.flatnonzero(before & ~gap), np.flatnonzero(gap & ~before)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    bounds = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    return hashes, np.searchsorted(starts, bounds)


def sequence_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """The hash of each k consecutive words (those of one text, or of texts end to end)."""
    if len(words) < k:
        return np.zeros(0, dtype=np.uint64)
    n = len(words) - k + 1
    total = words[:n].copy()
    for j in range(1, k):
        total = total * _STEP + words[j : j + n]
    return mix(total)
