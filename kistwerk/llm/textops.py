"""Hashes of words and word shingles of many texts at once, in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

from .common import mix

_rng = np.random.default_rng(6)
_BYTE = _rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = int(_rng.integers(2**62)) * 2 + 1
_PLACE = _rng.integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def powers(n: int, base: int = _BASE) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i < n; base is odd."""
    key = f"{base}"
    if key not in _powers or len(_powers[key][0]) < n:
        size = max(n, 1 << 16)
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            x = np.full(size, b, np.uint64)
            x[0] = 1
            out.append(np.multiply.accumulate(x))
        _powers[key] = tuple(out)
    up, down = _powers[key]
    return up[:n], down[:n]


def word_edges(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether the byte before, and that after, each byte belongs to a word of the same text."""
    n = len(data)
    word = ~_SPACE[data]
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = word[:-1], word[1:]
    edges = off[1:-1]
    before[edges[edges < n]] = False
    after[edges[edges > 0] - 1] = False
    return before, after


def word_bounds(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words [^\\x20\\x09-\\x0D]+ of all texts start and end, in order."""
    word = ~_SPACE[data]
    before, after = word_edges(data, off)
    return np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1


def word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words [^\\x20\\x09-\\x0D]+ with A-Z in lower case, in order, and for each text where its words begin (one more than texts)."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    low = _LOWER[data]
    start, end = word_bounds(data, off)
    up, down = powers(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[low] * up, out=sums[1:])
    h = mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * _PLACE[0])
    for i in np.flatnonzero(end - start > 64):  # a polynomial alone is weak for long strings made to collide
        h[i] = xxhash.xxh64_intdigest(low[start[i] : end[i]].tobytes())
    return h, np.searchsorted(start, off)


def shingle_sets(data: np.ndarray, off: np.ndarray, k: int = 5) -> list[np.ndarray]:
    """Each text's set of k-word shingles as sorted distinct 64-bit hashes; with fewer words the whole sequence is one."""
    h, at = word_hashes(data, off)
    if len(h) >= k:
        s = h[: len(h) - k + 1] * _PLACE[1]
        for j in range(1, k):
            s += h[j : len(h) - k + 1 + j] * _PLACE[1 + j]
        s = mix(s)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(s[a : b - k + 1]))
        elif b > a:
            out.append(mix((h[a:b] * _PLACE[32 : 32 + b - a]).sum(keepdims=True) + np.array([b - a], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
