"""Vectorised hashes of words and of windows of words."""

from __future__ import annotations

import functools

import numpy as np

_MULT = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_MULT), -1, 1 << 64))
_BYTES = np.random.default_rng(20240301).integers(1, 1 << 63, 256, np.uint64)
_BASES = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))
SPACE = 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads each bit over all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _grow(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


@functools.lru_cache(16)
def _powers(base: int, n: int) -> np.ndarray:
    return _grow(np.uint64(base), n)


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept for up to 2**20, made anew for longer texts."""
    size = 1 << max(10, (n - 1).bit_length() if n > 1 else 0)
    return (_powers(int(base), size) if size <= 1 << 20 else _grow(base, n))[:n]


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word of a text with one blank between words and none at its ends."""
    if not text:
        return np.empty(0, np.uint64)
    a = np.frombuffer(text, np.uint8)
    end = np.append(np.flatnonzero(a == SPACE), len(a))
    start = np.append(0, end[:-1] + 1)
    total = np.zeros(len(a) + 1, np.uint64)
    np.cumsum(_BYTES[a] * powers(_MULT, len(a)), dtype=np.uint64, out=total[1:])
    return mix((total[end] - total[start]) * powers(_INVERSE, len(a))[start] + (end - start).astype(np.uint64))


def window_hashes(words: np.ndarray, width: int, kind: int = 0) -> np.ndarray:
    """A 64-bit hash of each window of ``width`` words; ``kind`` chooses one of two independent bases."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    base = _BASES[kind]
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * powers(base, len(words)), dtype=np.uint64, out=total[1:])
    inverse = np.uint64(pow(int(base), -1, 1 << 64))
    return mix((total[width:] - total[:n]) * powers(inverse, n))


def shingles(words: np.ndarray, width: int = 5) -> np.ndarray:
    """Hashes of the runs of ``width`` words; of all words together if there are fewer, none if there is no word."""
    return window_hashes(words, min(width, len(words))) if len(words) else np.empty(0, np.uint64)
