"""Vectorised 64-bit hashing of words, shingles and byte windows (numpy, modulo 2**64)."""

from __future__ import annotations

import numpy as np

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_TABLE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for k, base in enumerate((_BASE, _INVERSE)):
            out = np.full(size, base, U64)
            out[0] = 1
            _powers[k] = np.multiply.accumulate(out)
    return _powers[0][:n], _powers[1]


def word_hashes(data: bytes) -> np.ndarray:
    """Hash of each word ``[^\\x20\\x09-\\x0D]+`` of ``data``, in order."""
    b = np.frombuffer(data, np.uint8)
    if not len(b):
        return np.zeros(0, U64)
    inside = np.r_[False, ~_SPACE[b], False]
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    up, down = powers(len(b) + 1)
    total = np.zeros(len(b) + 1, U64)
    np.cumsum(_TABLE[b] * up[:len(b)], out=total[1:])
    return mix((total[end] - total[start]) * down[start])


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of ``width`` adjacent words; with fewer words the whole sequence is one."""
    if not len(words):
        return np.zeros(0, U64)
    width = min(width, len(words))
    n = len(words) - width + 1
    h = np.zeros(n, U64)
    for k in range(width):
        h = h * U64(0xD6E8FEB86659FD93) + words[k:k + n]
    return np.unique(mix(h))


def byte_windows(b: np.ndarray, width: int) -> np.ndarray:
    """Hash of each ``width``-byte window, by doubling."""
    n = len(b) - width + 1
    if n <= 0:
        return np.zeros(0, U64)
    g, w, out, at = _TABLE[b], 1, None, 0
    while w <= width:
        if width & w:
            piece = g[at:at + n]
            out = piece.copy() if out is None else out * U64(0xA24BAED4963EE407) + piece
            at += w
        if 2 * w <= width:
            g = g[:-w] * U64(0x9FB21C651E98DF25 + 2 * w) + g[w:]
        w *= 2
    return mix(out)


def sliding(op, x: np.ndarray, width: int) -> np.ndarray:
    """``op`` (np.minimum or np.maximum) over each window of ``width`` values, by doubling."""
    n = len(x) - width + 1
    w = 1
    while 2 * w <= width:
        x = op(x[:-w], x[w:])
        w *= 2
    return op(x[:n], x[width - w:width - w + n])
