"""Vectorised hashes of bytes: a finalizer and the hash of every substring from one running sum."""

from __future__ import annotations

import numpy as np

ODD = np.uint64(0x9E3779B97F4A7C15)
_BYTE = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64)
_held: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: a bijection that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> list[np.ndarray]:
    if not _held or len(_held[0]) <= n:
        size = max(n + 1, 1 << 20)
        inverse = np.uint64(pow(int(ODD), -1, 1 << 64))
        _held[:] = [np.cumprod(np.r_[np.uint64(1), np.full(size, b)]) for b in (ODD, inverse)]
    return _held


class Substrings:
    """Hashes of substrings of a byte array, modulo 2^64 before the finalizer."""

    def __init__(self, raw: np.ndarray) -> None:
        power, self.inverse = _powers(len(raw))
        self.raw = raw
        self.running = np.r_[np.uint64(0), np.cumsum(_BYTE[raw] * power[: len(raw)])]

    def __call__(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Hashes of raw[first:last], element by element."""
        return mix((self.running[last] - self.running[first]) * self.inverse[first] + (last - first).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))

    def all_of(self, size: int) -> np.ndarray:
        """Hashes of every substring of one size."""
        n = len(self.running) - size
        return mix((self.running[size:] - self.running[:n]) * self.inverse[:n])

    def weighted(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """A second hash of raw[first:last], for short substrings, independent of the first one."""
        n = last - first
        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        value = mix((_BYTE[self.raw[np.repeat(first, n) + step]] ^ ODD) + step.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        out = np.zeros(len(n), np.uint64)
        some = np.flatnonzero(n)
        if len(some):
            out[some] = np.add.reduceat(value, (np.cumsum(n) - n)[some])
        return out
