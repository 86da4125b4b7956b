"""Hashes of every byte window of a text at once, with numpy."""

from __future__ import annotations

import numpy as np

# An odd base, its inverse modulo 2^64, and the mixer's multipliers.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_OF_BYTE = np.random.Generator(np.random.PCG64(20260101)).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers = {BASE: np.ones(1, np.uint64), INVERSE: np.ones(1, np.uint64)}


def powers(base: int, n: int) -> np.ndarray:
    """The first n powers modulo 2^64, kept for the worker's other texts."""
    have = _powers[base]
    while len(have) < n:
        have = np.concatenate([have, have * np.uint64(pow(base, len(have), 1 << 64))])
        _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX[0]
    x = (x ^ (x >> np.uint64(27))) * MIX[1]
    return x ^ (x >> np.uint64(31))


class Prefixes:
    """Polynomial prefix sums of a text's bytes, each byte standing for a random number."""

    def __init__(self, data: bytes):
        self.bytes = np.frombuffer(data, np.uint8)
        n = len(self.bytes)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_OF_BYTE[self.bytes] * powers(BASE, n), out=self.sums[1:])
        self.inverse = powers(INVERSE, n + 1)

    def between(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A hash of the bytes of each span; equal strings have equal hashes, wherever they are."""
        return mix((self.sums[ends] - self.sums[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64))

    def windows(self, length: int) -> np.ndarray:
        """Hashes of all windows of one length."""
        return mix((self.sums[length:] - self.sums[:-length]) * self.inverse[: len(self.sums) - length])


def as_signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
