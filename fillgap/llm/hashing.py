"""64-bit hashes of all spans of a text in whole arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

MULTIPLIER = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(MULTIPLIER, -1, 1 << 64)
LENGTH = 0xD6E8FEB86659FD93
STEP = 1 << 18  # codes that are hashed at once


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    """Powers of the multiplier and of its inverse, modulo 2 ** 64."""
    steps = np.ones((2, n), np.uint64)
    steps[0, 1:], steps[1, 1:] = MULTIPLIER, INVERSE
    return np.cumprod(steps, axis=1, dtype=np.uint64)


class SpanHasher:
    """Hashes spans by their codes, wherever they stand. Memory beyond the result grows with STEP and the longest span only."""

    def __init__(self):
        self.tables = powers(STEP + 1)

    def __call__(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """One hash for each span; spans are in order and don't overlap."""
        parts = [self._part(codes, starts[i:k], ends[i:k]) for i, k in self._parts(starts, ends)]
        return np.concatenate(parts) if parts else np.empty(0, np.uint64)

    @staticmethod
    def _parts(starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int]]:
        i = 0
        while i < len(starts):
            k = max(i + 1, int(np.searchsorted(ends, starts[i] + STEP, side="right")))
            yield i, k
            i = k

    def _part(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        base, n = int(starts[0]), int(ends[-1]) - int(starts[0])
        up, down = self.tables if n <= STEP else powers(n + 1)  # one span longer than STEP
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((codes[base : base + n].astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
        values = (sums[ends - base] - sums[starts - base]) * down[starts - base]
        return mixed(values + (ends - starts).astype(np.uint64) * np.uint64(LENGTH))
