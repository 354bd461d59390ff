"""Hashes of words and of byte strings, over whole batches at once.

A string's hash is a polynomial over 64-bit words, one per byte value, in an
odd base modulo 2**64.  Equal strings get equal hashes in every process.
"""

from __future__ import annotations

import numpy as np

_RNG = np.random.Generator(np.random.PCG64(20240607))
#: A word per byte value.
BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
WORD_BYTE = np.where(SPACE, np.uint64(0), BYTE)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


class Powers:
    """Powers of the base and of its inverse, as many as were asked for so far."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = 1 << (n - 1).bit_length()
            for name, base in (("up", BASE), ("down", INVERSE)):
                steps = np.full(size, base, dtype=np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up, self.down


def word_hashes(texts: list[bytes], powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, one after another, and where each text's begin."""
    raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    inside = ~SPACE[raw]
    starts = np.flatnonzero(inside & np.append(True, ~inside[:-1]))
    ends = np.cumsum([len(t) + 1 for t in texts])
    bounds = np.searchsorted(starts, np.append(0, ends))
    if not len(starts):
        return np.zeros(0, np.uint64), bounds
    up, down = powers.get(len(raw))
    sums = np.add.reduceat(WORD_BYTE[raw] * up[: len(raw)], starts)
    return mix(sums * down[starts]), bounds
