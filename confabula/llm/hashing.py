"""Hashes of substrings of packed text in numpy: prefix sums of a polynomial over 64-bit integers."""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(99991)
BYTE_VALUES = _RNG.integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

#: ASCII upper case to lower case, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Space and the control characters from tab to carriage return.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True


_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of the base and of its inverse."""
    if len(_POWERS[0]) <= n:
        size = 1 << max(20, int(n).bit_length())
        for i, x in enumerate((BASE, INVERSE)):
            own = np.full(size, x, np.uint64)
            own[0] = 1
            _POWERS[i] = np.cumprod(own, dtype=np.uint64)
    return _POWERS[0][: n + 1], _POWERS[1][: n + 1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


class Substrings:
    def __init__(self, data: np.ndarray):
        up, self.down = powers(len(data))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE_VALUES[data] * up[:-1], out=self.sums[1:])

    def hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Equal for equal bytes; different for others but for a chance of about 2 ** -60."""
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64) * _A)


def words(data: np.ndarray, bounds: np.ndarray, between: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and end of every run of bytes that aren't between words (ASCII white space); bounds: where rows begin, and the end."""
    solid = ~between[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    before = np.concatenate([[False], solid[:-1]]) if len(solid) else solid
    after = np.concatenate([solid[1:], [False]]) if len(solid) else solid
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return np.searchsorted(bounds, starts, "right") - 1, starts, ends
