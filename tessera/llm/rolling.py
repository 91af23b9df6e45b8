"""Rolling hashes of byte ranges, for whole Arrow batches at a time.

A range's hash is a polynomial of its bytes modulo the prime 2**61 - 1, from prefix sums, then mixed;
it does not depend on where the range stands, and any range costs the same. Two different ranges of n
bytes agree with a probability of n / 2**61 at most, whatever their bytes; with two bases, of its square.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
PRIME = U((1 << 61) - 1)
#: Drawn once; two of them give 122 bits.
BASES = (0x0E3779B97F4A7C15, 0x02B2AE3D27D4EB4F)
#: Bytes whose sums are taken at once, so that they stay below 2**64.
BLOCK = 1 << 20
LOW31, LOW30 = U((1 << 31) - 1), U((1 << 30) - 1)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The finishing steps of a well-known 64-bit mixer."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


def reduced(x: np.ndarray) -> np.ndarray:
    """x modulo the prime."""
    x = (x & PRIME) + (x >> U(61))
    return np.where(x >= PRIME, x - PRIME, x)


def times(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    """a * b modulo the prime, of factors below it, by halves of 30 and 31 bits."""
    ah, al, bh, bl = a >> U(31), a & LOW31, b >> U(31), b & LOW31
    cross = al * bh + ah * bl
    return reduced(U(2) * (ah * bh) + (cross >> U(30)) + ((cross & LOW30) << U(31)) + al * bl)


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of base and of its inverse, n of each at least."""
    if base not in _powers or len(_powers[base][0]) < n:
        size, made = 1 << max(16, (n - 1).bit_length()), []
        for b in (base, pow(base, -1, int(PRIME))):
            ups = np.ones(1, U)
            while len(ups) < size:
                ups = np.concatenate([ups, times(ups, U(pow(b, len(ups), int(PRIME))))])
            made.append(ups)
        _powers[base] = made[0], made[1]
    return _powers[base]


class Ranges:
    """Hashes of ranges of one stretch of bytes."""

    def __init__(self, data: np.ndarray, base: int = BASES[0]):
        up, self.down = powers(base, len(data) + 1)
        self.sums = np.zeros(len(data) + 1, U)
        for a in range(0, len(data), BLOCK):
            x, y = data[a : a + BLOCK].astype(U) + U(1), up[a : a + BLOCK][: len(data) - a]
            low, high = np.cumsum(x * (y & LOW31)), np.cumsum(x * (y >> U(31)))
            self.sums[a + 1 : a + 1 + len(x)] = reduced(low + (high >> U(30)) + ((high & LOW30) << U(31)) + self.sums[a])

    def between(self, starts, ends, down) -> np.ndarray:
        x = self.sums[ends] + PRIME - self.sums[starts]
        return mix(times(np.where(x >= PRIME, x - PRIME, x), down))

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return self.between(starts, ends, self.down[starts])

    def fixed(self, size: int) -> np.ndarray:
        """The hash of every range of so many bytes."""
        n = len(self.sums) - size
        return self.between(slice(0, n), slice(size, None), self.down[:n]) if n > 0 else np.zeros(0, U)


def sequences(values: np.ndarray, size: int) -> np.ndarray:
    """The hash of every run of so many values below the prime."""
    n = len(values) - size + 1
    if n <= 0:
        return np.zeros(0, U)
    total = values[:n]
    for k in range(1, size):
        total = reduced(times(total, U(BASES[1])) + values[k : n + k])
    return mix(total)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every window, by doubling."""
    span = 1
    while 2 * span <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (width - span)], x[width - span :]) if width > span else x


def firsts(keys: list[np.ndarray], order: list[np.ndarray]) -> np.ndarray:
    """True for the rows whose order is the least among the rows with their keys; equal orders are all first."""
    n = len(order[0])
    if not n:
        return np.zeros(0, bool)
    by = np.lexsort([*reversed(order), *reversed(keys)])
    fresh = np.ones(n, bool)
    fresh[1:] = np.logical_or.reduce([k[by[1:]] != k[by[:-1]] for k in keys])
    head = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    least = np.logical_and.reduce([o[by] == o[by[head]] for o in order])
    out = np.zeros(n, bool)
    out[by] = least
    return out
