"""Keyed permutations of the numbers 0 to n - 1: Feistel networks with cycle-walking.

The network permutes the numbers of an even count of bits, at most four times `n`. A result of `n` or
more is put in again until one below `n` comes out; that keeps the map one-to-one on 0 to n - 1.
"""

from hashlib import blake2b

import numpy as np


def _half(n):
    return max(1, ((n - 1).bit_length() + 1) // 2)


class Permutation:
    """A permutation of 0 to n - 1 for numbers of any size, with a cryptographic round function."""

    def __init__(self, n: int, key: bytes, rounds: int = 8):
        if n < 1:
            raise ValueError("n must be at least 1")
        self.n, self.half, self.rounds = n, _half(n), rounds
        self.mask = (1 << self.half) - 1
        self._hash = blake2b(n.to_bytes((n.bit_length() + 7) // 8, "big"), key=key[:64], digest_size=64)

    def _round(self, i, value):
        state = self._hash.copy()
        state.update(bytes([i]) + value.to_bytes((self.half + 7) // 8, "big"))
        return int.from_bytes(state.digest(), "big") & self.mask

    def _once(self, x):
        left, right = x >> self.half, x & self.mask
        for i in range(self.rounds):
            left, right = right, left ^ self._round(i, right)
        return left << self.half | right

    def _back(self, x):
        left, right = x >> self.half, x & self.mask
        for i in reversed(range(self.rounds)):
            left, right = right ^ self._round(i, left), left
        return left << self.half | right

    def __call__(self, x: int) -> int:
        x = self._once(x)
        while x >= self.n:
            x = self._once(x)
        return x

    def inverse(self, x: int) -> int:
        x = self._back(x)
        while x >= self.n:
            x = self._back(x)
        return x

    def pseudonym(self, x: int) -> int:
        """The next number on one keyed cycle through all of them, so that no number keeps its place
        (but for n = 1)."""
        return self((self.inverse(x) + 1) % self.n)

    def original(self, y: int) -> int:
        """The number whose pseudonym is `y`."""
        return self((self.inverse(y) - 1) % self.n)


def _mix(x):
    """A 64-bit mixing function on arrays."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class ArrayPermutation:
    """A permutation of 0 to n - 1 for arrays of numbers, for order rather than secrecy."""

    def __init__(self, n: int, key: str, rounds: int = 6):
        if not 1 <= n <= 1 << 62:
            raise ValueError("n must be from 1 to 2**62")
        self.n, self.half = n, np.uint64(_half(n))
        self.mask = np.uint64((1 << int(self.half)) - 1)
        digest = blake2b(key.encode(), digest_size=8 * rounds).digest()
        self.keys = np.frombuffer(digest, np.uint64)

    def _once(self, x):
        left, right = x >> self.half, x & self.mask
        for key in self.keys:
            left, right = right, left ^ (_mix(right ^ key) & self.mask)
        return left << self.half | right

    def _back(self, x):
        left, right = x >> self.half, x & self.mask
        for key in self.keys[::-1]:
            left, right = right ^ (_mix(left ^ key) & self.mask), left
        return left << self.half | right

    def _walk(self, x, step):
        x = step(np.asarray(x).astype(np.uint64))
        out = x >= self.n
        while out.any():
            x[out] = step(x[out])
            out = x >= self.n
        return x.astype(np.int64)

    def __call__(self, x) -> np.ndarray:
        return self._walk(x, self._once)

    def inverse(self, x) -> np.ndarray:
        return self._walk(x, self._back)
