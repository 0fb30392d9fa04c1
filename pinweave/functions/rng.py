"""A small generator with named seeding for runs that must repeat across machines."""

from __future__ import annotations

import hashlib

MASK = (1 << 64) - 1


class Xoshiro256PlusPlus:
    """The public-domain xoshiro256++ generator, its four words seeded by SHA-256 of the seed's little-endian bytes."""

    def __init__(self, seed: int):
        digest = hashlib.sha256((seed & MASK).to_bytes(8, "little")).digest()
        self.s = [int.from_bytes(digest[i : i + 8], "little") for i in range(0, 32, 8)]

    def next(self) -> int:
        rotl = lambda x, k: (x << k | x >> (64 - k)) & MASK
        s = self.s
        out = (rotl((s[0] + s[3]) & MASK, 23) + s[0]) & MASK
        t = s[1] << 17 & MASK
        s[2] ^= s[0]
        s[3] ^= s[1]
        s[1] ^= s[2]
        s[0] ^= s[3]
        s[2] ^= t
        s[3] = rotl(s[3], 45)
        return out

    def random(self) -> float:
        """A double in [0, 1) from the upper 53 bits."""
        return (self.next() >> 11) * 2.0**-53

    def below(self, n: int) -> int:
        """A whole number in [0, n) by masked rejection."""
        mask = (1 << (n - 1).bit_length()) - 1
        while (x := self.next() & mask) >= n:
            pass
        return x

    def permutation(self, n: int) -> list[int]:
        """A permutation built inside out."""
        out: list[int] = []
        for i in range(n):
            j = self.below(i + 1)
            out.append(out[j] if j < i else i)
            out[j] = i
        return out

    def fork(self, label: str) -> Xoshiro256PlusPlus:
        """An independent generator for a named task; the parent does not move."""
        digest = hashlib.sha256(b"".join(x.to_bytes(8, "little") for x in self.s) + label.encode()).digest()
        return Xoshiro256PlusPlus(int.from_bytes(digest[:8], "little"))
