"""Seeded 32-bit generator and normal variates with a fixed sequence for a seed."""

from __future__ import annotations

import math

WORD = 0xFFFFFFFF


class Uniform32:
    """Uniform numbers in [0, 1): the mulberry32 sequence of a 32-bit seed."""

    def __init__(self, seed: int):
        self.state = seed & WORD

    def __call__(self) -> float:
        self.state = (self.state + 0x6D2B79F5) & WORD
        z = self.state
        z = ((z ^ z >> 15) * (z | 1)) & WORD
        z ^= (z + (((z ^ z >> 7) * (z | 61)) & WORD)) & WORD
        return (z ^ z >> 14) / 4294967296

    def normal(self) -> float:
        """A standard normal by the cosine branch of Box and Muller; two draws, more if the first is 0."""
        u = 0.0
        while u == 0.0:
            u = self()
        return math.sqrt(-2 * math.log(u)) * math.cos(2 * math.pi * self())
