"""Cuts that no token can cross.

A vocabulary holds a limited set of neighbouring symbols: the pairs found inside its
tokens. Between two symbols that form no such pair, no token lies across, so a text may
be cut there and its fragments encoded one by one. ``symbols`` are bytes for a byte-level
vocabulary and code points for a vocabulary of characters.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np


class PairTable:
    """Which symbols below ``width`` stand next to each other inside some token.

    Symbols of ``width`` and above are taken to pair with everything, so a cut is only
    made where it is certain.
    """

    def __init__(self, tokens: Iterable[Iterable[int]], width: int):
        self.width = width
        self.joined = np.zeros((width + 1) * (width + 1), dtype=bool)
        self.joined[width * (width + 1) :] = True
        self.joined[width :: width + 1] = True
        for token in tokens:
            symbols = [min(s, width) for s in token]
            for a, b in zip(symbols, symbols[1:]):
                self.joined[a * (width + 1) + b] = True

    def open(self, symbols: np.ndarray) -> np.ndarray:
        """For each neighbouring pair, whether no token joins it."""
        s = np.minimum(symbols.astype(np.int32), self.width)
        return ~self.joined[s[:-1] * (self.width + 1) + s[1:]]


class FragmentMemo(dict):
    """Results by fragment. Cleared when it holds ``most`` of them, so its size stays bounded."""

    def __init__(self, make, most: int = 400_000, longest: int = 64):
        super().__init__()
        self.make, self.most, self.longest = make, most, longest

    def __missing__(self, fragment):
        value = self.make(fragment)
        if len(fragment) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[fragment] = value
        return value
