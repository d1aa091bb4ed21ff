"""Words: maximal runs of letters and digits, compared in lower case, and rolling hashes of runs of words."""

from __future__ import annotations

import re

import numpy as np

_WORD = re.compile(r"[^\W_]+")
_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)


def words(text: str | None) -> list[str]:
    """The words of a text; none for None."""
    if not text:
        return []
    if "İ" in text:  # its lower case holds a mark that would end the word
        return [w.lower() for w in _WORD.findall(text)]
    return _WORD.findall(text.lower())


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that sums of its values don't collide by pattern."""
    h = np.asarray(h).astype(np.uint64)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Rolling:
    """Karp-Rabin hashes modulo 2**64 of all runs in a sequence of 64-bit codes."""

    _powers = np.ones(1, dtype=np.uint64)
    _inverses = np.ones(1, dtype=np.uint64)

    def __init__(self, codes: np.ndarray):
        n = len(codes)
        self._grow(n)
        self.n = n
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(mix(codes) * Rolling._powers[:n], dtype=np.uint64, out=self.sums[1:])

    @classmethod
    def _grow(cls, n: int) -> None:
        if len(cls._powers) <= n:
            size = 2 * n + 1024
            powers = np.full(size, _BASE, dtype=np.uint64)
            inverses = np.full(size, _INVERSE, dtype=np.uint64)
            powers[0] = inverses[0] = 1
            cls._powers, cls._inverses = np.multiply.accumulate(powers), np.multiply.accumulate(inverses)

    def runs(self, length: int) -> np.ndarray:
        """The hash of the run of ``length`` codes that starts at each place."""
        if self.n < length:
            return np.zeros(0, dtype=np.uint64)
        return (self.sums[length:] - self.sums[: self.n - length + 1]) * Rolling._inverses[: self.n - length + 1]
