"""Restricted recompression of many texts at once.

A text is a sequence of symbols, at first its characters. A run round names every run of equal symbols by (symbol, count);
a pair round gives each symbol a side, left or right, by a bit of its name, and names every adjacent (left, right) pair.
A name is a 64-bit hash of what it stands for, so equal content has one name in all texts and no round needs a dictionary
that the tasks would have to share. Symbols longer than a round's limit stay as they are.

What a symbol is depends on the characters around it, but not on many: a left symbol of a pair round looks only at its
right neighbour, a right symbol only at its left one. The interval of characters on which each symbol depends is carried
along; wherever that stretch of text stands, in whatever text, it holds that very symbol.
"""

from __future__ import annotations

import numpy as np

from corvine.llm.words import mix

RUN_LIMITS = (1, 4)
PAIR_LIMITS = (1, 1, 2, 2, 4, 4, 8, 8, 16, 16, 32, 32, 64, 64)
FAR = 1 << 30
_ONE, _TWO = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


class Symbols:
    """The symbols of several texts, one text after another.

    ``name``; ``start`` and ``size`` in characters; ``low`` and ``high`` bound the characters that decide about the symbol
    (a place before the text or FAR after it if the text's edge does), and neither falls from a symbol to the next one;
    ``text`` numbers the texts. Places count from the beginning of all texts.
    """

    def __init__(self, codes: np.ndarray, bounds: np.ndarray):
        n = len(codes)
        self.bounds = bounds
        self.name = mix(codes.astype(np.uint64) + np.uint64(0x51ED270B))
        self.start = np.arange(n, dtype=np.int32)
        self.size = np.ones(n, dtype=np.int32)
        self.low, self.high = self.start.copy(), self.start + np.int32(1)
        self.text = np.repeat(np.arange(len(bounds) - 1, dtype=np.int32), np.diff(bounds))

    def _edges(self) -> np.ndarray:
        """Where a symbol is its text's last."""
        last = np.ones(len(self.name), dtype=bool)
        last[:-1] = self.text[1:] != self.text[:-1]
        return last

    def _keep(self, at: np.ndarray) -> None:
        for k in ("name", "start", "size", "low", "high", "text"):
            setattr(self, k, getattr(self, k)[at])

    def runs(self, limit: int) -> None:
        if len(self.name) < 2:
            return
        last = self._edges()
        short = self.size <= limit
        same = (self.name[1:] == self.name[:-1]) & ~last[:-1] & short[1:]
        head = np.flatnonzero(np.concatenate([[True], ~same]))
        tail = np.append(head[1:], len(self.name)) - 1
        # A short symbol or run of them looks at both neighbours, the text's edge included.
        low_before = np.where(head > 0, self.low[head - 1], -FAR)
        low_before[np.concatenate([[True], last[head[1:] - 1]])] = -FAR
        high_after = np.where(last[tail], FAR, self.high[np.minimum(tail + 1, len(self.name) - 1)])
        looks = short[head]
        low = np.where(looks, low_before, self.low[head]).astype(np.int32)
        high = np.where(looks, high_after, self.high[tail]).astype(np.int32)
        size = np.add.reduceat(self.size, head).astype(np.int32)
        count = (tail - head + 1).astype(np.uint64)
        self._keep(head)
        self.low, self.high, self.size = low, high, size
        many = count > 1
        self.name[many] = mix(self.name[many] * _ONE + count[many] * _TWO + np.uint64(limit))

    def pairs(self, limit: int, number: int) -> None:
        n = len(self.name)
        if n < 2:
            return
        last = self._edges()
        short = self.size <= limit
        side = ((self.name >> np.uint64(7 + number)) & np.uint64(1)).astype(bool)  # True: right
        left, right = short & ~side, short & side
        low, high = self.low, self.high
        # left symbols look at the next one, right symbols at the one before; bounds never fall from one symbol to the next,
        # so a look to the right only moves the upper bound, one to the left only the lower
        inner = ~last[:-1]
        new_low, new_high = low.copy(), high.copy()
        new_high[:-1] = np.where(left[:-1] & inner, high[1:], high[:-1])
        new_low[1:] = np.where(right[1:] & inner, low[:-1], low[1:])
        new_high[left & last] = FAR
        new_low[0] = -FAR if right[0] else new_low[0]
        first = np.flatnonzero(last[:-1]) + 1
        new_low[first[right[first]]] = -FAR
        joined = np.flatnonzero(left[:-1] & right[1:] & inner)
        name, size = self.name, self.size
        name[joined] = mix(name[joined] * _ONE ^ (name[joined + 1] * _TWO + np.uint64(number)))
        size[joined] += size[joined + 1]
        keep = np.ones(n, dtype=bool)
        keep[joined + 1] = False
        self.low, self.high = new_low, new_high
        self._keep(np.flatnonzero(keep))


def parse(texts: list[str], pair_limits: tuple[int, ...] = PAIR_LIMITS, run_limits: tuple[int, ...] = RUN_LIMITS) -> Symbols:
    """The top symbols of ``texts``."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), dtype="<u4")
    bounds = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) for t in texts], out=bounds[1:])
    s = Symbols(codes, bounds)
    done: set[int] = set()
    for number, limit in enumerate(pair_limits):
        if limit in run_limits and limit not in done:
            s.runs(limit)
            done.add(limit)
        s.pairs(limit, number)
    return s
