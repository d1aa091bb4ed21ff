"""A minimal acyclic transducer from words to token ids.

The words are compiled, in sorted order, into the smallest deterministic automaton that accepts just them: equal suffixes
share states. Every arc carries the number of words that sort before those behind it, so that the numbers along a path
add up to the word's index, and the index leads to the word's ids. The arrays lie in one file, which workers map into
memory and walk for many words at once.
"""

from __future__ import annotations

import mmap
import struct

import numpy as np

MAGIC = b"CVLX0001"


def build(words: list[bytes], ids: list[list[int]]) -> dict[str, np.ndarray]:
    """Arrays of the transducer for distinct ``words``; ``ids`` has the output of each."""
    order = sorted(range(len(words)), key=words.__getitem__)
    register: dict[tuple, int] = {}
    arcs: list[dict[int, int]] = []
    final: list[bool] = []
    count: list[int] = []

    def freeze(node: list) -> int:
        key = (node[0], tuple(node[1].items()))
        at = register.get(key)
        if at is None:
            at = register[key] = len(arcs)
            arcs.append(node[1])
            final.append(node[0])
            count.append(node[0] + sum(count[t] for t in node[1].values()))
        return at

    path: list[list] = [[False, {}]]  # the states of the last word, not frozen: [final, arcs]
    last = b""
    for i in order:
        word = words[i]
        shared = 0
        for a, b in zip(last, word):
            if a != b:
                break
            shared += 1
        while len(path) - 1 > shared:
            at = freeze(path.pop())
            path[-1][1][last[len(path) - 1]] = at
        for _ in word[shared:]:
            path.append([False, {}])
        path[-1][0] = True
        last = word
    while len(path) > 1:
        at = freeze(path.pop())
        path[-1][1][last[len(path) - 1]] = at
    root = freeze(path.pop())

    # State 0 stands for "no such word"; bytes that no word holds share one column.
    used = sorted({b for w in words for b in w})
    column = np.zeros(256, dtype=np.int32)
    column[used] = np.arange(1, len(used) + 1)
    n, width = len(arcs) + 1, len(used) + 1
    step = np.zeros((n, width), dtype=np.int32)
    skip = np.zeros((n, width), dtype=np.int32)
    for s, out in enumerate(arcs):
        before = int(final[s])
        for b, t in out.items():  # arcs were added in byte order
            step[s + 1, column[b]] = t + 1
            skip[s + 1, column[b]] = before
            before += count[t]
    outputs = [ids[i] for i in order]
    start = np.zeros(len(order) + 1, dtype=np.int32)
    np.cumsum([len(x) for x in outputs], out=start[1:])
    flat = np.array([x for o in outputs for x in o], dtype=np.int32)
    return {"column": column, "step": step.ravel(), "skip": skip.ravel(), "final": np.array([False, *final], dtype=np.int32), "start": start, "ids": flat, "shape": np.array([root + 1, width], dtype=np.int32)}


def to_bytes(arrays: dict[str, np.ndarray]) -> bytes:
    """One file's content: magic, number of arrays, then name, length and place of each, then the arrays."""
    head, body, at = [], [], 0
    for name, a in arrays.items():
        data = np.ascontiguousarray(a, dtype="<i4").tobytes()
        head.append(struct.pack("<16sqq", name.encode(), len(a), at))
        body.append(data)
        at += len(data)
    return MAGIC + struct.pack("<q", len(head)) + b"".join(head) + b"".join(body)


class Lexicon:
    """A transducer file, mapped into memory."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self._map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        if self._map[:8] != MAGIC:
            raise ValueError(f"{path} is no lexicon")
        (n,) = struct.unpack_from("<q", self._map, 8)
        base = 16 + 32 * n
        got = {}
        for i in range(n):
            name, size, at = struct.unpack_from("<16sqq", self._map, 16 + 32 * i)
            got[name.rstrip(b"\0").decode()] = np.frombuffer(self._map, dtype="<i4", count=size, offset=base + at)
        self.column, self.step, self.skip, self.final, self.start, self.ids = (got[k] for k in ("column", "step", "skip", "final", "start", "ids"))
        self.root, self.width = map(int, got["shape"])

    def index(self, words: list[bytes]) -> np.ndarray:
        """The index of each word, -1 where it isn't in the lexicon."""
        n = len(words)
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=n)
        begins = np.cumsum(lengths) - lengths
        columns = self.column[np.frombuffer(b"".join(words), dtype=np.uint8)]
        order = np.argsort(-lengths, kind="stable")  # at step k the words longer than k come first
        longer = n - np.searchsorted(np.sort(lengths), np.arange(int(lengths.max(initial=0)) + 1), side="right")
        state = np.full(n, self.root, dtype=np.int64)
        total = np.zeros(n, dtype=np.int64)
        for k in range(int(lengths.max(initial=0))):
            alive = order[: longer[k]]
            alive = alive[state[alive] > 0]
            if not len(alive):
                break
            arc = state[alive] * self.width + columns[begins[alive] + k]
            total[alive] += self.skip[arc]
            state[alive] = self.step[arc]
        return np.where(self.final[state] > 0, total, -1)
