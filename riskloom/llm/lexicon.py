"""A minimal acyclic transducer from words (bytes) to lists of token ids.

Words are added in byte order and every finished suffix is merged with an equal
one (shared suffixes), which gives the minimal automaton directly.  A node knows how
many words lie below each arc, so following a word adds up its number in byte order
(a perfect hash), and the number selects its ids in one table: that is the output of
the transducer.  The whole is one file of flat little-endian arrays that workers map
into memory; nothing is parsed or copied.
"""

from __future__ import annotations

import mmap
from collections.abc import Iterable

import numpy as np

_MAGIC = 0x4C455831


def build(entries: Iterable[tuple[bytes, list[int]]]) -> bytes:
    """The file of a lexicon; ``entries`` are unique words with their ids, in byte order."""
    register: dict[tuple, int] = {}
    nodes: list[tuple[bool, tuple[tuple[int, int], ...]]] = []

    def close(node: list) -> int:
        key = (node[0], tuple((label, child) for label, child in node[1]))
        at = register.get(key)
        if at is None:
            at = register[key] = len(nodes)
            nodes.append(key)
        return at

    outputs: list[int] = []
    ends = [0]
    path: list[list] = [[False, []]]  # open nodes: [final, arcs]; the last arc of each leads to the next
    last = b""
    for word, ids in entries:
        if word <= last and len(ends) > 1:
            raise ValueError("words must be unique and in byte order")
        common = 0
        while common < min(len(word), len(last)) and word[common] == last[common]:
            common += 1
        while len(path) > common + 1:
            done = close(path.pop())
            path[-1][1][-1] = (path[-1][1][-1][0], done)
        for byte in word[common:]:
            path[-1][1].append((byte, -1))
            path.append([False, []])
        path[-1][0] = True
        outputs.extend(ids)
        ends.append(len(outputs))
        last = word
    while len(path) > 1:
        done = close(path.pop())
        path[-1][1][-1] = (path[-1][1][-1][0], done)
    root = close(path[0])

    below = np.zeros(len(nodes), dtype=np.int64)  # children come before their parents
    first, label, target, skip = [0], [], [], []
    for i, (final, arcs) in enumerate(nodes):
        seen = int(final)
        for byte, child in arcs:
            label.append(byte)
            target.append(child)
            skip.append(seen)
            seen += int(below[child])
        below[i] = seen
        first.append(len(label))
    final = np.array([n[0] for n in nodes], dtype=np.int32)
    parts = [np.array(x, dtype=np.int32) for x in (first, label, target, skip)] + [final, np.array(ends, dtype=np.int32), np.array(outputs, dtype=np.int32)]
    head = np.array([_MAGIC, root, *[len(p) for p in parts]], dtype=np.int32)
    return b"".join(p.tobytes() for p in [head, *parts])


class Lexicon:
    """A mapped lexicon file; ``get`` gives the ids of a word, or None."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            self._map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        head = np.frombuffer(self._map, dtype=np.int32, count=9)
        if head[0] != _MAGIC:
            raise ValueError(f"{path} is no lexicon")
        at, views = 36, []
        for n in head[2:]:
            views.append(memoryview(self._map)[at : at + 4 * int(n)].cast("i"))
            at += 4 * int(n)
        self._root = int(head[1])
        self._first, self._label, self._target, self._skip, self._final, self._ends, self._out = views

    def __len__(self) -> int:
        return len(self._ends) - 1

    @property
    def nodes(self) -> int:
        return len(self._final)

    def get(self, word: bytes) -> list[int] | None:
        first, label, target, skip = self._first, self._label, self._target, self._skip
        node, number = self._root, 0
        for byte in word:
            lo, hi = first[node], first[node + 1]
            while lo < hi:
                mid = (lo + hi) >> 1
                if label[mid] < byte:
                    lo = mid + 1
                else:
                    hi = mid
            if lo == first[node + 1] or label[lo] != byte:
                return None
            number += skip[lo]
            node = target[lo]
        return self._out[self._ends[number] : self._ends[number + 1]].tolist() if self._final[node] else None
