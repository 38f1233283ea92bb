"""Double-array tries: every node is a place in two arrays, BASE and CHECK, and its child for a code is at BASE + code."""

from __future__ import annotations

import numpy as np

_FREE = -1


class DoubleArray:
    """A trie over sorted, distinct sequences of codes from 1 on; place 0 is the root.

    The children of a node go to BASE[node] + code, where CHECK holds their parent. Only children take up places, and
    only an only child may take any free one; siblings look for a BASE that suits all of them, first among free places.
    """

    def __init__(self, codes: np.ndarray, lengths: np.ndarray):
        self.base, self.check = np.zeros(1024, np.int64), np.full(1024, _FREE, np.int64)
        self.check[0] = 0
        self.low, self.used = 1, 1  # no place below low is free; none from used on is taken
        starts = np.cumsum(lengths) - lengths
        at, active = np.zeros(len(lengths), np.int64), np.arange(len(lengths))
        for depth in range(int(lengths.max(initial=0))):
            active = active[lengths[active] > depth]
            parent, code = at[active], codes[starts[active] + depth]
            fresh = np.r_[True, (parent[1:] != parent[:-1]) | (code[1:] != code[:-1])]  # equal prefixes stand together
            self._add(parent[fresh], code[fresh])
            at[active] = self.base[parent] + code

    def _reserve(self, size: int) -> None:
        if size > len(self.base):
            more = max(size, 2 * len(self.base)) - len(self.base)
            self.base, self.check = np.r_[self.base, np.zeros(more, np.int64)], np.r_[self.check, np.full(more, _FREE, np.int64)]

    def _add(self, parent: np.ndarray, code: np.ndarray) -> None:
        cuts = np.flatnonzero(np.r_[True, parent[1:] != parent[:-1]])
        sizes = np.diff(np.r_[cuts, len(parent)])
        for low, n in sorted(zip(cuts[sizes > 1].tolist(), sizes[sizes > 1].tolist()), key=lambda x: -x[1]):
            own = np.sort(code[low : low + n])
            self._put(parent[low : low + 1], own, self._fit(own))
        only = cuts[sizes == 1]
        if len(only):
            self._reserve(self.used + len(only))
            free = np.flatnonzero(self.check[self.low : self.used + len(only)] == _FREE)[: len(only)] + self.low
            self._put(parent[only], code[only], free - code[only])
            self.low = int(free[-1]) + 1

    def _put(self, parent: np.ndarray, code: np.ndarray, base: np.ndarray | int) -> None:
        self.base[parent] = base
        self.check[base + code] = parent
        self.used = max(self.used, int((base + code).max()) + 1)

    def _fit(self, own: np.ndarray, tries: int = 16) -> int:
        """A BASE under which all codes of own are free; beyond the last place taken there is always one."""
        reach, at = int(own[-1] - own[0]), self.low
        width = max(1, 8192 // len(own))
        self._reserve(self.used + reach + width + 2)
        for _ in range(tries):
            if at >= self.used:
                break
            free = np.flatnonzero(self.check[at : min(at + width, self.used)] == _FREE) + at
            suits = (self.check[free[:, None] + (own - own[0])[None, :]] == _FREE).all(1)
            if suits.any():
                return int(free[suits.argmax()] - own[0])
            at += width
        return self.used - int(own[0])

    def walk(self, codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The nodes of each sequence, from the root on, one sequence after the other; one that isn't in the trie is an error."""
        starts, ends = np.cumsum(lengths) - lengths, np.cumsum(lengths + 1) - lengths - 1
        out, active = np.zeros(int((lengths + 1).sum()), np.int64), np.arange(len(lengths))
        for depth in range(int(lengths.max(initial=0))):
            active = active[lengths[active] > depth]
            here = out[ends[active] + depth]
            there = self.base[here] + codes[starts[active] + depth]
            if (there < 1).any() or (there >= len(self.check)).any() or (self.check[there] != here).any():
                raise KeyError("a sequence leaves the trie")
            out[ends[active] + depth + 1] = there
        return out
