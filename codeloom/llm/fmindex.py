"""An FM-index over integer sequences: suffix array, Burrows-Wheeler transform in a wavelet matrix, sampled positions.

All searches are vectorised over patterns. Symbol 0 separates sequences; separators compare by position, so no pattern
and no walk to a sampled position crosses one.
"""

from __future__ import annotations

import numpy as np

SAMPLE = 16


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix order by prefix doubling; a step sorts only suffixes that are still tied. text must end with 0."""
    n = len(text)
    zeros = np.flatnonzero(text == 0)
    rank = len(zeros) + text.astype(np.int64)
    rank[zeros] = np.arange(len(zeros))
    order = np.argsort(rank, kind="stable")
    tied, key, at, depth = order, rank[order], np.arange(n), 1
    while True:
        new = np.concatenate([[True], key[1:] != key[:-1]])
        head = np.maximum.accumulate(np.where(new, at, 0))
        rank[tied] = head
        single = new & np.concatenate([new[1:], [True]])
        order[at[single]] = tied[single]
        tied, at = tied[~single], at[~single]
        if not len(tied):
            return order
        key = rank[tied] * n + rank[tied + depth]
        by = np.argsort(key, kind="stable")
        tied, key, depth = tied[by], key[by], depth * 2


class WaveletMatrix:
    """rank(c, i): how often c stands before place i. Bits are packed by 64 with running counts."""

    def __init__(self, values: np.ndarray, top: int):
        self.levels = []
        n = len(values)
        for bit in reversed(range(max(1, int(top).bit_length()))):
            ones = (values >> bit) & 1
            packed = np.packbits(np.concatenate([ones.astype(np.uint8), np.zeros(-n % 64 + 64, np.uint8)]), bitorder="little").view(np.uint64)
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(packed[:-1]), dtype=np.int64)])
            self.levels.append((bit, packed, before, n - int(ones.sum())))
            values = np.concatenate([values[ones == 0], values[ones == 1]])

    @staticmethod
    def _ones(packed: np.ndarray, before: np.ndarray, i: np.ndarray) -> np.ndarray:
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return before[i >> 6] + np.bitwise_count(packed[i >> 6] & low)

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        low, high = np.zeros_like(i), i
        for bit, packed, before, zeros in self.levels:
            one = ((c >> bit) & 1) == 1
            a, b = self._ones(packed, before, low), self._ones(packed, before, high)
            low, high = np.where(one, zeros + a, low - a), np.where(one, zeros + b, high - b)
        return high - low


class FMIndex:
    def __init__(self, text: np.ndarray):
        """text: symbols from 1, sequences ended by 0."""
        text = text.astype(np.int64)
        order = suffix_array(text)
        self.bwt = text[order - 1]
        top = int(text.max(initial=0))
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=top + 1))])
        self.tree = WaveletMatrix(self.bwt, top)
        self.sampled = (order % SAMPLE == 0) | (self.bwt == 0)
        self.sample_rank = np.cumsum(self.sampled) - 1
        self.positions = order[self.sampled]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows [from, to) of each pattern; patterns: one per row, of equal length, with known symbols."""
        known = patterns.max(axis=1, initial=0) < len(self.before) - 1
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), len(self.bwt), np.int64)
        high[~known] = 0
        for k in reversed(range(patterns.shape[1])):
            live = np.flatnonzero(low < high)
            c = patterns[live, k]
            low[live], high[live] = self.before[c] + self.tree.rank(c, low[live]), self.before[c] + self.tree.rank(c, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows, by steps back to a sampled one."""
        out, rows, steps = np.empty(len(rows), np.int64), rows.copy(), 0
        open_ = np.arange(len(rows))
        while len(open_):
            done = self.sampled[rows]
            out[open_[done]] = self.positions[self.sample_rank[rows[done]]] + steps
            open_, rows, steps = open_[~done], rows[~done], steps + 1
            c = self.bwt[rows]
            rows = self.before[c] + self.tree.rank(c, rows)
        return out
