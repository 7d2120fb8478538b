"""A context tree over bytes, weighted and folded into one probability per node.

A byte is eight binary decisions, most significant bit first. A node is a context of 0 to DEPTH bytes before and the bits
of the byte decided so far, with the counts of zeros and ones that followed in training. Its own estimate is
Krichevsky-Trofimov's. Context-tree weighting gives every node half its weight for stopping there and half for its
longer contexts:  Pw = (Pe + product of the longer contexts' Pw) / 2  and  Pw = Pe at full depth. Along a path of
contexts, the estimates of all depths mix with the resulting posterior weights; a path ends at the longest context that
training has seen, which takes the weight that is left.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np

DEPTH = 6


def log_gamma(x: np.ndarray) -> np.ndarray:
    """For x >= 0.5, by Stirling's series after a shift of eight."""
    shift = np.zeros_like(x)
    for k in range(8):
        shift += np.log(x + k)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log probability that the Krichevsky-Trofimov estimator gives to a sequence with these counts."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - 2 * math.lgamma(0.5) - log_gamma(zeros + ones + 1.0)


def contexts(stream: np.ndarray, depth: int) -> np.ndarray:
    """Of each byte of the stream from place `depth` on: the bytes before and itself as one number, itself lowest."""
    n = len(stream) - depth
    key = np.zeros(max(0, n), np.int64)
    for k in range(depth + 1):
        key = (key << 8) | stream[k : k + n]
    return key


class Places:
    """Places of distinct numbers, none below 0, in a hash table with open addresses: a lookup costs about one step, where a
    binary search in a large array misses the cache at each of its twenty."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        bits = max(4, int(len(keys)).bit_length() + 1)
        self.shift, self.last = np.uint64(64 - bits), (1 << bits) - 1
        self.table = np.full(1 << bits, -1, np.int32)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = left[self.table[slot[left]] < 0]
            self.table[slot[free]] = free
            left = left[self.table[slot[left]] != left]
            slot[left] = (slot[left] + 1) & self.last

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).view(np.int64)

    def of(self, keys: np.ndarray) -> np.ndarray:
        """The place of each number, or -1."""
        slot = self._slot(keys)
        at = self.table[slot]
        open_ = np.flatnonzero((at >= 0) & (self.keys[at] != keys))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & self.last
            at[open_] = self.table[slot[open_]]
            open_ = open_[(at[open_] >= 0) & (self.keys[at[open_]] != keys[open_])]
        return at


#: Of nodes with the same number of context bytes and decided bits: their numbers in rising order, how often they occur, and the ones
Nodes = tuple[np.ndarray, np.ndarray, np.ndarray]


def levels(keys: np.ndarray, counts: np.ndarray, depths: Iterable[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each depth: the distinct numbers of that many context bytes and a byte, and their counts."""
    out = []
    for d in depths:
        own, index = np.unique(keys & ((1 << (8 * (d + 1))) - 1), return_inverse=True)
        out.append((own, np.bincount(index, weights=counts)))
    return out


def nodes_of(own: np.ndarray, count: np.ndarray, bit: int) -> Nodes:
    path, index = np.unique(own >> (8 - bit), return_inverse=True)
    return path, np.bincount(index, weights=count), np.bincount(index, weights=count * ((own >> (7 - bit)) & 1))


def shorter(path: np.ndarray, depth: int, bit: int) -> np.ndarray:
    """The numbers of the same nodes with `depth` context bytes."""
    return path & ((1 << (8 * depth + bit)) - 1)


def upward(nodes: list[Nodes], first: int, bit: int, below: np.ndarray | None = None) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Of nodes of the depths from `first` on: each one's parent, each parent's share for stopping there, and the log weights
    of the first depth. below: those of the last depth, where longer contexts exist."""
    own = [log_kt(total - ones, ones) for _, total, ones in nodes]
    below = own[-1] if below is None else below
    parents, stops = [], []
    for k in range(len(nodes) - 1, 0, -1):
        up = np.searchsorted(nodes[k - 1][0], shorter(nodes[k][0], first + k - 1, bit))
        both = np.logaddexp(own[k - 1], np.bincount(up, weights=below, minlength=len(own[k - 1]))) - math.log(2)
        parents.insert(0, up)
        stops.insert(0, np.exp(own[k - 1] - math.log(2) - both))
        below = both
    return parents, stops, below


def downward(nodes: list[Nodes], parents: list[np.ndarray], stops: list[np.ndarray], gathered: np.ndarray, left: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
    """Numbers and chance of a one of each depth's nodes, then what the last depth's have gathered and the weight that is left
    to them. gathered, left: those of the first depth."""
    out, estimate = [], np.empty(0)
    for k, (path, total, ones) in enumerate(nodes):
        if k:
            up = parents[k - 1]
            gathered, left = (gathered + left * stops[k - 1] * estimate)[up], (left * (1 - stops[k - 1]))[up]
        estimate = (ones + 0.5) / (total + 1)
        out.append((path, gathered + left * estimate))  # not as float32, which is 1 from 2^24 equal bits on and leaves the other bit no chance
    return out, gathered, left


def log10_by_nodes(nodes: list[list[tuple[np.ndarray, np.ndarray]]], key: np.ndarray) -> np.ndarray:
    """log10 of the probability of each byte in its context, from the longest known contexts. nodes: by depth, then by bit."""
    out = np.zeros(len(key))
    for bit in range(8):
        p, open_ = np.full(len(key), 0.5), np.arange(len(key))
        for d in range(len(nodes) - 1, -1, -1):
            path, one = nodes[d][bit]
            if not len(path):
                continue
            want = shorter(key[open_] >> (8 - bit), d, bit)
            at = np.minimum(np.searchsorted(path, want), len(path) - 1)
            found = path[at] == want
            p[open_[found]] = one[at[found]]
            open_ = open_[~found]
        out += np.log10(np.where((key >> (7 - bit)) & 1, p, 1 - p))
    return out


class ContextTree:
    def __init__(self, keys: np.ndarray, counts: np.ndarray, depth: int):
        """keys: distinct numbers of `depth` context bytes and a byte (see contexts), in rising order; counts: how often."""
        self.depth = depth
        if not len(keys):  # nothing seen: every bit has probability 1/2
            keys, counts = np.zeros(1, np.int64), np.zeros(1, np.int64)
        by_depth = levels(keys, counts, range(depth + 1))
        self.nodes = [[None] * 8 for _ in range(depth + 1)]  # numbers of the nodes, and their chance of a one
        for bit in range(8):
            nodes = [nodes_of(own, count, bit) for own, count in by_depth]
            parents, stops, _ = upward(nodes, 0, bit)
            root = len(nodes[0][0])
            for d, found in enumerate(downward(nodes, parents, stops, np.zeros(root), np.ones(root))[0]):
                self.nodes[d][bit] = found
        self.keys = keys
        self.places: Places | None = None  # made where it is used, so it is not sent
        self.logs = np.zeros(len(keys))
        for bit in range(8):
            path, one = self.nodes[depth][bit]
            p = one[np.searchsorted(path, keys >> (8 - bit))].astype(np.float64)
            self.logs += np.log10(np.where((keys >> (7 - bit)) & 1, p, 1 - p))

    def log10(self, key: np.ndarray) -> np.ndarray:
        """log10 of the probability of each byte in its context."""
        if self.places is None:
            self.places = Places(self.keys)
        at = self.places.of(key)
        out = self.logs[at]
        new = np.flatnonzero(at < 0)
        if len(new):
            out[new] = log10_by_nodes(self.nodes, key[new])
        return out


class Trunk:
    """The nodes of up to `depth` context bytes. What hangs on a node of that depth is a branch: it needs only that node's
    share of the trunk, and gives the trunk only that node's weight, so branches are counted apart from each other."""

    def __init__(self, depth: int, rows: list[tuple[np.ndarray, ...]]):
        """rows: by bit, what weights() gives for the nodes of `depth` context bytes of all branches."""
        self.nodes, self.ends = [[None] * 8 for _ in range(depth)], []
        for bit, (path, total, ones, weight) in enumerate(rows):
            order = np.argsort(path)
            path, total, ones, weight = (x[order] for x in (path, total, ones, weight))
            nodes = []
            for d in range(depth):
                own, index = np.unique(shorter(path, d, bit), return_inverse=True)
                nodes.append((own, np.bincount(index, weights=total), np.bincount(index, weights=ones)))
            nodes.append((path, total, ones))
            parents, stops, _ = upward(nodes, 0, bit, weight)
            root = len(nodes[0][0])
            found, gathered, left = downward(nodes, parents, stops, np.zeros(root), np.ones(root))
            for d in range(depth):
                self.nodes[d][bit] = found[d]
            self.ends.append((path, gathered, left))

    @staticmethod
    def weights(keys: np.ndarray, counts: np.ndarray, first: int, depth: int) -> list[tuple[np.ndarray, ...]]:
        """By bit: number, total, ones and log weight of the nodes of `first` context bytes in whole branches."""
        by_depth = levels(keys, counts, range(first, depth + 1))
        out = []
        for bit in range(8):
            nodes = [nodes_of(own, count, bit) for own, count in by_depth]
            out.append((*nodes[0], upward(nodes, first, bit)[2]))
        return out

    def log10(self, keys: np.ndarray, counts: np.ndarray, asked: np.ndarray, depth: int) -> np.ndarray:
        """log10 of the probability of each of `asked`, from the keys and counts of all their branches."""
        first = len(self.nodes)
        by_depth = levels(keys, counts, range(first, depth + 1))
        found: list[list] = [[None] * 8 for _ in by_depth]
        for bit in range(8):
            nodes = [nodes_of(own, count, bit) for own, count in by_depth]
            parents, stops, _ = upward(nodes, first, bit)
            path, gathered, left = self.ends[bit]
            at = np.searchsorted(path, nodes[0][0])
            for k, x in enumerate(downward(nodes, parents, stops, gathered[at], left[at])[0]):
                found[k][bit] = x
        return log10_by_nodes(self.nodes + found, asked)
