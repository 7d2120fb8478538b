"""Shingle sets of texts as 64-bit hashes, and MinHash signatures of those sets."""

from __future__ import annotations

import numpy as np

from .common import hashed_words, mix

WORDS = 5
_RNG = np.random.Generator(np.random.PCG64(11))
_PLACE = _RNG.integers(1, 2**63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of all runs of five lower-cased words; of the whole sequence if it is shorter; none without words."""
    words = hashed_words(text, "white")
    width = min(WORDS, len(words))
    if not width:
        return words
    n = len(words) - width + 1
    total = np.full(n, width, np.uint64)
    for k in range(width):
        total += words[k : k + n] * _PLACE[k]
    return np.unique(mix(total))


class MinHash:
    """signatures(sets): for each set and each of `size` fixed bijections of 64 bits, the least image of the set."""

    def __init__(self, size: int):
        rng = np.random.Generator(np.random.PCG64(7))
        self.factors = rng.integers(1, 2**63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.shifts = rng.integers(0, 2**63, size, dtype=np.uint64)

    def signatures(self, sets: list[np.ndarray]) -> np.ndarray:
        """One row of signed 64-bit values per set; none of them may be empty."""
        out = np.empty((len(sets), len(self.factors)), np.uint64)
        at = 0
        while at < len(sets):  # blocks that stay in the cache
            to, size = at, 0
            while to < len(sets) and (to == at or size + len(sets[to]) <= 16_384):
                size += len(sets[to])
                to += 1
            items = np.concatenate(sets[at:to])
            starts = np.concatenate([[0], np.cumsum([len(x) for x in sets[at : to - 1]])]).astype(np.intp)
            for k, (a, b) in enumerate(zip(self.factors, self.shifts)):
                out[at:to, k] = np.minimum.reduceat(items * a + b, starts)
            at = to
        return out.view(np.int64)


def set_key(items: np.ndarray) -> tuple[int, int]:
    """128 bits that equal sets share."""
    with np.errstate(over="ignore"):
        one = mix(items + np.uint64(0x632BE59BD9B4E019)).sum(dtype=np.uint64)
        two = mix(items ^ np.uint64(0xD6E8FEB86659FD93)).sum(dtype=np.uint64) + np.uint64(len(items))
    return int(one.astype(np.int64)), int(two.astype(np.int64))
