"""A compressed FM-index over word numbers: bit-packed wavelet matrix, backward search for many patterns at once."""

from __future__ import annotations

import numpy as np


def suffix_order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of their suffixes, by the first ``depth`` symbols at least (prefix doubling).

    The first round takes as many symbols at once as fit into one number. Suffixes that agree that far stand in any order.
    """
    n = len(symbols)
    bits = max(1, int(symbols.max()).bit_length())
    step = max(1, min(62 // bits, depth))
    key = np.zeros(n, np.int64)
    for k in range(step):
        key <<= bits
        key[: max(0, n - k)] |= symbols[k:]
    while True:
        order = np.argsort(key)
        if step >= depth:
            return order
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate(([1], np.diff(key[order]) != 0)))
        if rank[order[-1]] == n:
            return order
        after = np.zeros(n, np.int64)
        after[: max(0, n - step)] = rank[step:]
        key, step = rank * (n + 2) + after, step * 2


class FMIndex:
    """Patterns of up to ``depth`` symbols can be looked up; symbols are numbers from 0 to sigma - 1.

    The last symbol must be a separator that no pattern holds.
    """

    def __init__(self, symbols: np.ndarray, sigma: int, depth: int):
        self.order = suffix_order(symbols, depth)
        last = symbols[self.order - 1]
        self.starts = np.concatenate(([0], np.cumsum(np.bincount(symbols, minlength=sigma)))).astype(np.int64)
        self.levels = []
        for level in reversed(range(max(1, int(sigma - 1).bit_length()))):
            bits = (last >> level & 1).astype(np.uint8)
            packed = np.packbits(bits, bitorder="little")
            words = np.zeros(len(bits) // 64 + 1, np.uint64)
            words.view(np.uint8)[: len(packed)] = packed
            counts = np.bitwise_count(words).astype(np.int32)
            before = np.concatenate(([0], np.cumsum(counts)[:-1])).astype(np.int32)
            self.levels.append((level, words, before, len(bits) - int(counts.sum())))
            last = np.concatenate((last[bits == 0], last[bits == 1]))
        everything = np.arange(sigma, dtype=np.int64)
        self.first = self._walk(everything, np.zeros(sigma, np.int64))

    def _walk(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, words, before, zeros in self.levels:
            word = at >> 6
            mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
            ones = before[word] + np.bitwise_count(words[word] & mask)
            at = np.where(symbols >> level & 1, zeros + ones, at - ones)
        return at

    def step(self, symbols: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of the patterns with one more symbol in front."""
        both = self._walk(np.concatenate((symbols, symbols)), np.concatenate((lo, hi)))
        base = self.starts[symbols] - self.first[symbols]
        return both[: len(lo)] + base, both[len(lo) :] + base


def matching_statistics(index: FMIndex, symbols: np.ndarray, begins: np.ndarray, length: int):
    """(matched, lo, hi) of each pattern symbols[b : b + length], which the index holds itself.

    Backward search takes symbols in front of the last one while the match stands elsewhere too; matched is how
    many it took, ``length`` at most, and lo, hi is the interval of the last step that another place shares.
    """
    matched = np.zeros(len(begins), np.int64)
    tail = symbols[begins + length - 1]
    lo, hi = index.starts[tail], index.starts[tail + 1]
    which, low, high = np.arange(len(begins)), lo, hi
    lo, hi = lo.copy(), hi.copy()
    for back in range(length - 1, -1, -1):
        if back < length - 1:
            low, high = index.step(symbols[begins[which] + back], low, high)
        alive = high - low > 1
        which, low, high = which[alive], low[alive], high[alive]
        if not len(which):
            break
        matched[which] += 1
        lo[which], hi[which] = low, high
    return matched, lo, hi
