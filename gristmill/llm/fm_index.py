"""A compressed FM-index over integer sequences, with searches of many patterns at a time.

The Burrows-Wheeler transform is kept in a wavelet matrix of packed bits with a running count per
64-bit word; a rank query costs one count and one popcount a level. Backward search narrows the
suffix-array interval of each pattern by one symbol to the left per step.
"""

from __future__ import annotations

import numpy as np

_MASK = (np.uint64(1) << np.arange(64, dtype=np.uint64)) - np.uint64(1)


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, sigma: int):
        self.n, self.levels = len(symbols), max(1, int(sigma - 1).bit_length())
        self.words, self.counts, self.zeros = [], [], []
        seq = symbols
        for level in range(self.levels - 1, -1, -1):
            bit = ((seq >> level) & 1).astype(bool)
            padded = np.zeros((self.n // 64 + 1) * 64, bool)
            padded[: self.n] = bit
            words = np.packbits(padded, bitorder="little").view(np.uint64)
            counts = np.zeros(len(words), np.int64)
            np.cumsum(np.bitwise_count(words[:-1]), out=counts[1:])
            self.words.append(words)
            self.counts.append(counts)
            self.zeros.append(self.n - int(bit.sum()))
            seq = np.concatenate([seq[~bit], seq[bit]])
        self.base = self._walk(np.arange(sigma), np.zeros(sigma, np.int64))

    def _walk(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            word = i >> 6
            ones = self.counts[k][word] + np.bitwise_count(self.words[k][word] & _MASK[i & 63])
            i = np.where((symbol >> level) & 1, self.zeros[k] + ones, i - ones)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol among the first i."""
        return self._walk(symbol, i) - self.base[symbol]


def suffix_array(text: np.ndarray) -> np.ndarray:
    """By prefix doubling; ends as soon as all ranks differ."""
    n = len(text)
    _, rank = np.unique(text, return_inverse=True)
    k = 1
    while n and int(rank.max()) < n - 1:
        after = np.zeros(n, np.int64)
        after[: n - k] = rank[k:] + 1 if k < n else 0
        _, rank = np.unique(rank * (n + 1) + after, return_inverse=True)
        k *= 2
    out = np.empty(n, np.int64)
    out[rank] = np.arange(n)
    return out


class FMIndex:
    """Index of several sequences of non-negative integers; a separator of its own ends each, so no
    match crosses two of them."""

    def __init__(self, pieces: list[np.ndarray]):
        sizes = np.array([len(p) for p in pieces], np.int64)
        self.first = np.cumsum(sizes + 1) - sizes - 1
        n = int((sizes + 1).sum())
        self.alphabet, dense = np.unique(np.concatenate(pieces) if pieces else np.zeros(0, np.uint64), return_inverse=True)
        text = np.empty(n, np.int64)
        ends = self.first + sizes
        text[ends] = np.arange(len(pieces))
        inside = np.ones(n, bool)
        inside[ends] = False
        text[inside] = dense + len(pieces)
        self.text, self.sigma = text, len(pieces) + len(self.alphabet)
        self.sa = suffix_array(text)
        self.smaller = np.zeros(self.sigma + 1, np.int64)
        np.cumsum(np.bincount(text, minlength=self.sigma), out=self.smaller[1:])
        self.bwt = WaveletMatrix(text[self.sa - 1], max(1, self.sigma))

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of symbol + pattern from those of the patterns."""
        before = self.smaller[symbol]
        return before + self.bwt.rank(symbol, lo), before + self.bwt.rank(symbol, hi)

    def matching(self, ends: np.ndarray, threshold: int, least: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics of the indexed text itself, cut off at the threshold: for each end
        position, how many symbols to the left of it occur together at least ``least`` times (no
        more than the threshold), and the interval of that match where it reaches the threshold.
        """
        reach = np.zeros(len(ends), np.int64)
        lo_all, hi_all = np.zeros(len(ends), np.int64), np.zeros(len(ends), np.int64)
        live = np.arange(len(ends))
        symbol = self.text[ends - 1]
        lo, hi = self.smaller[symbol], self.smaller[symbol + 1]
        for step in range(1, threshold + 1):
            if step > 1:
                lo, hi = self.extend(self.text[ends[live] - step], lo, hi)
            keep = hi - lo >= least
            live, lo, hi = live[keep], lo[keep], hi[keep]
            reach[live] = step
            if not len(live):
                break
        if len(live):
            lo_all[live], hi_all[live] = lo, hi
        return reach, lo_all, hi_all
