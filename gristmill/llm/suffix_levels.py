"""A logarithmic family of suffix arrays over byte strings.

Each level holds some text and its window starts in lexicographic order. A new batch gets a suffix
array of its own, is merge-scanned against every existing level for windows of equal content, and
then joins the family; levels of equal size class are merged, so there are at most a logarithmic
number of them and each window is merged a logarithmic number of times.
"""

from __future__ import annotations

import numpy as np


def big_endian(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one big-endian number; zeros follow the end."""
    padded = np.zeros(len(data) + 8, np.uint64)
    padded[: len(data)] = data
    n = len(data)
    out = padded[:n].copy()
    for k in range(1, 8):
        out <<= np.uint64(8)
        out |= padded[k : k + n]
    return out


def order_windows(eights: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of the windows by content (equal windows share one), by doubling from eight bytes on;
    and the largest rank."""
    n = len(eights)
    _, rank = np.unique(eights, return_inverse=True)
    size = 8
    while 2 * size <= length:
        after = np.zeros(n, np.int64)
        if size < n:
            after[: n - size] = rank[size:] + 1
        _, rank = np.unique(rank * (n + 1) + after, return_inverse=True)
        size *= 2
    _, ranks = np.unique(rank[starts] * np.int64(n + 1) + rank[starts + length - size], return_inverse=True)
    return ranks


class Level:
    """eights: text as big-endian numbers; starts: distinct windows in order; ids: their numbers."""

    def __init__(self, eights: np.ndarray, starts: np.ndarray, ids: np.ndarray, length: int):
        self.eights, self.starts, self.ids, self.length = eights, starts, ids, length

    def __len__(self) -> int:
        return len(self.starts)

    def compare(self, mine: np.ndarray, other: Level, theirs: np.ndarray) -> np.ndarray:
        """-1, 0 or 1 for each pair of windows given by their starts."""
        out = np.zeros(len(mine), np.int8)
        left = np.arange(len(mine))
        offsets = [*range(0, self.length - 7, 8)]
        if self.length % 8:
            offsets.append(self.length - 8)
        for k in offsets:
            a, b = self.eights[mine[left] + k], other.eights[theirs[left] + k]
            out[left] = (a > b).astype(np.int8) - (a < b).astype(np.int8)
            left = left[a == b]
            if not len(left):
                break
        return out

    def scan(self, other: Level) -> tuple[np.ndarray, np.ndarray]:
        """For each window of ``other``, its place among mine, and whether mine has an equal one."""
        lo, hi = np.zeros(len(other), np.int64), np.full(len(other), len(self), np.int64)
        equal = np.zeros(len(other), bool)
        live = np.arange(len(other)) if len(self) else np.zeros(0, np.int64)
        while len(live):
            mid = (lo[live] + hi[live]) >> 1
            sign = self.compare(self.starts[mid], other, other.starts[live])
            lo[live] = np.where(sign < 0, mid + 1, lo[live])
            hi[live] = np.where(sign < 0, hi[live], mid)
            same = sign == 0
            equal[live[same]] = True
            lo[live[same]] = hi[live[same]] = mid[same]
            live = live[lo[live] < hi[live]]
        return lo, equal

    def merged(self, other: Level) -> Level:
        """Both, which have no window in common."""
        at, _ = self.scan(other)
        starts = np.insert(self.starts, at, other.starts + len(self.eights))
        return Level(np.concatenate([self.eights, other.eights]), starts, np.insert(self.ids, at, other.ids), self.length)


class SuffixFamily:
    """Finds the windows of ``length`` bytes that occur more than once among all pieces added."""

    def __init__(self, length: int):
        self.length = length
        self.levels: list[Level] = []
        self.same: list[np.ndarray] = []  # for each window, the first one of equal content
        self.often: list[np.ndarray] = []
        self.count = 0

    def add(self, pieces: list[bytes]) -> None:
        """A batch; its windows are numbered on, piece by piece."""
        data = np.frombuffer(b"".join(pieces), np.uint8)
        sizes = np.array([len(p) for p in pieces], np.int64)
        windows = np.maximum(0, sizes - self.length + 1)
        total = int(windows.sum())
        if not total:
            return
        first = np.cumsum(sizes) - sizes
        starts = np.arange(total) + np.repeat(first - (np.cumsum(windows) - windows), windows)
        eights = big_endian(data)
        ranks = order_windows(eights, starts, self.length)
        heads = np.zeros(int(ranks.max()) + 1, np.int64)
        heads[ranks[::-1]] = np.arange(total - 1, -1, -1)  # the first window of each content
        number = self.count + np.arange(total)
        same = self.count + heads[ranks]
        often = np.zeros(total, bool)
        often[heads] = np.bincount(ranks) > 1
        self.same.append(same)
        self.often.append(often)
        self.count += total
        new = Level(eights, starts[heads], number[heads], self.length)
        for level in self.levels:
            at, equal = level.scan(new)
            if equal.any():
                older = level.ids[at[equal]]
                self._set(new.ids[equal], older)
                new = Level(new.eights, new.starts[~equal], new.ids[~equal], self.length)
        if len(new):
            self.levels.append(new)
        while len(self.levels) > 1 and len(self.levels[-2]).bit_length() <= len(self.levels[-1]).bit_length():
            last = self.levels.pop()
            self.levels.append(self.levels.pop().merged(last))

    def _set(self, newer: np.ndarray, older: np.ndarray) -> None:
        """``newer``, all of the last batch, have the content of ``older``."""
        self.same[-1][newer - (self.count - len(self.same[-1]))] = older
        bounds = np.cumsum([0, *map(len, self.often)])
        part = np.searchsorted(bounds, older, side="right") - 1
        for p in np.unique(part):
            self.often[p][older[part == p] - bounds[p]] = True

    def repeated(self) -> np.ndarray:
        """Whether each window occurs more than once."""
        if not self.count:
            return np.zeros(0, bool)
        same, often = np.concatenate(self.same), np.concatenate(self.often)
        return often[same[same]]
