"""Vectorised pre-tokenisation: the pieces that byte-pair merges never cross.

Both public vocabularies split text by character class before any merge. For text of Latin
letters (code points below ``SAFE``) the classes are a small table, so the pieces of a whole block
come from a few array operations; each distinct piece is encoded once and kept in a bounded cache.
Documents with other characters, or with the opening of a special token, take the reference
library itself, document by document, so results never depend on which way was taken.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import numpy as np

from .textblocks import Block, U, gather_runs, prefix_hash, row_slices_of, span_hash

SAFE = 0x180
SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
_WHITE = {9, 10, 11, 12, 13, 32, 0x85, 0xA0}
#: U+0130 lower-cases to two characters.
_ODD = {0x130}
CLASS = np.array([SPACE if c in _WHITE else {"L": LETTER, "N": NUMBER}.get(unicodedata.category(chr(c))[0], OTHER) for c in range(SAFE)] + [OTHER], np.uint8)
LOWER = np.array([ord(chr(c).lower()) if c not in _ODD else c for c in range(SAFE)], np.uint32)
_SHORT = np.zeros(SAFE + 1, bool)
_SHORT[[ord(c) for c in "stmd"]] = True


def code_points(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the block and document offsets into them."""
    text = block.data.tobytes().decode("utf-8")
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    if len(points) == len(block.data):
        return points, block.offsets
    lead = np.zeros(len(block.data) + 1, np.int64)
    np.cumsum((block.data & 0xC0) != 0x80, out=lead[1:])
    return points, lead[block.offsets]


def unsafe_docs(points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Numbers of documents that the tables don't cover."""
    odd = points >= SAFE
    for c in _ODD:
        odd |= points == c
    odd[:-1] |= (points[:-1] == ord("<")) & (points[1:] == ord("|"))
    where = np.flatnonzero(odd)
    return np.unique(np.searchsorted(offsets, where, side="right") - 1) if len(where) else where


def pieces(points: np.ndarray, offsets: np.ndarray, keep_space: bool) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pieces.

    keep_space: runs of a class, one blank before a run joins it, other white space stands alone;
    else: runs of a class, digits one by one, white space dropped. In both, an apostrophe that is a
    run of its own takes a following s, t, re, ve, m, ll or d.
    """
    n = len(points)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none
    kind = CLASS[np.minimum(points, SAFE)]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    start = first[:n].copy()
    start[1:] |= kind[1:] != kind[:-1]
    if not keep_space:
        start |= kind == NUMBER
    run_start = start.copy()
    if keep_space:
        # position b of a run that follows white space in the same document
        b = np.flatnonzero(run_start[1:] & ~first[1:n] & (kind[:-1] == SPACE) & (kind[1:] != SPACE)) + 1
        start[b - 1] = True
        start[b[points[b - 1] == 32]] = False
    # apostrophes that are runs of their own and begin a piece
    a = np.flatnonzero((points == 39) & start)
    a = a[a + 1 < n]
    a = a[run_start[a + 1] & ~first[a + 1] & (kind[a + 1] == LETTER)]
    if len(a):
        p1 = np.minimum(points[a + 1], SAFE)
        more = np.minimum(a + 2, n - 1)
        p2 = np.where((a + 2 < n) & ~first[a + 2 - (a + 2 > n)], points[more], 0)
        two = ((p1 == ord("r")) & (p2 == ord("e"))) | ((p1 == ord("v")) & (p2 == ord("e"))) | ((p1 == ord("l")) & (p2 == ord("l")))
        one = _SHORT[p1]
        hit = one | two
        start[a[hit] + 1] = False
        after = a[hit] + np.where(one[hit], 2, 3)
        start[after[after < n]] = True
    starts = np.flatnonzero(start)
    ends = np.append(starts[1:], n)
    if not keep_space:
        keep = kind[starts] != SPACE
        starts, ends = starts[keep], ends[keep]
    return starts, ends


class PieceEncoder:
    """Token ids of blocks of documents.

    encode: sizes and ids, one piece after the other, of some distinct pieces; whole: ids of one document by the reference library.
    """

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], whole: Callable[[str], list[int]], keep_space: bool, lower: bool, most: int = 300_000):
        self.encode, self.whole, self.keep_space, self.lower, self.most = encode, whole, keep_space, lower, most
        self._forget()

    def _forget(self) -> None:
        self.known: dict[int, int] = {}
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.at, self.size = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _add(self, hashes: list[int], texts: list[str]) -> None:
        sizes, flat = self.encode(texts)
        k, n = len(self.known), len(hashes)
        if k + n > len(self.at):
            self.at, self.size = np.resize(self.at, 2 * (k + n)), np.resize(self.size, 2 * (k + n))
        if self.used + len(flat) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * (self.used + len(flat)))
        self.size[k : k + n] = sizes
        self.at[k : k + n] = self.used + np.cumsum(sizes) - sizes
        self.flat[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        self.known.update(zip(hashes, range(k, k + n), strict=True))

    def block(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents one after the other, and their offsets."""
        points, offsets = code_points(block)
        slow = unsafe_docs(points, offsets)
        if self.lower:
            points = LOWER[np.minimum(points, SAFE - 1)]
        starts, ends = pieces(points, offsets, self.keep_space)
        if len(self.known) > self.most:
            self._forget()
        if len(starts):
            prefix = prefix_hash((points + np.uint32(1)).astype(U) * U(0xBF58476D1CE4E5B9))
            distinct, where, inverse = np.unique(span_hash(prefix, starts, ends), return_index=True, return_inverse=True)
            keys = distinct.tolist()
            known = self.known
            missing = [i for i, h in enumerate(keys) if h not in known]
            if missing:
                text = points.tobytes().decode("utf-32-le")
                s, e = starts[where[missing]].tolist(), ends[where[missing]].tolist()
                self._add([keys[i] for i in missing], [text[x:y] for x, y in zip(s, e, strict=True)])
            number = np.fromiter((known[h] for h in keys), np.int64, len(keys))[inverse]
            sizes = self.size[number]
            ids = self.flat[gather_runs(sizes, self.at[number])]
            upto = np.zeros(len(starts) + 1, np.int64)
            np.cumsum(sizes, out=upto[1:])
            docs = upto[np.searchsorted(starts, offsets)]
        else:
            ids, docs = np.zeros(0, np.uint32), np.zeros(len(block) + 1, np.int64)
        if len(slow):
            parts, at = [], 0
            lengths = np.diff(docs)
            for i in slow.tolist():
                own = np.asarray(self.whole(block.doc(i).decode("utf-8")), np.uint32)
                parts += [ids[docs[at] : docs[i]], own]
                lengths[i], at = len(own), i + 1
            ids = np.concatenate([*parts, ids[docs[at] :]])
            docs = np.concatenate([[0], np.cumsum(lengths)])
        return ids, docs

    def blocks(self, block: Block, most: int = 1 << 20):
        """The same in slices of at most ``most`` bytes, to bound memory: (first doc, ids, offsets)."""
        for a, b in row_slices_of(block, most):
            ids, docs = self.block(block.slice(a, b))
            yield a, ids, docs
