"""Substring deduplication by words, with an FM-index per shard.

Words are runs of bytes other than blank and 0x09 to 0x0D, compared as they are. A window is
``WINDOW`` consecutive words of one document; a word is removed if a window covers it whose word
sequence also starts earlier (smaller doc_id, or same document, earlier start).

Content anchors (see ``anchors``) route every window to a shard; whole segments that repeat are
settled by their hash on the way. The rest is indexed shard by shard in compressed FM-indexes, and
backward search over their wavelet matrices gives matching statistics of the segments streamed
through them: windows whose match reaches the threshold and whose earliest occurrence is before
their own start.

Cases: null and empty texts have no words; texts shorter than a window keep everything; a very long
text is scanned like any other, its segments going to as many shards; an empty table gives no row; a
row repeated as it is (same doc_id and text) counts once and every copy of the row gets that result;
rows that share a doc_id but not the text are documents of their own, ordered by a hash of the text;
equal texts under different doc_ids lose all but the first; rows with a null doc_id are documents of
their own, told apart by a hash of the text, sort before others (doc_ids below -2**62 may be among
them) and read back as null; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .anchors import Windows, covered, find, ids_of
from .common import batch_of
from .fm_index import FMIndex
from .textblocks import BLANKS, Block, byte_values, prefix_hash, runs, span_hash

WINDOW = 20


def word_hashes(block: Block) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, first = runs(block, BLANKS)
    return span_hash(prefix_hash(byte_values(block.data)), starts, ends), first


WORDS = Windows(length=WINDOW, gram=5, earlier=True, symbols=word_hashes, value=lambda words: words)


def compare(shard: np.ndarray, doc: np.ndarray, start: np.ndarray, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(piece, window) of windows that start earlier in another piece."""
    words = [np.frombuffer(p, np.uint64) for p in pieces]
    index = FMIndex(words)
    sizes = np.array([len(x) for x in words], np.int64)
    windows = sizes - WINDOW + 1
    which = np.repeat(np.arange(len(words)), windows)
    window = np.arange(len(which)) - np.repeat(np.cumsum(windows) - windows, windows)
    ends = index.first[which] + window + WINDOW
    reach, lo, hi = index.matching(ends, WINDOW)
    hit = np.flatnonzero(reach >= WINDOW)
    if not len(hit):
        return which[:0], window[:0]
    # order of places: by document, then by start
    owner = np.repeat(np.arange(len(words)), sizes + 1)
    place = np.arange(len(index.text)) - index.first[owner] + start[owner]
    order = np.empty(len(place) + 1, np.int64)
    order[np.lexsort((place, doc[owner]))] = np.arange(len(place))
    order[-1] = len(place)
    by_suffix = order[np.append(index.sa, len(place))]
    lows, inverse = np.unique(lo[hit], return_inverse=True)
    highs = np.zeros(len(lows), np.int64)
    highs[inverse] = hi[hit]
    earliest = np.minimum.reduceat(by_suffix, np.stack([lows, highs], axis=1).ravel())[::2][inverse]
    later = hit[earliest < order[index.first[which[hit]] + window[hit]]]
    return which[later], window[later]


KEPT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.binary())])


def remove_repeats(documents: DataFrame, digest: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): kept words joined by blanks, or with ``digest`` kept_sha256."""
    last = ("kept_sha256", pa.string()) if digest else ("kept", pa.string())
    schema = pa.schema([*KEPT][:3] + [pa.field(*last)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor()
        for b in batches:
            n, removed, kept = [], [], []
            for i in range(b.num_rows):
                words = expand.decompress(b.column("packed")[i].as_py()).split()
                gone = covered(b.column("spans")[i], WINDOW, len(words))
                left = words if gone is None else [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                n.append(len(words))
                removed.append(len(words) - len(left))
                raw = b" ".join(left)
                kept.append(hashlib.sha256(raw).hexdigest() if digest else raw.decode("utf-8"))
            yield batch_of(schema, ids_of(b), n, removed, kept)

    return find(documents, WORDS, compare, "words").mapInArrow(run, f"doc_id long, n_words long, n_removed long, {last[0]} string")
