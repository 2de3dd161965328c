"""Suffix-array deduplication by bytes, with a logarithmic family of suffix arrays per shard.

Texts are UTF-8 bytes. Every byte is removed that a ``WINDOW``-byte string covers which also starts
anywhere else, in the same or another document; overlaps count, and strings are judged on the input.

Content anchors (see ``anchors``) route every window to a shard; whole segments that repeat are
settled by their hash on the way. The rest goes, shard by shard and batch by batch, into a family
of suffix arrays (see ``suffix_levels``).

Cases: null and empty texts have no bytes; texts shorter than a window keep everything; a very long
text is scanned like any other, its segments going to as many shards; an empty table gives no row; a
row repeated as it is (same doc_id and text) counts once and every copy of the row gets that result;
rows that share a doc_id but not the text, and rows with a null doc_id, are documents of their own,
told apart by a hash of the text; equal texts under different doc_ids lose every byte from ``WINDOW``
bytes on; extra columns are kept by ``rewrite`` and ignored otherwise.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import Windows, covered, find, ids_of, row_hash, row_key
from .common import batch_of, quoted
from .suffix_levels import SuffixFamily
from .textblocks import Block, byte_values

WINDOW = 200
BATCH = 1 << 18
KEPT_DDL = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def raw_bytes(block: Block) -> tuple[np.ndarray, np.ndarray]:
    return block.data, block.offsets


BYTES = Windows(length=WINDOW, gram=40, earlier=False, symbols=raw_bytes, value=byte_values)


def compare(shard: np.ndarray, doc: np.ndarray, start: np.ndarray, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(piece, window) of windows that occur more than once among the pieces."""
    family = SuffixFamily(WINDOW)
    held: list[bytes] = []
    size = 0
    for p in pieces:
        held.append(p)
        size += len(p)
        if size >= BATCH:
            family.add(held)
            held, size = [], 0
    family.add(held)
    windows = np.array([len(p) - WINDOW + 1 for p in pieces], np.int64)
    which = np.repeat(np.arange(len(pieces)), windows)
    window = np.arange(len(which)) - np.repeat(np.cumsum(windows) - windows, windows)
    hit = family.repeated()
    return which[hit], window[hit]


def _found(documents: DataFrame) -> DataFrame:
    return find(documents, BYTES, compare, "bytes")


def remove_repeats(documents: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): spans are maximal removed runs, kept the bytes left."""
    return _found(documents).mapInArrow(_cut(False), KEPT_DDL)


def digest(documents: DataFrame) -> DataFrame:
    """The same with kept_sha256 in place of the bytes."""
    return _found(documents).mapInArrow(_cut(True), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def _cut(hashed: bool, keyed: bool = False):
    """keyed: the row's key (doc_id, th) in place of the doc_id, and the bytes as text."""
    key = [("doc_id", pa.int64()), ("th", pa.int32())] if keyed else [("doc_id", pa.int64())]
    kept_type = pa.binary() if not (hashed or keyed) else pa.string()
    schema = pa.schema([*key, ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256" if hashed else "kept", kept_type)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor()
        for b in batches:
            n, removed, spans, kept = [], [], [], []
            for i in range(b.num_rows):
                raw = expand.decompress(b.column("packed")[i].as_py())
                gone = covered(b.column("spans")[i], WINDOW, len(raw))
                n.append(len(raw))
                if gone is None:
                    removed.append(0)
                    spans.append(0)
                else:
                    removed.append(int(gone.sum()))
                    spans.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
                    raw = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                kept.append(hashlib.sha256(raw).hexdigest() if hashed else raw.decode("utf-8", errors="ignore") if keyed else raw)
            yield batch_of(schema, *((b.column("doc_id"), b.column("th")) if keyed else (ids_of(b),)), n, removed, spans, kept)

    return run


def rewrite(documents: DataFrame) -> DataFrame:
    """``documents`` with the bytes left as text (what is left of a character cut apart goes too),
    and n_chars, where there is such a column, counted anew; other columns are kept."""
    cut = _found(documents).mapInArrow(_cut(False, keyed=True), "doc_id long, th int, n_bytes long, n_removed long, n_spans long, kept string")
    id_, th, text = "gristmill id", "gristmill th", "gristmill text"
    # a repeated row has the same key, and the same text left
    left = cut.select(F.col("doc_id").alias(id_), F.col("th").alias(th), F.col("kept").alias(text)).dropDuplicates([id_, th])
    out = documents.withColumn(id_, row_key()).withColumn(th, row_hash()).drop("text").join(left, [id_, th]).withColumnRenamed(text, "text")
    if "n_chars" in documents.columns:
        out = out.withColumn("n_chars", F.length("text").cast(documents.schema["n_chars"].dataType))
    return out.select(*quoted(documents))
