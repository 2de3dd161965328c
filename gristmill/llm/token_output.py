"""Token ids as flat unsigned integer files with 64-bit document offsets.

Layout of a dataset folder: per part ``ids-NNNNN.bin`` (flat little-endian unsigned integers, 16
bits where the vocabulary allows, else 32), ``offsets-NNNNN.bin`` (signed 64-bit, one more than the
part's documents, in ids from the part's start), ``docs-NNNNN.bin`` (signed 64-bit document
numbers), and ``manifest.json`` with each part's base: the number of ids in all parts before it,
by prefix sums over the parts' counts. Parts are ranges of doc_id in ascending order.

Each task writes under a name of its own attempt and renames on success, so a retried or
speculative task leaves the same files; the manifest is written last, and only what it names counts.
Readers memory-map the files. The folder must be a file system path that driver and executors
share (a ``file:`` URL or a mounted path), since only such files can be memory-mapped.

Cases: null text is empty, and an empty text is the end id alone; equal doc_ids keep one entry per
row, in any order among themselves; a null doc_id sorts first and reads back as null (-2**63 in
the file); an empty table has no part; extra columns are ignored.
"""

from __future__ import annotations

import json
import mmap
import os
import zlib
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch_of, hold, shuffle_partitions, work_path
from .pretokens import PieceEncoder
from .textblocks import block_of

VOCABULARY = "byte_bpe_50k.json"
END_ID = 0
NULL_ID = -(1 << 63)


def encoder(path: str) -> PieceEncoder:
    """One per worker process."""
    return hold(("tokens", path), lambda: _encoder(path))


def _encoder(path: str) -> PieceEncoder:
    from tokenizers import Tokenizer

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()

    def pieces(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = library.encode(texts, is_pretokenized=True, add_special_tokens=False)
        return np.bincount(np.array(found.word_ids, np.int64), minlength=len(texts)), np.array(found.ids, np.uint32)

    return PieceEncoder(pieces, lambda text: library.encode(text, add_special_tokens=False).ids, keep_space=True, lower=False)


def local_path(url: str) -> str:
    parsed = urlparse(url)
    if parsed.scheme not in ("", "file"):
        raise ValueError(f"memory-mapped files need a shared file system path, not {url}")
    return unquote(parsed.path)


def _width(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    most = max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"])])
    return "<u2" if most < 1 << 16 else "<u4"


def write_dataset(documents: DataFrame, folder: str | None = None, vocabulary: str | None = None, end_id: int = END_ID, parts: int | None = None) -> str:
    """Encode all documents and write them in ascending doc_id order; returns the folder."""
    spark = documents.sparkSession
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    folder = folder or work_path(spark, "tokens")
    where, width = local_path(folder), _width(path)
    os.makedirs(where, exist_ok=True)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, task = encoder(path), TaskContext.get()
        part, tag = task.partitionId(), f"{task.taskAttemptId()}"
        names = [f"{where}/{kind}-{part:05d}.bin" for kind in ("ids", "offsets", "docs")]
        held = [f"{n}.{tag}" for n in names]
        n_docs = n_ids = 0
        with open(held[0], "wb") as ids_file, open(held[1], "wb") as offsets_file, open(held[2], "wb") as docs_file:
            offsets_file.write(np.zeros(1, "<i8").tobytes())
            for b in batches:
                keys = b.column("doc_id").fill_null(NULL_ID).to_numpy(zero_copy_only=False)
                for a, ids, cuts in pieces.blocks(block_of(b.column("text"))):
                    k = len(cuts) - 1
                    ends = cuts[1:] + np.arange(1, k + 1)
                    out = np.full(len(ids) + k, end_id, width)
                    keep = np.ones(len(out), bool)
                    keep[ends - 1] = False
                    out[keep] = ids
                    ids_file.write(out.tobytes())
                    offsets_file.write((ends + n_ids).astype("<i8").tobytes())
                    docs_file.write(keys[a : a + k].astype("<i8").tobytes())
                    n_docs += k
                    n_ids += len(out)
        for x, y in zip(held, names, strict=True):
            os.replace(x, y)
        yield pa.RecordBatch.from_pydict({"part": [part], "n_docs": [n_docs], "n_ids": [n_ids]})

    n = parts or shuffle_partitions(spark)
    counts = docs.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id").mapInArrow(run, "part long, n_docs long, n_ids long").collect()  # a row a part
    base, listed = 0, []
    for r in sorted((r for r in counts if r.n_docs), key=lambda r: r.part):
        listed.append({"part": r.part, "n_docs": r.n_docs, "n_ids": r.n_ids, "base": base})
        base += r.n_ids
    with open(f"{where}/manifest.json.tmp", "w", encoding="utf-8") as f:
        json.dump({"width": width, "end_id": end_id, "n_ids": base, "parts": listed}, f)
    os.replace(f"{where}/manifest.json.tmp", f"{where}/manifest.json")
    return folder


class Part:
    """One part, memory-mapped."""

    def __init__(self, folder: str, part: int, width: str):
        self.ids, self.offsets, self.docs = (self._map(f"{folder}/{kind}-{part:05d}.bin", t) for kind, t in (("ids", width), ("offsets", "<i8"), ("docs", "<i8")))

    @staticmethod
    def _map(path: str, kind: str) -> np.ndarray:
        with open(path, "rb") as f:
            return np.frombuffer(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ), kind)

    def __len__(self) -> int:
        return len(self.docs)

    def __getitem__(self, i: int) -> np.ndarray:
        return self.ids[self.offsets[i] : self.offsets[i + 1]]


ROWS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def read_dataset(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens, ids_crc32."""
    where = local_path(folder)
    with open(f"{where}/manifest.json", encoding="utf-8") as f:
        manifest = json.load(f)
    width, parts = manifest["width"], manifest["parts"]
    if not parts:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, base in zip(b.column("part").to_pylist(), b.column("base").to_pylist(), strict=True):
                own = Part(where, part, width)
                for a in range(0, len(own), 4096):
                    z = min(len(own), a + 4096)
                    keys = own.docs[a:z]
                    crc = [zlib.crc32(own[i].astype("<u4").tobytes()) for i in range(a, z)]
                    yield batch_of(ROWS, pa.array(keys, mask=keys == NULL_ID), base + own.offsets[a:z], np.diff(own.offsets[a : z + 1]), np.array(crc, np.int64))

    rows = spark.createDataFrame([(p["part"], p["base"]) for p in parts], "part long, base long")
    return rows.repartition(len(parts), "part").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
