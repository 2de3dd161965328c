"""BPE encoding and decoding by forced boundaries.

A vocabulary with word ends (``</w>``) is read from its file. Two neighbouring symbols that stand
next to each other inside no vocabulary token can never end up in one token, so a cut between them
is certain: a word falls into fragments that are encoded independently and concatenated. Distinct
fragments are encoded once per worker and kept in a bounded cache.

Cases: null text is empty; empty or blank text has no ids and decodes to the empty string; special
token strings inside a text, and text outside the Latin tables, are left to the tokenizers library;
equal rows give equal results; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, hold, trim
from .pretokens import PieceEncoder
from .textblocks import block_of

VOCABULARY = "word_bpe_49k.json"
END = "</w>"
#: Bytes of text that are encoded at a time; a longer document stands alone.
SLICE = 1 << 18


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: printable
    Latin-1 bytes stand for themselves, the others for code points from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class ForcedBoundaryBPE:
    def __init__(self, path: str, cache: int = 200_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        symbols = byte_symbols()
        self.inner = [vocab[s] for s in symbols]
        self.final = [vocab[s + END] for s in symbols]
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(merges):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merge.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        # inside[x, y]: some token has byte x right before byte y; the last column block: y ends the word
        value = {s: i for i, s in enumerate(symbols)}
        inside = np.zeros((256, 512), bool)
        for token in vocab:
            ends = token.endswith(END) and token != END
            raw = [value[c] for c in (token[: -len(END)] if ends else token) if c in value]
            for i in range(len(raw) - 1):
                inside[raw[i], raw[i + 1] + 256 * (ends and i == len(raw) - 2)] = True
        self.cut = [[not x for x in row] for row in inside.tolist()]
        self.most, self.cache = cache, {}
        self.strings: list[bytes] = [b""] * (1 + max(max(vocab.values()), *(t["id"] for t in spec["added_tokens"])))
        for token, i in [*vocab.items(), *((t["content"], t["id"]) for t in spec["added_tokens"])]:
            self.strings[i] = token.encode("utf-8")

    def fragments(self, word: bytes) -> list[tuple[bytes, bool]]:
        """The word cut at all certain boundaries; the flag marks the fragment that ends the word."""
        out, at, last = [], 0, len(word) - 1
        for i in range(last):
            if self.cut[word[i]][word[i + 1] + (256 if i + 1 == last else 0)]:
                out.append((word[at : i + 1], False))
                at = i + 1
        out.append((word[at:], True))
        return out

    def encode_word(self, word: bytes) -> list[int]:
        ids: list[int] = []
        for part in self.fragments(word) if word else ():
            found = self.cache.get(part)
            if found is None:
                if len(self.cache) >= self.most:
                    self.cache.clear()
                found = self.cache[part] = self._merged(*part)
            ids += found
        return ids

    def _merged(self, raw: bytes, ends: bool) -> list[int]:
        ids = [self.inner[b] for b in raw]
        if ends:
            ids[-1] = self.final[raw[-1]]
        if len(ids) > 48:
            return self._merged_long(ids)
        merge = self.merge
        while len(ids) > 1:
            best, at = None, 0
            for i in range(len(ids) - 1):
                m = merge.get((ids[i], ids[i + 1]))
                if m is not None and (best is None or m < best):
                    best, at = m, i
            if best is None:
                break
            ids[at : at + 2] = [best[1]]
        return ids

    def _merged_long(self, ids: list[int]) -> list[int]:
        """The same with a heap of candidate pairs and a linked list: n log n for long fragments."""
        n, merge = len(ids), self.merge
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(m[0], i, m[1], ids[i], ids[i + 1]) for i in range(n - 1) if (m := merge.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, new, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = new, -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for x in (before[i], i):
                if x >= 0 and after[x] >= 0 and (m := merge.get((ids[x], ids[after[x]]))):
                    heapq.heappush(heap, (m[0], x, m[1], ids[x], ids[after[x]]))
        return [x for x in ids if x >= 0]

    def encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and ids of the pieces."""
        found = [self.encode_word(p.encode("utf-8")) for p in pieces]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return sizes, np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum()))

    def decode(self, ids: list[int]) -> bytes:
        """The vocabulary has no decoder: tokens are joined by blanks."""
        strings = self.strings
        return b" ".join([strings[i] for i in ids])


def encoder(path: str) -> tuple[ForcedBoundaryBPE, PieceEncoder]:
    """One per worker process."""
    return hold(("bpe", path), lambda: _encoder(path))


def _encoder(path: str) -> tuple[ForcedBoundaryBPE, PieceEncoder]:
    from tokenizers import Tokenizer

    bpe, library = ForcedBoundaryBPE(path), None

    def whole(text: str) -> list[int]:
        nonlocal library
        if library is None:
            library = Tokenizer.from_file(path)
            library.no_truncation()
            library.no_padding()
        return library.encode(text, add_special_tokens=False).ids

    return bpe, PieceEncoder(bpe.encode_pieces, whole, keep_space=False, lower=True)


IDS = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
DIGEST = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def _docs(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def encode(documents: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, ids): token ids of every document."""
    path = vocabulary or public_tokenizers.path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = encoder(path)[1]
        for b in batches:
            for a, ids, docs in pieces.blocks(block_of(b.column("text")), SLICE):
                lists = pa.ListArray.from_arrays(pa.array(docs, pa.int32()), pa.array(ids.astype(np.int32)))
                yield batch_of(IDS, b.column("doc_id").slice(a, len(docs) - 1), lists)
            trim()

    return _docs(documents).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, text) from (doc_id, ids)."""
    path = vocabulary or public_tokenizers.path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)[0]
        for b in batches:
            texts = [bpe.decode(ids or []).decode("utf-8") for ids in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(documents: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Encode and decode every document in one pass: (doc_id, n_tokens, ids_sha256, decoded_sha256)."""
    return _docs(documents).mapInArrow(digests(vocabulary or public_tokenizers.path(VOCABULARY)), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def digests(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What a worker does with its batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, pieces = encoder(path)
        for b in batches:
            for a, ids, docs in pieces.blocks(block_of(b.column("text")), SLICE):
                cuts, raw, listed = docs.tolist(), ids.astype("<u4").tobytes(), ids.tolist()
                spans = list(zip(cuts, cuts[1:], strict=False))
                yield batch_of(
                    DIGEST,
                    b.column("doc_id").slice(a, len(spans)),
                    np.diff(docs),
                    [hashlib.sha256(raw[4 * x : 4 * y]).hexdigest() for x, y in spans],
                    [hashlib.sha256(bpe.decode(listed[x:y])).hexdigest() for x, y in spans],
                )
            trim()

    return run
