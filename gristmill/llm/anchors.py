"""Exact repeats of fixed-length windows, found by content anchors.

A window is ``length`` consecutive symbols of one document (words or bytes). Its anchor is the
leftmost of its ``gram``-symbol runs with the smallest hash, so equal windows have equal anchors at
equal places. Consecutive windows with one anchor form a segment: the unit that is shuffled, by
anchor hash, without text. Segments of equal anchor and equal content form a class; only classes
that share an anchor with another class are compared by content, and only one member of each.

Steps:
1. ``scan``: segments of every document (anchor, content hash, place); copies inside one Arrow
   batch are combined before the shuffle, so a passage that a third of all documents share is one
   row per batch.
2. ``decide``: after a shuffle by anchor and a sort (which spills), each task streams its rows
   once. It keeps only the state of the current anchor, however many rows that has.
3. ``fetch``: the text of one member of each class whose anchor has several classes, by a join on
   the row; segments of hot anchors give their single windows instead, as hashes without text, so
   that one shard holds equal windows only and is streamed in constant memory.
4. the caller's index over the fetched segments, by shard; then ``spans_by_document``.

A place is a row and a position in it. Rows are told apart by doc_id and 31 bits of a hash of their
text, which stand above the position in ``start``; so rows that share a doc_id have places of their
own, and a row repeated as it is has the same ones.

Two modes. ``earlier``: a window counts if its content also starts earlier (smaller doc_id, or same
document, earlier start). ``elsewhere``: it counts if its content starts anywhere else.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch_of, materialize, release, shuffle_partitions
from .textblocks import Block, U, block_of, mix, prefix_hash, row_slices_of, sliding_min, span_hash

#: Kinds of rows after ``decide``: all windows of the segment count; compare by content.
REPEATED, COMPARE = 0, 1
#: Windows of an anchor with more classes than this shard by their own content.
HOT_CLASSES = 2000
SLICE = 1 << 20
#: Keys of rows without a doc_id: the lowest quarter of all longs, by a hash of the text.
NULL_ID, NULL_KEYS = -(1 << 63), 1 << 62

ROW = pa.schema([("anchor", pa.int64()), ("content", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("windows", pa.int32()), ("many", pa.int8())])
ROW_DDL = "anchor long, content long, doc_id long, start long, windows int, many byte"
FOUND = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("windows", pa.int32()), ("kind", pa.int8()), ("anchor", pa.int64()), ("many", pa.int8())])
FOUND_DDL = "doc_id long, start long, windows int, kind byte, anchor long, many byte"


@dataclass(frozen=True)
class Windows:
    """symbols: a block's symbols and the first symbol of each document (one more than documents);
    value: a 64-bit value of each symbol."""

    length: int
    gram: int
    earlier: bool
    symbols: Callable[[Block], tuple[np.ndarray, np.ndarray]]
    value: Callable[[np.ndarray], np.ndarray]


def leftmost_smallest(gram: np.ndarray, size: int) -> np.ndarray:
    """For each window of ``size`` grams, the place of its smallest hash, the leftmost of equal ones."""
    out = np.empty(max(0, len(gram) - size + 1), np.int64)
    part = (1 << 24) - size  # the 24 low bits of a hash give way to the place within a part
    for a in range(0, len(out), part):
        own = gram[a : a + part + size - 1]
        low = sliding_min(((own >> U(24)) << U(24)) | np.arange(len(own), dtype=U), size)
        out[a : a + part] = a + (low & U((1 << 24) - 1)).astype(np.int64)
    return out


def segments(values: np.ndarray, first: np.ndarray, w: Windows):
    """(document, start within it, windows, anchor hash, content hash) of all segments."""
    n = len(values)
    none = np.zeros(0, np.int64)
    if n < w.length:
        return none, none, none, none.view(U), none.view(U)
    prefix = prefix_hash(values)
    at = np.arange(n - w.gram + 1)
    gram = span_hash(prefix, at, at + w.gram)
    place = leftmost_smallest(gram, w.length - w.gram + 1)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    valid = doc[: len(place)] == doc[w.length - 1 :]
    new = np.ones(len(place), bool)
    new[1:] = (place[1:] != place[:-1]) | ~valid[:-1] | (doc[1 : len(place)] != doc[: len(place) - 1])
    new &= valid
    start = np.flatnonzero(new)
    # a segment ends before the next start or the next invalid window
    stop = np.flatnonzero(np.append(new, True)[1:] | ~np.append(valid, False)[1:]) + 1
    stop = stop[np.searchsorted(stop, start, side="right")]
    owner = doc[start]
    content = span_hash(prefix, start, stop + w.length - 1)
    # the anchor's place within the segment is part of what makes two segments equal
    content = mix(content ^ ((place[start] - start).astype(U) * U(0x9E3779B97F4A7C15)))
    return owner, start - first[owner], stop - start, gram[place[start]], content


def scan(documents: DataFrame, w: Windows) -> DataFrame:
    """Segments of all documents, copies of a batch combined (see ``decide`` for ``many``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in batches:
            block, ids = block_of(b.column("text")), b.column("doc_id").to_numpy(zero_copy_only=False)
            th = b.column("th").to_numpy().astype(np.int64) << 32
            held = []
            for a, z in row_slices_of(block, SLICE):
                symbols, first = w.symbols(block.slice(a, z))
                for at in range(0, len(symbols), SLICE) if z - a == 1 else (0,):  # a long text in overlapping parts
                    part, own = (symbols[at : at + SLICE + w.length - 1], None) if z - a == 1 else (symbols, first)
                    doc, start, windows, anchor, content = segments(w.value(part), np.array([0, len(part)]) if own is None else own, w)
                    held.append((anchor, content, ids[a:z][doc], (start + at) | th[a:z][doc], windows.astype(np.int32)))
            if held:
                yield combine(*(np.concatenate(x) for x in zip(*held, strict=True)), w.earlier)

    return documents.mapInArrow(run, ROW_DDL)


def combine(anchor, content, doc, start, windows, earlier: bool) -> pa.RecordBatch:
    """One open row per class, and a settled row (anchor: a hash of the place) for the others.

    many: 0 an open row of one member, 1 an open row of several, 2 a settled row.
    """
    order = np.lexsort((start, doc, content, anchor))
    anchor, content, doc, start, windows = (x[order] for x in (anchor, content, doc, start, windows))
    same = np.zeros(len(anchor), bool)
    same[1:] = (anchor[1:] == anchor[:-1]) & (content[1:] == content[:-1])
    twin = same.copy()  # a repeated row: the same place again
    twin[1:] &= (doc[1:] == doc[:-1]) & (start[1:] == start[:-1])
    keep = ~twin
    anchor, content, doc, start, windows, same = (x[keep] for x in (anchor, content, doc, start, windows, same))
    head = np.flatnonzero(~same)
    many = np.full(len(anchor), 2, np.int8)
    many[head] = np.diff(np.append(head, len(anchor))) > 1
    anchor[same] = mix(doc[same].astype(U))
    return batch_of(ROW, anchor.view(np.int64), content.view(np.int64), doc, start, windows, many)


def decide(rows: DataFrame, w: Windows, partitions: int) -> DataFrame:
    """Rows of anchors that occur in several segments: what counts as a whole, and what must be
    compared by content. One streaming pass over rows sorted by anchor, class and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = _Stream(w.earlier)
        for b in batches:
            yield from state.add(*(b.column(i).to_numpy(zero_copy_only=False) for i in range(6)))
        yield from state.close()

    return rows.repartition(partitions, "anchor").sortWithinPartitions("anchor", "content", "doc_id", "start").mapInArrow(run, FOUND_DDL)


class _Stream:
    """Carries the class that is still open from batch to batch: its first row, whether it has more
    members, and how many classes of its anchor closed before it. A class closes when another row
    follows, and then knows whether its anchor has other classes: one before it, or that row's."""

    def __init__(self, earlier: bool):
        self.earlier = earlier
        self.open: list | None = None
        self.last_place: tuple = ()
        self.more = self.after_others = False

    @staticmethod
    def _rows(kind: int, pick, anchor, doc, start, windows, many) -> pa.RecordBatch:
        return batch_of(FOUND, doc[pick], start[pick], windows[pick], np.full(len(doc[pick]), kind, np.int8), anchor[pick], many)

    def add(self, anchor, content, doc, start, windows, many) -> Iterator[pa.RecordBatch]:
        done = many == 2
        if done.any():
            yield self._rows(REPEATED, done, anchor, doc, start, windows, np.ones(int(done.sum()), np.int8))
            anchor, content, doc, start, windows, many = (x[~done] for x in (anchor, content, doc, start, windows, many))
        if not len(anchor):
            return
        carried = self.open is not None
        if carried:
            anchor, content, doc, start, windows, many = (np.concatenate([x, y]) for x, y in zip(self.open, (anchor, content, doc, start, windows, many), strict=True))
        n = len(anchor)
        other_anchor = np.ones(n, bool)
        other_anchor[1:] = anchor[1:] != anchor[:-1]
        head = other_anchor.copy()
        head[1:] |= content[1:] != content[:-1]
        twin = np.zeros(n, bool)  # a repeated row: the same place again
        twin[1:] = ~head[1:] & (doc[1:] == doc[:-1]) & (start[1:] == start[:-1])
        if carried and n > 1 and not head[1]:
            twin[1] = (doc[1], start[1]) == self.last_place
        heads = np.flatnonzero(head)
        several = np.add.reduceat((~twin).astype(np.int64), heads) > 1
        several |= np.maximum.reduceat(many, heads) > 0
        begins = other_anchor[heads]
        if carried:
            several[0] |= self.more
            begins[0] = not self.after_others
        ends = np.append(begins[1:], True)
        shared = ~(begins & ends)  # the anchor has other classes
        rest = ~head & ~twin
        if rest.any():
            yield self._rows(REPEATED, rest, anchor, doc, start, windows, np.ones(int(rest.sum()), np.int8))
        closed = slice(0, len(heads) - 1)
        yield from self._give(heads[closed], several[closed], shared[closed], anchor, doc, start, windows)
        last = heads[-1]
        self.open = [x[last : last + 1] for x in (anchor, content, doc, start, windows, many)]
        self.last_place = (doc[-1], start[-1])
        self.more, self.after_others = bool(several[-1]), not begins[-1]

    def _give(self, heads, several, shared, anchor, doc, start, windows) -> Iterator[pa.RecordBatch]:
        if shared.any():
            yield self._rows(COMPARE, heads[shared], anchor, doc, start, windows, several[shared].astype(np.int8))
        if not self.earlier and several.any():  # the first member counts as well
            yield self._rows(REPEATED, heads[several], anchor, doc, start, windows, np.ones(int(several.sum()), np.int8))

    def close(self) -> Iterator[pa.RecordBatch]:
        if self.open is not None:
            anchor, _, doc, start, windows, _ = self.open
            yield from self._give(np.array([0]), np.array([self.more]), np.array([self.after_others]), anchor, doc, start, windows)


def pack(documents: DataFrame) -> DataFrame:
    """(doc_id, missing, th, packed): texts as compressed bytes, so that joins move less."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        squeeze = zstandard.ZstdCompressor(level=1)
        for b in batches:
            block = block_of(b.column("text"))
            yield batch_of(PACKED, b.column("doc_id"), b.column("missing"), b.column("th"), [squeeze.compress(block.doc(i)) for i in range(len(block))])

    return documents.mapInArrow(run, "doc_id long, missing boolean, th int, packed binary")


PACKED = pa.schema([("doc_id", pa.int64()), ("missing", pa.bool_()), ("th", pa.int32()), ("packed", pa.binary())])
PIECE = pa.schema([("shard", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("many", pa.int8()), ("piece", pa.binary())])
SPAN_DDL = "doc_id long, start long, windows int"
SPAN = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("windows", pa.int32())])


def fetch(packed: DataFrame, found: DataFrame, w: Windows) -> DataFrame:
    """(shard, doc_id, start, many, piece): symbols of one member of each class that must be compared.

    A shard is an anchor. Segments of an anchor with more than ``HOT_CLASSES`` classes give a row
    without a piece for each of their windows, the window's hash as shard, those of a batch combined
    (``many`` as in ``combine``).
    """
    compare = found.where(F.col("kind") == COMPARE)
    hot = compare.groupBy("anchor").agg(F.count(F.lit(1)).alias("classes")).where(F.col("classes") > HOT_CLASSES).select("anchor", F.lit(True).alias("hot"))
    item = F.struct(place_of("start").alias("start"), "windows", "anchor", F.coalesce("hot", F.lit(False)).alias("hot"))
    wanted = compare.join(hot, "anchor", "left").groupBy("doc_id", hash_of("start").alias("th")).agg(F.collect_list(item).alias("wanted"))  # one document's segments

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor()
        for b in batches:
            rows: list[tuple] = []
            size, windows = 0, []
            docs, ths = b.column("doc_id").to_numpy(), b.column("th").to_numpy()
            for i in range(b.num_rows):
                if i and docs[i] == docs[i - 1] and ths[i] == ths[i - 1]:
                    continue  # a repeated row
                block = Block(data := np.frombuffer(expand.decompress(b.column("packed")[i].as_py()), np.uint8), np.array([0, len(data)]))
                symbols, high = w.symbols(block)[0], int(ths[i]) << 32
                own = b.column("wanted")[i].values
                for s, k, anchor, is_hot in zip(*(own.field(j).to_pylist() for j in range(4)), strict=True):
                    if is_hot:
                        prefix = prefix_hash(w.value(symbols[s : s + k + w.length - 1]))
                        windows.append((span_hash(prefix, np.arange(k), np.arange(k) + w.length), np.full(k, docs[i]), s + np.arange(k) + high))
                        size += 24 * k
                    else:
                        rows.append((anchor, docs[i], s + high, 0, symbols[s : s + k + w.length - 1].tobytes()))
                        size += len(rows[-1][-1])
                if size > SLICE:
                    yield from give(rows, windows)
                    rows, windows, size = [], [], 0
            yield from give(rows, windows)

    def give(rows: list[tuple], windows: list[tuple]) -> Iterator[pa.RecordBatch]:
        if rows:
            yield batch_of(PIECE, *zip(*rows, strict=True))
        if windows:
            key, doc, start = (np.concatenate(x) for x in zip(*windows, strict=True))
            one = combine(key, key, doc, start, np.ones(len(key), np.int32), w.earlier)
            yield batch_of(PIECE, one.column("anchor"), one.column("doc_id"), one.column("start"), one.column("many"), pa.nulls(one.num_rows, pa.binary()))

    return packed.drop("missing").join(wanted, ["doc_id", "th"]).mapInArrow(run, "shard long, doc_id long, start long, many byte, piece binary")


class _EqualWindows:
    """Streams rows of equal windows, shard by shard in the order of their places, in constant memory."""

    def __init__(self, earlier: bool):
        self.earlier, self.shard, self.last, self.first = earlier, None, None, None

    def add(self, shard: np.ndarray, doc: np.ndarray, start: np.ndarray, many: np.ndarray) -> Iterator[tuple]:
        """(doc, start) arrays of places that count."""
        n = len(shard)
        settled = many == 2
        head = np.ones(n, bool)
        head[1:] = shard[1:] != shard[:-1]
        head[0] = self.shard != shard[0]
        twin = np.zeros(n, bool)
        twin[1:] = ~head[1:] & (doc[1:] == doc[:-1]) & (start[1:] == start[:-1])
        twin[0] = not head[0] and self.last == (doc[0], start[0])
        yield doc[settled | (~head & ~twin)], start[settled | (~head & ~twin)]
        if not self.earlier:  # the first of several counts as well
            group = np.cumsum(head)
            more = np.bincount(group, (many == 1) | (~head & ~twin), int(group[-1]) + 1) > 0
            if self.first is not None and more[0]:
                yield np.array([self.first[0]]), np.array([self.first[1]])
                self.first = None
            heads = np.flatnonzero(head)
            known = more[group[heads]] & ~settled[heads]
            yield doc[heads[known]], start[heads[known]]
            if len(heads):
                at = heads[-1]
                self.first = None if more[group[at]] or settled[at] else (doc[at], start[at])
        self.shard, self.last = shard[-1], (doc[-1], start[-1])


def by_shards(pieces: DataFrame, partitions: int, w: Windows, compare: Callable[..., tuple[np.ndarray, np.ndarray]], most: int = 1 << 20) -> DataFrame:
    """Apply ``compare(shard, doc, start, pieces)`` to whole shards, about ``most`` bytes at a time;
    it gives (piece number, window within the piece) of the windows that count. Pieces of a repeated
    row (same place) are compared once. Rows without a piece are streamed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        last: tuple = ()
        equal = _EqualWindows(w.earlier)

        def once(part: pa.RecordBatch) -> pa.RecordBatch:
            nonlocal last
            shard, doc, start = (part.column(k).to_numpy() for k in ("shard", "doc_id", "start"))
            same = np.zeros(len(shard), bool)
            same[1:] = (shard[1:] == shard[:-1]) & (doc[1:] == doc[:-1]) & (start[1:] == start[:-1])
            same[0] = (shard[0], doc[0], start[0]) == last
            last = (shard[-1], doc[-1], start[-1])
            return part.filter(pa.array(~same)) if same.any() else part

        def flush(table: pa.Table) -> pa.RecordBatch:
            doc, start = (table.column(k).to_numpy() for k in ("doc_id", "start"))
            which, window = compare(table.column("shard").to_numpy(), doc, start, table.column("piece").to_pylist())
            return spans(doc[which], start[which] + window, which)

        def spans(doc: np.ndarray, at: np.ndarray, which: np.ndarray) -> pa.RecordBatch:
            first = np.ones(len(which), bool)
            first[1:] = (which[1:] != which[:-1]) | (at[1:] != at[:-1] + 1)
            heads = np.flatnonzero(first)
            return batch_of(SPAN, doc[heads], at[heads], np.diff(np.append(heads, len(which))).astype(np.int32))

        for b in batches:
            bare = b.column("piece").is_null().to_numpy(zero_copy_only=False)
            if bare.any():
                rows = b.filter(pa.array(bare))
                for doc, at in equal.add(*(rows.column(k).to_numpy() for k in ("shard", "doc_id", "start", "many"))):
                    yield spans(doc, at, doc)
                b = b.filter(pa.array(~bare))
            for a in range(0, b.num_rows, 512):
                part = once(b.slice(a, 512))
                held.append(part)
                size += part.column("piece").nbytes
                if size > most:
                    table = pa.Table.from_batches(held)
                    shard = table.column("shard").to_numpy()
                    cut = int(np.searchsorted(shard, shard[-1]))  # the last shard may go on
                    if cut:
                        yield flush(table.slice(0, cut))
                        held = table.slice(cut).to_batches()
                        size = sum(x.column("piece").nbytes for x in held)
        if held:
            yield flush(pa.Table.from_batches(held))

    return pieces.repartition(partitions, "shard").sortWithinPartitions("shard", "doc_id", "start").mapInArrow(run, SPAN_DDL)


def place_of(start: str) -> Column:
    """The position within the text."""
    return F.col(start).bitwiseAND(F.lit((1 << 32) - 1)).cast("int")


def hash_of(start: str) -> Column:
    """The bits of the text's hash that stand above the position."""
    return F.shiftright(start, 32).cast("int")


def spans_by_document(found: DataFrame, compared: DataFrame) -> DataFrame:
    """(doc_id, th, spans): ranges of counted windows, of one document each."""
    whole = found.where(F.col("kind") == REPEATED).select("doc_id", "start", "windows").unionByName(compared)
    return whole.groupBy("doc_id", hash_of("start").alias("th")).agg(F.collect_list(F.struct(place_of("start").alias("start"), "windows")).alias("spans"))


def row_key() -> Column:
    """doc_id, or a key of its own for each text whose doc_id is null. These keys sort before other
    doc_ids; only doc_ids below -2**62 may sort among them."""
    own = F.xxhash64("text").bitwiseAND(F.lit(NULL_KEYS - 1)) + F.lit(NULL_ID)
    return F.coalesce(F.col("doc_id").cast("long"), own)


def row_hash() -> Column:
    """31 bits of a hash of the text."""
    return F.xxhash64("text").bitwiseAND(F.lit((1 << 31) - 1)).cast("int")


def documents_of(documents: DataFrame) -> DataFrame:
    """(doc_id, th, text, missing): with ``row_key`` as doc_id; missing: the doc_id is null."""
    return documents.select(row_key().alias("doc_id"), row_hash().alias("th"), "text", F.col("doc_id").isNull().alias("missing"))


def ids_of(batch: pa.RecordBatch) -> pa.Array:
    """The batch's doc_ids, null again where they are missing."""
    return pa.array(batch.column("doc_id").to_numpy(), mask=batch.column("missing").to_numpy(zero_copy_only=False))


def find(documents: DataFrame, w: Windows, compare: Callable, name: str, most: int = 1 << 20) -> DataFrame:
    """(doc_id, missing, th, packed, spans) of every document: its text and the ranges of windows that count."""
    spark = documents.sparkSession
    partitions = shuffle_partitions(spark)
    docs = documents_of(documents)
    found = materialize(decide(scan(docs.drop("missing"), w), w, partitions), name)
    packed = pack(docs)
    compared = by_shards(fetch(packed, found, w), partitions, w, compare, most)
    return packed.join(spans_by_document(found, compared), ["doc_id", "th"], "left")


def covered(spans: pa.ListScalar, length: int, n: int) -> np.ndarray | None:
    """Which of n symbols the spans' windows cover; None for none."""
    own = spans.values
    if own is None or not len(own):
        return None
    start, windows = own.field(0).to_numpy(), own.field(1).to_numpy()
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, np.minimum(start, n), 1)
    np.add.at(edge, np.minimum(start + windows + length - 1, n), -1)
    return np.cumsum(edge[:n]) > 0
