"""Benchmark decontamination with one Aho-Corasick automaton over normalised test items.

Text and items are normalised alike: A-Z lower-cased, words are runs of ``0-9``, ``a-z`` and
non-ASCII characters. Every window of ten item words (a shorter item is one window) is a pattern of
word numbers; other words of a document have the number 0. The automaton reads the numbers of a
document once and reports all occurrences, overlapping ones too; word positions map back to byte
offsets of the original text. A worker builds the automaton once and keeps it for its next tasks.

Cases: null or empty texts and texts without words give 0 words and no hit; null items and items
without words never match; equal items under several ids are all reported, and a repeated item row,
or an id of several texts, is listed once; an item whose id is null is found like others but has no
id to list or count; very long texts are read in parts that overlap by a window; repeated documents
give a row each, with a null doc_id too; an empty table gives no row, and an empty benchmark leaves
all documents clean; other columns, whatever their names, are ignored or, by ``clean``, kept.

The items are broadcast behind a check of their size: up to ``automaton_bytes`` of text they make one
automaton and one scan. Beyond that they are dealt to several automata, each with a scan of its own
over a written table, so that memory stays that of one automaton.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, hold, keep_rows, materialize
from .textblocks import block_of, runs, table_of

WINDOW = 10
#: Item text of one automaton. Each word begins a pattern of its own, so memory is some 220 times this.
AUTOMATON_BYTES = 1 << 20
#: Documents are read in parts of about so many bytes.
PART = 4 << 20
_WORD = bytes([*range(48, 58), *range(97, 123), *range(128, 256)])
_NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if c in _WORD else 32 for c in range(256))
_NOT_WORD = ~table_of(_WORD + bytes(range(65, 91)))

SPAN = pa.struct([("start_word", pa.int32()), ("end_word", pa.int32()), ("start_byte", pa.int64()), ("end_byte", pa.int64())])
SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(SPAN))])
DDL = "doc_id long, n_words long, n_hit long, items array<string>, spans array<struct<start_word:int,end_word:int,start_byte:long,end_byte:long>>"


def words_of(text: str | bytes | None) -> list[bytes]:
    if text is None:
        return []
    return (text.encode() if isinstance(text, str) else text).translate(_NORMAL).split()


class Patterns:
    """The automaton over all windows of (item id, text) rows. It reads words as numbers of ``width``
    digits to the base 32; a first digit is never a later one, so matches begin and end with words.
    A pattern is known by a number: ``sizes`` and ``names`` have its words and the item ids it stands for."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW):
        texts = [(name, words_of(text)) for name, text in items]
        words = list(dict.fromkeys(w for _, x in texts for w in x))
        self.width = 1
        while 32**self.width <= len(words):
            self.width += 1
        self.codes = {w: self._digits(k) for k, w in enumerate(words, 1)}
        self.other = self._digits(0)
        self.window, self.sizes, self.names = window, [], []
        found: dict[str, int] = {}
        for name, text in texts:
            size = min(window, len(text))
            line = "".join([self.codes[w] for w in text])
            for i in range(len(text) - size + 1) if size else ():
                k = found.setdefault(line[i * self.width : (i + size) * self.width], len(found))
                if k == len(self.sizes):
                    self.sizes.append(size)
                    self.names.append(set())
                if name is not None:
                    self.names[k].add(name)
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for pattern, k in found.items():
            self.machine.add_word(pattern, k)
        if found:
            self.machine.make_automaton()

    def _digits(self, k: int) -> str:
        digits = [k >> 5 * j & 31 for j in range(self.width)]
        return "".join(chr(64 + d if j else 32 + d) for j, d in enumerate(digits))

    def scan(self, text: bytes) -> tuple[int, list[list[int]], list[str]]:
        """(number of words, merged hit word ranges, item ids in order) of one document."""
        line, code, other = text.translate(_NORMAL), self.codes.get, self.other
        count, spans, who, before = 0, [], set(), ""
        for part in parts(line):
            words = part.split()
            if self.sizes:
                own = before + "".join([code(w, other) for w in words])
                first = count - len(before) // self.width
                for end, k in self.machine.iter(own):  # ends ascend
                    who |= self.names[k]
                    stop = first + (end + 1) // self.width
                    start = stop - self.sizes[k]
                    while spans and start <= spans[-1][1]:  # a longer pattern may reach back over several spans
                        last = spans.pop()
                        start, stop = min(start, last[0]), max(stop, last[1])
                    spans.append([start, stop])
                before = own[len(own) - (self.window - 1) * self.width :] if len(own) > (self.window - 1) * self.width else own
            count += len(words)
        return count, spans, sorted(who)


def parts(line: bytes) -> Iterator[bytes]:
    """A normalised text in parts, cut at blanks."""
    at = 0
    while len(line) - at > PART:
        cut = line.find(b" ", at + PART)
        if cut < 0:
            break
        yield line[at:cut]
        at = cut
    yield line[at:] if at else line


def find_contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, automaton_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, items (sorted as strings), spans (word and byte
    ranges of the original text)."""
    found = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    shared = _automata(benchmark, automaton_bytes)
    for p, items in enumerate(shared):
        last = p == len(shared) - 1
        found = found.mapInArrow(_scanner(items, window, p == 0, last), DDL if last else DDL + ", text string")
        if not last:  # scans in one chain would hold all automata at a time
            found = materialize(found, "scan")
    return found


def _automata(benchmark: DataFrame, automaton_bytes: int) -> list:
    """Broadcast items under a key of their own, at most about ``automaton_bytes`` of text in each;
    at least one list."""
    spark = benchmark.sparkSession
    items = benchmark.where(F.col("text").isNotNull()).select(F.col("item_id").cast("string").alias("item_id"), "text").distinct()
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).head()[0]
    count = max(1, -(-int(total) // automaton_bytes))
    out = []
    for p in range(count):
        own = items if count == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == p)
        out.append((uuid.uuid4().hex, spark.sparkContext.broadcast([tuple(r) for r in own.collect()])))  # within the bound
    return out


def _held(shared: tuple, window: int) -> Patterns:
    """The worker's automaton of these items."""
    return hold(("decontam", shared[0], window), lambda: Patterns(shared[1].value, window))


def _scanner(shared: tuple, window: int, first: bool, last: bool):
    """One scan; a later scan adds to what the earlier ones found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = _held(shared, window)
        for b in batches:
            block = block_of(b.column("text"))
            before = [[]] * len(block) if first else b.column("items").to_pylist()
            ranges = [[]] * len(block) if first else [[[s["start_word"], s["end_word"]] for s in x] for x in b.column("spans").to_pylist()]
            n, hit, who, where = [], [], [], []
            for i in range(len(block)):
                count, spans, items = patterns.scan(block.doc(i))
                if ranges[i]:
                    spans, items = merge_ranges(ranges[i] + spans), sorted({*before[i], *items})
                n.append(count)
                hit.append(sum(e - s for s, e in spans))
                who.append(items)
                if spans:
                    starts, ends, _ = runs(block.slice(i, i + 1), _NOT_WORD)
                    where.append([{"start_word": s, "end_word": e, "start_byte": int(starts[s]), "end_byte": int(ends[e - 1])} for s, e in spans])
                else:
                    where.append([])
            columns = [b.column("doc_id"), np.array(n, np.int64), np.array(hit, np.int64), who, where]
            yield batch_of(SCHEMA, *columns) if last else batch_of(SCHEMA.append(pa.field("text", pa.string())), *columns, b.column("text"))

    return run


def merge_ranges(ranges: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for s, e in sorted(ranges):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def clean(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, automaton_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """The rows of ``documents`` without any window of ``benchmark``, all columns kept; a filter,
    without a join back."""
    automata = _automata(benchmark, automaton_bytes)
    for shared in automata:

        def keep(texts: Iterator[pa.Array], shared=shared) -> Iterator[tuple[pa.Array, int, int]]:
            patterns = _held(shared, window)
            for column in texts:
                block = block_of(column)
                yield pa.array([not patterns.scan(block.doc(i))[1] for i in range(len(block))], pa.bool_()), 0, len(block)

        documents = keep_rows(documents, keep)
        if shared is not automata[-1]:
            documents = materialize(documents, "scan")
    return documents


def digest(found: DataFrame) -> DataFrame:
    """The columns of the query contract."""
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )
