"""Near-duplicate documents by b-bit MinHash.

A document's set holds its distinct shingles of five words (A-Z lower-cased; with fewer words the
whole sequence is one shingle). Documents of equal sets are one class, known by the hash of its
set. Minima of 128 hash functions give 32 band keys of four full minima each; of every minimum four
bits are kept and packed into eight 64-bit numbers, from whose differing nibbles the similarity is
estimated, corrected for chance collisions: J = (share equal - 1/16) / (1 - 1/16).

Links: two classes are compared if they share a band key and their estimate reaches ``LEAST``; a
link holds if 100 * intersection >= 75 * union on the full sets. At a similarity of 0.75 a pair
shares no band with a probability of 5e-6, and falls below ``LEAST`` (five standard errors) with one
of less than 1e-6.

No pair is ever written that isn't a link or a pair with the centre of a band:
1. ``star_pairs``: each member of a band with the band's centre, its class of the smallest doc_id.
2. ``test_stars`` tests these pairs on the full sets. A group is a centre with all members of its
   bands; members without a link to their centre are its outsiders.
3. ``test_cells`` takes the groups that have outsiders and other members, in cells of bounded size,
   and tests each outsider with all members of its group that it isn't connected with yet. A cell
   gives a spanning forest: one row per outsider at most, whatever the number of its pairs.
4. Components of these links (``components``).
So a group whose members all resemble its centre costs one test a member, and every pair of
different components that shares a band is tested. Sets are compared by 64-bit shingle hashes, and
classes are told apart by 64 bits of their set's hash.

Cases: documents without words (or null text) have no shingle and no link; texts of one to four
words link with equal sequences only; a very long text is one set like any other and travels alone;
repeated rows, and texts of equal sets, are of one class; a tie of doc_ids is settled by a hash of
the text, so rows that share a doc_id but not the text are documents of their own; so are rows with
a null doc_id, which sort last: their component_id is the smallest doc_id of their component, null
where it has none. An empty table gives no row; extra columns are ignored by ``near_duplicates`` and
kept by ``clean``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, materialize, quoted, release, shuffle_partitions
from .components import connected_components
from .textblocks import BLANKS, Block, U, block_of, byte_values, gather_runs, lower_ascii, mix, prefix_hash, row_slices_of, runs, span_hash

SHINGLE = 5
HASHES, ROWS, BITS = 128, 4, 4
BANDS = HASHES // ROWS
#: Similarity of a link, in per cent, and the least estimate that is checked.
LINK, LEAST = 75, 0.54
#: Bounds of one side of a cell: members, and shingles of all of them.
CELL_ROWS, CELL_SHINGLES = 1024, 1 << 19
_A = mix(np.arange(1, HASHES + 1, dtype=U)) | U(1)
_B = mix(np.arange(HASHES + 1, 2 * HASHES + 1, dtype=U))


def shingle_sets(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, ascending within each document, and the number of them."""
    starts, ends, first = runs(block, BLANKS)
    words = np.diff(first)
    if not len(starts):
        return np.zeros(0, U), words
    prefix = prefix_hash(span_hash(prefix_hash(byte_values(lower_ascii(block.data))), starts, ends))
    count = np.where(words == 0, 0, np.maximum(1, words - SHINGLE + 1))
    at = gather_runs(count, first[:-1])
    doc = np.repeat(np.arange(len(words)), count)
    found = span_hash(prefix, at, np.minimum(at + SHINGLE, first[doc + 1]))
    order = np.lexsort((found, doc))
    found, doc = found[order], doc[order]
    keep = np.ones(len(found), bool)
    keep[1:] = (found[1:] != found[:-1]) | (doc[1:] != doc[:-1])
    return found[keep], np.bincount(doc[keep], minlength=len(words))


SETS = pa.schema([("doc_id", pa.int64()), ("missing", pa.bool_()), ("th", pa.int64()), ("n", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("bands", pa.list_(pa.int64())), ("bits", pa.list_(pa.int64()))])
SET_DDL = "doc_id long, missing boolean, th long, n int, h1 long, h2 long, bands array<long>, bits array<long>"


def signatures(sets: np.ndarray, count: np.ndarray):
    """(h1, h2, bands, bits) of the documents that have shingles."""
    first = np.cumsum(count) - count
    first, held = first[count > 0], int((count > 0).sum())
    if not held:
        return np.zeros(0, U), np.zeros(0, U), np.zeros((0, BANDS), U), np.zeros((0, HASHES * BITS // 64), U)
    h1 = np.add.reduceat(mix(sets ^ U(0xA5A5A5A5A5A5A5A5)), first)
    h2 = np.add.reduceat(mix(sets + U(0x3C6EF372FE94F82B)), first)
    minima = np.empty((held, HASHES), U)
    work = np.empty_like(sets)
    for j in range(HASHES):
        np.multiply(sets, _A[j], out=work)
        np.add(work, _B[j], out=work)
        minima[:, j] = np.minimum.reduceat(work, first)
    bands = np.zeros((held, BANDS), U)
    for r in range(ROWS):
        bands = mix(bands * U(0x9E3779B97F4A7C15) + minima[:, r::ROWS])
    bands = mix(bands + np.arange(BANDS, dtype=U)[None, :])
    per = 64 // BITS
    low = ((minima >> U(16)) & U((1 << BITS) - 1)).reshape(held, HASHES // per, per)
    bits = np.bitwise_or.reduce(low << (np.arange(per, dtype=U) * U(BITS))[None, None, :], axis=2)
    return h1, h2, bands, bits


def identified(documents: DataFrame) -> DataFrame:
    """(doc_id, missing, th, text): doc_id (0 where it is missing) and a hash of the text tell rows apart."""
    doc_id = F.col("doc_id").cast("long")
    return documents.select(F.coalesce(doc_id, F.lit(0)).alias("doc_id"), doc_id.isNull().alias("missing"), F.xxhash64("text").alias("th"), "text")


def describe(docs: DataFrame) -> DataFrame:
    """The size and hash of each row's set, its band keys and packed bits (``SETS``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in batches:
            block = block_of(b.column("text"))
            for a, z in row_slices_of(block, 1 << 20):
                sets, count = shingle_sets(block.slice(a, z))
                some = count > 0
                h1, h2, bands, bits = signatures(sets, count)
                full = np.zeros((2, z - a), np.int64)
                full[0, some], full[1, some] = h1.view(np.int64), h2.view(np.int64)
                lists = []
                for x in (bands, bits):
                    cuts = np.concatenate([[0], np.cumsum(np.where(some, x.shape[1], 0))])
                    lists.append(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(np.ascontiguousarray(x).view(np.int64).ravel())))
                yield batch_of(SETS, *(b.column(k).slice(a, z - a) for k in ("doc_id", "missing", "th")), count.astype(np.int32), full[0], full[1], *lists)

    return docs.mapInArrow(run, SET_DDL)


_NIBBLES = 0x1111111111111111


def differing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many of the packed values differ, over the last axis."""
    d = x ^ y
    d |= d >> U(2)
    d |= d >> U(1)
    return np.bitwise_count(d & U(_NIBBLES)).sum(axis=-1, dtype=np.int64)


def estimate(different):
    """Similarity from the number of differing values, corrected for collisions."""
    chance = 1 / (1 << BITS)
    return ((1 - different / HASHES) - chance) / (1 - chance)


def fitting(bits: np.ndarray, n: int, other_bits: np.ndarray, other_n: np.ndarray) -> np.ndarray:
    """Which of the others may be linked by estimate and set size."""
    low, high = np.minimum(n, other_n).astype(np.int64), np.maximum(n, other_n).astype(np.int64)
    return (100 * low >= LINK * high) & (estimate(differing(bits, other_bits)) >= LEAST)


def linked(common, left, right):
    """Whether sets of these sizes and this intersection are linked."""
    return (common > 0) & (100 * common >= LINK * (left + right - common))


def bits_of(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().view(U).reshape(len(column), -1)


def unpacked(texts: list[bytes], expand: zstandard.ZstdDecompressor) -> tuple[np.ndarray, np.ndarray]:
    """The sets of packed texts: shingle hashes, and where each set begins (one more than texts)."""
    raw = [expand.decompress(x) for x in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    sets, count = shingle_sets(Block(data, np.concatenate([[0], np.cumsum([len(x) for x in raw], dtype=np.int64)])))
    return sets, np.concatenate([[0], np.cumsum(count)])


def star_pairs(classes: DataFrame) -> DataFrame:
    """(a, b): each member b of a band with the band's centre a."""
    keys = classes.select("v", F.when(F.col("first.missing"), F.lit((1 << 63) - 1)).otherwise(F.col("first.doc_id")).alias("place"), F.explode("bands").alias("key"))
    centres = keys.groupBy("key").agg(F.min_by("v", "place").alias("a"), F.count(F.lit(1)).alias("size")).where("size > 1").select("key", "a")
    return keys.select("key", F.col("v").alias("b")).join(centres.hint("merge"), "key").where("a <> b").select("a", "b").distinct()


def texts_of(docs: DataFrame, classes: DataFrame, stars: DataFrame) -> DataFrame:
    """(v, n, bits, packed) of each class in a pair: its first row's text, compressed."""
    wanted = stars.select(F.explode(F.array("a", "b")).alias("v")).distinct()
    rows = classes.select("v", "n", "bits", "first.*").join(wanted.hint("merge"), "v")
    schema = pa.schema([("doc_id", pa.int64()), ("missing", pa.bool_()), ("th", pa.int64()), ("packed", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        squeeze = zstandard.ZstdCompressor(level=1)
        for b in batches:
            block = block_of(b.column("text"))
            yield batch_of(schema, *(b.column(k) for k in ("doc_id", "missing", "th")), [squeeze.compress(block.doc(i)) for i in range(len(block))])

    packed = docs.mapInArrow(run, "doc_id long, missing boolean, th long, packed binary")
    return packed.join(rows.hint("merge"), ["doc_id", "missing", "th"]).dropDuplicates(["doc_id", "missing", "th"]).select("v", "n", "bits", "packed")


def test_stars(stars: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, n, linked): the pairs with the size of b's set, tested on their full sets."""
    right = texts.select(F.col("v").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("xb"), F.col("packed").alias("pb"))
    left = texts.select(F.col("v").alias("a"), F.col("n").alias("na"), F.col("bits").alias("xa"), F.col("packed").alias("pa"))
    both = stars.join(right.hint("merge"), "b").join(left.hint("merge"), "a").select("a", "b", "na", "nb", "xa", "xb", "pa", "pb")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int32()), ("linked", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        expand = zstandard.ZstdDecompressor()
        for batch in batches:
            na, nb = (batch.column(k).to_numpy() for k in ("na", "nb"))
            ok = np.zeros(batch.num_rows, bool)
            if batch.num_rows:
                fit = fitting(bits_of(batch.column("xa")), na, bits_of(batch.column("xb")), nb)
                for some in np.split(rows := np.flatnonzero(fit), np.arange(256, len(rows), 256)):
                    centres, where = np.unique(batch.column("a").to_numpy()[some], return_index=True)
                    place = np.searchsorted(centres, batch.column("a").to_numpy()[some]) + len(some)
                    packed = [batch.column("pb")[i].as_py() for i in some] + [batch.column("pa")[i].as_py() for i in some[where]]
                    sets, cut = unpacked(packed, expand)
                    for k, i in enumerate(some):
                        left, right = sets[cut[place[k]] : cut[place[k] + 1]], sets[cut[k] : cut[k + 1]]
                        ok[i] = linked(len(np.intersect1d(left, right, assume_unique=True)), len(left), len(right))
            yield batch_of(schema, batch.column("a"), batch.column("b"), nb, ok)

    return both.mapInArrow(run, "a long, b long, n int, linked boolean")


def test_cells(tested: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b): a forest that connects the outsiders of each group with those members that they are
    linked with. A cell (i, j) has the outsiders of part i and all members of part j of a group."""
    groups = tested.groupBy("a").agg(F.count(F.lit(1)).alias("rows"), F.count_if(~F.col("linked")).alias("outsiders"), F.sum("n").alias("shingles")).where("rows > 1 and outsiders > 0")
    parts = F.greatest(F.ceil(F.col("rows") / CELL_ROWS), F.ceil(F.col("shingles") / CELL_SHINGLES)).cast("int")
    dealt = tested.join(groups.select("a", parts.alias("parts")).hint("merge"), "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int"))
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    as_member = F.transform(every, lambda i: F.struct(i.alias("i"), F.col("part").alias("j")))
    as_outsider = F.transform(every, lambda j: F.struct(F.col("part").alias("i"), j.alias("j")))
    cells = F.when(F.col("linked"), as_member).otherwise(F.array_union(as_member, as_outsider))
    placed = dealt.select("a", "b", "n", "linked", "part", F.explode(cells).alias("cell"))
    rows = placed.join(texts.select(F.col("v").alias("b"), "bits", "packed").hint("merge"), "b")
    outside, inside = ~F.col("linked") & (F.col("cell.i") == F.col("part")), F.col("cell.j") == F.col("part")
    rows = rows.select("a", "cell.i", "cell.j", "b", "n", "linked", outside.alias("outside"), inside.alias("inside"), "bits", "packed")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        expand = zstandard.ZstdDecompressor()
        for cell in whole_cells(batches):
            yield batch_of(schema, *forest(cell, expand))

    return rows.repartition(shuffle_partitions(tested.sparkSession), "a", "i", "j").sortWithinPartitions("a", "i", "j", "b").mapInArrow(run, "a long, b long")


def whole_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one cell at a time; they stand together."""
    held: list[pa.RecordBatch] = []
    last: tuple = ()
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in ("a", "i", "j")])
        cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
        for start, stop in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
            key = tuple(keys[:, start].tolist())
            if held and key != last:
                yield pa.concat_batches(held)
                held = []
            last = key
            held.append(batch.slice(start, stop - start))
    if held:
        yield pa.concat_batches(held)


def forest(cell: pa.RecordBatch, expand: zstandard.ZstdDecompressor) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that connect what the cell's outsiders are linked with. Members linked to the centre
    are one component from the start, and an outsider is tested with other components only."""
    b, n = cell.column("b").to_numpy(), cell.column("n").to_numpy()
    joined, outside, inside = (cell.column(k).to_numpy(zero_copy_only=False) for k in ("linked", "outside", "inside"))
    bits, centre = bits_of(cell.column("bits")), len(b)
    label = np.where(joined, centre, np.arange(len(b)))
    if outside.any():
        sets, cut = unpacked(cell.column("packed").to_pylist(), expand)
        words, dense = np.unique(sets, return_inverse=True)
        size, flag, members = np.diff(cut), np.zeros(len(words), bool), np.flatnonzero(inside)
        for x in np.flatnonzero(outside).tolist():
            other = members[label[members] != label[x]]
            other = other[fitting(bits[x], n[x], bits[other], n[other])]
            if not len(other):
                continue
            own = dense[cut[x] : cut[x + 1]]
            flag[own] = True
            seen = flag[dense[gather_runs(size[other], cut[other])]]
            common = np.add.reduceat(seen, np.cumsum(size[other]) - size[other], dtype=np.int64)
            flag[own] = False
            hit = label[other[linked(common, size[x], size[other])]]
            if len(hit):
                met = np.append(hit, label[x])
                label[np.isin(label, met)] = met.max()
    new = np.flatnonzero(~joined & (label != np.arange(len(b))))
    return np.append(b, cell.column("a")[0].as_py())[label[new]], b[new]


def components_of(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each row's description (``SETS`` without bands and bits), and (h1, h2, n, head) of each class,
    head being the first row (missing, doc_id, th) of its component."""
    docs = identified(documents)
    described = materialize(describe(docs), "sets")
    # one row per class: equal sets have equal keys and bits
    classes = described.where("n > 0").groupBy("h1", "h2", "n").agg(F.min(F.struct("missing", "doc_id", "th")).alias("first"), F.first("bands").alias("bands"), F.first("bits").alias("bits"))
    classes = materialize(classes.withColumn("v", F.col("h1")), "classes")
    stars = materialize(star_pairs(classes), "stars")
    texts = materialize(texts_of(docs, classes, stars), "texts")
    tested = materialize(test_stars(stars, texts), "pairs")
    links = tested.where("linked").select("a", "b").unionByName(test_cells(tested, texts))
    label = connected_components(links).select(F.col("vertex").alias("v"), "component")
    of_class = classes.select("h1", "h2", "n", "first", "v").join(label.hint("merge"), "v", "left").select("h1", "h2", "n", "first", F.coalesce("component", "v").alias("component"))
    heads = of_class.groupBy("component").agg(F.min("first").alias("head"))
    return described.drop("bands", "bits"), of_class.join(heads.hint("merge"), "component").select("h1", "h2", "n", "head")


def near_duplicates(documents: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): one row per row of ``documents``."""
    described, classes = components_of(documents)
    out = described.join(classes.hint("merge"), ["h1", "h2", "n"], "left").withColumn("row", F.struct("missing", "doc_id", "th")).withColumn("head", F.coalesce("head", "row"))
    doc_id, component_id = F.when(~F.col("missing"), F.col("doc_id")), F.when(~F.col("head.missing"), F.col("head.doc_id"))
    return out.select(doc_id.alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), component_id.alias("component_id"), F.coalesce(doc_id == component_id, F.col("row") == F.col("head")).alias("kept"))


def clean(documents: DataFrame) -> DataFrame:
    """The first row of each component, with all columns; a row repeated as it is stays once."""
    described, classes = components_of(documents)
    heads = classes.select("head.*").unionByName(described.where("n = 0").select("missing", "doc_id", "th")).distinct()
    names = {k: f"gristmill {k}" for k in ("missing", "doc_id", "th")}
    doc_id = F.col("doc_id").cast("long")
    keyed = documents.select(*quoted(documents), F.coalesce(doc_id, F.lit(0)).alias(names["doc_id"]), doc_id.isNull().alias(names["missing"]), F.xxhash64("text").alias(names["th"]))
    left = keyed.join(heads.withColumnsRenamed(names).hint("merge"), [*names.values()], "left_semi").dropDuplicates([*names.values()])
    return left.select(*quoted(documents))
