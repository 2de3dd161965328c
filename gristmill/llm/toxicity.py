"""Toxicity severity by cumulative-link (proportional-odds) ordinal regression.

Grades 0 .. K-1 are ordered. One weight vector over sparse word features serves all thresholds:
P(grade > k) = sigmoid(x.w - theta_k) with theta ascending, fitted by the likelihood of the grades,
P(grade = k) = P(grade > k-1) - P(grade > k); the expected severity is the sum of P(grade > k) over
k. Features are the distinct words of a text (runs of letters and digits, A-Z lower-cased), keyed by
a 64-bit hash, no bucket shared. Words of two rows or more whose share of rows above grade 0 is off
by two standard errors take part, whatever the number of labelled rows; an L1 penalty selects among
them, so the model is a small table.

Grades are the labels as they are given, negative ones counting as 0; of a column with the values 0
and 1 there are two grades and one threshold.

The model is fitted on a bounded sample of labelled rows: those of at most ``max_rows`` labels (the
smallest hashes of doc_id, independent of file order), copies counted once, and at most ``max_words``
words, those furthest off. Words are counted and chosen on the executors; the driver gets the chosen
words of each row. Scoring covers every document and whole texts.

Cases: null or empty texts score the base rate of an empty feature vector; very long texts are a row
like others, of their distinct words; without labelled rows, or with one grade only, severity is that
grade (0 without rows) for all; null labels and labels without a doc_id are ignored; several labels
of one document count as rows of their own; words equally far off are taken by their hash; repeated
rows and rows with a null doc_id are scored like others; an empty table gives no row; extra columns
are ignored by ``score`` and kept by ``clean``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, keep_rows, materialize, release
from .textblocks import Block, block_of, byte_values, lower_ascii, prefix_hash, row_slices_of, runs, span_hash, table_of

MAX_ROWS, MAX_WORDS = 12_000, 50_000
#: Words of a row whose hashes, if equal, make two rows copies of each other.
SKETCH = 3
#: Least expected severity of a document that counts as toxic.
CUT = 0.3
_NOT_WORD = ~table_of(bytes([*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]))


@dataclass(frozen=True)
class OrdinalModel:
    keys: np.ndarray  # ascending uint64 hashes of words
    weights: np.ndarray  # float64, one per key
    thresholds: np.ndarray  # ascending float64, K-1

    def severity(self, score: np.ndarray) -> np.ndarray:
        if not len(self.thresholds):
            return np.zeros(len(score))
        z = np.clip(score[:, None] - self.thresholds[None, :], -500, 500)
        return (1 / (1 + np.exp(-z))).sum(axis=1)


def word_features(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """(document number, word hash) of all words, repeats included."""
    starts, ends, first = runs(block, _NOT_WORD)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    prefix = prefix_hash(byte_values(lower_ascii(block.data)))
    return np.repeat(np.arange(len(block)), np.diff(first)), span_hash(prefix, starts, ends)


def distinct_pairs(doc: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((key, doc))
    doc, key = doc[order], key[order]
    keep = np.ones(len(doc), bool)
    keep[1:] = (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])
    return doc[keep], key[keep]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fit_rows(row: np.ndarray, col: np.ndarray, words: int, grade: np.ndarray, l1: float = 1e-4, steps: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) of the largest penalised likelihood, by proximal gradient steps with
    momentum and a step size found by backtracking. Rows are given as distinct (row, word) pairs and
    a grade per row. The negative logarithm of the likelihood is convex in weights and thresholds;
    gaps between thresholds are kept as logarithms, so they stay in order."""
    n, k = len(grade), int(grade.max()) + 1
    share = np.clip([(grade > j).mean() for j in range(k - 1)], 1e-3, 1 - 1e-3)
    theta = np.log((1 - share) / share)
    x = np.concatenate([np.zeros(words), theta[:1], np.log(np.maximum(np.diff(theta), 1e-2))])

    def thresholds(v: np.ndarray) -> np.ndarray:
        return np.cumsum(np.concatenate([v[words : words + 1], np.exp(np.clip(v[words + 1 :], -20, 20))]))

    def loss(v: np.ndarray) -> tuple[float, np.ndarray]:
        bounds = np.concatenate([[-np.inf], thresholds(v), [np.inf]])
        score = np.bincount(row, v[col], n) if len(row) else np.zeros(n)
        upper, lower = _sigmoid(score - bounds[grade]), _sigmoid(score - bounds[grade + 1])
        gap = 1 - np.exp(bounds[grade] - bounds[grade + 1])
        likely = np.maximum(upper * (1 - lower) * gap, 1e-300)  # upper - lower, without cancellation
        by_score = (upper + lower - 1) / n
        by_bound = np.bincount(grade, (1 - upper) / np.maximum((1 - lower) * gap, 1e-12), k) / n
        by_bound[1:] -= np.bincount(grade + 1, lower / np.maximum(upper * gap, 1e-12), k + 1)[1:-1] / n
        by_theta = np.cumsum(by_bound[:0:-1])[::-1]  # of each threshold with all above it
        out = np.empty_like(v)
        out[:words] = np.bincount(col, by_score[row], words) if len(row) else 0
        out[words] = by_theta[0]
        out[words + 1 :] = by_theta[1:] * np.exp(np.clip(v[words + 1 :], -20, 20))
        return -float(np.log(likely).mean()), out

    ahead, momentum, rate = x.copy(), 1.0, 1.0
    for _ in range(steps):
        value, slope = loss(ahead)
        rate *= 1.5
        while True:
            new = ahead - rate * slope
            new[:words] = np.sign(new[:words]) * np.maximum(np.abs(new[:words]) - rate * l1, 0)
            step = new - ahead
            if loss(new)[0] <= value + slope @ step + step @ step / (2 * rate) + 1e-12 or rate < 1e-9:
                break
            rate /= 2
        if (ahead - new) @ (new - x) > 0:  # momentum points uphill
            momentum = 1.0
        following = (1 + (1 + 4 * momentum**2) ** 0.5) / 2
        ahead, x, momentum = new + (momentum - 1) / following * (new - x), new, following
    return x[:words], thresholds(x)


def labelled_rows(documents: DataFrame, labels: DataFrame, label: str, max_rows: int) -> DataFrame:
    """(keys, y): distinct word hashes and grade of the rows fitted on, one of each set of copies."""
    chosen = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.greatest(F.col(label).cast("int"), F.lit(0)).alias("y"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(max_rows)
    # max_rows ids at most, so this side may be broadcast
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    schema = pa.schema([("doc_id", pa.int64()), ("y", pa.int32()), ("keys", pa.list_(pa.int64()))])

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            block = block_of(b.column("text"))
            for a, z in row_slices_of(block, 1 << 20):
                doc, key = distinct_pairs(*word_features(block.slice(a, z)))
                cuts = np.searchsorted(doc, np.arange(z - a + 1))
                yield batch_of(schema, b.column("doc_id").slice(a, z - a), b.column("y").slice(a, z - a), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(key.view(np.int64))))

    found = rows.mapInArrow(features, "doc_id long, y int, keys array<long>").withColumn("sketch", F.slice("keys", 1, SKETCH))
    place = F.struct(F.xxhash64("doc_id"), "doc_id", "y")
    once = found.groupBy("sketch").agg(F.min_by(F.struct("keys", "y"), place).alias("row"), F.min(place).alias("place"))
    return once.orderBy("place").limit(max_rows).select("row.keys", "row.y")


def telling_words(rows: DataFrame, max_words: int, min_docs: int = 2, least_z: float = 2.0) -> np.ndarray:
    """Hashes of the words that occur in at least ``min_docs`` rows and much more (or less) often in
    rows above grade 0 than by chance, by a two-proportion z score; in ascending order."""
    n, on = rows.agg(F.count(F.lit(1)), F.count_if(F.col("y") > 0)).head()
    p = on / n
    words = rows.select(F.explode("keys").alias("key"), (F.col("y") > 0).alias("on")).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.count_if("on").alias("seen"))
    off = F.abs(F.col("seen") - F.col("n") * p) / F.sqrt(F.greatest(F.lit(1e-9), F.col("n") * (p * (1 - p))))
    far = words.where(F.col("n") >= min_docs).withColumn("z", off).where(F.col("z") >= least_z)
    found = far.orderBy(F.desc("z"), "key").limit(max_words).select("key").toArrow()
    return np.sort(found.column("key").to_numpy().view(np.uint64))


def fit(documents: DataFrame, labels: DataFrame, label: str = "toxic", max_rows: int = MAX_ROWS, max_words: int = MAX_WORDS) -> OrdinalModel:
    """Fit on the rows of at most ``max_rows`` labels, with at most ``max_words`` words."""
    none = np.zeros(0, np.uint64)
    rows = materialize(labelled_rows(documents, labels, label, max_rows), "labelled")
    low, high = rows.agg(F.min("y"), F.max("y")).head()
    if not high:
        return OrdinalModel(none, np.zeros(0), np.zeros(0))
    if low == high:  # every row has the highest grade
        return OrdinalModel(none, np.zeros(0), np.full(high, -500.0))
    words = telling_words(rows, max_words)
    shared = rows.sparkSession.sparkContext.broadcast(words)  # max_words at most
    schema = pa.schema([("y", pa.int32()), ("at", pa.list_(pa.int32()))])

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for b in batches:
            lists = []
            for keys in b.column("keys"):
                own = keys.values.to_numpy().view(np.uint64)
                lists.append(np.flatnonzero(np.isin(held, own, assume_unique=True)).astype(np.int32))
            yield batch_of(schema, b.column("y"), lists)

    found = rows.mapInArrow(numbers, "y int, at array<int>").toArrow()
    lists = found.column("at").combine_chunks()
    col, row = lists.flatten().to_numpy().astype(np.int64), np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
    weights, thresholds = fit_rows(row, col, len(words), found.column("y").to_numpy().astype(np.int64))
    live = weights != 0
    return OrdinalModel(words[live], weights[live], thresholds)


def _scores(block: Block, model: OrdinalModel) -> np.ndarray:
    doc, key = word_features(block)
    out = np.zeros(len(block))
    if not len(doc) or not len(model.keys):
        return out
    at = np.minimum(np.searchsorted(model.keys, key), len(model.keys) - 1)
    hit = model.keys[at] == key
    doc, key = distinct_pairs(doc[hit], key[hit])
    np.add.at(out, doc, model.weights[np.searchsorted(model.keys, key)])
    return out


def score(documents: DataFrame, model: OrdinalModel, cut: float = CUT) -> DataFrame:
    """(doc_id, severity, grade, toxic): expected severity, that rounded, and whether it reaches ``cut``."""
    shared = documents.sparkSession.sparkContext.broadcast(model)  # at most the words of max_rows texts
    schema = pa.schema([("doc_id", pa.int64()), ("severity", pa.float64()), ("grade", pa.int32()), ("toxic", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in batches:
            block = block_of(b.column("text"))
            for a, z in row_slices_of(block, 1 << 20):
                severity = shared.value.severity(_scores(block.slice(a, z), shared.value))
                yield batch_of(schema, b.column("doc_id").slice(a, z - a), severity, np.rint(severity).astype(np.int32), severity >= cut)

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, severity double, grade int, toxic boolean")


def clean(documents: DataFrame, model: OrdinalModel, cut: float = CUT) -> DataFrame:
    """The rows of ``documents`` whose expected severity stays below ``cut``, all columns kept; a
    filter in one pass, without a join back."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def keep(texts: Iterator[pa.Array]) -> Iterator[tuple[pa.Array, int, int]]:
        release()
        for column in texts:
            block = block_of(column)
            for a, z in row_slices_of(block, 1 << 20):
                yield pa.array(shared.value.severity(_scores(block.slice(a, z), shared.value)) < cut), a, z

    return keep_rows(documents, keep)
