"""Approximate nearest neighbours by inner product: an NN-descent graph and greedy graph search.

Build. The graph's neighbours are those by angle: vectors are packed as 8-bit unit vectors and a
norm, for the build only, so vectors of small norm are resolved like others. First edges come from
random hyperplane cells (``tables`` independent ones, cells over ``CELL`` rows split by a hash):
within a cell every pair is scored. Then each NN-descent iteration joins neighbours of neighbours:
every vertex gathers its nearest neighbours and the vertices it is a neighbour of, in blocks of
bounded size, scores all pairs of a block, and proposes to each member what beats its worst
neighbour. The best ``degree`` stay. Far edges join them for the search: in each cell, to the members
of largest inner product (which lead to large norms), and between vertices drawn together by a hash
(which lead out of a cluster that is a component of its own).

Search. A query starts from its own neighbours, and from the best of ``ENTRIES`` vertices of largest
norm or smallest hash. In each round the best vertices of its beam that weren't expanded yet are
joined with the graph; new vertices are scored exactly, in double precision on the original vectors,
and the beam keeps the best. Rounds go on until every vertex of each beam was expanded, ``rounds`` at
most. Queries that then still have fewer than k neighbours, or one among their k that wasn't expanded,
are answered by a scan of all rows, in blocks of queries of bounded size.

Every row is indexed. Recall is measured against brute force in tests and in the README.

Cases: null, empty or zero vectors, and those with null or non-finite components, take no part;
vectors whose length isn't the most common one take no part either; equal vectors are neighbours;
ties go to the smaller id; fewer candidates than k give all of them; a repeated vec_id counts once
(its first vector in array order), a null one not at all; an empty table gives no row; extra columns
are ignored; very long vectors are rows like others, in blocks of fewer queries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import batch_of, materialize, shuffle_partitions

CELL = 1024
#: Vertices every search may start from, and bytes of vectors that are broadcast at a time.
ENTRIES, BROADCAST_BYTES = 1024, 4 << 20
EDGE_DDL = "u long, v long, s float, far boolean"
EDGES = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("s", pa.float32()), ("far", pa.bool_())])


def valid_vectors(vectors: DataFrame) -> DataFrame:
    """(id, x): usable vectors as doubles, one per id."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("x")).where("id is not null and x is not null and size(x) > 0")
    bad = F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = rows.where(~bad).where(F.exists("x", lambda c: c != 0)).groupBy("id").agg(F.min("x").alias("x"))
    sizes = rows.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), "n").limit(1)  # one row
    return rows.join(F.broadcast(sizes.select("n")), F.size("x") == F.col("n")).select("id", "x")


def _matrix(column, kind) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(lists)
    return lists.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(n, -1) if n else np.zeros((0, 1), kind)


def _packed(column) -> np.ndarray:
    return np.stack([np.frombuffer(x, np.int8) for x in column.to_pylist()]).astype(np.float32) if len(column) else np.zeros((0, 1), np.float32)


def pack_vectors(rows: DataFrame, tables: int, bits: int, seed: int = 1) -> DataFrame:
    """(id, q, norm, cells): the unit vector in 8-bit integers, the norm, and its cell in every table."""
    schema = pa.schema([("id", pa.int64()), ("q", pa.binary()), ("norm", pa.float32()), ("cells", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = None
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column("x"), np.float64)
            top = np.abs(x).max(axis=1, keepdims=True)  # first to this, so that no square overflows
            length = np.linalg.norm(x / top, axis=1, keepdims=True)
            x = x / top / length
            if planes is None:
                planes = np.random.default_rng(seed).standard_normal((x.shape[1], tables * max(1, bits)))
            side = (x @ planes > 0).reshape(len(x), tables, -1)
            code = (side[:, :, :bits] << np.arange(bits)).sum(axis=2) if bits else np.zeros((len(x), tables), np.int64)
            code = code * tables + np.arange(tables)
            # a common scale: components of unit vectors are about 1 / sqrt(d)
            q = np.clip(np.rint(x * (127 * np.sqrt(x.shape[1]) / 4.5)), -127, 127).astype(np.int8)
            norm = np.minimum((top * length).ravel(), np.finfo(np.float32).max).astype(np.float32)
            cells = pa.ListArray.from_arrays(pa.array(np.arange(0, code.size + 1, tables), pa.int32()), pa.array(code.ravel().astype(np.int64)))
            yield batch_of(schema, b.column("id"), [r.tobytes() for r in q], norm, cells)

    return rows.mapInArrow(run, "id long, q binary, norm float, cells array<long>")


def best_edges(edges: DataFrame, degree: int) -> DataFrame:
    """The best ``degree`` distinct neighbours of each vertex, with their rank from 1. Ties go by a
    hash, so that of many vertices as near none is left out by all others."""
    place = F.row_number().over(W.partitionBy("u").orderBy(F.desc("s"), F.xxhash64("u", "v"), "v"))
    distinct = edges.where("u <> v").groupBy("u", "v").agg(F.max("s").alias("s"))
    return distinct.withColumn("r", place).where(F.col("r") <= degree)


def _propose(ids: np.ndarray, s: np.ndarray, worst: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each member of a block, its best ``most`` others that beat its worst neighbour."""
    n = len(ids)
    if n > most:
        top = np.argpartition(-s, most, axis=1)[:, :most]
        s = np.take_along_axis(s, top, axis=1)
        v = ids[top]
    else:
        v = np.broadcast_to(ids, (n, n))
    good = s > worst[:, None]
    row = np.nonzero(good)[0]
    return ids[row], v[good], s[good]


def _blocks(most: int, far: int = 0):
    """Score the blocks of rows (ids, qs, worst) given as lists; ``far``: also so many edges to the
    others of largest inner product, of rows (ids, qs, worst, norm)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                own = b.column("members")[i].values
                ids, at = np.unique(own.field(0).to_numpy(), return_index=True)
                if len(ids) < 2:
                    continue
                q = _packed(own.field(1))[at]
                s = q @ q.T  # whole numbers; what is added settles ties, differently for each pair
                s += np.random.default_rng(ids[:2].view(np.uint64)).random(s.shape, np.float32) / 2
                np.fill_diagonal(s, -np.inf)
                u, v, score = _propose(ids, s, own.field(2).to_numpy(zero_copy_only=False)[at], most)
                yield batch_of(EDGES, u, v, score, np.zeros(len(u), bool))
                if far:
                    norm = own.field(3).to_numpy(zero_copy_only=False)[at].astype(np.float64)
                    u, v, score = _propose(ids, s * (norm / norm.max())[None, :], np.full(len(ids), -np.inf), far)
                    yield batch_of(EDGES, u, v, score.astype(np.float32), np.ones(len(u), bool))

    return run


def build_graph(rows: DataFrame, degree: int = 32, tables: int = 12, iterations: int = 3, width: int = 20, most: int = 8, far: int = 8) -> tuple[DataFrame, DataFrame]:
    """(u, v, s, r), the nearest neighbours of every vertex, s in units of the packed vectors, and
    (u, v), the far edges."""
    spark = rows.sparkSession
    n = rows.count()
    if not n:
        empty = spark.createDataFrame([], "u long, v long, s float, r int")
        return empty, empty.select("u", "v")
    bits = max(0, int(np.ceil(np.log2(max(1, n / CELL)))))
    packed = materialize(pack_vectors(rows, tables, bits), "packed")
    parts = shuffle_partitions(spark)

    placed = packed.select("id", "q", "norm", F.explode("cells").alias("cell"))
    sizes = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("size"))
    member = F.struct("id", "q", F.lit(float("-inf")).cast("float").alias("worst"), "norm")
    blocks = placed.join(sizes, "cell").withColumn("salt", F.pmod(F.xxhash64("id", "cell"), F.ceil(F.col("size") / (2 * CELL)))).groupBy("cell", "salt").agg(F.collect_list(member).alias("members"))  # about 2 * CELL rows, by the salt
    first = materialize(blocks.mapInArrow(_blocks(12, 3), EDGE_DDL), "edges")
    graph = materialize(best_edges(first.where("not far"), degree), "graph")
    large = best_edges(first.where("far"), far).select("u", "v")
    drawn = [packed.select("id", F.pmod(F.xxhash64("id", F.lit(k)), F.lit(max(1, n // 4))).alias("draw"), F.lit(k).alias("k")) for k in (1, 2)]  # about four in each
    drawn = drawn[0].unionByName(drawn[1]).groupBy("draw", "k").agg(F.collect_list("id").alias("ids")).select("ids", F.explode("ids").alias("u"))
    drawn = drawn.select("u", F.explode("ids").alias("v")).where("u <> v")
    away = materialize(large.unionByName(drawn).distinct(), "far")

    for _ in range(iterations):
        # each vertex with its packed form and the similarity a new neighbour has to beat
        worst = graph.groupBy("u").agg(F.min("s").alias("w"), F.count(F.lit(1)).alias("n"))
        vertex = packed.join(worst, packed["id"] == worst["u"], "left").select("id", "q", F.when(F.col("n") >= degree, F.col("w")).otherwise(F.lit(float("-inf"))).cast("float").alias("worst"))
        near = graph.where(F.col("r") <= width)
        around = near.select(F.col("u").alias("mid"), F.col("v").alias("id")).unionByName(near.select(F.col("v").alias("mid"), F.col("u").alias("id"))).distinct()
        counts = around.groupBy("mid").agg(F.count(F.lit(1)).alias("size"))
        around = around.join(counts, "mid").withColumn("salt", F.pmod(F.xxhash64("id", "mid"), F.ceil(F.col("size") / 96)))
        placed = around.join(vertex, "id").repartition(parts, "mid", "salt")  # the one shuffle of the packed vectors
        blocks = placed.groupBy("mid", "salt").agg(F.collect_list(F.struct("id", "q", "worst")).alias("members"))  # about 96 rows, by the salt
        found = blocks.mapInArrow(_blocks(most), EDGE_DDL).select("u", "v", "s")
        graph = materialize(best_edges(found.unionByName(graph.select("u", "v", "s")), degree), "graph")
    return graph, away


def _score(pairs: DataFrame, rows: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, vec_id, score) for pairs (query_id, vec_id)."""
    both = pairs.join(rows.select(F.col("id").alias("vec_id"), F.col("x").alias("xv")), "vec_id").join(queries.select(F.col("id").alias("query_id"), F.col("x").alias("xq")), "query_id").select("query_id", "vec_id", "xq", "xv")
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 4096):
                part = b.slice(a, 4096)
                yield batch_of(schema, part.column("query_id"), part.column("vec_id"), (_matrix(part.column("xq"), np.float64) * _matrix(part.column("xv"), np.float64)).sum(axis=1))

    return both.mapInArrow(run, "query_id long, vec_id long, score double")


def _best_of(held: DataFrame, few: list, keep: int, few_ask: bool) -> DataFrame:
    """(query_id, vec_id, s): the ``keep`` best of each batch of the rows ``held`` (id, x) for each of
    the ``few`` rows, or of the few for each row held. The few are broadcast: the caller bounds their
    bytes."""
    shared = held.sparkSession.sparkContext.broadcast((np.array([r[0] for r in few], np.int64), np.array([r[1] for r in few], np.float64)))
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("s", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            asked, given = (ids, x), (b.column("id").to_numpy(), _matrix(b.column("x"), np.float64))
            if not few_ask:
                asked, given = given, asked
            s = asked[1] @ given[1].T
            s[asked[0][:, None] == given[0][None, :]] = -np.inf
            n = len(given[0])
            top = np.argpartition(-s, keep, axis=1)[:, :keep] if n > keep else np.broadcast_to(np.arange(n), s.shape)
            score = np.take_along_axis(s, top, axis=1)
            row, at = np.nonzero(score > -np.inf)
            yield batch_of(schema, asked[0][row], given[0][top[row, at]], score[row, at])

    return held.mapInArrow(run, "query_id long, vec_id long, s double")


def scan_rows(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id): for each query (id, x), all rows that may be among its k best, by a scan
    for each block of queries."""
    ranked = W.partitionBy("query_id").orderBy(F.desc("s"), "vec_id")
    size = max(1, BROADCAST_BYTES // (8 * int(queries.select(F.size("x")).head()[0])))
    blocks = -(-queries.count() // size)
    out = None
    for block in range(blocks):
        own = queries.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block).collect()  # about ``size`` rows
        for a in range(0, len(own), size):
            found = _best_of(rows, own[a : a + size], 2 * k, True).withColumn("r", F.row_number().over(ranked)).where(F.col("r") <= 2 * k).select("query_id", "vec_id")
            found = materialize(found, "scan")
            out = found if out is None else out.unionByName(found)
    return out


def all_links(graph: tuple[DataFrame, DataFrame], back: int = 6) -> DataFrame:
    """(u, v): neighbours and far edges, and back from each vertex's ``back`` nearest neighbours, so
    that every vertex can be reached."""
    near, far = graph
    return near.select("u", "v").unionByName(near.where(F.col("r") <= back).select(F.col("v").alias("u"), F.col("u").alias("v"))).unionByName(far).distinct()


def search(rows: DataFrame, graph: tuple[DataFrame, DataFrame], queries: DataFrame, k: int = 20, beam: int = 60, rounds: int = 8, expand: int = 30) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query (id, x), a vertex of the graph."""
    ranked = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    links = materialize(all_links(graph), "links")
    first = queries.select(F.size("x")).head()
    if first is None:
        return queries.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # starts: own neighbours, the vertices that have the query as neighbour, and the best entries
    starts = links.join(queries.select(F.col("id").alias("u")), "u").select(F.col("u").alias("query_id"), F.col("v").alias("vec_id"))
    back = links.join(queries.select(F.col("id").alias("v")), "v").select(F.col("v").alias("query_id"), F.col("u").alias("vec_id"))
    entries = max(1, min(ENTRIES, BROADCAST_BYTES // (8 * int(first[0])))) // 2 + 1
    norm = F.aggregate("x", F.lit(0.0), lambda a, c: a + c * c)
    chosen = rows.orderBy(F.desc(norm), "id").limit(entries).collect() + rows.orderBy(F.xxhash64("id"), "id").limit(entries).collect()
    chosen = [*{r.id: r for r in chosen}.values()]
    entered = _best_of(queries.select("id", "x"), chosen, beam, False).select("query_id", "vec_id")
    def marked(held: DataFrame) -> DataFrame:
        """With the rank in the beam, and whether the next round expands the vertex: one sort."""
        live = ~F.col("done") & (F.col("r") <= beam)
        place = F.sum(live.cast("int")).over(ranked.rowsBetween(W.unboundedPreceding, W.currentRow))
        return materialize(held.withColumn("r", F.row_number().over(ranked)).withColumn("pick", live & (place <= expand)), "beam")

    asked = queries.select("id", "x")
    seen = marked(_score(starts.unionByName(back).unionByName(entered).distinct(), rows, asked).withColumn("done", F.lit(False)))
    for _ in range(rounds):
        chosen = seen.where("pick").select("query_id", "vec_id")
        if chosen.isEmpty():
            break
        reached = chosen.join(links, chosen["vec_id"] == links["u"]).select("query_id", F.col("v").alias("vec_id")).where("query_id <> vec_id").distinct()
        new = _score(reached.join(seen.select("query_id", "vec_id"), ["query_id", "vec_id"], "left_anti"), rows, asked).withColumn("done", F.lit(False))
        seen = marked(seen.select("query_id", "vec_id", "score", (F.col("done") | F.col("pick")).alias("done")).unionByName(new))
    # what is still open among the first k, and queries with fewer than k
    many = seen.groupBy("query_id").agg(F.count(F.lit(1)).alias("many"))
    open_ = seen.where(F.col("pick") & (F.col("r") <= k)).select("query_id").distinct().withColumn("open", F.lit(True))
    state = queries.select("id", "x").join(many, F.col("id") == many["query_id"], "left").drop("query_id").join(open_, F.col("id") == open_["query_id"], "left")
    left = materialize(state.where(F.col("open") | (F.coalesce("many", F.lit(0)) < k)).select("id", "x"), "left")
    out = seen.select("query_id", "vec_id", "score")
    if not left.isEmpty():
        found = _score(scan_rows(rows, left, k).join(out, ["query_id", "vec_id"], "left_anti"), rows, asked)
        out = out.unionByName(found)
    return out.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def nearest(vectors: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """The k nearest others of every row whose vec_id is divisible by ``every``."""
    rows = materialize(valid_vectors(vectors), "vectors")
    return search(rows, build_graph(rows), rows.where(F.pmod("id", F.lit(every)) == 0), k)
