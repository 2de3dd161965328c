"""Connected components by alternating large and small stars, as Spark joins and aggregates.

Each step gives every vertex's neighbours to its smallest neighbour; edges shrink to stars whose
centres are the smallest vertices. Nothing is gathered on the driver but a count and a checksum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(low, "u").where((F.col("v") > F.col("u")) & (F.col("v") != F.col("m"))).select(F.col("m").alias("a"), F.col("v").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(low, "u").where(F.col("v") != F.col("m")).select(F.col("m").alias("a"), F.col("v").alias("b"))
    return moved.unionByName(low.select(F.col("m").alias("a"), F.col("u").alias("b"))).distinct()


def _checksum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).head())


def connected_components(edges: DataFrame) -> DataFrame:
    """(vertex, component) of every vertex of an edge (a, b); the component is its smallest vertex."""
    edges = materialize(edges.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    before = _checksum(edges)
    while before[0]:
        edges = materialize(_small_star(_large_star(edges).distinct()), "edges")
        after = _checksum(edges)
        if after == before:
            break
        before = after
    stars = edges.groupBy("b").agg(F.min("a").alias("component")).select(F.col("b").alias("vertex"), "component")
    return stars.unionByName(edges.select(F.col("a").alias("vertex"), F.col("a").alias("component")).distinct())
