"""Sources: raw CSV parts, the day-partitioned lake, explicit paths, query files, samples."""

from __future__ import annotations

import json
from functools import reduce
from pathlib import Path

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import typed_events, time_columns
from ..spec import QuerySpec


def _header(spark: SparkSession, path: str) -> tuple[str, ...]:
    return tuple(spark.read.option("header", True).csv(path).columns)


def read_csv(spark: SparkSession, paths: str | list[str], strict: bool = False) -> DataFrame:
    """CSV parts as text columns, unioned by name. Parts of equal header are read as one scan, and a
    column a part lacks is null there. strict: a malformed row fails the read; else what can be read is
    kept."""
    spark_paths = _expand(spark, paths)
    by_header: dict[tuple[str, ...], list[str]] = {}
    for p in spark_paths:
        by_header.setdefault(_header(spark, p), []).append(p)
    frames = [
        spark.read.option("header", True).option("mode", "FAILFAST" if strict else "PERMISSIVE").schema(T.StructType([T.StructField(c, T.StringType()) for c in header])).csv(own)
        for header, own in by_header.items()
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def _expand(spark: SparkSession, paths: str | list[str]) -> list[str]:
    """File paths of globs, by whatever file system holds them."""
    out = []
    for p in [paths] if isinstance(paths, str) else paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
        out += [s.getPath().toString() for s in found or ()]
    if not out:
        raise FileNotFoundError(f"nothing matches {paths}")
    return sorted(out)


def read_raw_events(spark: SparkSession, paths: str | list[str], strict: bool = False) -> DataFrame:
    return typed_events(read_csv(spark, paths, strict))


def read_lake(spark: SparkSession, lake: str) -> DataFrame:
    """The lake; filters on day prune folders by themselves."""
    return spark.read.parquet(f"{lake}/events")


def read_paths(spark: SparkSession, lake: str, paths: list[str]) -> DataFrame:
    """Chosen folders or files of the lake, with the partition column kept."""
    return spark.read.option("basePath", f"{lake}/events").parquet(*paths)


def read_file(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet file as a relation of its own."""
    return spark.sql(f"SELECT * FROM parquet.`{path}`")


def load(df: DataFrame) -> DataFrame:
    """Held in memory (and on disk, where memory is short) for repeated queries."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def read_dimension(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("inferSchema", True).csv(path)


def query_files(folder: str) -> dict[str, QuerySpec]:
    """Query documents of a folder, by file name in order; a list file gives its named entries."""
    out: dict[str, QuerySpec] = {}
    for p in sorted(Path(folder).glob("*.json")):
        raw = json.loads(p.read_bytes())
        if isinstance(raw, list):
            out |= {r.get("name", f"{p.stem}_{i}"): QuerySpec.parse(r.get("query", r)) for i, r in enumerate(raw)}
        else:
            out[p.stem] = QuerySpec.parse(raw)
    return out


def day_manifest(df: DataFrame) -> dict[str, list[str]]:
    """{day: files} of a lake frame. Spark prunes by itself; this is for other tools."""
    rows = df.select(F.col("day").cast("string").alias("day"), F.col("_metadata.file_path").alias("f")).distinct().collect()  # a row a file
    out: dict[str, list[str]] = {}
    for r in sorted(rows):
        out.setdefault(r.day, []).append(r.f)
    return out


def manifest_files(manifest: dict[str, list[str]], spec: QuerySpec) -> list[str]:
    """Files of the days that the query's tests on day leave."""
    days = set(manifest)
    for p in spec.where:
        if p.col == "day":
            test = {"eq": lambda d, v=p.val: d == v, "between": lambda d, v=p.val: v[0] <= d <= v[1], "in": lambda d, v=p.val: d in v, "gte": lambda d, v=p.val: d >= v, "lte": lambda d, v=p.val: d <= v, "gt": lambda d, v=p.val: d > v, "lt": lambda d, v=p.val: d < v}.get(p.op)
            if test:
                days = {d for d in days if test(d)}
    return [f for d in sorted(days) for f in manifest[d]]


def synthetic_events(spark: SparkSession, n: int, seed: int = 42, partitions: int | None = None) -> DataFrame:
    """n generated events over 2024; equal for equal arguments."""
    pick = lambda options, k: F.element_at(F.array(*map(F.lit, options)), (F.pmod(F.xxhash64("id", F.lit(seed + k)), F.lit(len(options))) + 1).cast("int"))
    number = lambda most, k: F.pmod(F.xxhash64("id", F.lit(seed + k)), F.lit(most))
    rows = spark.range(0, n, 1, partitions) if partitions else spark.range(n)
    rows = rows.select("id", F.timestamp_seconds(F.lit(1704067200) + number(366 * 86400, 0)).alias("ts"), pick(("impression", "click", "serve", "purchase"), 1).alias("type"))
    money = lambda kind, k: F.when(F.col("type") == kind, (number(100000, k) / 100).cast("double"))
    return rows.select(
        "ts", *(c.alias(k) for k, c in time_columns(F.col("ts")).items()), "type", F.concat(F.lit("a"), F.lpad(F.col("id").cast("string"), 12, "0")).alias("auction_id"),
        number(1000, 2).cast("int").alias("advertiser_id"), number(500, 3).cast("int").alias("publisher_id"), money("impression", 4).alias("bid_price"),
        number(100000, 5).alias("user_id"), money("purchase", 6).alias("total_price"), pick(("US", "JP", "DE", "FR", "GB", "CA", "IN", "BR", "AU", "MX"), 7).alias("country"),
    )


def settings(spark: SparkSession) -> dict[str, str]:
    return {"timezone": spark.conf.get("spark.sql.session.timeZone"), "shuffle_partitions": spark.conf.get("spark.sql.shuffle.partitions")}
