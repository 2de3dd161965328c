"""Queries that write the test events by a sink and read them back by a source, with the SQL of what
must come back. Files go to a folder of their own in the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .oracle import EVENTS, query_sql
from .plans.build import ViewStore
from .plans.catalog import full_catalog
from .plans.router import route, run_view
from .quality import repair
from .schema import COLUMNS, adapt_events
from .sources import readers, sinks
from .spec import QuerySpec
from .suite import ALL

_SHOWN = ("auction_id", "type", "day", "hour", "minute", "advertiser_id", "publisher_id", "user_id", "country", "bid_price", "total_price")
_SHOWN_SQL = ", ".join(f'"{c}"' for c in _SHOWN)
_DAYS = QuerySpec.parse({"select": ["auction_id"], "where": [{"col": "day", "op": "between", "val": ["2024-01-03", "2024-01-06"]}]})


def _folder(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='gristmill-')}"
    return f"{root.rstrip('/')}/gristmill-io-{uuid.uuid4().hex}"


def _raw(events: DataFrame) -> DataFrame:
    """As text parts hold them: times in epoch milliseconds."""
    return events.select(F.unix_millis(F.col("ts").cast("timestamp")).alias("ts"), *(c for c in COLUMNS if c not in ("ts", "week", "day", "hour", "minute")))


def csv_parts(spark: SparkSession, d: str) -> DataFrame:
    """Text parts of different columns, unioned by name."""
    raw, folder = _raw(adapt_events(spark, d)), _folder(spark)
    sinks.write_csv(raw.where("user_id % 2 = 0"), f"{folder}/a")
    sinks.write_csv(raw.where("user_id % 2 <> 0").drop("total_price"), f"{folder}/b")
    return readers.read_raw_events(spark, [f"{folder}/a/*.csv", f"{folder}/b/*.csv"]).select(*_SHOWN)


def csv_strict(spark: SparkSession, d: str) -> DataFrame:
    folder = _folder(spark)
    sinks.write_csv(_raw(adapt_events(spark, d)), folder)
    return readers.read_raw_events(spark, f"{folder}/*.csv", strict=True).select(*_SHOWN)


def lake(spark: SparkSession, d: str) -> DataFrame:
    """Day folders, read with a filter that prunes them."""
    folder = _folder(spark)
    sinks.write_lake(adapt_events(spark, d), folder)
    return readers.read_lake(spark, folder).where("day between date'2024-01-03' and date'2024-01-06'").select(*_SHOWN)


def lake_paths(spark: SparkSession, d: str) -> DataFrame:
    """The files that a manifest of days gives for a query."""
    folder = _folder(spark)
    sinks.write_lake(adapt_events(spark, d), folder)
    manifest = readers.day_manifest(readers.read_lake(spark, folder))
    return readers.read_paths(spark, folder, readers.manifest_files(manifest, _DAYS)).select(*_SHOWN)


def single_file(spark: SparkSession, d: str) -> DataFrame:
    folder = _folder(spark)
    sinks.write_single(adapt_events(spark, d).where("total_price is not null"), folder)
    return readers.read_file(spark, folder).select(*_SHOWN)


def type_and_day(spark: SparkSession, d: str) -> DataFrame:
    folder = _folder(spark)
    sinks.write_partitioned(adapt_events(spark, d), folder, ("type", "day"), ("country",))
    return spark.read.parquet(folder).where("type = 'impression'").select(*_SHOWN)


def dimension(spark: SparkSession, d: str) -> DataFrame:
    folder = _folder(spark)
    sinks.write_csv(spark.read.parquet(f"{d}/nation.parquet").select("n_nationkey", "n_name", "n_regionkey"), f"{folder}/csv")
    sinks.write_single(readers.read_dimension(spark, f"{folder}/csv"), f"{folder}/copy")
    return readers.read_file(spark, f"{folder}/copy")


def stored_view(spark: SparkSession, d: str) -> DataFrame:
    """A view built into a store, promoted, held in memory and read for a routed query."""
    spec = QuerySpec.parse(ALL["q4_advertiser_type_counts"], COLUMNS)
    catalog = full_catalog()
    mv = route(spec, catalog).plan.mv
    store = ViewStore(spark, _folder(spark))
    store.build_all([mv], adapt_events(spark, d), 1)
    decision = route(spec, catalog, store.ready, store.rows())
    return run_view(store.read(decision.target), spec, decision.plan)


def rejected_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows that quality checks turn down, through their file, with the reasons."""
    e = adapt_events(spark, d).withColumn("publisher_id", F.when(F.col("publisher_id") != 7, F.col("publisher_id"))).withColumn("total_price", F.col("total_price") - 10)
    folder = _folder(spark)
    sinks.write_csv(repair.rejected(e), folder)
    return readers.read_csv(spark, f"{folder}/*.csv").select("auction_id", "reasons")


def health_rows(spark: SparkSession, d: str) -> DataFrame:
    """A health table appended to twice."""
    folder = _folder(spark)
    for n in (1, 2):
        sinks.append(adapt_events(spark, d).groupBy("country").agg(F.count(F.lit(1)).alias("n")).withColumn("run", F.lit(n)), folder)
    return spark.read.parquet(folder)


_BETWEEN = "WHERE \"day\" BETWEEN DATE '2024-01-03' AND DATE '2024-01-06'"
ROUND_TRIPS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "io_csv_union_by_name": (csv_parts, f"SELECT {_SHOWN_SQL} FROM (SELECT * REPLACE (CASE WHEN user_id % 2 = 0 THEN total_price END AS total_price) FROM {EVENTS}) AS e"),
    "io_csv_strict": (csv_strict, f"SELECT {_SHOWN_SQL} FROM {EVENTS} AS e"),
    "io_lake": (lake, f"SELECT {_SHOWN_SQL} FROM {EVENTS} AS e {_BETWEEN}"),
    "io_lake_manifest_paths": (lake_paths, f"SELECT {_SHOWN_SQL} FROM {EVENTS} AS e {_BETWEEN}"),
    "io_single_file": (single_file, f"SELECT {_SHOWN_SQL} FROM {EVENTS} AS e WHERE total_price IS NOT NULL"),
    "io_type_and_day": (type_and_day, f"SELECT {_SHOWN_SQL} FROM {EVENTS} AS e WHERE type = 'impression'"),
    "io_dimension_copy": (dimension, "SELECT CAST(n_nationkey AS INTEGER) AS n_nationkey, n_name, CAST(n_regionkey AS INTEGER) AS n_regionkey FROM nation"),
    "io_stored_view": (stored_view, query_sql(QuerySpec.parse(ALL["q4_advertiser_type_counts"], COLUMNS))),
    "io_rejected_rows": (rejected_rows, f"""WITH e AS (SELECT * REPLACE (nullif(publisher_id, 7) AS publisher_id, total_price - 10 AS total_price) FROM {EVENTS}),
 r AS (SELECT auction_id, concat_ws(',', CASE WHEN advertiser_id IS NULL OR publisher_id IS NULL OR type IS NULL OR "day" IS NULL THEN 'null key' END,
 CASE WHEN type NOT IN ('impression', 'purchase', 'click', 'serve') THEN 'type' END, CASE WHEN length(country) <> 2 THEN 'country' END,
 CASE WHEN total_price < 0 OR total_price > 10000 THEN 'total_price' END) AS reasons FROM e) SELECT * FROM r WHERE reasons <> ''"""),
    "io_appended_runs": (health_rows, f"WITH e AS (SELECT * FROM {EVENTS}) SELECT country, count(*) AS n, 1 AS run FROM e GROUP BY country UNION ALL SELECT country, count(*), 2 FROM e GROUP BY country"),
}
