"""Incremental refresh: each micro-batch of events becomes partial rows of a view.

Partial rows are written to a folder of their batch number and a batch that is run again overwrites its
own, so every batch counts once. Reading adds the partials up; ``compact`` folds them into one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.catalog import MVDef

_AGAIN = {"SUM": F.sum, "COUNT": F.sum, "MIN": F.min, "MAX": F.max}


def combine(partials: DataFrame, mv: MVDef) -> DataFrame:
    if bad := [m.name for m in mv.measures if not m.additive]:
        raise ValueError(f"can't be refreshed in parts: {bad}")
    kinds = dict(partials.dtypes)
    return partials.groupBy(*mv.dims).agg(*(_AGAIN[m.func](m.name).cast(kinds[m.name]).alias(m.name) for m in mv.measures))


def stream_view(events: DataFrame, mv: MVDef, folder: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Start maintaining ``mv`` from a streaming frame of events."""

    def write(batch: DataFrame, number: int) -> None:
        mv.frame(batch).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read_view(spark, mv: MVDef, folder: str) -> DataFrame:
    return combine(spark.read.parquet(folder).drop("batch"), mv)


def windowed(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and spend per window and type; rows later than ``late`` are left out."""
    money = F.sum(F.col("bid_price").cast("decimal(18,6)")).cast("double")
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))  # watermarks need a zoned time
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "type").agg(F.count(F.lit(1)).alias("events"), money.alias("spend")).select(F.col("window.start").alias("start"), "type", "events", "spend")
