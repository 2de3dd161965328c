"""The ad-event table: its columns, the typed projection of raw text, and an adapter view that gives
the generic ``events`` test table the same shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENTS = T.StructType(
    [
        T.StructField("ts", T.TimestampType()),
        T.StructField("week", T.DateType()),
        T.StructField("day", T.DateType()),
        T.StructField("hour", T.TimestampType()),
        T.StructField("minute", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("auction_id", T.StringType()),
        T.StructField("advertiser_id", T.IntegerType()),
        T.StructField("publisher_id", T.IntegerType()),
        T.StructField("bid_price", T.DoubleType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("total_price", T.DoubleType()),
        T.StructField("country", T.StringType()),
    ]
)
COLUMNS = tuple(EVENTS.fieldNames())
#: Columns of money: summed exactly, as decimals of this type, so that no result depends on order.
MONEY = ("bid_price", "total_price")
MONEY_TYPE = "decimal(18,6)"
TYPES = ("impression", "purchase", "click", "serve")


def time_columns(ts: Column, zoned: bool = True) -> dict[str, Column]:
    kind = "timestamp" if zoned else "timestamp_ntz"
    return {
        "week": F.to_date(F.date_trunc("week", ts)),
        "day": F.to_date(ts),
        "hour": F.date_trunc("hour", ts).cast(kind),
        "minute": F.date_format(ts, "yyyy-MM-dd HH:mm"),
    }


def _integer(c: str, kind: str) -> Column:
    """Text to a whole number, null where it is no number; a fraction is rounded. Whole numbers don't
    go through doubles, which don't hold all of them."""
    text = f"nullif(trim({c}), '')"
    exact = F.expr(f"CASE WHEN {text} RLIKE '^[+-]?[0-9]+$' THEN try_cast({text} AS bigint) END").try_cast(kind)
    return F.coalesce(exact, F.round(F.expr(f"CASE WHEN NOT {text} RLIKE '^[+-]?[0-9]+$' THEN try_cast({text} AS double) END")).try_cast(kind))


def typed_events(raw: DataFrame) -> DataFrame:
    """Raw text columns to the event schema; rows without a readable time are dropped."""
    names = {c.lower().lstrip("_"): c for c in raw.columns}
    text = raw.select(*(F.col(f"`{names[c]}`").cast("string").alias(c) if c in names else F.lit(None).cast("string").alias(c) for c in ("ts", "type", "auction_id", "advertiser_id", "publisher_id", "bid_price", "user_id", "total_price", "country")))
    ts = F.timestamp_millis(F.expr("try_cast(try_cast(nullif(trim(ts), '') as double) as bigint)"))
    money = {c: F.expr(f"try_cast(nullif(trim({c}), '') as double)").alias(c) for c in MONEY}
    out = text.withColumn("ts", ts).where(F.col("ts").isNotNull())
    return out.select(
        "ts", *(c.alias(k) for k, c in time_columns(F.col("ts")).items()), "type", "auction_id",
        _integer("advertiser_id", "int").alias("advertiser_id"), _integer("publisher_id", "int").alias("publisher_id"), money["bid_price"],
        _integer("user_id", "bigint").alias("user_id"), money["total_price"], "country",
    )


#: Countries of the adapter view, by user_id modulo their number.
ADAPTER_COUNTRIES = ("US", "JP", "DE", "FR", "GB")


def adapt_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The generic test table in the event schema; a view with signup stands for serve."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    kind = F.col("event_type")
    return e.select(
        "ts", *(c.alias(k) for k, c in time_columns(F.col("ts"), zoned=False).items()),
        F.when(kind == "view", "impression").when(kind == "signup", "serve").otherwise(kind).alias("type"),
        F.col("event_id").cast("string").alias("auction_id"), F.get_json_object("props", "$.k").cast("int").alias("advertiser_id"),
        (F.col("user_id") % 10).cast("int").alias("publisher_id"), F.when(kind == "view", F.col("value")).alias("bid_price"), "user_id",
        F.when(kind == "purchase", F.col("value")).alias("total_price"),
        F.element_at(F.array(*map(F.lit, ADAPTER_COUNTRIES)), (F.col("user_id") % len(ADAPTER_COUNTRIES)).cast("int") + 1).alias("country"),
    )
