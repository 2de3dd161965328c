"""Checks that the event table means what queries take it to mean."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.compare import same_rows
from ..operators.execute import run_base
from ..plans.catalog import MVDef
from ..plans.router import route, run_view
from ..schema import EVENTS
from ..spec import QuerySpec

KEYS = ("day", "type", "advertiser_id", "publisher_id")
TOLERANCE = 1e-5


def check_values(events: DataFrame, low: str, high: str) -> DataFrame:
    """All checks that are a matter of rows, from one pass: (check, passed, observed)."""
    inside = F.col("day").between(F.lit(low).cast("date"), F.lit(high).cast("date"))
    by_hand = (F.col("day") >= F.lit(low).cast("date")) & (F.col("day") <= F.lit(high).cast("date"))
    price = F.col("total_price").cast("decimal(18,6)")
    one = events.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.to_date("ts") != F.col("day")).alias("tz_day"), F.count_if(F.date_trunc("hour", "ts") != F.col("hour")).alias("tz_hour"),
        F.count_if(inside).alias("between"), F.count_if(by_hand).alias("by_hand"),
        F.count_if(F.col("day").isin(F.lit(low).cast("date"), F.lit(high).cast("date"))).alias("ends"), F.count_if((F.col("day") > F.lit(low).cast("date")) & (F.col("day") < F.lit(high).cast("date"))).alias("strict"),
        F.sum(price).cast("double").alias("total"), F.count("total_price").alias("priced"), F.avg("total_price").alias("mean"),
        F.sum(F.coalesce(price, F.lit(0))).cast("double").alias("total0"),
        F.min("total_price").alias("least"), F.max("total_price").alias("most"),
        *(F.count_if(F.col(k).isNull()).alias(f"null_{k}") for k in KEYS),
        F.min("day").alias("first"), F.max("day").alias("last"), F.countDistinct("day").alias("days"),
        F.count_if(~F.col("day").cast("string").rlike(r"^\d{4}-\d{2}-\d{2}$")).alias("odd_days"),
    )
    mean = F.col("total") / F.nullif(F.col("priced"), F.lit(0))
    close = lambda a, b: F.coalesce(F.abs(a - b) <= TOLERANCE * F.greatest(F.abs(b), F.lit(1.0)), a.isNull() & b.isNull())
    span = F.datediff("last", "first") + 1
    checks = {
        "tz_day": (F.col("tz_day") == 0, F.col("tz_day")), "tz_hour": (F.col("tz_hour") == 0, F.col("tz_hour")),
        "between_equals_bounds": (F.col("between") == F.col("by_hand"), F.col("between")), "between_includes_ends": (F.col("between") == F.col("strict") + F.col("ends"), F.col("ends")),
        "avg_is_sum_by_count": (close(mean, F.col("mean")), F.col("priced")), "avg_skips_nulls": (close(F.col("total0") / F.nullif(F.col("priced"), F.lit(0)), F.col("mean")), F.col("n") - F.col("priced")),
        "price_range": (F.coalesce((F.col("least") >= 0) & (F.col("most") <= 10000), F.lit(True)), F.col("priced")),
        **{f"null_{k}": (F.col(f"null_{k}") == 0, F.col(f"null_{k}")) for k in KEYS},
        "day_format": (F.col("odd_days") == 0, F.col("odd_days")), "day_range": (F.coalesce(F.col("first").between(F.lit("2024-01-01").cast("date"), F.lit("2024-12-31").cast("date")) & (F.col("last") <= F.lit("2024-12-31").cast("date")), F.lit(True)), F.col("days")),
        "day_coverage": (F.coalesce(F.col("days") >= 0.8 * span, F.lit(True)), F.col("days")),
    }
    rows = F.array(*(F.struct(F.lit(k).alias("check"), ok.alias("passed"), seen.cast("bigint").alias("observed")) for k, (ok, seen) in checks.items()))
    return one.select(F.inline(rows))


def check_types(events: DataFrame) -> list[tuple[str, bool]]:
    """Each column's type against the event schema; zone-less timestamps count as timestamps."""
    plain = lambda t: T.TimestampType() if isinstance(t, T.TimestampNTZType) else t
    have = {f.name: plain(f.dataType) for f in events.schema}
    return [(f"type_{f.name}", have.get(f.name) == f.dataType) for f in EVENTS]


def check_settings(spark) -> list[tuple[str, bool]]:
    return [("timezone_utc", spark.conf.get("spark.sql.session.timeZone") in ("UTC", "Etc/UTC", "Z", "+00:00"))]


def check_views(events: DataFrame, catalog: dict[str, MVDef], views, specs: dict[str, QuerySpec]) -> list[tuple[str, bool]]:
    """Routed results against the base table's, for the queries that have a view."""
    out = []
    for name, spec in specs.items():
        plan = route(spec, catalog).plan
        if plan:
            out.append((f"view_{name}", same_rows(run_base(events, spec), run_view(views(plan.mv.name), spec, plan))))
    return out


def report(results: list[tuple[str, bool]]) -> dict:
    failed = [n for n, ok in results if not ok]
    return {"checks": len(results), "passed": len(results) - len(failed), "failed": failed, "advice": [f"look into {n}" for n in failed]}
