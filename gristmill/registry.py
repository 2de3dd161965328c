"""Registered queries over the test tables, each with the DuckDB SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .oracle import EVENTS, query_sql, view_sql
from .operators.batch import run_batch
from .operators.compare import full_compare, left_compare, mismatches, restrict_to_keys
from .operators.execute import run_base, run_sampled
from .plans.catalog import REBUILT, MVDef, full_catalog, wide_view
from .plans.router import route, run_view
from .quality import guardrails, integrity, repair
from .schema import COLUMNS, MONEY_TYPE, adapt_events
from .sources.readers import synthetic_events
from .spec import QuerySpec
from .round_trips import ROUND_TRIPS
from .streaming.refresh import combine
from .suite import ALL

Query = Callable[[SparkSession, str], DataFrame]
SPECS = {name: QuerySpec.parse(doc, COLUMNS) for name, doc in ALL.items()}
CATALOG = full_catalog()


def _plain(df: DataFrame) -> DataFrame:
    """Decimals as doubles and zoned times as plain ones, to compare with DuckDB's."""
    return df.select(*(F.col(f"`{c}`").cast("double" if t.startswith("decimal") else "timestamp_ntz" if t == "timestamp" else t).alias(c) for c, t in df.dtypes))


def _base(spec: QuerySpec, spark: SparkSession, d: str) -> DataFrame:
    return run_base(adapt_events(spark, d), spec)


def _routed(spec: QuerySpec, spark: SparkSession, d: str) -> DataFrame:
    """Through the best view, computed on the way."""
    plan = route(spec, CATALOG).plan
    return run_view(plan.mv.frame(adapt_events(spark, d)), spec, plan)


def _view(mv: MVDef, spark: SparkSession, d: str) -> DataFrame:
    return _plain(mv.frame(adapt_events(spark, d)))


def _spec(doc: dict) -> QuerySpec:
    return QuerySpec.parse(doc, COLUMNS)


#: One query for each operator of the contract that says no more than that operator.
_FILTERS = {
    "eq": {"col": "country", "op": "eq", "val": "JP"},
    "neq": {"col": "type", "op": "neq", "val": "error"},
    "lt": {"col": "total_price", "op": "lt", "val": 20},
    "lte": {"col": "advertiser_id", "op": "lte", "val": 10},
    "gt": {"col": "bid_price", "op": "gt", "val": 50.5},
    "gte": {"col": "week", "op": "gte", "val": "2024-01-15"},
    "between": {"col": "day", "op": "between", "val": ["2024-01-05", "2024-01-09"]},
    "in": {"col": "publisher_id", "op": "in", "val": [1, 3, 5]},
    "is_null": {"col": "bid_price", "op": "is_null"},
    "is_not_null": {"col": "total_price", "op": "is_not_null"},
}
_WHOLE = [("eq", 4.5), ("neq", 4.5), ("lt", 4.5), ("lte", 4.5), ("gt", 4.5), ("gte", 4.5), ("between", [2.5, 6.5]), ("in", [1, 2.5, 3])]
_AGGREGATES = {
    "sum": {"SUM": "bid_price", "as": "v"}, "count_star": {"COUNT": "*", "as": "v"}, "count_col": {"COUNT": "total_price", "as": "v"},
    "count_distinct": {"COUNT": "DISTINCT user_id", "as": "v"}, "avg": {"AVG": "total_price", "as": "v"}, "min": {"MIN": "bid_price", "as": "v"}, "max": {"MAX": "ts", "as": "v"},
}
CONTRACT = {
    **{f"op_filter_{k}": _spec({"select": ["auction_id", p["col"]], "where": [p]}) for k, p in _FILTERS.items()},
    **{f"op_agg_{k}": _spec({"select": ["country", m], "group_by": ["country"]}) for k, m in _AGGREGATES.items()},
    **{f"op_fraction_{op}": _spec({"select": ["auction_id", "publisher_id"], "where": [{"col": "publisher_id", "op": op, "val": v}]}) for op, v in _WHOLE},
    "op_filter_any": _spec({"select": ["auction_id", "type"], "where": [{"any": [{"col": "country", "op": "eq", "val": "JP"}, {"all": [{"col": "total_price", "op": "gt", "val": 50}, {"col": "publisher_id", "op": "in", "val": [1, 2]}]}]}]}),
    "op_filter_not": _spec({"select": ["auction_id", "country"], "where": [{"not": {"any": [{"col": "country", "op": "in", "val": ["US", "DE"]}, {"col": "total_price", "op": "lt", "val": 90}]}}]}),
    "op_having": _spec({"select": ["day", "country", {"COUNT": "*", "as": "n"}, {"SUM": "bid_price"}], "group_by": ["day", "country"], "having": [{"col": "n", "op": "gte", "val": 40}, {"not": {"col": "sum(bid_price)", "op": "lt", "val": 300}}]}),
    "op_having_limit": _spec({"select": ["publisher_id", {"AVG": "total_price", "as": "mean"}], "group_by": ["publisher_id"], "having": [{"any": [{"col": "mean", "op": "gt", "val": 50}, {"col": "publisher_id", "op": "eq", "val": 3}]}], "order_by": [{"col": "mean", "dir": "desc"}], "limit": 4}),
    "op_agg_global": _spec({"select": [{"COUNT": "*", "as": "n"}, {"SUM": "bid_price", "as": "spend"}, {"AVG": "bid_price"}]}),
    "op_projection": _spec({"select": ["auction_id", "type", "hour", "minute"]}),
    "op_select_all": _spec({"select": ["*"], "where": [{"col": "day", "op": "eq", "val": "2024-01-03"}]}),
    "op_distinct_groups": _spec({"select": ["country", "type"], "group_by": ["country", "type"]}),
    "op_order_limit": _spec({"select": ["auction_id", "bid_price"], "order_by": [{"col": "bid_price", "dir": "desc"}], "limit": 25}),
    "op_topk": _spec({"select": ["publisher_id", {"SUM": "total_price"}], "group_by": ["publisher_id"], "order_by": [{"col": "sum(total_price)", "dir": "desc"}], "limit": 3}),
}


# comparisons, samples, batches and checks

_DAY_COUNTRY = wide_view("day", "country")
_DAILY = _spec({"select": ["day", {"COUNT": "*", "as": "events"}, {"SUM": "bid_price", "as": "spend"}], "group_by": ["day"]})
_IMPRESSIONS = _spec({"select": ["day", {"COUNT": "*", "as": "events"}, {"SUM": "bid_price", "as": "spend"}], "where": [{"col": "type", "op": "eq", "val": "impression"}, {"col": "day", "op": "gte", "val": "2024-01-10"}], "group_by": ["day"]})


def full_outer_compare(spark: SparkSession, d: str) -> DataFrame:
    e = adapt_events(spark, d)
    return full_compare(run_base(e, _DAILY), run_base(e, _IMPRESSIONS), ["day"], ["events", "spend"])


def left_join_compare(spark: SparkSession, d: str) -> DataFrame:
    e = adapt_events(spark, d)
    return left_compare(run_base(e, _DAILY), run_base(e, _IMPRESSIONS), ["day"], "spend")


def semi_join_keys(spark: SparkSession, d: str) -> DataFrame:
    e = adapt_events(spark, d)
    return restrict_to_keys(e.select("auction_id", "publisher_id", "country"), e.where("total_price > 95").select("publisher_id", "country"), ["publisher_id", "country"])


def view_mismatches(spark: SparkSession, d: str) -> DataFrame:
    """Base rows against a view folded to its groups, whose spend in one country is off by one: just
    that country's groups differ."""
    e = adapt_events(spark, d)
    spec, plan = SPECS["s1_revenue_by_country_day"], route(SPECS["s1_revenue_by_country_day"], CATALOG).plan
    left, right = (f.withColumnRenamed("SUM(bid_price)", "spend") for f in (run_base(e, spec), run_view(plan.mv.frame(e), spec, plan)))
    right = right.withColumn("spend", F.col("spend") + F.when(F.col("country") == "JP", 1.0).otherwise(0.0))
    return mismatches(left, right, ["country", "day"], ["spend"]).select("country", "day")


def superset_batch(spark: SparkSession, d: str) -> DataFrame:
    """Two queries from one aggregation, joined again to show both."""
    shared = {"where": [{"col": "type", "op": "eq", "val": "impression"}], "group_by": ["country"]}
    specs = {"spend": _spec({"select": ["country", {"SUM": "bid_price", "as": "spend"}], **shared}), "most": _spec({"select": ["country", {"MAX": "bid_price", "as": "most"}, {"COUNT": "*", "as": "n"}], **shared})}
    out, _ = run_batch(adapt_events(spark, d), specs, run_base)
    return out["spend"].join(out["most"], "country")


def composite_distinct(spark: SparkSession, d: str) -> DataFrame:
    return adapt_events(spark, d).groupBy("type").agg(F.countDistinct("advertiser_id", "country").alias("pairs"))


def filtered_aggregates(spark: SparkSession, d: str) -> DataFrame:
    e = adapt_events(spark, d)
    impression, money = F.col("type") == "impression", F.col("bid_price").cast(MONEY_TYPE)
    return e.groupBy("day").agg(F.sum(F.when(impression, money)).cast("double").alias("filtered"), F.sum(F.when(impression, money).otherwise(0)).cast("double").alias("conditional"), F.count_if(impression).alias("impressions"))


def quarantine_counts(spark: SparkSession, d: str) -> DataFrame:
    """Rows with and without a null key; purchases over 90 stand in as rows without publisher."""
    e = adapt_events(spark, d).withColumn("publisher_id", F.when(F.coalesce(F.col("total_price") <= 90, F.lit(True)), F.col("publisher_id")))
    keep, bad = repair.quarantine(e)
    return keep.groupBy("type").agg(F.count(F.lit(1)).alias("n")).withColumn("part", F.lit("keep")).unionByName(bad.groupBy("type").agg(F.count(F.lit(1)).alias("n")).withColumn("part", F.lit("quarantine")))


def constraint_counts(spark: SparkSession, d: str) -> DataFrame:
    return repair.count_violations(adapt_events(spark, d).withColumn("total_price", F.col("total_price") - 10))


def constraint_rows(spark: SparkSession, d: str) -> DataFrame:
    return repair.enforce(adapt_events(spark, d)).select("auction_id", "type")


def guardrail_values(spark: SparkSession, d: str) -> DataFrame:
    return guardrails.check_values(adapt_events(spark, d), "2024-01-05", "2024-01-09")


def integrity_checksums(spark: SparkSession, d: str) -> DataFrame:
    return integrity.checksums(_DAY_COUNTRY.frame(adapt_events(spark, d)), _DAY_COUNTRY)


def integrity_spot_check(spark: SparkSession, d: str) -> DataFrame:
    e = adapt_events(spark, d)
    return integrity.spot_check(e, _DAY_COUNTRY.frame(e), _DAY_COUNTRY).select("day", "country")


def top_compare(spark: SparkSession, d: str) -> DataFrame:
    """Base revenue by country against a view of purchases, with relative differences."""
    e = adapt_events(spark, d)
    left = run_base(e, _spec({"select": ["country", {"SUM": "total_price", "as": "v"}], "group_by": ["country"]}))
    right = run_base(e, _spec({"select": ["country", {"SUM": "total_price", "as": "v"}], "where": [{"col": "day", "op": "gte", "val": "2024-01-02"}], "group_by": ["country"]}))
    return integrity.compare_top(left, right, ["country"], "v")


def refreshed_view(spark: SparkSession, d: str) -> DataFrame:
    """A view from two batches of events, as a stream would leave them."""
    e, mv = adapt_events(spark, d), CATALOG["mv_day_country_type_adv"]
    early = F.col("day") < "2024-01-15"
    return _plain(combine(mv.frame(e.where(early)).unionByName(mv.frame(e.where(~early))), mv))


def sampled_counts(spark: SparkSession, d: str) -> DataFrame:
    return run_sampled(adapt_events(spark, d), _spec({"select": ["user_id", {"COUNT": "*", "as": "n"}], "group_by": ["user_id"]}), 10.0)


def generated_events(spark: SparkSession, d: str) -> DataFrame:
    return synthetic_events(spark, 10_000).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def lateral_joins(spark: SparkSession, d: str) -> DataFrame:
    """The joins of the comparisons on larger tables: revenue by nation and month."""
    read = lambda t: spark.read.parquet(f"{d}/{t}.parquet")
    lines = read("lineitem").select("l_orderkey", (F.col("l_extendedprice").cast("decimal(18,4)") * (F.lit(1).cast("decimal(18,4)") - F.col("l_discount").cast("decimal(18,4)"))).alias("v")).groupBy("l_orderkey").agg(F.sum("v").alias("v"))
    rows = read("orders").select("o_orderkey", "o_custkey", F.date_trunc("month", "o_orderdate").cast("date").alias("month")).join(lines, F.col("o_orderkey") == F.col("l_orderkey")).join(read("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(read("nation").select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("n_name", "month").agg(F.sum("v").cast("double").alias("revenue"), F.count(F.lit(1)).alias("orders"))


_OTHERS: dict[str, tuple[Query, str | None]] = {
    "op_full_outer_compare": (full_outer_compare, f"""WITH l AS ({query_sql(_DAILY)}), r AS ({query_sql(_IMPRESSIONS)})
SELECT coalesce(l."day", r."day") AS "day", l."day" IS NOT NULL AS in_left, r."day" IS NOT NULL AS in_right, l.events AS left_events, r.events AS right_events,
 CAST(abs(coalesce(l.events, 0) - coalesce(r.events, 0)) AS DOUBLE) AS diff_events, l.spend AS left_spend, r.spend AS right_spend, abs(coalesce(l.spend, 0) - coalesce(r.spend, 0)) AS diff_spend
FROM l FULL JOIN r ON l."day" = r."day\""""),
    "op_left_join_compare": (left_join_compare, f"""WITH l AS ({query_sql(_DAILY)}), r AS ({query_sql(_IMPRESSIONS)}) SELECT l."day", l.spend AS left_spend, r.spend AS right_spend FROM l LEFT JOIN r ON l."day" = r."day\""""),
    "op_semi_join_keys": (semi_join_keys, f"WITH e AS (SELECT * FROM {EVENTS}) SELECT auction_id, publisher_id, country FROM e WHERE (publisher_id, country) IN (SELECT publisher_id, country FROM e WHERE total_price > 95)"),
    "op_view_mismatches": (view_mismatches, f"""WITH q AS ({query_sql(SPECS["s1_revenue_by_country_day"])}) SELECT country, "day" FROM q WHERE country = 'JP' AND "SUM(bid_price)" IS NOT NULL"""),
    "superset_batch_projection": (superset_batch, f"SELECT country, CAST(sum(CAST(bid_price AS DECIMAL(18,6))) AS DOUBLE) AS spend, max(bid_price) AS most, count(*) AS n FROM {EVENTS} AS e WHERE type = 'impression' GROUP BY country"),
    "op_agg_composite_distinct": (composite_distinct, f"SELECT type, count(DISTINCT CAST(advertiser_id AS VARCHAR) || '-' || country) AS pairs FROM {EVENTS} AS e GROUP BY type"),
    "op_agg_filtered": (filtered_aggregates, f"""SELECT "day", CAST(sum(CAST(bid_price AS DECIMAL(18,6))) FILTER (WHERE type = 'impression') AS DOUBLE) AS filtered, CAST(sum(CASE WHEN type = 'impression' THEN CAST(bid_price AS DECIMAL(18,6)) ELSE 0 END) AS DOUBLE) AS conditional, count(*) FILTER (WHERE type = 'impression') AS impressions FROM {EVENTS} AS e GROUP BY "day\""""),
    "dq_quarantine_null_keys": (quarantine_counts, f"SELECT type, count(*) AS n, CASE WHEN total_price > 90 THEN 'quarantine' ELSE 'keep' END AS part FROM {EVENTS} AS e GROUP BY ALL"),
    "dq_constraints": (constraint_counts, f"""WITH e AS (SELECT * REPLACE (total_price - 10 AS total_price) FROM {EVENTS})
SELECT 'type' AS "constraint", count(*) AS "rows" FROM e WHERE type NOT IN ('impression', 'purchase', 'click', 'serve') UNION ALL
SELECT 'country', count(*) FROM e WHERE length(country) <> 2 UNION ALL SELECT 'total_price', count(*) FROM e WHERE total_price < 0 OR total_price > 10000"""),
    "dq_enforce": (constraint_rows, f"SELECT auction_id, type FROM {EVENTS} AS e WHERE type IN ('impression', 'purchase', 'click', 'serve') AND length(country) = 2 AND coalesce(total_price BETWEEN 0 AND 10000, true)"),
    "guardrail_values": (guardrail_values, f"""WITH e AS (SELECT * FROM {EVENTS}), t AS (SELECT count(*) AS n, count(total_price) AS priced, count(*) FILTER (WHERE "day" BETWEEN DATE '2024-01-05' AND DATE '2024-01-09') AS inside,
 count(*) FILTER (WHERE "day" IN (DATE '2024-01-05', DATE '2024-01-09')) AS ends, count(DISTINCT "day") AS days, count(*) FILTER (WHERE advertiser_id IS NULL) AS na FROM e)
SELECT 'tz_day' AS "check", true AS passed, 0 AS observed FROM t UNION ALL SELECT 'tz_hour', true, 0 FROM t UNION ALL SELECT 'between_equals_bounds', true, inside FROM t
UNION ALL SELECT 'between_includes_ends', true, ends FROM t UNION ALL SELECT 'avg_is_sum_by_count', true, priced FROM t UNION ALL SELECT 'avg_skips_nulls', true, n - priced FROM t
UNION ALL SELECT 'price_range', true, priced FROM t UNION ALL SELECT 'null_day', true, 0 FROM t UNION ALL SELECT 'null_type', true, 0 FROM t UNION ALL SELECT 'null_advertiser_id', na = 0, na FROM t
UNION ALL SELECT 'null_publisher_id', true, 0 FROM t UNION ALL SELECT 'day_format', true, 0 FROM t UNION ALL SELECT 'day_range', true, days FROM t UNION ALL SELECT 'day_coverage', true, days FROM t"""),
    "integrity_checksums": (integrity_checksums, f"WITH v AS ({view_sql(_DAY_COUNTRY)}) SELECT 'rows in all' AS measure, CAST(count(*) AS DOUBLE) AS total FROM v " + " ".join(f"UNION ALL SELECT '{m.name}', CAST(sum(CAST({m.name} AS DECIMAL(38,6))) AS DOUBLE) FROM v" for m in _DAY_COUNTRY.measures)),
    "integrity_spot_check": (integrity_spot_check, f'SELECT "day", country FROM {EVENTS} AS e WHERE false'),
    "integrity_top_compare": (top_compare, f"""WITH e AS (SELECT * FROM {EVENTS}), a AS (SELECT country, CAST(sum(CAST(total_price AS DECIMAL(18,6))) AS DOUBLE) AS v FROM e GROUP BY country), b AS (SELECT country, CAST(sum(CAST(total_price AS DECIMAL(18,6))) AS DOUBLE) AS v FROM e WHERE "day" >= DATE '2024-01-02' GROUP BY country),
 j AS (SELECT coalesce(a.country, b.country) AS country, a.v AS base_value, b.v AS view_value, coalesce(abs(coalesce(a.v, 0) - coalesce(b.v, 0)) / nullif(abs(coalesce(a.v, b.v)), 0), 0) AS off FROM a FULL JOIN b ON a.country = b.country)
SELECT *, CASE WHEN off > 0.05 THEN 'FAIL' WHEN off > 0.01 THEN 'WARN' ELSE 'OK' END AS status FROM j"""),
    "stream_refreshed_view": (refreshed_view, view_sql(CATALOG["mv_day_country_type_adv"])),
    "op_sample_fixed_seed": (sampled_counts, None),
    "source_synthetic": (generated_events, None),
    "join_nation_month": (lateral_joins, """SELECT n_name, CAST(date_trunc('month', o_orderdate) AS DATE) AS "month", CAST(sum(v) AS DOUBLE) AS revenue, count(*) AS orders FROM (SELECT l_orderkey, sum(CAST(l_extendedprice AS DECIMAL(18,4)) * (1 - CAST(l_discount AS DECIMAL(18,4)))) AS v FROM lineitem GROUP BY l_orderkey) AS l
JOIN orders ON o_orderkey = l_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL"""),
}

def _read_back(query: Query, spark: SparkSession, d: str) -> DataFrame:
    return _plain(query(spark, d))


_VIEWS = [*CATALOG.values(), *REBUILT]
_ROUTED = {k: s for k, s in SPECS.items() if route(s, CATALOG).plan}


def queries() -> dict[str, Query]:
    return {
        **{k: partial(_base, s) for k, s in SPECS.items()},
        **{f"mv_route_{k}": partial(_routed, s) for k, s in _ROUTED.items()},
        **{f"mv_build_{m.name}": partial(_view, m) for m in _VIEWS},
        **{k: partial(_base, s) for k, s in CONTRACT.items()},
        **{k: q for k, (q, _) in _OTHERS.items()},
        **{k: partial(_read_back, q) for k, (q, _) in ROUND_TRIPS.items()},
    }


def oracle_sql() -> dict[str, str]:
    return {
        **{k: query_sql(s) for k, s in SPECS.items()},
        **{f"mv_route_{k}": query_sql(s) for k, s in _ROUTED.items()},
        **{f"mv_build_{m.name}": view_sql(m) for m in _VIEWS},
        **{k: query_sql(s) for k, s in CONTRACT.items()},
        **{k: s for k, (_, s) in _OTHERS.items() if s},
        **{k: s for k, (_, s) in ROUND_TRIPS.items()},
    }
