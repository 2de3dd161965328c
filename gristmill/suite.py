"""The query documents: examples, stress, adversarial, a mixed suite and the cost model's suite, on
the dates and countries of the test tables."""

from __future__ import annotations

IMPRESSION, PURCHASE, CLICK = ({"col": "type", "op": "eq", "val": v} for v in ("impression", "purchase", "click"))
NOT_SERVE = {"col": "type", "op": "neq", "val": "serve"}
COUNT = {"COUNT": "*"}


def _is(col, val):
    return {"col": col, "op": "eq", "val": val}


def _in(col, *vals):
    return {"col": col, "op": "in", "val": list(vals)}


def _between(col, a, b):
    return {"col": col, "op": "between", "val": [a, b]}


def _q(groups, measures, where=(), order=(), limit=None):
    doc = {"from": "events", "select": [*groups, *measures], "where": list(where), "group_by": list(groups)}
    if order:
        doc["order_by"] = [{"col": c, "dir": d} for c, d in order]
    return doc | ({"limit": limit} if limit else {})


def _a(func, col, alias):
    return {func: col, "as": alias}


BID, TOTAL = {"SUM": "bid_price"}, {"SUM": "total_price"}
JANUARY = ("2024-01-01", "2024-01-31")

EXAMPLES = {
    "q1_daily_impr_revenue": _q(["day"], [BID], [IMPRESSION]),
    "q2_publisher_by_country": _q(["publisher_id"], [BID], [IMPRESSION, _is("country", "US"), _between("day", *JANUARY)]),
    "q3_avg_purchase_by_country": _q(["country"], [{"AVG": "total_price"}], [PURCHASE]),
    "q4_advertiser_type_counts": _q(["advertiser_id", "type"], [COUNT]),
    "q5_minute_breakdown": _q(["minute"], [BID], [IMPRESSION, _is("day", "2024-01-15")]),
}
STRESS = {
    "s1_revenue_by_country_day": _q(["country", "day"], [BID], [IMPRESSION], [("day", "asc")]),
    "s2_ctr_per_advertiser": _q(["advertiser_id"], [COUNT], [_in("type", "click", "impression")], [("COUNT(*)", "desc")]),
    "s3_top_advertisers_us": _q(["advertiser_id"], [TOTAL], [PURCHASE, _is("country", "US"), _between("day", "2024-01-10", "2024-01-25")], [("SUM(total_price)", "desc")]),
    "s4_avg_bid_per_publisher_week": _q(["publisher_id", "week"], [{"AVG": "bid_price"}], [IMPRESSION], [("AVG(bid_price)", "desc")]),
    "s5_hourly_spend_japan": _q(["hour"], [BID], [IMPRESSION, _is("country", "JP"), _is("day", "2024-01-11")], [("hour", "asc")]),
    "s6_impressions_per_country": _q(["country"], [COUNT], [IMPRESSION], [("COUNT(*)", "desc")]),
    "s7_advertiser_publisher_matrix": _q(["advertiser_id", "publisher_id"], [COUNT], [CLICK, _between("day", *JANUARY)]),
    "s8_purchase_revenue_de_fr": _q(["day"], [TOTAL], [PURCHASE, _in("country", "DE", "FR")], [("day", "asc")]),
    "s9_high_traffic_days": _q(["day"], [COUNT], [IMPRESSION, _between("day", "2024-01-07", "2024-01-13")], [("COUNT(*)", "desc")]),
    "s10_avg_purchase_advertiser_country": _q(["advertiser_id", "country"], [{"AVG": "total_price"}], [PURCHASE]),
}
ADVERSARIAL = {
    "a1_empty_result_set": _q(["day"], [BID], [IMPRESSION, _between("day", "2026-01-01", "2026-01-07")]),
    "a2_large_in_list": _q(["country"], [COUNT], [IMPRESSION, _in("country", "US", "JP", "DE", "FR", "GB", "CA", "IN", "BR", "AU", "MX")]),
    "a3_order_by_aggregate": _q(["publisher_id"], [TOTAL], [IMPRESSION], [("SUM(total_price)", "desc")]),
    "a4_minute_grain_wide_day": _q(["minute"], [COUNT], [_is("day", "2024-01-15")], [("minute", "asc")]),
    "a5_mixed_filters": _q(["country", "day"], [TOTAL], [PURCHASE, _in("country", "US", "CA", "GB"), _between("day", "2024-01-23", "2024-01-30")], [("day", "asc")]),
    "a6_skewed_groups": {"from": "events", "select": ["advertiser_id", _a("COUNT", "*", "event_count"), TOTAL], "group_by": ["advertiser_id"], "order_by": [{"col": "event_count", "dir": "desc"}], "limit": 5},
    "a7_no_match": _q(["country"], [COUNT], [_is("country", "NONEXISTENT"), PURCHASE]),
    "a8_all_aggregates": _q(["country"], [_a("COUNT", "*", "total_events"), _a("SUM", "total_price", "total_revenue"), _a("AVG", "total_price", "avg_price"), _a("MIN", "total_price", "min_price"), _a("MAX", "total_price", "max_price")], [PURCHASE], [("total_revenue", "desc")], 10),
    "a9_null_handling": _q(["country"], [COUNT, {"AVG": "total_price"}], [{"col": "total_price", "op": "gt", "val": 0}, {"col": "advertiser_id", "op": "is_not_null"}], [("country", "asc")]),
    "a10_hour_of_day_edge": _q(["day", "hour"], [COUNT], [_is("day", "2024-01-20"), _between("hour", 23, 23)], [("hour", "asc")]),
}
SUITE = {
    "daily_impression_revenue": _q(["day"], [_a("SUM", "bid_price", "total_revenue")], [IMPRESSION], [("day", "asc")], 10),
    "revenue_by_country_day": _q(["country", "day"], [_a("SUM", "bid_price", "revenue")], [IMPRESSION], [("revenue", "desc")], 20),
    "ctr_per_advertiser": _q(["advertiser_id"], [_a("COUNT", "*", "total_events"), _a("SUM", "bid_price", "total_spend")], [_in("type", "click", "impression")], [("total_events", "desc")], 15),
    "top_advertisers_us": _q(["advertiser_id"], [_a("SUM", "total_price", "purchase_revenue"), _a("COUNT", "*", "events")], [_is("country", "US"), _between("day", "2024-01-10", "2024-01-31"), PURCHASE], [("purchase_revenue", "desc")], 10),
    "avg_purchase_by_country": _q(["country"], [_a("AVG", "total_price", "avg_purchase_value"), _a("COUNT", "*", "purchase_count")], [PURCHASE], [("avg_purchase_value", "desc")], 25),
    "hourly_spend_japan": _q(["hour"], [_a("SUM", "bid_price", "hourly_spend"), _a("COUNT", "*", "event_count")], [_is("country", "JP"), _between("day", "2024-01-05", "2024-01-20")], [("hourly_spend", "desc")]),
    "impressions_per_country": _q(["country"], [_a("COUNT", "*", "impression_count")], [IMPRESSION], [("impression_count", "desc")]),
    "advertiser_publisher_matrix": _q(["advertiser_id", "publisher_id"], [_a("SUM", "bid_price", "total_bid"), _a("COUNT", "*", "event_count")], [NOT_SERVE], [("total_bid", "desc")], 50),
    "purchase_revenue_eu": _q(["country", "day"], [_a("SUM", "total_price", "purchase_revenue")], [_in("country", "DE", "FR", "ES", "IT"), PURCHASE], [("purchase_revenue", "desc")], 30),
    "high_traffic_days": _q(["day"], [_a("COUNT", "*", "total_events"), _a("COUNT", "DISTINCT user_id", "unique_users")], [NOT_SERVE], [("total_events", "desc")], 10),
    "large_in_list_test": _q(["advertiser_id"], [_a("COUNT", "*", "event_count")], [_in("advertiser_id", *range(1, 21))], [("event_count", "desc")]),
    "order_by_aggregate": _q(["publisher_id"], [_a("AVG", "bid_price", "avg_bid"), _a("MAX", "bid_price", "max_bid"), _a("COUNT", "*", "bid_count")], [IMPRESSION], [("avg_bid", "desc")], 20),
    "empty_result_set": _q(["day"], [_a("SUM", "bid_price", "revenue")], [IMPRESSION, _between("day", "2026-01-01", "2026-01-07")]),
    "all_aggregates_test": _q(["type"], [_a("COUNT", "*", "event_count"), _a("SUM", "bid_price", "total_bid"), _a("AVG", "bid_price", "avg_bid"), _a("MIN", "bid_price", "min_bid"), _a("MAX", "bid_price", "max_bid")], [_is("day", "2024-01-15")], [("total_bid", "desc")]),
    "minute_breakdown": _q(["minute"], [_a("COUNT", "*", "events_per_minute")], [_is("day", "2024-01-01"), _is("country", "US")], [("events_per_minute", "desc")], 30),
}
#: 1 and 2 January 2024 in epoch milliseconds.
FIRST, SECOND = 1704067200000, 1704153600000
COST_SUITE = {
    "simple_aggregation": _q(["advertiser_id"], [_a("sum", "bid_price", "total_spend")], [IMPRESSION], [("total_spend", "desc")], 100),
    "time_series": _q(["country"], [_a("count", "*", "events"), _a("sum", "bid_price", "revenue")], [_between("ts", FIRST, SECOND), _in("type", "impression", "click")], [("revenue", "desc")]),
    "funnel_analysis": _q(["auction_id", "advertiser_id"], [_a("count", "*", "events_in_funnel"), _a("max", "ts", "last_event_time")], [_in("type", "serve", "impression", "click", "purchase")], [("events_in_funnel", "desc")], 1000),
    "user_journey": _q(["user_id"], [_a("count", "distinct auction_id", "unique_auctions"), _a("sum", "total_price", "total_purchases")], [_is("country", "US"), NOT_SERVE], [("total_purchases", "desc")], 500),
    "geo_analysis": _q(["country", "publisher_id"], [_a("avg", "bid_price", "avg_bid"), _a("count", "*", "impression_count")], [_in("country", "US", "JP", "DE"), IMPRESSION], [("impression_count", "desc")]),
    "high_cardinality": _q(["advertiser_id", "publisher_id", "country"], [_a("count", "*", "event_count")], [NOT_SERVE], [("event_count", "desc")], 10000),
    "selective_lookup": {"select": ["*"], "where": [_is("advertiser_id", 42), PURCHASE], "order_by": [{"col": "ts", "dir": "desc"}], "limit": 50},
    "revenue_analysis": _q(["advertiser_id"], [_a("sum", "total_price", "purchase_revenue"), _a("sum", "bid_price", "ad_spend"), _a("count", "*", "total_events")], [{"col": "ts", "op": "gte", "val": FIRST}], [("purchase_revenue", "desc")], 200),
}
ALL = EXAMPLES | STRESS | ADVERSARIAL | {f"suite_{k}": v for k, v in SUITE.items()} | {f"cost_{k}": v for k, v in COST_SUITE.items()}
