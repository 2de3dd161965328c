"""Materialized views: what each holds, and how it is computed from base rows.

A measure is stored as an aggregate of a column over all rows of a group, or over the rows of one
event type (``only``). Sums stay decimals, averages are kept as sum and count, so everything but
distinct counts can be aggregated again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.aggregates import exact_sum
from ..schema import TYPES


@dataclass(frozen=True)
class Stored:
    name: str
    func: str  # SUM, COUNT, MIN, MAX or DISTINCT
    col: str  # "*" for rows
    only: str | None = None  # event type

    @property
    def additive(self) -> bool:
        return self.func != "DISTINCT"

    def column(self) -> Column:
        only = F.col("type") == self.only if self.only else None
        value = F.lit(1) if self.col == "*" else F.col(self.col)
        picked = F.when(only, value) if only is not None else value
        if self.func == "SUM":
            return exact_sum(F.col(self.col), self.col, only)
        return {"COUNT": F.count, "MIN": F.min, "MAX": F.max, "DISTINCT": F.countDistinct}[self.func](picked)


@dataclass(frozen=True)
class MVDef:
    name: str
    dims: tuple[str, ...]
    measures: tuple[Stored, ...]
    only: str | None = None  # event type all rows have
    partition: tuple[str, ...] = ()  # leading dimensions of its files
    keyed: bool = False  # rows with a null dimension are left out

    def frame(self, base: DataFrame) -> DataFrame:
        """The view computed from base rows."""
        if self.only:
            base = base.where(F.col("type") == self.only)
        if self.keyed:
            base = base.dropna(subset=list(self.dims))
        return base.groupBy(*self.dims).agg(*(m.column().alias(m.name) for m in self.measures))

    def find(self, func: str, col: str, only: str | None) -> Stored | None:
        return next((m for m in self.measures if (m.func, m.col, m.only) == (func, col, only)), None)


def _sum(name: str, col: str, only: str | None = None) -> tuple[Stored, Stored]:
    """A sum and its count of non-null values, for averages."""
    return Stored(name, "SUM", col, only), Stored(f"n_{name}", "COUNT", col, only)


ROWS = Stored("events", "COUNT", "*")
#: What a wide view holds about each event type.
WIDE = (
    *_sum("sum_bid_impr", "bid_price", "impression"),
    *_sum("sum_total_pur", "total_price", "purchase"),
    *(Stored(f"cnt_{t}", "COUNT", "*", t) for t in TYPES),
    Stored("events_all", "COUNT", "*"),
)
WIDE_GRAINS = ("day", "week", "hour")
WIDE_DIMS = ("advertiser_id", "publisher_id", "country", "type", "user_id")


def wide_view(grain: str, dim: str) -> MVDef:
    """One view of the wide family: grain, dimension and country."""
    dims = tuple(dict.fromkeys((grain, dim, "country")))
    return MVDef(f"mv_{grain}_{dim}_wide", dims, WIDE, partition=(grain,))


_BID, _TOTAL = _sum("sum_bid", "bid_price"), _sum("sum_total", "total_price")
FIXED = (
    MVDef("mv_day_impr_revenue", ("day",), (*_BID, ROWS), "impression", ("day",)),
    MVDef("mv_day_country_publisher_impr", ("day", "country", "publisher_id"), (*_BID, ROWS), "impression", ("day",)),
    MVDef("mv_country_purchase_avg", ("country",), (*_TOTAL, Stored("n", "COUNT", "*"), Stored("min_total", "MIN", "total_price"), Stored("max_total", "MAX", "total_price")), "purchase", ("country",)),
    MVDef("mv_all_adv_type_counts", ("advertiser_id", "type"), (Stored("cnt", "COUNT", "*"),), partition=("type",)),
    MVDef("mv_day_minute_impr", ("day", "minute"), (*_BID, ROWS), "impression", ("day",)),
    MVDef("mv_hour_country_pub_adv_impr", ("hour", "day", "country", "publisher_id", "advertiser_id"), (*_BID, ROWS), "impression", ("day",)),
    MVDef("mv_day_country_type_adv", ("day", "country", "type", "advertiser_id", "publisher_id"), (ROWS, *_BID, *_TOTAL), partition=("day",)),
    MVDef("mv_week_adv_country_type", ("week", "advertiser_id", "country", "type"), (ROWS, *_BID, *_TOTAL, Stored("unique_users", "DISTINCT", "user_id")), partition=("week",)),
)
#: The rebuilt variants: rows with null keys left out, and counts by type.
_BY_TYPE = tuple(Stored(n, "COUNT", "*", t) for n, t in (("impressions", "impression"), ("clicks", "click"), ("serves", "serve"), ("purchases", "purchase")))
_REVENUE = Stored("revenue", "SUM", "total_price", "purchase")
REBUILT = (
    MVDef("rebuilt_all_adv_type_counts", ("advertiser_id", "type"), (Stored("total_events", "COUNT", "*"), Stored("active_days", "DISTINCT", "day"), Stored("first_seen", "MIN", "ts"), Stored("last_seen", "MAX", "ts"), Stored("total_revenue", "SUM", "total_price")), keyed=True),
    MVDef("rebuilt_day_advertiser_id_wide", ("day", "advertiser_id"), (*_BY_TYPE, _REVENUE), partition=("day",), keyed=True),
    MVDef("rebuilt_day_country_wide", ("day", "country"), (*_BY_TYPE, _REVENUE, Stored("unique_users", "DISTINCT", "user_id")), partition=("day",), keyed=True),
    MVDef("rebuilt_day_type_wide", ("day", "type"), (Stored("total_events", "COUNT", "*"), *(Stored(f"unique_{n}", "DISTINCT", c) for n, c in (("advertisers", "advertiser_id"), ("publishers", "publisher_id"), ("countries", "country"), ("users", "user_id"))), Stored("revenue", "SUM", "total_price")), partition=("day",), keyed=True),
    MVDef("rebuilt_hour_advertiser_id_wide", ("hour", "day", "advertiser_id"), (*_BY_TYPE[:3], Stored("total_events", "COUNT", "*"), _REVENUE), partition=("day",), keyed=True),
)


def full_catalog(users: bool = True) -> dict[str, MVDef]:
    """All views that queries may be routed to."""
    wide = [wide_view(g, d) for g in WIDE_GRAINS for d in WIDE_DIMS if users or d != "user_id"]
    return {m.name: m for m in (*FIXED, *wide)}
