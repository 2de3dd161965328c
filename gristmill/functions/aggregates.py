"""Aggregates over base rows. Sums of money are exact (decimal inside, double outside)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import MONEY, MONEY_TYPE
from ..spec import Measure


def exact_sum(col: str | Column, name: str = "", only: Column | None = None) -> Column:
    """Sum as a decimal for money columns, else Spark's own; null without a non-null value."""
    c = F.col(col) if isinstance(col, str) else col
    if only is not None:
        c = F.when(only, c)
    if (name or (col if isinstance(col, str) else "")) in MONEY:
        return F.sum(c.cast(MONEY_TYPE))
    return F.sum(c)


def plain(c: Column, money: bool) -> Column:
    return c.cast("double") if money else c


def base_measure(m: Measure, schema: T.StructType) -> Column:
    money = m.col in MONEY
    if m.func == "COUNT":
        return F.count(F.lit(1)) if m.col == "*" else F.countDistinct(m.col) if m.distinct else F.count(m.col)
    if m.func == "SUM":
        return plain(exact_sum(m.col), money)
    if m.func == "AVG":
        return plain(exact_sum(m.col), True) / F.nullif(F.count(m.col), F.lit(0))
    return F.min(m.col) if m.func == "MIN" else F.max(m.col)
