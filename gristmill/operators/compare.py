"""Joins that compare two results: by keys, in full, or on sampled keys."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOLERANCE = 1e-6


def full_compare(left: DataFrame, right: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """Full outer join by keys (nulls compare equal): both sides' measures and their difference."""
    a = left.select(*(F.col(k).alias(f"l_{k}") for k in keys), F.lit(1).alias("in_left"), *(F.col(m).alias(f"left_{m}") for m in measures))
    b = right.select(*(F.col(k).alias(f"r_{k}") for k in keys), F.lit(1).alias("in_right"), *(F.col(m).alias(f"right_{m}") for m in measures))
    on = reduce(lambda x, y: x & y, (F.col(f"l_{k}").eqNullSafe(F.col(f"r_{k}")) for k in keys))
    both = a.join(b, on, "full_outer")
    return both.select(
        *(F.coalesce(f"l_{k}", f"r_{k}").alias(k) for k in keys), F.col("in_left").isNotNull().alias("in_left"), F.col("in_right").isNotNull().alias("in_right"),
        *(c for m in measures for c in (F.col(f"left_{m}"), F.col(f"right_{m}"), F.abs(F.coalesce(f"left_{m}", F.lit(0)) - F.coalesce(f"right_{m}", F.lit(0))).cast("double").alias(f"diff_{m}"))),
    )


def mismatches(left: DataFrame, right: DataFrame, keys: list[str], measures: list[str], tolerance: float = TOLERANCE) -> DataFrame:
    joined = full_compare(left, right, keys, measures)
    wrong = reduce(or_, (F.col(f"diff_{m}") > tolerance for m in measures), ~(F.col("in_left") & F.col("in_right")))
    return joined.where(wrong)


def left_compare(left: DataFrame, right: DataFrame, keys: list[str], measure: str) -> DataFrame:
    """Left join: each left row with the right side's measure, or null."""
    return left.select(*keys, F.col(measure).alias(f"left_{measure}")).join(right.select(*keys, F.col(measure).alias(f"right_{measure}")), keys, "left")


def restrict_to_keys(df: DataFrame, sample: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are in a sample of keys (semi join; Spark broadcasts the sample if it is small)."""
    return df.join(sample.select(*keys).distinct(), keys, "left_semi")


def sample_keys(df: DataFrame, keys: list[str], n: int, seed: int = 7) -> DataFrame:
    """n distinct key rows at random: the smallest by a seeded hash, so any engine can repeat it."""
    return df.select(*keys).distinct().orderBy(F.xxhash64(F.lit(seed), *(F.col(k).cast("string") for k in keys)), *keys).limit(n)


def same_rows(left: DataFrame, right: DataFrame) -> bool:
    """Whether two results hold the same rows, counted."""
    columns = sorted(left.columns)
    if columns != sorted(right.columns):
        return False
    a, b = left.select(*(F.col(f"`{c}`") for c in columns)), right.select(*(F.col(f"`{c}`") for c in columns))
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
