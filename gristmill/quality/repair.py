"""Quarantine of rows without keys, constraints, and folder names of days."""

from __future__ import annotations

import re
from datetime import date
from functools import reduce
from operator import or_
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import TYPES

KEYS = ("day", "type", "advertiser_id", "publisher_id")
#: Bounds of the constraints.
COUNTRY_LENGTH, LEAST_PRICE, MOST_PRICE = 2, 0.0, 10_000.0


def null_keys(keys: tuple[str, ...] = KEYS) -> Column:
    return reduce(or_, (F.col(k).isNull() for k in keys))


def quarantine(events: DataFrame, keys: tuple[str, ...] = KEYS) -> tuple[DataFrame, DataFrame]:
    """(rows to keep, rows without a key)."""
    return events.where(~null_keys(keys)), events.where(null_keys(keys))


def quarantine_report(bad: DataFrame, most: int = 10_000) -> DataFrame:
    """The first bad rows in order, stamped; a report, the rows themselves stay in ``bad``."""
    return bad.orderBy(*(F.col(c).asc_nulls_last() for c in ("day", "type", "auction_id"))).limit(most).withColumn("quarantined_at", F.current_timestamp())


def violations() -> dict[str, Column]:
    """A test of each constraint; a null value breaks none."""
    broken = {
        "type": ~F.col("type").isin(*TYPES),
        "country": F.length("country") != COUNTRY_LENGTH,
        "total_price": (F.col("total_price") < LEAST_PRICE) | (F.col("total_price") > MOST_PRICE),
    }
    return {k: F.coalesce(c, F.lit(False)) for k, c in broken.items()}


def count_violations(events: DataFrame) -> DataFrame:
    """One row a constraint, from one pass."""
    tests = violations()
    one = events.agg(*(F.count_if(c).alias(k) for k, c in tests.items()))
    return one.select(F.explode(F.create_map(*(x for k in tests for x in (F.lit(k), F.col(k))))).alias("constraint", "rows"))


def enforce(events: DataFrame) -> DataFrame:
    """Rows that break no constraint."""
    return events.where(~reduce(or_, violations().values()))


def rejected(events: DataFrame) -> DataFrame:
    """All rows without a key or that break a constraint, with the reasons of each: what neither
    ``quarantine`` nor ``enforce`` keeps."""
    tests = {"null key": null_keys(KEYS), **violations()}
    why = F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in tests.items())))
    return events.withColumn("reasons", why).where(F.size("reasons") > 0).withColumn("reasons", F.concat_ws(",", "reasons")).withColumn("quarantined_at", F.current_timestamp())


_DATES = (r"(\d{4})-(\d{1,2})-(\d{1,2})(?:[ T].*)?", r"(\d{4})/(\d{1,2})/(\d{1,2})", r"(\d{4})(\d{2})(\d{2})", r"(\d{4})_(\d{1,2})_(\d{1,2})", r"(\d{4})\.(\d{1,2})\.(\d{1,2})")
YEARS = range(2020, 2031)


def normal_day(name: str) -> str | None:
    """The ISO day that a folder name means (also URL-encoded, with a time, or with other marks), or
    None if it means none between 2020 and 2030."""
    text = unquote(name).strip()
    for pattern in _DATES:
        if m := re.fullmatch(pattern, text):
            try:
                found = date(*map(int, m.groups()))
            except ValueError:
                return None
            return found.isoformat() if found.year in YEARS else None
    return None


def repair_day_folders(spark, root: str) -> dict[str, list[str]]:
    """Give ``day=...`` folders their ISO names; where that folder is there already, move the files
    into it under names that are free. What means no day is left and reported."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    at = fs_path(root)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    done: dict[str, list[str]] = {"renamed": [], "merged": [], "unreadable": []}
    for status in fs.listStatus(at):
        name = status.getPath().getName()
        if not status.isDirectory() or not name.startswith("day="):
            continue
        day = normal_day(name[4:])
        if day is None:
            done["unreadable"].append(name)
        elif name != f"day={day}":
            target = fs_path(f"{root}/day={day}")
            if not fs.exists(target):
                fs.rename(status.getPath(), target)
                done["renamed"].append(name)
                continue
            for i, f in enumerate(fs.listStatus(status.getPath())):
                own = f.getPath().getName()
                free = fs_path(target, own)
                while fs.exists(free):
                    i += 1
                    free = fs_path(target, f"merged-{i}-{own}")
                fs.rename(f.getPath(), free)
            fs.delete(status.getPath(), True)
            done["merged"].append(name)
    return done


def next_steps(counts: dict[str, int]) -> list[str]:
    return [f"repair {n} rows that break the {k} constraint" for k, n in counts.items() if n] or ["nothing to repair"]
