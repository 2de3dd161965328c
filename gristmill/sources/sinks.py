"""Sinks: the lake, Parquet, CSV and JSON results."""

from __future__ import annotations

import csv
import io
import json
import os
import time
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_lake(events: DataFrame, lake: str, cluster: tuple[str, ...] = ("type", "country")) -> None:
    """Day folders, clustered inside. Rows are rebalanced by day: small days share a task, and a day
    over Spark's advisory size is split, so files are of a good size and no day waits for one task."""
    events.hint("rebalance", "day").sortWithinPartitions("day", *cluster).write.mode("overwrite").partitionBy("day").option("compression", "zstd").parquet(f"{lake}/events")


def write_partitioned(df: DataFrame, path: str, by: tuple[str, ...], cluster: tuple[str, ...] = ()) -> None:
    df.repartition(*by).sortWithinPartitions(*by, *cluster).write.mode("overwrite").partitionBy(*by).option("compression", "zstd").parquet(path)


def write_single(df: DataFrame, path: str) -> None:
    """One file, for small results."""
    df.coalesce(1).write.mode("overwrite").option("compression", "zstd").parquet(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV parts with header, written by the executors."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_csv_file(df: DataFrame, path: str) -> int:
    """One local CSV file, row by row through the driver and moved into place when complete."""
    text = f"{path}.{uuid.uuid4().hex}.tmp"
    n = 0
    with open(text, "w", newline="", encoding="utf-8") as f:
        out = csv.writer(f)
        out.writerow(df.columns)
        for r in df.toLocalIterator():
            out.writerow(r)
            n += 1
    os.replace(text, path)
    return n


def csv_text(columns: list[str], rows: list) -> str:
    buffer = io.StringIO()
    out = csv.writer(buffer)
    out.writerow(columns)
    out.writerows(rows)
    return buffer.getvalue()


def write_json(report: dict, path: str) -> None:
    text = f"{path}.{uuid.uuid4().hex}.tmp"
    with open(text, "w", encoding="utf-8") as f:
        json.dump(report, f, indent=1, default=str)
    os.replace(text, path)


def write_markdown(rows: list[dict], path: str, title: str) -> None:
    columns = list(rows[0]) if rows else []
    lines = [f"# {title}", "", "| " + " | ".join(columns) + " |", "|" + "---|" * len(columns), *("| " + " | ".join(str(r[c]) for c in columns) + " |" for r in rows)]
    with open(path, "w", encoding="utf-8") as f:
        f.write("\n".join(lines) + "\n")


def clean_folder(folder: str, max_age_s: float = 24 * 3600) -> int:
    """Delete left-over temporary files that are older."""
    gone = 0
    for name in os.listdir(folder):
        p = os.path.join(folder, name)
        if name.endswith(".tmp") and time.time() - os.path.getmtime(p) >= max_age_s:
            os.remove(p)
            gone += 1
    return gone
