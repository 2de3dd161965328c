"""Query documents to DataFrames. Nothing runs until the caller asks for rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.aggregates import base_measure
from ..functions.predicates import conjunction
from ..spec import QuerySpec


def filtered(df: DataFrame, spec: QuerySpec) -> DataFrame:
    condition = conjunction(spec.where, df.schema)
    return df if condition is None else df.where(condition)


def finish(out: DataFrame, spec: QuerySpec, ties: bool = True) -> DataFrame:
    """Order, limit and the selected columns. Nulls come last both ways; under a limit the group
    keys (or all columns) break ties, so that the same rows come out each time."""
    condition = conjunction(spec.having, out.schema)
    if condition is not None:
        out = out.where(condition)
    keys, named = [], set()
    for o in spec.order_by:
        name = spec.resolve_order(o)
        named.add(name)
        keys.append(F.col(f"`{name}`").desc_nulls_last() if o.descending else F.col(f"`{name}`").asc_nulls_last())
    if spec.limit and ties:
        keys += [F.col(f"`{c}`").asc_nulls_last() for c in (spec.group_by or out.columns) if c not in named and c in out.columns]
    if keys:
        out = out.orderBy(*keys)
    if spec.limit:
        out = out.limit(spec.limit)
    return out.select(*(F.col(f"`{c}`") for c in spec.select)) if spec.select else out


def run_base(df: DataFrame, spec: QuerySpec) -> DataFrame:
    """The query on base rows."""
    rows = filtered(df, spec)
    if spec.aggregates:
        made = [base_measure(m, df.schema).alias(m.name) for m in spec.measures]
        groups = [F.col(f"`{c}`") for c in spec.group_by]
        rows = rows.groupBy(*groups).agg(*made) if made else rows.select(*groups).distinct()
    elif spec.columns:
        keep = dict.fromkeys([*spec.columns, *(o.col for o in spec.order_by)])
        rows = rows.select(*(F.col(f"`{c}`") for c in keep))
    return finish(rows, spec)


def run_sampled(df: DataFrame, spec: QuerySpec, percent: float, seed: int = 42) -> DataFrame:
    """The query on a Bernoulli sample of rows; sums and counts are scaled up. Asked for explicitly,
    never chosen in the background. Distinct counts, minima and maxima stay as the sample has them."""
    fraction = min(max(percent, 0.0), 100.0) / 100
    out = run_base(df.sample(False, fraction, seed), spec)
    if not fraction:
        return out
    scale = {m.name for m in spec.measures if m.func == "SUM" or m.func == "COUNT" and not m.distinct}
    kinds = dict(out.dtypes)
    return out.select(*((F.col(f"`{c}`") / fraction if kinds[c] == "double" else F.round(F.col(f"`{c}`") / fraction).cast(kinds[c])).alias(c) if c in scale else F.col(f"`{c}`") for c in out.columns))


def wants_sample(spec: QuerySpec) -> bool:
    """Whether a sample is worth proposing: groups by a column of very many values, over all times."""
    timed = any(c in ("ts", "day", "week", "hour", "minute") for p in spec.where for c in p.cols)
    return bool(spec.measures) and not timed and any(c in ("user_id", "auction_id", "minute") for c in spec.group_by)
