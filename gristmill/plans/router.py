"""Routing: a view may answer a query only if it provably gives the base table's answer.

1. The view's type filter is implied by the query.
2. Every other predicate can be tested on the view's dimensions (or on a coarser time that follows
   from one); none is ever dropped. A query fixed to one type may use measures stored for that type
   instead, and then groups without such rows are left out.
3. The query's groups follow from the view's dimensions.
4. Every measure can be derived; a distinct count only at exactly the view's dimensions.
5. The view is ready, and keeps rows with null keys.

Among the admissible the one with the fewest rows wins (where known), then the best score.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.aggregates import plain
from ..functions.predicates import conjunction
from ..operators.execute import finish
from ..schema import MONEY
from ..spec import Condition, Measure, QuerySpec
from .catalog import MVDef, Stored

#: Times that follow from another: to derive the first, any of the others.
DERIVED = {"hour": ("hour",), "day": ("day", "hour"), "week": ("week", "day", "hour"), "minute": ("minute",)}


@dataclass(frozen=True)
class RoutedPlan:
    mv: MVDef
    only: str | None  # type whose stored measures are used
    residual: tuple[Condition, ...]
    score: float


@dataclass(frozen=True)
class Rejection:
    reason: str
    detail: str = ""


def _derivable(col: str, mv: MVDef) -> bool:
    return col in mv.dims or any(c in mv.dims for c in DERIVED.get(col, ()))


def _derived(col: str, mv: MVDef) -> Column:
    if col in mv.dims:
        return F.col(col)
    source = F.col(next(c for c in DERIVED[col] if c in mv.dims))
    return F.to_date(source) if col == "day" else F.to_date(F.date_trunc("week", source))


def _parts(m: Measure, mv: MVDef, only: str | None, exact: bool) -> tuple[Stored, ...] | None:
    """Stored measures that a query measure is made of, or None."""
    if m.distinct:
        found = mv.find("DISTINCT", m.col, only)
        return (found,) if found and exact else None
    if m.func == "AVG":
        pair = mv.find("SUM", m.col, only), mv.find("COUNT", m.col, only)
        return pair if all(pair) else None
    found = mv.find(m.func, m.col, only)
    return (found,) if found else None


def admit(spec: QuerySpec, mv: MVDef) -> RoutedPlan | Rejection:
    if not spec.aggregates:
        return Rejection("unsupported_operation", "no aggregate")
    if mv.keyed:
        return Rejection("custom_filter", "rows with null keys are missing")
    kind = spec.equality("type")
    residual, only = list(spec.where), None
    if mv.only:
        if kind != mv.only:
            return Rejection("custom_filter", f"holds only {mv.only}")
        residual = [p for p in residual if not (p.col == "type" and p.op == "eq")]
    elif "type" not in mv.dims and kind is not None:
        only = kind
        residual = [p for p in residual if not (p.col == "type" and p.op == "eq")]
        if not mv.find("COUNT", "*", only):
            return Rejection("missing_columns", f"nothing stored for type {kind}")
    if bad := [c for p in residual for c in p.cols if not _derivable(c, mv)]:
        return Rejection("custom_filter", f"can't test {bad[0]}")
    if bad := [c for c in spec.group_by if not _derivable(c, mv) or (mv.only and c == "type")]:
        return Rejection("missing_columns", f"no {bad[0]}")
    exact = set(spec.group_by) == set(mv.dims)
    for m in spec.measures:
        if _parts(m, mv, only, exact) is None:
            return Rejection("missing_columns", f"can't derive {m.canonical}")
    return RoutedPlan(mv, only, tuple(residual), score(spec, mv))


#: Points of the tie-break: groups covered, no groups to merge, filters tested, type filter shared.
SCORE = {"dims": 50, "exact": 30, "filters": 20, "type": 10}


def score(spec: QuerySpec, mv: MVDef) -> float:
    got = SCORE["dims"] if set(spec.group_by) <= set(mv.dims) else 0
    got += SCORE["exact"] if set(spec.group_by) == set(mv.dims) else 0
    got += SCORE["filters"] if all(c in mv.dims for p in spec.where for c in p.cols if c != "type") else 0
    return got + (SCORE["type"] if mv.only else 0)


@dataclass(frozen=True)
class Decision:
    plan: RoutedPlan | None
    rejected: dict[str, Rejection]

    @property
    def target(self) -> str:
        return self.plan.mv.name if self.plan else "events"


def route(spec: QuerySpec, catalog: dict[str, MVDef], ready: Callable[[str], bool] = lambda _: True, rows: dict[str, int] | None = None) -> Decision:
    """The best admissible view, or the base table with the reason each view was turned down."""
    plans, rejected = [], {}
    for name, mv in catalog.items():
        found = admit(spec, mv) if ready(name) else Rejection("partition_mismatch", "not ready")
        if isinstance(found, RoutedPlan):
            plans.append(found)
        else:
            rejected[name] = found
    known = rows or {}
    best = min(plans, key=lambda p: (known.get(p.mv.name, float("inf")), -p.score, len(p.mv.dims), p.mv.name), default=None)
    return Decision(best, rejected)


def run_view(view: DataFrame, spec: QuerySpec, plan: RoutedPlan) -> DataFrame:
    """The query on a view's rows."""
    mv, only = plan.mv, plan.only
    needed = dict.fromkeys([*spec.group_by, *(c for p in plan.residual for c in p.cols)])
    stored = {s.name for m in spec.measures for s in _parts(m, mv, only, True)}
    present = mv.find("COUNT", "*", only)
    if only:
        stored.add(present.name)
    rows = view.select(*(_derived(c, mv).alias(c) for c in needed), *(F.col(s).alias(f"stored {s}") for s in sorted(stored)))
    condition = conjunction(plan.residual, rows.schema)
    if condition is not None:
        rows = rows.where(condition)
    here = F.sum(F.col(f"stored {present.name}")) if only else F.lit(1)
    if spec.measures and not only and spec.group_by and set(spec.group_by) == set(mv.dims):
        # a row of the view is a group: nothing to aggregate again
        return finish(rows.select(*spec.group_by, *(_as_stored(m, _parts(m, mv, None, True)).alias(m.name) for m in spec.measures)), spec)
    if spec.measures or only:
        made = [_again(m, _parts(m, mv, only, True)).alias(m.name) for m in spec.measures]
        rows = rows.groupBy(*spec.group_by).agg(*made, here.alias("rows here"))
        if only and spec.group_by:
            rows = rows.where(F.col("rows here") > 0)
        rows = rows.drop("rows here")
    else:
        rows = rows.select(*spec.group_by).distinct()
    return finish(rows, spec)


def _as_stored(m: Measure, parts: tuple[Stored, ...]) -> Column:
    money = m.col in MONEY
    first = F.col(f"stored {parts[0].name}")
    if m.func == "AVG":
        return plain(first, True) / F.nullif(F.col(f"stored {parts[1].name}"), F.lit(0))
    return plain(first, money) if m.func == "SUM" else first


def _again(m: Measure, parts: tuple[Stored, ...]) -> Column:
    money = m.col in MONEY
    first = F.col(f"stored {parts[0].name}")
    if m.func == "COUNT":
        return F.max(first) if m.distinct else F.coalesce(F.sum(first), F.lit(0).cast("bigint"))
    if m.func == "AVG":
        return plain(F.sum(first), True) / F.nullif(F.sum(F.col(f"stored {parts[1].name}")), F.lit(0))
    return plain(F.sum(first), money) if m.func == "SUM" else F.min(first) if m.func == "MIN" else F.max(first)
