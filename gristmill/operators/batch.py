"""Several queries in one pass: queries with the same source, filters and groups share one
aggregation that holds the union of their measures, and each takes its own columns from it."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import replace

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from ..spec import Measure, QuerySpec, SpecError
from .execute import finish


def group_key(spec: QuerySpec) -> str:
    return json.dumps([spec.table, spec.where_key(), sorted(spec.group_by)], default=str)


def supersets(specs: dict[str, QuerySpec]) -> list[list[str]]:
    """Names of the queries that can share one pass, in order of first appearance."""
    groups: dict[object, list[str]] = {}
    for name, spec in specs.items():
        groups.setdefault(group_key(spec) if spec.aggregates else ("alone", name), []).append(name)
    return list(groups.values())


def check_aliases(specs: dict[str, QuerySpec]) -> None:
    """One alias must not stand for different aggregates within a batch."""
    meaning: dict[str, str] = {}
    for spec in specs.values():
        for m in spec.measures:
            if meaning.setdefault(m.name, m.canonical) != m.canonical:
                raise SpecError(f"{m.name} stands for {meaning[m.name]} and {m.canonical}")


def superset(specs: list[QuerySpec]) -> QuerySpec:
    """One query with the groups of all and the union of their measures, under canonical names."""
    first = specs[0]
    union = {m.canonical: replace(m, alias="") for s in specs for m in s.measures}
    return QuerySpec(first.table, first.group_by, tuple(union.values()), (*first.group_by, *union), first.where, first.group_by)


def run_batch(df: DataFrame, specs: dict[str, QuerySpec], base: Callable[[DataFrame, QuerySpec], DataFrame]) -> tuple[dict[str, DataFrame], list[DataFrame]]:
    """(frame of each query, persisted supersets to unpersist when done). ``base`` runs one query, on
    a view or the base table as it sees fit; a superset goes through it as well."""
    out, held = {}, []
    for names in supersets(specs):
        if len(names) == 1:
            out[names[0]] = base(df, specs[names[0]])
            continue
        shared = base(df, superset([specs[n] for n in names])).persist(StorageLevel.MEMORY_AND_DISK)
        held.append(shared)
        for n in names:
            spec = specs[n]
            own = shared.select(*spec.group_by, *(shared[f"`{m.canonical}`"].alias(m.name) for m in spec.measures))
            out[n] = finish(own, spec)
    return out, held


def chunks(names: list[str], most: int = 20) -> Iterator[list[str]]:
    """At most ``most`` queries at a time."""
    for a in range(0, len(names), most):
        yield names[a : a + most]


class ResultTooLarge(RuntimeError):
    pass


def collect_within(df: DataFrame, megabytes: int = 4096) -> list:
    """Rows on the driver, refused once their text passes the bound; one partition at a time."""
    rows, size = [], 0
    for r in df.toLocalIterator():
        size += sum(len(str(v)) for v in r)
        if size > megabytes << 20:
            raise ResultTooLarge(f"the result passes {megabytes} MB")
        rows.append(r)
    return rows
