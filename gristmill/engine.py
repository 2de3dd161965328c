"""The engine: route a query document, run it on a view or the base table, and keep account."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame

from .operators.batch import run_batch
from .operators.execute import run_base, run_sampled
from .plans.analyzer import WorkloadAnalyzer
from .plans.cache import ResultCache, data_version
from .plans.catalog import MVDef
from .plans.cost import CostedPlan, explain_cost
from .plans.router import Decision, route, run_view
from .plans.telemetry import Telemetry
from .spec import QuerySpec


class Engine:
    """base: the event table; views: a frame for each view that is there, by name.

    A view whose frame can't be read is as good as none: the query runs on the base table.
    """

    def __init__(self, base: DataFrame, catalog: dict[str, MVDef] | None = None, views: Callable[[str], DataFrame] | None = None, ready: Callable[[str], bool] = lambda _: True, rows: dict[str, int] | None = None, version: str = ""):
        self.base, self.catalog, self.views = base, catalog or {}, views
        self.ready, self.rows, self.version = ready, rows, version
        self.telemetry, self.analyzer, self.cache = Telemetry(), WorkloadAnalyzer(), ResultCache()

    def parse(self, raw: dict | QuerySpec) -> QuerySpec:
        return raw if isinstance(raw, QuerySpec) else QuerySpec.parse(raw, tuple(self.base.columns))

    def plan(self, raw: dict | QuerySpec) -> Decision:
        return route(self.parse(raw), self.catalog, self.ready, self.rows)

    def frame(self, raw: dict | QuerySpec, views: bool = True, sample: float | None = None, seed: int = 42) -> DataFrame:
        """The result, lazily. sample: per cent of base rows, for an approximate answer."""
        spec = self.parse(raw)
        if sample is not None:
            return run_sampled(self.base, spec, sample, seed)
        decision = self.plan(spec) if views and self.views else None
        if decision and decision.plan:
            return run_view(self.views(decision.target), spec, decision.plan)
        return run_base(self.base, spec)

    def explain(self, raw: dict | QuerySpec) -> CostedPlan:
        """What each route would read, and the one that routing takes."""
        spec = self.parse(raw)
        return explain_cost(spec, self.base, self.catalog if self.views else {}, self.views, self.ready)

    def collect(self, raw: dict | QuerySpec, name: str = "query", cached: bool = False, views: bool = True) -> list:
        """Rows, with routing and time recorded."""
        spec = self.parse(raw)
        began = time.perf_counter()
        decision = route(spec, self.catalog if views and self.views else {}, self.ready, self.rows)
        record = self.telemetry.record(name, decision, (time.perf_counter() - began) * 1000)
        began = time.perf_counter()
        make = lambda: run_view(self.views(decision.target), spec, decision.plan) if decision.plan else run_base(self.base, spec)
        found = (self.cache.get(spec, self.version or data_version(self.base), make) if cached else make()).collect()
        seconds = time.perf_counter() - began
        record.execution_ms, record.rows = seconds * 1000, len(found)
        self.analyzer.record(spec, bool(decision.plan), seconds)
        return found

    def batch(self, raws: dict[str, dict | QuerySpec]) -> tuple[dict[str, DataFrame], list[DataFrame]]:
        """Many queries, those with the same filters and groups in one pass."""
        return run_batch(self.base, {k: self.parse(v) for k, v in raws.items()}, lambda _, spec: self.frame(spec))
