"""What was routed where and why, how long it took and how many files it read."""

from __future__ import annotations

import json
import time
from dataclasses import asdict, dataclass, field

from .router import Decision


@dataclass
class RoutingRecord:
    query: str
    status: str  # hit or fallback
    target: str
    fallback_reason: str | None
    candidates: dict[str, str]
    routing_ms: float
    execution_ms: float = 0.0
    rows: int | None = None
    files: int | None = None
    total_files: int | None = None

    @property
    def pruned(self) -> bool:
        return self.files is not None and self.total_files is not None and self.files < self.total_files


@dataclass
class Telemetry:
    records: list[RoutingRecord] = field(default_factory=list)
    began: float = field(default_factory=time.time)

    def record(self, query: str, decision: Decision, routing_ms: float) -> RoutingRecord:
        reasons = [r.reason for r in decision.rejected.values()]
        main = max(set(reasons), key=reasons.count) if reasons and decision.plan is None else None if decision.plan else "no_mv_match"
        self.records.append(RoutingRecord(query, "hit" if decision.plan else "fallback", decision.target, main, {k: f"{r.reason}: {r.detail}" for k, r in decision.rejected.items()}, routing_ms))
        return self.records[-1]

    def summary(self) -> dict:
        n = len(self.records)
        mean = lambda k: sum(getattr(r, k) for r in self.records) / n if n else 0.0
        reasons: dict[str, int] = {}
        for r in self.records:
            if r.fallback_reason:
                reasons[r.fallback_reason] = reasons.get(r.fallback_reason, 0) + 1
        return {
            "queries": n, "hits": sum(r.status == "hit" for r in self.records), "hit_rate": mean_hit(self.records), "mean_routing_ms": mean("routing_ms"),
            "mean_execution_ms": mean("execution_ms"), "fallback_reasons": reasons, "pruned": sum(r.pruned for r in self.records),
            "advice": advice(self.records),
        }

    def export(self, path: str) -> None:
        with open(path, "w", encoding="utf-8") as f:
            json.dump({"summary": self.summary(), "records": [asdict(r) for r in self.records]}, f, indent=1, default=str)


def mean_hit(records: list[RoutingRecord]) -> float:
    return sum(r.status == "hit" for r in records) / len(records) if records else 0.0


def advice(records: list[RoutingRecord]) -> list[str]:
    out = []
    if records and mean_hit(records) < 0.8:
        out.append("many queries read the base table; see the workload's suggested views")
    if any(r.routing_ms > 10 for r in records):
        out.append("routing takes over 10 ms; the catalog may be too large")
    if slow := [r.query for r in records if r.execution_ms > 5000]:
        out.append(f"slow queries: {', '.join(slow[:5])}")
    return out
