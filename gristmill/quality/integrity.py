"""Is a view still what its definition gives on today's base rows?"""

from __future__ import annotations

import time
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.compare import mismatches, restrict_to_keys, sample_keys
from ..plans.build import ViewStore
from ..plans.catalog import MVDef


def checksums(view: DataFrame, mv: MVDef) -> DataFrame:
    """(measure, total) of every numeric measure, and the row count, in one pass."""
    numeric = {k for k, t in view.dtypes if t in ("bigint", "int", "double") or t.startswith("decimal")}
    names = [m.name for m in mv.measures if m.name in numeric]
    sums = [F.sum(F.col(n).cast("decimal(38,6)")).cast("double").alias(n) for n in names]
    one = view.agg(F.count(F.lit(1)).cast("double").alias("rows in all"), *sums)
    return one.select(F.explode(F.create_map(*(x for n in ["rows in all", *names] for x in (F.lit(n), F.col(f"`{n}`"))))).alias("measure", "total"))


def spot_check(base: DataFrame, view: DataFrame, mv: MVDef, n: int = 100, seed: int = 7) -> DataFrame:
    """Sampled groups of the view whose measures differ from a fresh computation of just those groups."""
    keys = sample_keys(view.dropna(subset=list(mv.dims)), list(mv.dims), n, seed)
    fresh = mv.frame(restrict_to_keys(base, keys, list(mv.dims)))
    numeric = [m.name for m in mv.measures if m.func not in ("MIN", "MAX")]
    return mismatches(fresh, restrict_to_keys(view, keys, list(mv.dims)), list(mv.dims), numeric)


def health(base: DataFrame, view: DataFrame, mv: MVDef, n: int = 100) -> dict:
    """OK, STALE (totals or samples differ) or ERROR (columns are missing)."""
    began = time.time()
    if missing := {*mv.dims, *(m.name for m in mv.measures)} - set(view.columns):
        return {"view": mv.name, "status": "ERROR", "detail": f"missing columns: {sorted(missing)}", "seconds": time.time() - began}
    want, have = (dict(map(tuple, checksums(f, mv).collect())) for f in (mv.frame(base), view))
    off = [k for k in want if abs((want[k] or 0) - (have.get(k) or 0)) > 1e-6]
    wrong = 0 if off else spot_check(base, view, mv, n).count()
    return {"view": mv.name, "status": "STALE" if off or wrong else "OK", "detail": f"totals differ: {off}" if off else f"{wrong} sampled groups differ", "seconds": time.time() - began}


def check_store(base: DataFrame, store: ViewStore, catalog: dict[str, MVDef]) -> list[dict]:
    """Health of all built views; stale ones are marked, so that no query is routed to them."""
    out = []
    for name, mv in catalog.items():
        if store.ready(name):
            out.append(found := health(base, store.read(name), mv))
            if found["status"] != "OK":
                store.mark_stale(name)
    return out


def health_table(spark, results: list[dict]) -> DataFrame:
    rows = [spark.createDataFrame([(r["view"], r["status"], r["detail"], r["seconds"])], "view string, status string, detail string, seconds double") for r in results]
    return reduce(DataFrame.unionAll, rows).withColumn("checked_at", F.current_timestamp())


#: Relative differences from which a comparison warns, and from which it fails.
WARN, FAIL = 0.01, 0.05


def compare_top(base_top: DataFrame, view_top: DataFrame, keys: list[str], measure: str) -> DataFrame:
    """Full join of two top lists with the relative difference of a measure."""
    a = base_top.select(*keys, F.col(measure).cast("double").alias("base_value"))
    b = view_top.select(*keys, F.col(measure).cast("double").alias("view_value"))
    off = F.abs(F.coalesce("base_value", F.lit(0.0)) - F.coalesce("view_value", F.lit(0.0))) / F.nullif(F.abs(F.coalesce("base_value", "view_value")), F.lit(0.0))
    return a.join(b, keys, "full_outer").select(*keys, "base_value", "view_value", F.coalesce(off, F.lit(0.0)).alias("off"), F.when(F.coalesce(off, F.lit(0.0)) > FAIL, "FAIL").when(F.coalesce(off, F.lit(0.0)) > WARN, "WARN").otherwise("OK").alias("status"))
