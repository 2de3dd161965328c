"""Command line: prepare a lake and views, run query files, compare, check, repair.

    python -m gristmill.cli prepare --raw 'raw/events_part_*.csv' --lake LAKE --mvs MVS
    python -m gristmill.cli run --lake LAKE --mvs MVS --queries FOLDER --out FOLDER [--adaptive] [--approx-sample P] [--approx-seed N] [--telemetry] [--batch]
    python -m gristmill.cli baseline (--lake LAKE | --raw GLOB) --queries FOLDER --out FOLDER
    python -m gristmill.cli explain --lake LAKE --mvs MVS --queries FOLDER
    python -m gristmill.cli validate | integrity --lake LAKE --mvs MVS ; guardrails | repair --lake LAKE
"""

from __future__ import annotations

import argparse
import os
import time
from dataclasses import asdict

from pyspark.sql import SparkSession

from .engine import Engine
from .operators.batch import chunks
from .operators.compare import same_rows
from .plans.build import ViewStore, fits
from .plans.catalog import FIXED, REBUILT, WIDE_DIMS, WIDE_GRAINS, full_catalog, wide_view
from .quality import guardrails, integrity, repair
from .sources import readers, sinks


def session(args) -> SparkSession:
    b = SparkSession.builder.appName("gristmill").config("spark.sql.session.timeZone", "UTC")
    if args.threads:
        b = b.master(f"local[{args.threads}]").config("spark.sql.shuffle.partitions", args.threads)
    if args.mem:
        b = b.config("spark.driver.memory", args.mem)
    return b.getOrCreate()


def prepare(spark, args) -> dict:
    events = readers.read_raw_events(spark, args.raw, args.strict)
    sinks.write_lake(events, args.lake)
    if args.dimension:
        sinks.write_single(readers.read_dimension(spark, args.dimension), f"{args.lake}/apps_dim")
    base = readers.read_lake(spark, args.lake)
    if args.manifest:
        sinks.write_json({"days": readers.day_manifest(base)}, args.manifest)
    return build(spark, args)


def build(spark, args) -> dict:
    base = readers.read_lake(spark, args.lake)
    wide = [wide_view(g, d) for g in WIDE_GRAINS for d in WIDE_DIMS if (args.users or d != "user_id") and fits(base, g, d, args.max_rows)]
    store = ViewStore(spark, args.mvs)
    store.clean_staging()
    done = store.build_all([*FIXED, *([] if args.fixed_only else wide), *(REBUILT if args.rebuilt else [])], base, args.workers)
    return {k: {"status": s.status, "rows": s.rows, "seconds": s.seconds, "error": s.error} for k, s in done.items()}


def engine_of(spark, args) -> Engine:
    store = ViewStore(spark, args.mvs) if args.mvs else None
    base = readers.read_lake(spark, args.lake) if args.lake else readers.read_raw_events(spark, args.raw, args.strict)
    return Engine(base, full_catalog() if store else {}, store and store.read, store.ready if store else (lambda _: False), store and store.rows())


def run(spark, args) -> dict:
    engine, specs, told = engine_of(spark, args), readers.query_files(args.queries), {}
    os.makedirs(args.out, exist_ok=True)
    for names in chunks(list(specs)):
        frames, held = engine.batch({n: specs[n] for n in names}) if args.batch else ({}, [])
        for n in names:
            began = time.perf_counter()
            if args.approx_sample is not None:
                frame = engine.frame(specs[n], sample=args.approx_sample, seed=args.approx_seed)
            else:
                frame = frames.get(n) or engine.frame(specs[n])
            decision = engine.plan(specs[n])
            rows = sinks.write_csv_file(frame, f"{args.out}/{n}.csv")
            seconds = time.perf_counter() - began
            told[n] = {"target": decision.target if args.approx_sample is None and not args.batch else "events", "rows": rows, "seconds": seconds}
            record = engine.telemetry.record(n, decision, 0.0)
            record.execution_ms, record.rows = seconds * 1000, rows
            engine.analyzer.record(specs[n], bool(decision.plan), seconds)
        for h in held:
            h.unpersist()
    if args.telemetry:
        engine.telemetry.export(f"{args.out}/telemetry.json")
    if args.adaptive:
        sinks.write_json(engine.analyzer.report(engine.catalog), f"{args.out}/mv_suggestions.json")
    sinks.write_json(told, f"{args.out}/report.json")
    return told


def baseline(spark, args) -> dict:
    args.mvs = None
    return run(spark, args)


def validate(spark, args) -> dict:
    engine = engine_of(spark, args)
    specs = readers.query_files(args.queries)
    return guardrails.report([(n, same_rows(engine.frame(s), engine.frame(s, views=False))) for n, s in specs.items() if engine.plan(s).plan])


def check_integrity(spark, args) -> dict:
    results = integrity.check_store(readers.read_lake(spark, args.lake), ViewStore(spark, args.mvs), full_catalog())
    if args.update_health_table and results:
        sinks.append(integrity.health_table(spark, results), f"{args.mvs}/mv_health")
    return {r["view"]: r for r in results}


def check_guardrails(spark, args) -> dict:
    base = readers.read_lake(spark, args.lake)
    low, high = map(str, base.agg({"day": "min"}).head() + base.agg({"day": "max"}).head())
    values = [(r["check"], r.passed) for r in guardrails.check_values(base, low, high).collect()]
    return guardrails.report([*values, *guardrails.check_types(base), *guardrails.check_settings(spark)])


def run_repair(spark, args) -> dict:
    folders = repair.repair_day_folders(spark, f"{args.lake}/events")
    base = readers.read_lake(spark, args.lake)
    keep, bad = repair.quarantine(base)
    counts = {r.constraint: r.rows for r in repair.count_violations(keep).collect()}
    if args.out:
        sinks.write_csv(repair.rejected(base), f"{args.out}/quarantine")  # every row; the report is cut
        sinks.write_csv(repair.quarantine_report(bad), f"{args.out}/quarantine_report")
        sinks.write_partitioned(repair.enforce(keep), f"{args.out}/events", ("type", "day"), ("country",))
    return {"folders": folders, "violations": counts, "next": repair.next_steps(counts)}


def explain(spark, args) -> dict:
    engine = engine_of(spark, args)
    return {n: asdict(engine.explain(s)) for n, s in readers.query_files(args.queries).items()}


COMMANDS = {"explain": explain, "prepare": prepare, "build": build, "run": run, "baseline": baseline, "validate": validate, "integrity": check_integrity, "guardrails": check_guardrails, "repair": run_repair}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="gristmill", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("command", choices=COMMANDS)
    for flag in ("raw", "lake", "mvs", "queries", "out", "dimension", "manifest", "mem"):
        p.add_argument(f"--{flag}")
    p.add_argument("--threads", type=int)
    p.add_argument("--workers", type=int, default=4)
    p.add_argument("--max-rows", type=int, default=80_000_000)
    p.add_argument("--approx-sample", type=float)
    p.add_argument("--approx-seed", type=int, default=42)
    for flag in ("strict", "users", "fixed-only", "rebuilt", "adaptive", "telemetry", "batch", "update-health-table"):
        p.add_argument(f"--{flag}", action="store_true")
    return p


def main(argv: list[str] | None = None) -> dict:
    args = parser().parse_args(argv)
    told = COMMANDS[args.command](session(args), args)
    print(told)
    return told


if __name__ == "__main__":
    main()
