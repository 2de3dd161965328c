import datetime
import json

import pytest
from pyspark.sql import functions as F

from gristmill import cli
from gristmill.operators.compare import mismatches, same_rows, sample_keys
from gristmill.plans.catalog import full_catalog, wide_view
from gristmill.engine import Engine
from gristmill.plans.cost import shape
from gristmill.quality import guardrails, integrity, repair
from gristmill.schema import COLUMNS, adapt_events
from gristmill.sources import readers, sinks
from gristmill.spec import QuerySpec
from gristmill.streaming.refresh import read_view, stream_view, windowed
from gristmill.suite import ALL, COST_SUITE


@pytest.fixture(scope="module")
def events(spark, sf_dir):
    return adapt_events(spark, sf_dir).persist()


def test_raw_parts_with_different_columns(spark, tmp_path):
    (tmp_path / "events_part_0.csv").write_text("ts,type,auction_id,advertiser_id,publisher_id,bid_price,user_id,total_price,country\n1704067200000,impression,a1,12.7,3,1.5,9,,US\nbad,click,a2,1,1,,1,,JP\n1704070800000,purchase,a3,abc,2,,8,4.25,DE\n")
    (tmp_path / "events_part_1.csv").write_text("ts,type,country,extra\n1704153600000,serve,FR,x\n")
    rows = readers.read_raw_events(spark, f"{tmp_path}/events_part_*.csv").orderBy("ts").collect()
    assert [r.type for r in rows] == ["impression", "purchase", "serve"]  # the unreadable time is dropped
    assert rows[0].advertiser_id == 13 and rows[1].advertiser_id is None and rows[2].bid_price is None
    (tmp_path / "whole.csv").write_text("ts,user_id\n1704067200000,9007199254740993\n1704067200000, 7.6 \n1704067200000,99999999999999999999\n")
    assert sorted(str(r.user_id) for r in readers.read_raw_events(spark, f"{tmp_path}/whole.csv").collect()) == ["8", "9007199254740993", "None"]
    assert rows[0].total_price is None and rows[1].total_price == 4.25
    assert rows[1].hour.hour == 1 and rows[0].week == datetime.date(2024, 1, 1) and rows[0].minute == "2024-01-01 00:00"
    with pytest.raises(FileNotFoundError):
        readers.read_csv(spark, f"{tmp_path}/none*.csv")


def test_command_line_from_raw_to_checks(spark, tmp_path):
    raw = readers.synthetic_events(spark, 3000, partitions=2).select(F.unix_millis("ts").alias("ts"), "type", "auction_id", "advertiser_id", "publisher_id", "bid_price", "user_id", "total_price", "country")
    sinks.write_csv(raw, f"{tmp_path}/raw")
    (tmp_path / "q").mkdir()
    for k in ("q3_avg_purchase_by_country", "s6_impressions_per_country", "q4_advertiser_type_counts"):
        (tmp_path / "q" / f"{k}.json").write_text(json.dumps(ALL[k]))
    lake, mvs = f"{tmp_path}/lake", f"{tmp_path}/mvs"
    built = cli.main(["prepare", "--raw", f"{tmp_path}/raw/*.csv", "--lake", lake, "--mvs", mvs, "--fixed-only", "--manifest", f"{tmp_path}/days.json"])
    assert all(v["status"] == "READY" for v in built.values()) and readers.read_lake(spark, lake).count() == 3000
    told = cli.main(["run", "--lake", lake, "--mvs", mvs, "--queries", f"{tmp_path}/q", "--out", f"{tmp_path}/out", "--telemetry", "--adaptive"])
    assert told["q4_advertiser_type_counts"]["target"] == "mv_all_adv_type_counts" and (tmp_path / "out" / "telemetry.json").exists()
    base = cli.main(["baseline", "--lake", lake, "--queries", f"{tmp_path}/q", "--out", f"{tmp_path}/base"])
    for k in told:
        assert told[k]["rows"] == base[k]["rows"]
        assert sorted((tmp_path / "out" / f"{k}.csv").read_text().splitlines()) == sorted((tmp_path / "base" / f"{k}.csv").read_text().splitlines())
    assert not cli.main(["validate", "--lake", lake, "--mvs", mvs, "--queries", f"{tmp_path}/q"])["failed"]
    assert "timezone_utc" not in cli.main(["guardrails", "--lake", lake])["failed"]
    manifest = json.loads((tmp_path / "days.json").read_text())["days"]
    spec = QuerySpec.parse({"select": ["day"], "where": [{"col": "day", "op": "between", "val": ["2024-03-01", "2024-03-02"]}]})
    picked = readers.manifest_files(manifest, spec)
    assert readers.read_paths(spark, lake, picked).select("day").distinct().count() == 2
    plan = readers.read_lake(spark, lake).where("day = date'2024-03-01'")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(day" in plan


def test_quarantine_constraints_and_folders(spark, events, tmp_path):
    bad = events.withColumn("publisher_id", F.when(F.col("publisher_id") > 0, F.col("publisher_id"))).withColumn("country", F.when(F.col("user_id") % 7 == 0, "USA").otherwise(F.col("country")))
    keep, out = repair.quarantine(bad)
    assert keep.count() + out.count() == bad.count() and out.where("publisher_id is not null").isEmpty()
    counts = {r.constraint: r.rows for r in repair.count_violations(bad).collect()}
    assert counts["country"] == bad.where("country = 'USA'").count() and counts["total_price"] == 0
    assert repair.enforce(bad).where("country = 'USA' or type = 'error'").isEmpty()
    assert repair.quarantine_report(out, 5).count() == 5
    assert [repair.normal_day(x) for x in ("2024-01-01%2008%3A00%3A00%2B00", "2024/1/5", "20240230", "1999-01-01", "x")] == ["2024-01-01", "2024-01-05", None, None, None]
    for name in ("day=2024-01-01", "day=2024-01-01%2008%3A00", "day=20240102", "day=never"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "part-0").write_text(name)
    done = repair.repair_day_folders(spark, f"file://{tmp_path}")
    assert done["merged"] and done["renamed"] == ["day=20240102"] and done["unreadable"] == ["day=never"]
    assert len([p for p in (tmp_path / "day=2024-01-01").iterdir() if not p.name.startswith(".")]) == 2


def test_health_of_views(spark, events):
    mv = wide_view("day", "country")
    view = mv.frame(events)
    assert integrity.health(events, view, mv)["status"] == "OK"
    assert integrity.health(events.where("country <> 'US'"), view, mv)["status"] == "STALE"
    assert integrity.health(events, view.drop("events_all"), mv)["status"] == "ERROR"
    keys = sample_keys(view, ["day", "country"], 4)
    assert keys.count() == 4 and same_rows(keys, sample_keys(view, ["day", "country"], 4))
    off = view.withColumn("events_all", F.col("events_all") + (F.col("country") == "JP").cast("int"))
    assert mismatches(view, off, ["day", "country"], ["events_all"]).select("country").distinct().collect()[0].country == "JP"


def test_guardrails(events):
    failed = [r["check"] for r in guardrails.check_values(events, "2024-01-05", "2024-01-09").collect() if not r.passed]
    assert not failed and all(ok for _, ok in guardrails.check_types(events))
    assert guardrails.check_types(events.withColumn("day", F.col("day").cast("string")))[2] == ("type_day", False)


def test_streams_refresh_views(spark, events, tmp_path):
    mv = full_catalog()["mv_day_country_type_adv"]
    for part in (0, 1):
        events.where(F.col("user_id") % 2 == part).write.mode("append").parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    stream_view(source, mv, f"{tmp_path}/view", f"{tmp_path}/state").awaitTermination(120)
    assert same_rows(read_view(spark, mv, f"{tmp_path}/view"), mv.frame(events).select(*(F.col(c).cast(t) for c, t in read_view(spark, mv, f"{tmp_path}/view").dtypes)))
    query = windowed(source).writeStream.outputMode("complete").format("memory").queryName("windows").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.sql("select sum(events) as n from windows").head().n == events.count()


def test_costs_of_routes(events):
    views = {k: mv.frame(events).persist() for k, mv in full_catalog().items()}
    engine = Engine(events, full_catalog(), views.get)
    plan = engine.explain(ALL["q4_advertiser_type_counts"])
    assert plan.chosen == engine.plan(ALL["q4_advertiser_type_counts"]).target and not plan.routes[0].reason
    assert {r.target for r in plan.routes} == {"events", *views} and all(r.tasks >= 1 and r.bytes > 0 for r in plan.routes)
    jp = QuerySpec.parse({"select": [{"COUNT": "*"}], "where": [{"col": "country", "op": "eq", "val": "JP"}]}, COLUMNS)
    assert engine.explain(jp).share == events.where("country = 'JP'").count() / events.count() and engine.explain(jp).most_rows == 1
    assert {shape(QuerySpec.parse(d, COLUMNS)) for d in COST_SUITE.values()} <= {"rows", "total", "series", "breakdown", "distinct counts"}


def test_repair_writes_every_row(events):
    bad = events.withColumn("total_price", F.lit(-1.0)).withColumn("advertiser_id", F.when(F.col("user_id") % 2 == 0, 1))
    rows = repair.rejected(bad)
    assert rows.count() == events.count() and rows.where("reasons like 'null key%total_price'").count() == events.where("user_id % 2 <> 0").count()


def test_csv_text_has_real_line_ends(tmp_path):
    assert sinks.csv_text(["a", "b"], [(1, "x,y")]).splitlines() == ["a,b", '1,"x,y"']
