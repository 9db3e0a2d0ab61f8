"""Tables for readers: the same answers as from quotes, changed days alone, pruned reads."""

import datetime
import random
import re

import pytest
from pyspark.sql import functions as F

from indexwright.plans import quality, reads
from indexwright.plans.stored import ReadTables


def _quotes(spark, n, seed=1, days=9):
    pick = random.Random(seed)
    rows = [(f"q{seed}-{i}", pick.choice(["A-B", "B-C", "C-A"]), pick.choice(["T1", "T7", "T21"]), datetime.date(2026, 7, 1 + pick.randrange(days)),
             pick.randrange(86400), str(pick.randrange(100, 99999) / 100), pick.choice(["LIVE_COLLECTED", "SIMULATED_DEMO"]),
             pick.choice(["COMPLETE", "PARTIAL"]), pick.choice(["HIGH", "LOW"]), pick.choice("YN")) for i in range(n)]
    return spark.createDataFrame(rows, "quote_id string, route string, bucket string, collected_date date, s int, fare string, provenance string, "
                                 "quality_status string, component_confidence string, imputation_code string").selectExpr(
        "*", "cast(collected_date as timestamp) + make_dt_interval(0, 0, 0, s) as collected_at", "cast(fare as decimal(12,2)) total_fare").drop("s", "fare")


def _rows(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


def _formatted(spark, frame):
    return spark._jvm.PythonSQLUtils.explainString(frame._jdf.queryExecution(), "formatted")


def _same_reports(tables, quotes):
    for route in (None, "b-c", "Z-Z"):
        assert _rows(quality.profile_of_parts(tables.fares, route)) == _rows(quality.lead_time_profile(quotes, route))
        for n in (1, 5, 400):
            got = [r["quote_id"] for r in tables.latest_quotes(n, route).collect()]
            assert got == [r["quote_id"] for r in reads.latest_quotes(quotes, n, route).collect()]
    assert _rows(quality.counts_of_parts(tables.quality)) == _rows(quality.quality_counts(quotes))
    assert _rows(quality.summary_of_parts(tables.quality)) == _rows(quality.quality_summary(quotes))


def test_reports_from_parts_and_changed_days(spark, tmp_path):
    quotes = _quotes(spark, 300)
    tables = ReadTables(spark, str(tmp_path / "read"))
    assert not tables.has("quotes")
    tables.put_quotes(quotes)
    tables.refresh_parts()
    _same_reports(tables, quotes)
    # Late quotes for two days and a new day: only these partitions are written again.
    late = _quotes(spark, 60, seed=2, days=11).filter("day(collected_date) in (3, 5, 11)")
    days = [r[0] for r in late.select("collected_date").distinct().collect()]
    both = spark.createDataFrame(quotes.unionByName(late).collect(), quotes.schema)
    before = {p.name: sorted(f.name for f in p.iterdir()) for p in (tmp_path / "read" / "quality").glob("collected_date=*")}
    tables.put_quotes(both, days)
    tables.refresh_parts(days)
    _same_reports(tables, both)
    after = {p.name: sorted(f.name for f in p.iterdir()) for p in (tmp_path / "read" / "quality").glob("collected_date=*")}
    changed = {f"collected_date={d}" for d in days}
    assert {k for k in after if after[k] != before.get(k)} == changed and len(after) > len(changed)


def test_listing_opens_only_the_newest_days(spark, tmp_path):
    tables = ReadTables(spark, str(tmp_path / "read"))
    tables.put_quotes(_quotes(spark, 200))
    tables.refresh_parts()
    found = tables.latest_quotes(3)
    assert found.count() == 3
    plan = _formatted(spark, found)
    assert re.search(r"PartitionFilters: \[isnotnull\(collected_date#\d+\), \(collected_date#\d+ >= Subquery", plan)


def test_index_rows(spark, tmp_path):
    tables = ReadTables(spark, str(tmp_path / "read"))
    routes = spark.createDataFrame([("A-B", "2026-07-01", 100.0), ("A-B", "2026-07-02", 101.5), ("B-C", "2026-07-02", 99.0)], "route string, d string, v double").selectExpr(
        "route", "cast(d as date) obs_date", "cast(v as decimal(18,6)) index_value", "cast(100 as decimal(18,6)) prev_index_value")
    weights = spark.createDataFrame([("A-B", 0.5, 1, "x", "2026-01-01"), ("A-B", 0.6, 1, "y", "2026-06-01")], "route string, weight double, evidence_rung int, evidence_ref string, d string").selectExpr(
        "*", "cast(d as date) effective_from").drop("d")
    tables.put_index(routes, weights)
    history = reads.route_history(tables.routes, tables.weights, "a-b").collect()
    assert [(str(r["obs_date"]), r["weight"]) for r in history] == [("2026-07-01", 0.6), ("2026-07-02", 0.6)]
    plan = _formatted(spark, tables.routes.filter("route = 'A-B'"))
    assert "PartitionFilters: [isnotnull(route" in plan


@pytest.mark.parametrize("name", ["fares", "quality", "quotes"])
def test_missing_tables_are_told(spark, tmp_path, name):
    assert not ReadTables(spark, str(tmp_path / "none")).has(name)
