"""Groups too large for one task must give the same results as ordinary ones."""

import statistics

import pytest
from pyspark.sql import functions as F

from indexwright.operators import quantiles, screening
from indexwright.operators.matching import relatives
from indexwright.plans.replay import input_hash, observation_hashes, with_input_hash


def _skewed(spark, n=3000):
    """One stratum with two thirds of the pairs and heavily repeated values."""
    return spark.range(n).selectExpr(
        "case when id % 3 < 2 then 'HOT' else concat('R', id % 20) end route", "'T1' bucket",
        "date'2026-07-02' obs_date", "concat('k', id) pair_key", "cast(100 as decimal(12,2)) previous_fare",
        "cast(case when id % 2 = 0 then 100 else 60 + pmod(hash(id), 120) end as decimal(12,2)) current_fare",
        "1L quotes", "'PAIRED' status")


def _rows(frame):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in frame.collect()), key=repr)


def _quantile(values, fraction):
    values, at = sorted(values), fraction * (len(values) - 1)
    lo = int(at)
    return values[lo] if lo + 1 >= len(values) else values[lo] + (at - lo) * (values[lo + 1] - values[lo])


def test_spread_against_brute_force(spark):
    pairs = relatives(_skewed(spark))
    strata = {}
    for r in pairs.filter("plausible").collect():
        strata.setdefault(r["route"], []).append(r["log_relative"])
    got = {r["route"]: r for r in screening.stratum_spread(pairs).select("route", "n", "p5", "p95", "median", "mad", "mean_ad").distinct().collect()}
    assert set(got) == set(strata)
    for route, logs in strata.items():
        median = statistics.median(logs)
        away = [abs(x - median) for x in logs]
        want = [len(logs), _quantile(logs, 0.05), _quantile(logs, 0.95), median, statistics.median(away), sum(away) / len(away)]
        assert all(abs(a - b) < 1e-9 for a, b in zip(got[route][1:], want))


@pytest.mark.parametrize("partitions", ["1", "37"])
def test_ranked_quantiles_against_brute_force(spark, partitions):
    # Groups of one row to two thirds of all; in one, most values crowd around a point, in another all are equal.
    rows = spark.range(5000).selectExpr(
        "case when id % 3 < 2 then 'HOT' when id % 30 = 2 then 'EQUAL' when id % 1000 = 5 then 'FEW' when id = 8 then 'ONE' else concat('G', id % 40) end g",
        "case when id % 30 = 2 then 7D when id % 3 < 2 then 1 + pmod(hash(id), 997) * 1e-12 when id = 11 then null else cast(pmod(hash(id), 50) as double) / 7 end v")
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r["g"]: r for r in quantiles.ranked_quantiles(rows, ["g"], "v", {"m": 0.5, "p": 0.05, "top": 1.0}).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])
    values = {}
    for r in rows.filter("v is not null").collect():
        values.setdefault(r["g"], []).append(r["v"])
    assert set(got) == set(values)
    for g, vs in values.items():
        assert got[g]["group_rows"] == len(vs) and got[g]["top"] == max(vs)
        assert abs(got[g]["m"] - statistics.median(vs)) < 1e-15 and abs(got[g]["p"] - _quantile(vs, 0.05)) < 1e-15


def test_a_large_group_is_ranked_in_pieces(spark):
    rows = spark.range(4000).selectExpr("'HOT' g", "cast(id as double) v")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed = rows.repartitionByRange(16, "g", "v").groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(placed) == 16 and max(r["count"] for r in placed) < 500


def test_digest_depends_on_the_group_alone(spark):
    q = spark.range(2000).selectExpr(
        "case when id < 1500 then 'HOT' else 'X' end route", "concat('k', id % 700) pair_key",
        "cast(id % 13 + 1 as decimal(12,2)) total_fare")
    once = {r["route"]: r for r in input_hash(q, ["route"]).collect()}
    assert once == {r["route"]: r for r in input_hash(q.repartition(9), ["route"]).collect()}
    more = spark.range(50_000).selectExpr("concat('R', id % 3) route", "concat('k', id) pair_key", "cast(id % 90 + 1 as decimal(12,2)) total_fare")
    beside = {r["route"]: r for r in input_hash(q.unionByName(more), ["route"]).collect()}
    assert {k: beside[k] for k in once} == once and once["HOT"]["quotes"] == 1500
    changed = q.withColumn("total_fare", F.when(F.col("pair_key") == "k5", 99).otherwise(F.col("total_fare")).cast("decimal(12,2)"))
    assert input_hash(changed, ["route"]).filter("route = 'HOT'").first()["input_hash"] != once["HOT"]["input_hash"]
    twice = q.filter("route = 'X'").unionByName(q.filter("route = 'X'"))
    assert input_hash(twice, ["route"]).first()["input_hash"] != once["X"]["input_hash"]


def test_hashes_of_three_levels(spark):
    """Levels hold the digest of all their quotes; an append changes the hashes of its own day only."""
    columns = "route string, bucket string, d string, pair_key string, f int"
    rows = [(r, b, d, f"k{i}", 100 + i) for r in ("X", "Y") for b in ("T1", "T7") for d in ("2026-01-01", "2026-01-02") for i in range(20)]
    frame = lambda rows: spark.createDataFrame(rows, columns).selectExpr(
        "route", "bucket", "cast(d as date) collected_date", "pair_key", "cast(f as decimal(12,2)) total_fare")
    quotes = frame(rows)
    hashes = {(str(r["obs_date"]), r["level"], r["route"], r["bucket"]): r["input_hash"] for r in observation_hashes(quotes).collect()}
    for level, keys in (("STRATUM", ["route", "bucket"]), ("ROUTE", ["route"]), ("HEADLINE", [])):
        for r in input_hash(quotes, ["collected_date", *keys]).collect():
            place = [r[k] if k in keys else None for k in ("route", "bucket")]
            assert hashes[str(r["collected_date"]), level, *place] == r["input_hash"]
    assert len(hashes) == 2 * (4 + 2 + 1)
    more = {(str(r["obs_date"]), r["level"], r["route"], r["bucket"]): r["input_hash"]
            for r in observation_hashes(quotes.unionByName(frame([("X", "T1", "2026-01-02", "new", 7)]))).collect()}
    assert {k for k in more if more[k] != hashes[k]} == {
        ("2026-01-02", "STRATUM", "X", "T1"), ("2026-01-02", "ROUTE", "X", None), ("2026-01-02", "HEADLINE", None, None)}
    lone = spark.createDataFrame([("2026-01-09", "ROUTE", "X", None)], "d string, level string, route string, bucket string").selectExpr(
        "cast(d as date) obs_date", "level", "route", "bucket")
    assert with_input_hash(lone, observation_hashes(quotes)).first()["input_hash"].startswith("e3b0c44298fc1c14")
