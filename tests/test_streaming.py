"""Incremental ingest gives the same index as one run over everything."""

from datetime import date

from pyspark.sql import functions as F

from indexwright.operators.elementary import stratum_index
from indexwright.streaming.incremental import chain_states, inserts_a_day, newest_states, run_incremental

DAYS = ["2026-07-01", "2026-07-02", "2026-07-03", "2026-07-04"]


def _quotes(spark, days, bump=0):
    rows = [(f"{r}{b}{k}{d}{bump}", 0, r, b, f"k{k}", d, 100 + 5 * k + 3 * i + bump)
            for r in ("A-B", "C-D") for b in ("T1", "T7") for k in range(4) for i, d in enumerate(days)]
    return spark.createDataFrame(
        rows, "query_hash string, ordinal int, route string, bucket string, pair_key string, d string, f int"
    ).selectExpr("query_hash", "ordinal", "route", "bucket", "pair_key", "cast(d as date) collected_date",
                 "cast(d as timestamp) collected_at", "cast(f as decimal(12,2)) total_fare")


def test_incremental_matches_full(spark, tmp_path):
    places = [str(tmp_path / n) for n in ("in", "quotes", "index", "state")]
    arrivals = [
        _quotes(spark, DAYS[:2]),
        # A repeated offer, and the third day still missing.
        _quotes(spark, DAYS[3:]).unionByName(_quotes(spark, DAYS[:1]).limit(3)),
        # The missing day, late: it becomes the predecessor of the last for every stratum.
        _quotes(spark, DAYS[2:3]).filter("route = 'A-B' and pair_key <> 'k3'"),
    ]
    schema = arrivals[0].schema
    for part in arrivals:
        part.coalesce(1).write.mode("append").parquet(places[0])
        run_incremental(spark, *places, schema)
    everything = spark.read.schema(schema).parquet(places[1])
    assert everything.count() == sum(a.count() for a in arrivals) - 3
    _same_as_full_run(spark, everything, places[2])
    assert spark.read.parquet(places[2]).filter("revision = 2").count() > 0


def _same_as_full_run(spark, quotes, index_table):
    want = {tuple(r) for r in stratum_index(quotes).filter("index_value is not null").select(
        "route", "bucket", "obs_date", "index_value").collect()}
    newest = spark.read.parquet(index_table).groupBy("route", "bucket", "obs_date").agg(F.max_by("index_value", "revision").alias("v"))
    assert {tuple(r) for r in newest.filter("v is not null").collect()} == want


def test_very_late_quotes_count_and_dead_days_are_revised(spark, tmp_path):
    """Quotes that come three years late enter, and a day they leave without a match loses its value."""
    places = [str(tmp_path / n) for n in ("in", "quotes", "index", "state")]
    arrivals = [
        _quotes(spark, ["2026-07-01", "2026-07-04"]),
        _quotes(spark, ["2023-07-02"]),
        # A day between, of other products: the last day's predecessor has no product of it.
        _quotes(spark, ["2026-07-02"]).withColumn("pair_key", F.concat(F.lit("z"), "pair_key")),
    ]
    schema = arrivals[0].schema
    for part in arrivals:
        part.coalesce(1).write.mode("append").parquet(places[0])
        run_incremental(spark, *places, schema)
    everything = spark.read.schema(schema).parquet(places[1])
    assert everything.count() == sum(a.count() for a in arrivals)
    assert everything.filter("collected_date = '2023-07-02'").count() > 0
    assert spark.read.parquet(places[2]).filter("index_value is null").count() > 0
    _same_as_full_run(spark, everything, places[2])


def test_inserting_a_day_is_noticed(spark):
    assert inserts_a_day(_quotes(spark, DAYS[1:2]), _quotes(spark, [DAYS[0], DAYS[2]]))
    assert not inserts_a_day(_quotes(spark, DAYS[3:]), _quotes(spark, DAYS[:3]))
    assert not inserts_a_day(_quotes(spark, DAYS[:1]), _quotes(spark, DAYS[:3]))


MONTHS = ["2026-01-30", "2026-01-31", "2026-02-02", "2026-02-20", "2026-03-01", "2026-03-15", "2026-04-01"]


def test_a_batch_reads_nothing_before_the_month_it_touches(spark, tmp_path):
    """Stored quotes of earlier months are made unreadable; the chains go on from their states."""
    places = [str(tmp_path / n) for n in ("in", "quotes", "index", "state")]
    arrivals = [
        _quotes(spark, MONTHS[:-2]),
        _quotes(spark, MONTHS[-2:]),
        # Late quotes of one route in March, on a day known and on a day between.
        _quotes(spark, ["2026-03-01", "2026-03-10"], bump=2).filter("route = 'A-B'"),
    ]
    schema = arrivals[0].schema
    everything = arrivals[0]
    for number, part in enumerate(arrivals):
        part.coalesce(1).write.mode("append").parquet(places[0])
        if number:
            everything = everything.unionByName(part)
            for file in (tmp_path / "quotes").glob("*/collected_date=2026-01-*/*"):
                file.write_bytes(b"unreadable")
        run_incremental(spark, *places, schema)
        _same_as_full_run(spark, everything, places[2])
    states = spark.read.parquet(f"{places[2]}-chains")
    assert states.filter("batch = 2").agg(F.min("month")).first()[0].isoformat() == "2026-03-01"


def test_a_month_that_loses_its_values_hides_its_state(spark):
    rows = "route string, bucket string, obs_date date, index_value decimal(18,6)"
    old = spark.createDataFrame([("A-B", "T1", date.fromisoformat("2026-01-05"), 100), ("A-B", "T1", date.fromisoformat("2026-02-05"), 101)],
                                "route string, bucket string, obs_date date, v int").selectExpr("route", "bucket", "obs_date", "cast(v as decimal(18,6)) index_value")
    chains = chain_states(old).withColumn("batch", F.lit(0))
    starts = spark.createDataFrame([("A-B", "T1", date.fromisoformat("2026-02-01"))], "route string, bucket string, start date")
    after = chain_states(spark.createDataFrame([], rows), starts, chains).withColumn("batch", F.lit(1))
    found = {r["month"].isoformat(): r["state"] for r in newest_states(chains.unionByName(after)).collect()}
    assert found == {"2026-01-01": 100, "2026-02-01": None}
