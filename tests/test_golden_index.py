"""Published golden values of the index core."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from indexwright.operators import aggregate, screening
from indexwright.operators.elementary import chain, elementary, stratum_days, stratum_index
from indexwright.operators.matching import match_periods, relatives
from indexwright.plans.index_run import run_index, stratum_table

GOLDEN = [
    ("6E-101-SAVER", 5000, 5000), ("6E-102-SAVER", 5500, 5610), ("6E-103-SAVER", 6000, 6300),
    ("6E-104-SAVER", 6500, 6695), ("6E-105-SAVER", 6200, 20000),
]


def _gm(pairs, mode):
    row = elementary(stratum_days(pairs, mode, with_flags=True)).first()
    return row


def _index(pairs, mode):
    """The index a day after a base of 100."""
    stats = stratum_days(pairs, mode, with_flags=True).drop("flagged")
    base = stats.withColumn("obs_date", F.date_sub("obs_date", 1))
    return chain(base.unionByName(stats)).orderBy(F.desc("obs_date")).first()["index_value"]


def test_golden_pairs_reject(pairs_of):
    pairs = pairs_of(GOLDEN)
    row = _gm(pairs, "REJECT")
    assert row["gm_relative"] == Decimal("1.024841")
    assert (row["accepted"], row["rejected"]) == (4, 1)
    assert _index(pairs, "REJECT") == Decimal("102.484143")
    rules = screening.screen(relatives(pairs), "REJECT").filter("rule_id is not null").collect()
    assert [(r["pair_key"], r["rule_id"], r["kept"]) for r in rules] == [
        ("6E-105-SAVER", "OUTLIER_MAD_LOG_RELATIVE", False)]
    assert rules[0]["score"] == pytest.approx(40.04, abs=0.01)


def test_golden_pairs_flag_keeps_all(pairs_of):
    row = _gm(pairs_of(GOLDEN), "FLAG")
    assert (row["accepted"], row["rejected"], row["flagged"]) == (5, 0, 1)


def test_route_and_headline_golden(spark):
    strata = spark.createDataFrame(
        [("A-B", b, "102.484143" if b == "T7" else "100") for b in ("T1", "T7", "T15", "T21", "T30", "T45")],
        "route string, bucket string, v string",
    ).selectExpr(
        "route", "bucket", "date'2026-07-02' obs_date", "cast(v as decimal(18,6)) index_value",
        "1L raw_quotes", "1L input_quote_count", "0L excluded_count", "0 insufficient")
    assert aggregate.route_index(strata).first()["index_value"] == Decimal("100.414024")
    parts = spark.createDataFrame(
        [(r, "100.414024" if r == "A" else "100") for r in "ABCD"], "route string, v string"
    ).selectExpr("date'2026-07-02' obs_date", "route", "cast(0.25 as decimal(10,8)) weight",
                 "cast(v as decimal(18,6)) index_value", "cast(100 as decimal(18,6)) previous_index")
    top = aggregate.weighted_arithmetic(parts, ["obs_date"]).first()
    assert top["index_value"] == Decimal("100.103506")
    assert top["movement"] == Decimal("0.103506")
    got = {r["route"]: r["contribution"] for r in aggregate.contributions(parts, ["obs_date"]).collect()}
    assert got["A"] == Decimal("0.103506") and got["B"] == 0


def test_contributions_need_every_previous(spark):
    parts = spark.createDataFrame(
        [("A", "101", "100"), ("B", "100", None)], "route string, v string, p string"
    ).selectExpr("date'2026-07-02' obs_date", "route", "cast(0.5 as decimal(10,8)) weight",
                 "cast(v as decimal(18,6)) index_value", "cast(p as decimal(18,6)) previous_index")
    assert aggregate.contributions(parts, ["obs_date"]).count() == 0
    assert aggregate.weighted_arithmetic(parts, ["obs_date"]).first()["movement"] is None


def test_bad_weight_stops_the_job(spark):
    parts = spark.createDataFrame([("A",)], "route string").selectExpr(
        "date'2026-07-02' obs_date", "route", "cast(0 as decimal(10,8)) weight",
        "cast(100 as decimal(18,6)) index_value", "cast(null as decimal(18,6)) previous_index")
    with pytest.raises(Exception, match="positive"):
        aggregate.weighted_arithmetic(parts, ["obs_date"]).collect()


def test_mad_zero_falls_back_to_mean_deviation(pairs_of):
    rows = [("a", 5000, 5100), ("b", 6000, 6120), ("c", 7000, 7140), ("d", 8000, 8160), ("e", 5000, 21000)]
    row = _gm(pairs_of(rows), "REJECT")
    assert (row["accepted"], row["rejected"]) == (4, 1)
    assert row["gm_relative"] == Decimal("1.020000")


def test_small_stratum_is_winsorised_or_flagged(pairs_of):
    rows = [("a", 100, 100), ("b", 100, 100), ("c", 100, 100), ("d", 100, 300)]
    assert _index(pairs_of(rows), "REJECT") == Decimal("126.295613")
    assert _index(pairs_of(rows), "FLAG") == Decimal("131.607401")


def test_six_pairs_one_tripled(pairs_of):
    rows = [(c, 100, 100) for c in "abcde"] + [("f", 100, 300)]
    assert _index(pairs_of(rows), "REJECT") == Decimal("100.000000")
    assert round(_index(pairs_of(rows), "FLAG"), 2) == Decimal("120.09")
    assert _gm(pairs_of(rows), "FLAG")["flagged"] == 1


def test_market_wide_doubling_is_untouched(pairs_of):
    row = _gm(pairs_of([(c, 100, 200) for c in "abcd"]), "FLAG")
    assert row["gm_relative"] == Decimal("2.000000") and row["flagged"] == 0


def test_plausibility_bounds_are_inclusive(pairs_of):
    rows = [("lo", 100, 1), ("hi", 1, 100), ("below", "100.01", 1), ("above", 1, "100.01"), ("x", 5, 5)]
    row = _gm(pairs_of(rows), "FLAG")
    assert (row["accepted"], row["implausible"], row["rejected"]) == (3, 2, 2)


def test_non_positive_price_stops_the_job(pairs_of):
    with pytest.raises(Exception, match="non-positive price"):
        stratum_days(pairs_of([("a", 100, 0), ("b", 1, 1)])).collect()


def test_below_minimum_is_insufficient_not_zero(pairs_of):
    row = _gm(pairs_of([("a", 100, 110), ("b", 100, 110)]), "FLAG")
    assert row["gm_relative"] is None and row["insufficient"]


DAYS = ["2026-07-01", "2026-07-02", "2026-07-04", "2026-07-05"]


def _series(quotes_of, fares, route="A-B", bucket="T7", keys="xyz"):
    return quotes_of([(route, bucket, k, d, f) for d, f in fares for k in keys])


def test_chain_over_a_gap_uses_the_older_index(quotes_of):
    gap = [(DAYS[0], 100), (DAYS[1], 110), (DAYS[3], 200)]
    other = [("C-D", "T7", k, d, 50) for d in DAYS for k in "xyz"]
    q = _series(quotes_of, gap).unionByName(quotes_of(other))
    got = [(str(r["obs_date"]), r["index_value"]) for r in
           stratum_index(q).filter("route = 'A-B'").orderBy("obs_date").collect()]
    # The third day is missing, so the fourth has no pairs with the global previous day.
    assert got == [(DAYS[0], Decimal("100.000000")), (DAYS[1], Decimal("110.000000")), (DAYS[3], None)]


def test_counts_of_first_and_measured_days(quotes_of):
    q = _series(quotes_of, [(DAYS[0], 100), (DAYS[1], 110)]).unionByName(
        quotes_of([("A-B", "T7", "x", DAYS[1], 105), ("A-B", "T7", "new", DAYS[1], 90)]))
    rows = stratum_index(q).orderBy("obs_date").collect()
    assert [r["input_quote_count"] for r in rows] == [3, 3]
    assert [r["raw_quotes"] for r in rows] == [3, 5]
    matched = {(r["pair_key"], r["status"]) for r in match_periods(q).filter(f"obs_date = '{DAYS[1]}'").collect()}
    assert ("new", "NEW") in matched and ("x", "PAIRED") in matched


def test_invariants(quotes_of):
    rows = [("A-B", "T7", f"k{i}", d, 100 + 7 * i + 3 * j * (i % 3)) for i in range(6) for j, d in enumerate(DAYS)]
    q = quotes_of(rows)
    base = sorted(map(tuple, stratum_index(q).collect()))
    assert sorted(map(tuple, stratum_index(q.repartition(7)).collect())) == base
    doubled = q.withColumn("total_fare", (F.col("total_fare") * 2).cast("decimal(12,2)"))
    assert sorted(map(tuple, stratum_index(doubled).collect())) == base
    for k in (2.5, 1e6):
        assert sorted(map(tuple, stratum_index(q, k=k).collect())) == base
    flat = q.withColumn("total_fare", F.lit(100).cast("decimal(12,2)"))
    assert {r["index_value"] for r in stratum_index(flat).collect()} == {Decimal("100.000000")}


def test_headline_is_refused_on_simulated_days(spark, quotes_of):
    rows = [(r, "T7", k, d, 100 + i, "SIMULATED_DEMO" if (d == DAYS[1] and r == "A-B") else "LIVE_COLLECTED")
            for i, d in enumerate(DAYS[:3]) for r in ("A-B", "C-D") for k in "xyz"]
    weights = spark.createDataFrame([("A-B",), ("C-D",)], "route string").selectExpr("route", "cast(0.5 as decimal(10,8)) weight")
    run = run_index(quotes_of(rows), weights)
    assert [str(r["obs_date"]) for r in run.refused.collect()] == [DAYS[1]]
    heads = run.headline.orderBy("obs_date").collect()
    assert [str(r["obs_date"]) for r in heads] == [DAYS[0], DAYS[2]]
    # The stored previous is the last headline that was not refused.
    assert heads[1]["prev_index_value"] == heads[0]["index_value"]
    assert {str(r["obs_date"]) for r in run.contributions.collect()} == {DAYS[2]}


def test_imputation_moves_with_the_other_buckets(quotes_of):
    rows = [("A-B", b, k, d, f) for b in ("T1", "T7") for k in "xyz" for d, f in zip(DAYS, (100, 110, 121, 121))
            if not (b == "T7" and d == DAYS[2])]
    got = {(r["bucket"], str(r["obs_date"])): r for r in stratum_table(quotes_of(rows), missing="impute").collect()}
    assert got[("T7", DAYS[2])]["index_value"] == Decimal("121.000000")
    assert got[("T7", DAYS[2])]["insufficient"] == 1
    assert stratum_table(quotes_of(rows)).filter(f"bucket = 'T7' and obs_date = '{DAYS[2]}'").count() == 0
