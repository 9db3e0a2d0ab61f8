"""Normalisation, constraints, weights, series, publication and admission rules."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from indexwright.operators import constraints, matching, normalise, specification, uncertainty, weights
from indexwright.plans import admission, publication, quality, series

D = Decimal


def _offers(spark, rows):
    return spark.createDataFrame(
        rows, "carrier string, flight_no string, fare_brand string, total_fare string, currency string, base_fare string, taxes string")


def test_normalise(spark):
    good, bad = normalise.normalise(_offers(spark, [
        (" 6e", "6E1 ", "", "₹1,000.00", None, "900", "100"),
        ("6E", None, "S", "1000", "inr", "900", None),
        ("6E", None, "S", "1000", "INR", "900", "200"),
        ("6E", None, "S", "1000", "INR", None, None),
        ("6EX", None, None, "1", "INR", None, None), ("6E", None, None, "0", "INR", None, None),
        ("6E", None, None, "1", "USD", None, None), ("6E", None, None, "x", "INR", None, None),
        ("6E", None, None, "5", "INR", "?", None),
    ]))
    scored = normalise.quality_score(good.withColumn("provenance", F.lit("LIVE_COLLECTED"))).collect()
    assert [(r["component_confidence"], r["quality_status"], r["quality_score"]) for r in scored] == [
        ("HIGH", "COMPLETE", D("0.850")), ("MEDIUM", "COMPLETE", D("0.750")),
        ("LOW", "PARTIAL", D("0.650")), ("LOW", "PARTIAL", D("0.550"))]
    assert scored[0]["carrier"] == "6E" and scored[0]["flight_no"] == "6E1" and scored[0]["fare_brand"] is None
    assert scored[2]["components_exceed_total"]
    assert [r["reject_reason"] for r in bad.collect()] == [
        "carrier code is not two characters", "total_fare must be positive", "currency is out of scope",
        "total_fare is not a parseable amount", "base_fare is not a parseable amount"]


def test_null_flights_share_one_key(spark):
    rows = spark.createDataFrame([("6E", None, "S"), ("6E", "", None)], "carrier string, flight_no string, fare_brand string")
    assert [r[0] for r in rows.select(matching.flight_key()).collect()] == ["6E|?|S", "6E|?|?"]


def test_adversarial_rows_are_caught(spark):
    base = ("DEL-BOM", "4500", "INR", "LIVE_COLLECTED", "COMPLETE", "HIGH", "N", "NONE", "q1", "2026-07-01", "2026-07-08")
    changes = {"route_format": {0: "XX-BOM"}, "positive_fare": {1: "0"}, "currency_inr": {2: "USD"}, "provenance_known": {3: None},
               "imputed_or_sourced": {8: None}, "travel_after_collected": {10: "2026-07-01"}, "route_ends_differ": {0: "DEL-DEL"}}
    rows = [base] + [tuple(ch.get(i, v) for i, v in enumerate(base)) for ch in changes.values()]
    frame = spark.createDataFrame(
        rows, "route string, f string, currency string, provenance string, quality_status string, component_confidence string, "
        "imputation_code string, missing_reason string, quote_id string, c string, t string").selectExpr(
        "*", "cast(f as decimal(12,2)) total_fare", "cast(c as date) collected_date", "cast(t as date) travel_date",
        *[f"cast(null as decimal(12,2)) {x}" for x in ("base_fare", "taxes", "udf", "convenience_fee")])
    counts = {r["rule"]: r["violations"] for r in constraints.check(frame, constraints.quote_rules()).collect()}
    assert {k: v for k, v in counts.items() if v} == {k: 1 for k in changes}
    assert constraints.quarantine(frame, constraints.quote_rules()).count() == len(changes)


def test_null_keys(spark):
    frame = spark.createDataFrame([("a", None), ("a", None), ("b", "x"), ("b", "x")], "k string, f string")
    assert constraints.duplicate_keys(frame, ["k", "f"], nulls_equal=False).count() == 1
    assert constraints.duplicate_keys(frame, ["k", "f"], nulls_equal=True).count() == 2


def test_near_duplicates(spark):
    frame = spark.createDataFrame(
        [("1", None, "S", 5), ("2", None, "S", 5), ("3", None, "S", 6), ("4", "F1", "S", 5), ("5", None, None, 5), ("6", None, None, 5)],
        "quote_id string, flight_no string, fare_brand string, total_fare int").selectExpr(
        "*", "'s' source", "'6E' carrier", "timestamp'2026-07-01 05:00:00' departure_at", "date'2026-07-01' collected_date", "'A-B' route", "'T1' bucket")
    kept, log = matching.collapse_near_duplicates(frame)
    assert sorted(r["quote_id"] for r in kept.collect()) == ["1", "3", "4", "5"]
    assert {(r["quote_id"], r["kept_quote_id"]) for r in log.collect()} == {("2", "1"), ("6", "5")}


def test_weights_close_exactly(spark):
    traffic = spark.createDataFrame([("A-B", 1), ("C-D", 1), ("E-F", 1)], "route string, volume long")
    got = {r["route"]: r["weight"] for r in weights.weights_from_traffic(traffic, 1, "x").collect()}
    assert got == {"A-B": D("0.33333333"), "C-D": D("0.33333333"), "E-F": D("0.33333334")}
    with pytest.raises(Exception, match="non-positive traffic"):
        weights.weights_from_traffic(traffic.withColumn("volume", F.lit(0)), 1, "x").collect()
    big = spark.createDataFrame([("DEL-BOM", 79259890 * 55122422), ("DEL-GAU", 79259890 * 6160157)], "route string, volume long")
    assert sum(r["weight"] for r in weights.weights_from_traffic(big, 3, "x").collect()) == 1


def test_weight_set_that_does_not_close(spark):
    bad = spark.createDataFrame([("A-B", "0.97", 1, "x")], "route string, w string, evidence_rung int, evidence_ref string").selectExpr(
        "route", "cast(w as decimal(10,8)) weight", "evidence_rung", "evidence_ref")
    assert [r["rule"] for r in weights.validate_weights(bad).collect()] == ["not_closed"]
    assert [r["rule"] for r in weights.validate_weights(bad.filter("false")).collect()] == ["empty_set"]
    null_rung = bad.selectExpr("route", "cast(1 as decimal(10,8)) weight", "cast(null as int) evidence_rung", "' ' evidence_ref")
    assert {r["rule"] for r in weights.validate_weights(null_rung).collect()} == {"bad_evidence_rung", "missing_evidence_ref"}


def test_stratum_error_needs_two_pairs(spark):
    rows = spark.createDataFrame([(1, None), (2, 0.02), (9, 0.02)], "accepted int, var_log double").selectExpr(
        "*", "cast(100 as decimal(18,6)) index_value")
    got = {r["accepted"]: r for r in uncertainty.stratum_error(rows).collect()}
    assert got[1]["standard_error"] is None and got[1]["lower_95"] is None
    assert got[2]["standard_error"] == D("10.000000") and got[2]["upper_95"] == D("227.060000")
    assert got[9]["upper_95"] == D("109.239528") and got[2]["relative_error_pct"] == D("10.000")


def test_specification(spark):
    rows = spark.createDataFrame([("DEL-BOM", "6e", None, None), ("DEL-BOM", "6e", "S", 15)],
                                 "route string, carrier string, fare_brand string, baggage_kg int")
    got = specification.specification(rows).collect()
    assert got[0]["match_key"] == "DEL-BOM|6E|ECONOMY|ONE_WAY|DIRECT|MORNING|?|?|UNKNOWN|UNKNOWN|ADULT"
    assert len(got[0]["match_hash"]) == 16 and not got[1]["fully_specified"]


def _daily(spark, rows):
    return spark.createDataFrame(rows, "d string, v string").selectExpr("cast(d as date) obs_date", "cast(v as decimal(18,6)) index_value")


def test_frequency(spark):
    daily = _daily(spark, [("2025-12-29", "100"), ("2025-12-31", "102"), ("2026-01-04", "104"), ("2026-01-20", "110")])
    weeks = series.to_frequency(daily, "W").orderBy("period_start").collect()
    assert [(r["period"], r["index_value"], r["days_observed"], r["coverage_pct"]) for r in weeks] == [
        ("2026-W01", D("102.000000"), 3, D("42.9")), ("2026-W04", D("110.000000"), 1, D("14.3"))]
    assert weeks[1]["movement_pct"] == D("7.843")
    months = series.to_frequency(daily, "M").orderBy("period_start").collect()
    assert [(r["period"], r["days_in_period"], r["is_complete"]) for r in months] == [("2025-12", 31, False), ("2026-01", 31, False)]


def test_half_even_means(spark):
    daily = _daily(spark, [("2026-01-01", "100.000001"), ("2026-01-02", "100.000002"), ("2026-02-01", "100.000002"), ("2026-02-02", "100.000003")])
    assert [r["value"] for r in series.monthly_average(daily).orderBy("month").collect()] == [D("100.000002"), D("100.000002")]


def test_backtest(spark):
    ours = spark.createDataFrame([(2026, m, v) for m, v in enumerate((100, 110, 99, 99, 101), 1)], "year int, month int, value int")
    bench = spark.createDataFrame([(2026, m, v) for m, v in enumerate((100, 105, 100, 100, 90), 1)], "year int, month int, value int")
    cast = [f.selectExpr("year", "month", "cast(value as decimal(14,6)) value") for f in (ours, bench)]
    row = series.compare_movements(*cast).first()
    assert (row["aligned_months"], row["sufficient"], row["directional_agreement_pct"]) == (4, True, D("75.00"))
    short = series.compare_movements(cast[0].filter("month < 3"), cast[1]).first()
    assert not short["sufficient"] and short["mae"] is None
    none = series.compare_movements(cast[0].withColumn("year", F.lit(2020)), cast[1]).first()
    assert none["aligned_months"] == 0 and none["limitation"].startswith("No overlapping")


def test_contribution_and_scenario(spark):
    rows = spark.createDataFrame([(20, 10, 0)], "fuel_change_pct int, demand_change_pct int, direct_fare_shock_pct int")
    r = series.scenarios(rows).first()
    assert (r["from_fuel_pct"], r["from_demand_pct"], r["total_fare_change_pct"]) == (D("4.900"), D("4.500"), D("9.400"))
    assert (r["min_bps"], r["max_bps"], r["is_material"], len(r["caveats"])) == (D("1.41"), D("5.64"), False, 5)
    falling = series.contribution_range(rows, F.lit(-10).cast("decimal(9,3)")).first()
    assert (falling["min_bps"], falling["max_bps"]) == (D("-6.00"), D("-1.50"))
    with pytest.raises(ValueError):
        series.contribution_range(rows, F.lit(1), low="0.7")


def test_two_date_comparison_omits_unmeasured(spark):
    rows = spark.createDataFrame(
        [("A", "2026-07-01", "100"), ("A", "2026-07-08", "105"), ("B", "2026-07-08", "90"), ("C", "2026-07-02", "90"), ("C", "2026-07-08", "90")],
        "route string, d string, v string").selectExpr("route", "cast(d as date) obs_date", "cast(v as decimal(18,6)) index_value")
    got = series.two_date_comparison(rows, 7).collect()
    assert [(r["route"], r["change_pct"], r["band"]) for r in got] == [("A", D("5.00"), "SHARP_RISE")]


def _events(spark, rows):
    return spark.createDataFrame(
        rows, "obs_id string, t string, action string, actor string, reason string, s string, supersedes_id string").selectExpr(
        "obs_id", "cast(t as timestamp) event_ts", "action", "actor", "reason", "cast(s as timestamp) scheduled_at", "supersedes_id")


def test_publication(spark):
    events = _events(spark, [
        ("a", "2026-07-01", "SUBMIT", None, None, None, None), ("a", "2026-07-02", "APPROVE", "ann", None, None, None),
        ("a", "2026-07-03", "PUBLISH", None, None, None, None),
        ("b", "2026-07-04", "REVISE", "bob", "late file", None, "a"),
        ("c", "2026-07-01", "SUBMIT", None, None, None, None), ("c", "2026-07-02", "SUBMIT", None, None, None, None),
        ("c", "2026-07-03", "APPROVE", " ", None, "2026-07-09", None), ("c", "2026-07-04", "PUBLISH", None, None, None, None),
        ("c", "2026-07-05", "WITHDRAW", None, " ", None, None)])
    got = [(r["obs_id"], r["action"], r["violation"]) for r in publication.transition_violations(events).orderBy("event_ts").collect()]
    assert got == [("c", "SUBMIT", "RESUBMITTED"), ("c", "APPROVE", "UNNAMED_APPROVER"),
                   ("c", "PUBLISH", "NOT_APPROVED"), ("c", "WITHDRAW", "NO_REASON")]
    obs = spark.createDataFrame([(i, "2026-06-30", "HEADLINE") for i in "abc"], "obs_id string, obs_date string, level string")
    # The correction is only approved, yet what it corrects is already out.
    assert publication.current_published(obs, events).count() == 0
    past = publication.current_published(obs, events, as_of=F.lit("2026-07-03").cast("timestamp")).collect()
    assert [r["obs_id"] for r in past] == ["a"] and past[0]["approved_by"] == "ann"


def test_forbidden_events_have_no_effect(spark):
    events = _events(spark, [
        # Out before its day, then on it.
        ("a", "2026-07-01", "SUBMIT", None, None, None, None), ("a", "2026-07-02", "APPROVE", " ann ", None, "2026-07-05", None),
        ("a", "2026-07-03", "PUBLISH", None, None, None, None), ("a", "2026-07-06", "PUBLISH", None, None, None, None),
        # Corrections: too early, in time, of a correction, and of a figure that is gone by then.
        ("b", "2026-07-05", "REVISE", "bob", "file", None, "a"), ("b", "2026-07-08", "PUBLISH", None, None, None, None),
        ("c", "2026-07-07", "REVISE", "bob", "file", None, "a"), ("c", "2026-07-08", "PUBLISH", None, None, None, None),
        ("d", "2026-07-09", "REVISE", "cy", "again", None, "c"), ("d", "2026-07-10", "PUBLISH", None, None, None, None),
        ("d", "2026-07-11", "WITHDRAW", None, "wrong", None, None), ("e", "2026-07-12", "REVISE", "cy", "late", None, "d")])
    got = {(r["obs_id"], str(r["event_ts"])[:10], r["violation"]) for r in publication.transition_violations(events).collect()}
    assert got == {("a", "2026-07-03", "EARLY_RELEASE"), ("b", "2026-07-05", "TARGET_NOT_PUBLISHED"), ("b", "2026-07-08", "NOT_APPROVED"),
                   ("e", "2026-07-12", "TARGET_NOT_PUBLISHED")}
    states = {r["obs_id"]: (r["state"], r["approved_by"]) for r in publication.publication_state(events).collect()}
    assert states == {"a": ("PUBLISHED", "ann"), "c": ("PUBLISHED", "bob"), "d": ("WITHDRAWN", "cy")}


ROBOTS = """# comment
User-agent: a
User-agent: IndexBot
Disallow: /search
Allow: /search/open
Disallow: /*.pdf$
Crawl-delay: 9

User-agent: *
Disallow: /
Disallow: https://x.example/api/v1
"""


def test_robots(spark):
    snaps = spark.createDataFrame(
        [("s", 200, ROBOTS), ("gone", 404, None), ("no", 403, None), ("page", 200, " <!DOCTYPE html>"), ("down", None, None), ("err", 500, "x")],
        "source string, status int, body string").withColumn("outcome", admission.classify_snapshot(F.col("status"), F.col("body")))
    assert {r["source"]: r["outcome"] for r in snaps.collect()} == {
        "s": "OK", "gone": "ABSENT", "no": "FORBIDDEN", "page": "ABSENT", "down": "UNAVAILABLE", "err": "UNAVAILABLE"}
    rules = admission.robots_rules(snaps.filter("outcome = 'OK'"), "IndexBot/2.0")
    paths = ["/", "/search", "/search/open/x", "/a/b.pdf", "/a/b.pdf?x", "/api/v1", "/api/v1/x", "/api/v10"]
    asked = spark.createDataFrame([("s", p) for p in paths] + [(s, "/x") for s in ("gone", "no", "unknown")], "source string, path string")
    got = {(r["source"], r["path"]): r["allowed"] for r in admission.path_verdicts(asked, snaps, rules).collect()}
    assert [got[("s", p)] for p in paths] == [True, False, True, False, True, False, False, True]
    assert got[("gone", "/x")] and not got[("no", "/x")] and not got[("unknown", "/x")]
    assert [r["delay"] for r in admission.crawl_delays(rules).collect()] == [9.0]


def test_run_status_and_budget(spark):
    outcomes = spark.createDataFrame([(1, "BLOCKED", 0), (2, "FAILED", 0), (3, "FAILED", 0), (3, "COLLECTED", 4)], "job_id int, status string, quotes int")
    assert {r["job_id"]: r["job_status"] for r in quality.run_status(outcomes).collect()} == {1: "SUCCESS", 2: "FAILED", 3: "PARTIAL"}
    fetches = spark.range(5).selectExpr("id fetch_id", "'s' source", "'/x' path", "timestamp_seconds(1782864000 + 10 * id) planned_at")
    sources = spark.createDataFrame([("s", True, True, "https://x", 3)], "source string, enabled boolean, approved boolean, base_url string, tier int")
    verdicts = spark.createDataFrame([("s", "/x", True, "-")], "source string, path string, allowed boolean, matched_rule string")
    got = admission.admission_verdicts(fetches, sources, verdicts, "contact", budget=3).orderBy("fetch_id")
    assert [r["decision"] for r in got.collect()] == ["ALLOWED"] * 3 + ["DEFERRED_RATE_LIMIT"] * 2
    delays = spark.createDataFrame([("s", 17.0)], "source string, delay double")
    times = admission.send_times(got.filter("decision = 'ALLOWED'"), delays).orderBy("fetch_id").collect()
    assert [str(r["send_at"])[11:] for r in times] == ["00:00:00", "00:00:17", "00:00:34"]
    nobody = admission.admission_verdicts(fetches, sources, verdicts, "")
    assert {r["decision"] for r in nobody.collect()} == {"BLOCKED_UNREVIEWED"}
    with pytest.raises(ValueError):
        admission.admission_verdicts(fetches, sources, verdicts, "c", budget=201)


def _walk(rows, delays, budget):
    """Decisions by walking through all fetches of a source in order."""
    out, last, used = {}, {}, {}
    for source, at, fetch in sorted(rows):
        day = (source, at // 86_400_000_000)
        ok = (source not in last or at >= last[source] + delays.get(source, 5.0) * 1_000_000) and used.get(day, 0) < budget
        if ok:
            last[source], used[day] = at, used.get(day, 0) + 1
        out[fetch] = "ALLOWED" if ok else "DEFERRED_RATE_LIMIT"
    return out


@pytest.mark.parametrize("budget", [0, 1, 3, 200])
def test_fetches_wait_for_the_one_before(spark, budget):
    import random
    pick, start = random.Random(budget), 1782864000_000_000
    delays = {"slow": 3600.0, "days": 200_000.0, "busy": 5.0, "night": 60.0}
    rows = []
    for source, n, span in (("slow", 120, 4 * 86400), ("days", 60, 12 * 86400), ("busy", 500, 3000), ("none", 80, 400), ("night", 40, 900)):
        first = start + 86_400_000_000 - 450_000_000 if source == "night" else start  # around midnight
        rows += [(source, first + pick.randrange(span * 1_000_000)) for _ in range(n)]
    rows += [("none", start + 5_000_000 * k) for k in range(3)] * 2 + [("pair", start), ("pair", start + 1_000_000)]
    rows = [(s, t, i) for i, (s, t) in enumerate(rows)]
    fetches = spark.createDataFrame(rows, "source string, t bigint, fetch_id bigint").selectExpr("fetch_id", "source", "'/x' path", "timestamp_micros(t) planned_at").repartition(3)
    names = sorted({r[0] for r in rows})
    sources = spark.createDataFrame([(n, True, True, "https://x", 3) for n in names], "source string, enabled boolean, approved boolean, base_url string, tier int")
    verdicts = spark.createDataFrame([(n, "/x", True, "-") for n in names], "source string, path string, allowed boolean, matched_rule string")
    declared = spark.createDataFrame(list(delays.items()), "source string, delay double")
    got = admission.admission_verdicts(fetches, sources, verdicts, "contact", budget=budget, delays=declared)
    want = _walk(rows, delays, budget)
    assert {r["fetch_id"]: r["decision"] for r in got.collect()} == want
    if budget > 1:
        assert [want[i] for s, _, i in rows if s == "pair"] == ["ALLOWED", "DEFERRED_RATE_LIMIT"]


def test_quality_summary_refresh(spark, tmp_path):
    base = spark.createDataFrame([("2026-07-01", 5), ("2026-07-02", 7)], "d string, f int").selectExpr(
        "cast(d as date) collected_date", "cast(f as decimal(12,2)) total_fare", "'LIVE_COLLECTED' provenance", "'COMPLETE' quality_status",
        "'HIGH' component_confidence", "'N' imputation_code")
    path = str(tmp_path / "summary")
    quality.refresh_quality_summary(base, path)
    import datetime
    later = base.withColumn("total_fare", F.lit(9).cast("decimal(12,2)"))
    quality.refresh_quality_summary(later, path, [datetime.date(2026, 7, 2)])
    got = {str(r["collected_date"]): r["mean_fare"] for r in spark.read.parquet(path).collect()}
    assert got == {"2026-07-01": D("5.000000"), "2026-07-02": D("9.000000")}


def test_lead_time_profile_without_baseline(spark):
    rows = spark.createDataFrame([("T1", "A-B", 10), ("T7", "A-B", 20)], "bucket string, route string, f int").selectExpr(
        "bucket", "route", "cast(f as decimal(12,2)) total_fare", "date'2026-07-01' collected_date")
    assert all(r["relative_to_t21"] is None for r in quality.lead_time_profile(rows).collect())


def test_publication_records_need_names_and_reasons(spark):
    rows = [("a", 0, "SUBMIT", None, None, None), ("b", 1, "APPROVE", "ann", None, None), ("c", 1, "PUBLISH", None, None, None),
            ("d", 1, "APPROVE", " ", None, None), ("e", 0, "REVISE", "bob", None, "b"), ("f", 0, "REVISE", "bob", "why", "b"),
            ("g", 1, "APPROVE", "ann", None, None), ("g", 2, "PUBLISH", None, None, None), ("g", 3, "WITHDRAW", "ann", "", None),
            ("h", 1, "APPROVE", "ann", None, None), ("h", 2, "APPROVE", None, None, None), ("i", 1, "ERASE", "ann", None, None)]
    events = spark.createDataFrame(rows, "obs_id string, n int, action string, actor string, reason string, supersedes_id string").selectExpr(
        "obs_id", "timestamp_seconds(n) event_ts", "action", "actor", "reason", "supersedes_id")
    found = constraints.quarantine(publication.recorded_publications(events), constraints.publication_rules())
    assert {r["obs_id"]: r["broken_rules"] for r in found.collect()} == {
        "c": ["approval_is_attributed"], "d": ["approval_is_attributed"], "e": ["revision_has_reason"], "g": ["withdrawal_has_reason"],
        "h": ["approval_is_attributed"], "i": ["state_known", "approval_is_attributed"]}
