"""Quality and operations reports, series, comparisons and listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from indexwright.functions.labels import departure_band, movement_band
from indexwright.operators import constraints, specification
from indexwright.operators.aggregate import route_index
from indexwright.operators import screening
from indexwright.plans import lineage, quality, reads, series
from registry.base import query
from registry.sql_parts import compose, day, he, hes

OBS = day("obs_date")
COLLECTED = day("collected_date")

# -- row and key rules ---------------------------------------------------------------

ROUTE_NAMES = "^[A-Z ]+-[A-Z ]+$"


@query("p2_quality_score", compose("""
    SELECT quote_id, greatest(1000 - CASE WHEN flight_no IS NULL THEN 250 ELSE 0 END
             - CASE WHEN base_c IS NULL THEN 200 WHEN component_confidence = 'LOW' THEN 100 ELSE 0 END
             - CASE WHEN provenance = 'SIMULATED_DEMO' THEN 500 ELSE 0 END, 0) / 1000.0 AS quality_score FROM q""", "q"))
def _(t):
    return t.quotes.select("quote_id", "quality_score")


@query("p3_stratum_sizes", compose(
    f"SELECT route, bucket, {COLLECTED} AS collected_date, count(*) AS quotes FROM q GROUP BY ALL", "q"))
def _(t):
    return t.quotes.groupBy("route", "bucket", "collected_date").agg(F.count("*").alias("quotes"))


@query("p8_components_exceed_total", compose(
    "SELECT quote_id, (base_c + tax_c) / 100.0 AS component_sum FROM q WHERE base_c + tax_c > fare_c", "q"))
def _(t):
    return t.quotes.filter("components_exceed_total").select("quote_id", "component_sum")


@query("p8_fare_components", compose("""
    SELECT component, count(*) AS rows, CAST(sum(c) AS BIGINT) / 100.0 AS amount FROM (
      SELECT 'BASE' AS component, base_c AS c FROM q UNION ALL SELECT 'TAX', tax_c FROM q) WHERE c IS NOT NULL GROUP BY component""", "q"))
def _(t):
    from indexwright.operators.normalise import fare_components
    return fare_components(t.quotes).groupBy("component").agg(
        F.count("*").alias("rows"), F.sum("amount").alias("amount"))


_RULES = ["route_format", "route_ends_differ", "positive_fare", "currency_inr", "provenance_known", "quality_status_known",
          "confidence_known", "imputation_known", "missing_reason_known", "imputed_or_sourced", "components_not_negative"]


@query("p7_row_constraints", compose(f"""
    SELECT rule, CAST(violations AS BIGINT) AS violations FROM (
      SELECT 'travel_after_collected' AS rule, count(*) FILTER (travel_date <= collected_date) AS violations FROM q
      UNION ALL SELECT r.rule, 0 FROM (VALUES {', '.join(f"('{r}')" for r in _RULES if r != 'positive_fare')}) r(rule)
      UNION ALL SELECT 'positive_fare', count(*) FILTER (fare_c <= 0) FROM q)""", "q"))
def _(t):
    return constraints.check(t.quotes, constraints.quote_rules(ROUTE_NAMES))


@query("p7_quarantined_rows", compose("""
    SELECT quote_id, 'travel_after_collected' AS broken_rules FROM q WHERE travel_date <= collected_date""", "q"))
def _(t):
    return constraints.quarantine(t.quotes, constraints.quote_rules(ROUTE_NAMES)).select("quote_id", "broken_rules")


@query("p7_observation_constraints", compose("""
    SELECT rule, CAST(0 AS BIGINT) AS violations FROM (VALUES ('positive_index'), ('level_known'), ('headline_has_no_ref'),
       ('stratum_has_bucket')) r(rule) WHERE (SELECT count(*) FROM q) > 0""", "q"))
def _(t):
    return constraints.check(t.run.observations(), constraints.observation_rules())


@query("p7_weight_constraints", compose("""
    SELECT rule, CAST(0 AS BIGINT) AS violations FROM (VALUES ('evidence_rung'), ('weight_range')) r(rule)
    WHERE (SELECT count(*) FROM weights) > 0""", "weights"))
def _(t):
    return constraints.check(t.weights, constraints.weight_rules())


_DEDUP = ["source", "carrier", "flight_no", "fare_brand", "collected_date"]


@query("p7b_duplicate_quotes", compose(f"""
    SELECT source, carrier, flight_no, fare_brand, {COLLECTED} AS collected_date, count(*) AS copies FROM q
    WHERE flight_no IS NOT NULL GROUP BY ALL HAVING count(*) > 1""", "q"))
def _(t):
    return constraints.duplicate_keys(t.quotes, _DEDUP, nulls_equal=False)


@query("p7b_duplicate_identities", compose(f"""
    SELECT source, carrier, flight_no, fare_brand, {COLLECTED} AS collected_date, count(*) AS copies FROM q
    GROUP BY ALL HAVING count(*) > 1""", "q"))
def _(t):
    return constraints.duplicate_keys(t.quotes, _DEDUP, nulls_equal=True)


# -- specification ------------------------------------------------------------------
# Event times stand in for departures, so that every clock band occurs.


@query("p4_departure_band", """
    SELECT event_id, CASE WHEN h < 8 THEN 'EARLY_MORNING' WHEN h < 12 THEN 'MORNING' WHEN h < 16 THEN 'MIDDAY'
           WHEN h < 20 THEN 'EVENING' ELSE 'NIGHT' END AS band
    FROM (SELECT event_id, hour(ts + INTERVAL '5 hours 30 minutes') AS h FROM events)""")
def _(t):
    return t.table("events").select("event_id", departure_band(F.col("ts")).alias("band"))


_SPEC = {"spec": """
    SELECT *, 'BUSINESS' AS x, CASE WHEN line_no = 1 THEN 'DIRECT' WHEN line_no = 2 THEN 'ONE_STOP' ELSE 'MULTI_STOP' END AS routing,
           CASE WHEN part_key % 2 = 0 THEN 'BUSINESS' ELSE 'ECONOMY' END AS cabin,
           CASE WHEN part_key % 3 = 0 THEN 15 END AS baggage_kg,
           CASE WHEN part_key % 5 = 0 THEN 'UNKNOWN' ELSE 'NON_REFUNDABLE' END AS refundability FROM q""",
    "keys": """
    SELECT quote_id, route || '|' || carrier || '|' || cabin || '|ONE_WAY|' || routing || '|EARLY_MORNING|' || fare_brand || '|' ||
           coalesce(CAST(baggage_kg AS VARCHAR), '?') || '|' || refundability || '|NO_CHANGES|ADULT' AS match_key,
           CAST(baggage_kg IS NOT NULL AND refundability <> 'UNKNOWN' AS BIGINT) AS fully_specified FROM spec"""}


def _specified(t):
    q = t.quotes.select(
        "quote_id", "route", "carrier", "fare_brand", "departure_at", "order_key", "line_no", "pair_key",
        (F.col("line_no") - 1).alias("stops"),
        F.when(F.col("part_key") % 2 == 0, "business").alias("cabin"),
        F.when(F.col("part_key") % 3 == 0, 15).alias("baggage_kg"),
        F.when(F.col("part_key") % 5 != 0, "non_refundable").alias("refundability"),
        F.lit("no_changes").alias("changeability"))
    return specification.specification(q)


@query("p4_specification", compose("""
    SELECT quote_id, match_key, left(sha256(match_key), 16) AS match_hash, fully_specified FROM keys""", "q", extra=_SPEC))
def _(t):
    return _specified(t).select("quote_id", "match_key", "match_hash", "fully_specified")


@query("p4c_match_key_groups", compose("""
    SELECT left(sha256(match_key), 16) AS match_hash, count(*) AS quotes FROM keys GROUP BY ALL""", "q", extra=_SPEC))
def _(t):
    return _specified(t).groupBy("match_hash").agg(F.count("*").alias("quotes"))


@query("p4d_fully_specified", compose(
    "SELECT fully_specified, count(*) AS quotes FROM keys GROUP BY ALL", "q", extra=_SPEC))
def _(t):
    return _specified(t).groupBy("fully_specified").agg(F.count("*").alias("quotes"))


@query("p4e_specification_difference", compose("""
    SELECT a.quote_id AS left_id, b.quote_id AS right_id, array_to_string(list_filter([
        CASE WHEN a.route <> b.route THEN 'route' END, CASE WHEN a.carrier <> b.carrier THEN 'carrier' END,
        CASE WHEN a.cabin <> b.cabin THEN 'cabin' END, CASE WHEN a.routing <> b.routing THEN 'routing' END,
        CASE WHEN a.fare_brand <> b.fare_brand THEN 'fare_brand' END,
        CASE WHEN a.baggage_kg IS DISTINCT FROM b.baggage_kg THEN 'baggage_kg' END,
        CASE WHEN a.refundability <> b.refundability THEN 'refundability' END], lambda x: x IS NOT NULL), ',') AS differing
    FROM spec a JOIN spec b ON a.order_key = b.order_key AND b.line_no = a.line_no + 1""", "q", extra=_SPEC))
def _(t):
    s = _specified(t)
    a, b = s.alias("a"), s.alias("b")
    joined = a.join(b, (F.col("a.order_key") == F.col("b.order_key")) & (F.col("b.line_no") == F.col("a.line_no") + 1))
    return joined.select(F.col("a.quote_id").alias("left_id"), F.col("b.quote_id").alias("right_id"),
                         specification.differences("a", "b").alias("differing"))


# -- quality ----------------------------------------------------------------------


@query("a13_lead_time_profile", compose(f"""
    SELECT b.bucket, CAST(b.days AS BIGINT) AS days, CAST(b.bucket = 'T21' AS BIGINT) AS cpi_comparable, quotes,
           lo / 100.0 AS min_fare, {he('s * 10000', 'quotes')} / 1000000.0 AS mean_fare, hi / 100.0 AS max_fare,
           round_even((s / quotes) / (SELECT sum(fare_c) / count(*) FROM q WHERE bucket = 'T21'
              AND collected_date = (SELECT max(collected_date) FROM q)) * 100, 1) AS relative_to_t21
    FROM (SELECT bucket, count(*) AS quotes, min(fare_c) AS lo, max(fare_c) AS hi, CAST(sum(fare_c) AS BIGINT) AS s FROM q
          WHERE collected_date = (SELECT max(collected_date) FROM q) GROUP BY bucket)
    JOIN (VALUES ('T1', 1), ('T7', 7), ('T15', 15), ('T21', 21), ('T30', 30), ('T45', 45)) b(bucket, days) USING (bucket)""", "q"))
def _(t):
    return quality.profile_of_parts(t.parts.fares)


@query("a13_lead_time_profile_route", compose(f"""
    SELECT bucket, count(*) AS quotes, min(fare_c) / 100.0 AS min_fare, max(fare_c) / 100.0 AS max_fare FROM q
    WHERE collected_date = (SELECT max(collected_date) FROM q) AND route = 'ASIA-EUROPE' GROUP BY bucket""", "q"))
def _(t):
    return quality.profile_of_parts(t.parts.fares, "asia-europe").select("bucket", "quotes", "min_fare", "max_fare")


@query("a14_quality_counts", compose("""
    SELECT CASE WHEN grouping(quality_status) = 0 THEN 'quality_status' WHEN grouping(provenance) = 0 THEN 'provenance'
                WHEN grouping(component_confidence) = 0 THEN 'component_confidence' ELSE 'total' END AS dimension,
           coalesce(quality_status, provenance, component_confidence, '') AS code, count(*) AS quotes,
           CAST(0 AS BIGINT) AS imputed, count(*) FILTER (quality_status_raw = 'COMPLETE') AS complete
    FROM (SELECT *, quality_status AS quality_status_raw FROM q)
    GROUP BY GROUPING SETS ((quality_status), (provenance), (component_confidence), ())""", "q"))
def _(t):
    return quality.counts_of_parts(t.parts.quality)


@query("a14_quality_rates", compose(f"""
    SELECT n AS quotes, CAST(0 AS BIGINT) AS quotes_imputed, strata_computed, used AS quotes_used, excl AS quotes_excluded,
           strata_insufficient, {he('excl * 10000', 'used + excl')} / 100.0 AS rejection_pct, CAST(0 AS DOUBLE) AS imputation_pct,
           {he('complete * 10000', 'n')} / 100.0 AS complete_pct
    FROM (SELECT count(*) AS n, count(*) FILTER (quality_status = 'COMPLETE') AS complete FROM q),
         (SELECT count(i6) AS strata_computed, CAST(sum(input_quote_count) FILTER (i6 IS NOT NULL) AS BIGINT) AS used,
                 CAST(sum(excluded_count) FILTER (i6 IS NOT NULL) AS BIGINT) AS excl,
                 CAST(sum(insufficient) AS BIGINT) AS strata_insufficient FROM strata)""", "q", "strata"))
def _(t):
    return quality.quality_rates(t.quotes, t.run.strata)


@query("a14_quality_daily", compose(f"""
    SELECT {COLLECTED} AS collected_date, count(*) AS quotes, count(*) FILTER (quality_status <> 'COMPLETE') AS not_complete
    FROM q GROUP BY collected_date""", "q"))
def _(t):
    return quality.daily_quality(t.quotes)


@query("a14b_quality_summary", compose(f"""
    SELECT {COLLECTED} AS collected_date, provenance, quality_status, component_confidence, 'N' AS imputation_code,
           count(*) AS observations, min(fare_c) / 100.0 AS min_fare,
           {he('CAST(sum(fare_c) AS BIGINT) * 10000', 'count(*)')} / 1000000.0 AS mean_fare, max(fare_c) / 100.0 AS max_fare
    FROM q GROUP BY ALL""", "q"))
def _(t):
    return quality.summary_of_parts(t.parts.quality)


@query("p12_provenance_mode", compose("""
    SELECT string_agg(DISTINCT provenance, ',' ORDER BY provenance) AS provenances, 'OFFLINE_DEMO' AS mode FROM q""", "q"))
def _(t):
    return quality.provenance_mode(t.quotes)


_NOW = "TIMESTAMP '2024-02-01 00:00:00'"


def _now():
    return F.lit("2024-02-01 00:00:00").cast("timestamp")


@query("p10_freshness", f"""
    SELECT event_type, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS latest_at,
           round_even((epoch({_NOW}) - floor(epoch(max(ts)))) / 3600, 1) AS age_hours,
           CASE WHEN round_even((epoch({_NOW}) - floor(epoch(max(ts)))) / 3600, 1) <= 26 THEN 'CURRENT'
                WHEN round_even((epoch({_NOW}) - floor(epoch(max(ts)))) / 3600, 1) <= 72 THEN 'STALE' ELSE 'OVERDUE' END AS freshness
    FROM events GROUP BY event_type""")
def _(t):
    return quality.observation_age(t.table("events"), _now(), "ts", ["event_type"])


_STATUS = "CASE event_type WHEN 'view' THEN 'COLLECTED' WHEN 'click' THEN 'COLLECTED' WHEN 'purchase' THEN 'BLOCKED' WHEN 'signup' THEN 'DEFERRED' ELSE 'FAILED' END"


def _outcomes(t):
    kind = (F.when(F.col("event_type").isin("view", "click"), "COLLECTED").when(F.col("event_type") == "purchase", "BLOCKED")
            .when(F.col("event_type") == "signup", "DEFERRED").otherwise("FAILED"))
    return t.table("events").select(
        F.floor(F.col("event_id") / 5).alias("job_id"), kind.alias("status"),
        F.get_json_object("props", "$.k").cast("bigint").alias("quotes"), "ts", "user_id", "event_type", "event_id")


@query("a20_run_status", f"""
    SELECT job_id, requests_total, collected, blocked, deferred, failed, quotes,
           CASE WHEN failed > 0 AND collected > 0 THEN 'PARTIAL' WHEN failed > 0 THEN 'FAILED' ELSE 'SUCCESS' END AS job_status
    FROM (SELECT event_id // 5 AS job_id, count(*) AS requests_total, count(*) FILTER (s = 'COLLECTED') AS collected,
                 count(*) FILTER (s = 'BLOCKED') AS blocked, count(*) FILTER (s = 'DEFERRED') AS deferred,
                 count(*) FILTER (s = 'FAILED') AS failed, CAST(sum(CAST(props->>'k' AS BIGINT)) AS BIGINT) AS quotes
          FROM (SELECT *, {_STATUS} AS s FROM events) GROUP BY ALL)""")
def _(t):
    return quality.run_status(_outcomes(t))


def _decision():
    return (F.when(F.col("event_type") == "error", "BLOCKED_ROBOTS").when(F.col("event_type") == "signup", "DEFERRED_RATE_LIMIT")
            .otherwise("ALLOWED"))


_DECISION = "CASE event_type WHEN 'error' THEN 'BLOCKED_ROBOTS' WHEN 'signup' THEN 'DEFERRED_RATE_LIMIT' ELSE 'ALLOWED' END"


@query("a15_operations", f"""
    SELECT strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS latest_at,
           round_even((epoch({_NOW}) - floor(epoch(max(ts)))) / 3600, 1) AS age_hours, 'CURRENT' AS freshness,
           count(*) AS requests, count(*) FILTER (event_type = 'error') + count(*) FILTER (event_type = 'click' AND user_id % 7 = 0) AS failed_responses,
           count(*) AS decisions, count(*) FILTER (event_type = 'error') AS blocked, count(DISTINCT user_id) AS sources_total,
           count(DISTINCT user_id) FILTER (user_id % 3 = 0) AS sources_enabled,
           'warning: failed responses ' || CAST(count(*) FILTER (event_type = 'error') + count(*) FILTER (event_type = 'click' AND user_id % 7 = 0) AS VARCHAR)
             || ',info: refused requests ' || CAST(count(*) FILTER (event_type = 'error') AS VARCHAR) AS alerts
    FROM events""")
def _(t):
    e = t.table("events")
    responses = e.select(F.when(F.col("event_type") == "error", 503).when(
        (F.col("event_type") == "click") & (F.col("user_id") % 7 == 0), F.lit(None)).otherwise(200).alias("http_status"))
    sources = e.select("user_id").distinct().select((F.col("user_id") % 3 == 0).alias("enabled"))
    return quality.operations(responses, e.select(_decision().alias("decision")), sources,
                              e.select(F.col("ts").alias("collected_at")), _now())


@query("a15_decision_mix", f"SELECT {_DECISION} AS decision, count(*) AS rows FROM events GROUP BY ALL")
def _(t):
    return quality.mix(t.table("events").select(_decision().alias("decision")), "decision")


@query("a15_quotes_per_source", compose("SELECT source, count(*) AS rows FROM q GROUP BY source", "q"))
def _(t):
    return quality.mix(t.quotes, "source")


@query("a21_latest_decision", f"""
    SELECT user_id, arg_max({_DECISION}, (ts, event_id)) AS decision, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS decided_at
    FROM events GROUP BY user_id""")
def _(t):
    rows = t.table("events").select("user_id", F.col("ts").alias("decided_at"), "event_id", _decision().alias("decision"))
    return quality.latest_per_group(rows, ["user_id"], ["decided_at", "event_id"], ["decision", "decided_at"])


@query("a23_permission_summary", """
    SELECT source, CAST(permits AND NOT (SELECT bool_and(unreachable) FROM p) AS BIGINT) AS permits, CAST(unreachable AS BIGINT) AS unreachable
    FROM p""".replace("FROM p", "FROM (SELECT user_id AS source, coalesce(bool_or(event_type = 'view') FILTER (event_id % 4 <> 0), FALSE) AS permits, bool_and(user_id % 5 = 0) AS unreachable FROM events GROUP BY user_id) p"))
def _(t):
    e = t.table("events").select(
        F.col("user_id").alias("source"), F.when(F.col("event_id") % 4 == 0, "/").otherwise("/search").alias("path"),
        (F.col("event_type") == "view").alias("allowed"),
        F.when(F.col("user_id") % 5 == 0, F.when(F.col("event_id") % 2 == 0, "FORBIDDEN").otherwise("UNAVAILABLE")).otherwise("OK").alias("outcome"))
    return quality.permission_summary(e)[0]


# -- series --------------------------------------------------------------------------

_DAILY = {"daily": """SELECT CAST(ts AS DATE) AS d, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS HUGEINT) AS c, count(*) AS n FROM events GROUP BY ALL""",
          "daily6": f"SELECT d, CAST({he('c * 10000', 'n')} AS HUGEINT) AS i6 FROM daily"}


def _event_days(t):
    """A daily series at six decimals: the mean event value."""
    cents = F.round(F.col("value") * 100).cast("bigint").cast("decimal(18,0)")
    total = F.sum(cents).cast("decimal(22,0)") / 100
    days = t.table("events").groupBy(F.to_date("ts").alias("obs_date")).agg(
        F.bround(total.cast("decimal(22,2)") / F.count("*").cast("decimal(11,0)"), 6).cast("decimal(18,6)").alias("index_value"))
    return days


def _freq_sql(start, end, label):
    return compose(f"""
      SELECT {day('s')} AS period_start, {day('e')} AS period_end, label AS period, i6 / 1000000.0 AS index_value, days_observed,
             p6 / 1000000.0 AS previous_index_value, CAST(e - s + 1 AS BIGINT) AS days_in_period,
             {he('days_observed * 1000', 'e - s + 1')} / 10.0 AS coverage_pct, CAST(days_observed >= e - s + 1 AS BIGINT) AS is_complete,
             (i6 - p6) / 1000000.0 AS movement, {hes('(i6 - p6) * 100000', 'p6')} / 1000.0 AS movement_pct
      FROM (SELECT *, lag(i6) OVER (ORDER BY s) AS p6 FROM (
        SELECT CAST({start} AS DATE) AS s, CAST({end} AS DATE) AS e, {label} AS label,
               CAST({he('sum(i6)', 'count(*)')} AS HUGEINT) AS i6, count(DISTINCT d) AS days_observed FROM daily6 GROUP BY ALL))""", extra=_DAILY)


@query("a10_daily", _freq_sql("d", "d", day("d")))
def _(t):
    return series.to_frequency(_event_days(t), "D")


@query("a10_weekly", _freq_sql("date_trunc('week', d)", "date_trunc('week', d) + INTERVAL 6 DAY", "strftime(d, '%G-W%V')"))
def _(t):
    return series.to_frequency(_event_days(t), "W")


@query("a10_monthly", _freq_sql("date_trunc('month', d)", "last_day(d)", "strftime(d, '%Y-%m')"))
def _(t):
    return series.to_frequency(_event_days(t), "M")


@query("a10_route_index_monthly", compose(f"""
    SELECT strftime(obs_date, '%Y-%m') AS period, CAST({he('sum(i6)', 'count(*)')} AS BIGINT) / 1000000.0 AS index_value
    FROM routes WHERE i6 IS NOT NULL GROUP BY ALL""", "routes"))
def _(t):
    rows = t.run.routes.filter("index_value is not null")
    return series.to_frequency(series.daily_mean(rows), "M").select("period", "index_value")


@query("w3_previous_period", compose(f"""
    SELECT {day('obs_date')} AS period, lag({day('obs_date')}) OVER (ORDER BY obs_date) AS previous_period FROM head_all""", "head_all"))
def _(t):
    from pyspark.sql import Window
    rows = t.run.routes.filter("index_value is not null")
    days = series.to_frequency(series.daily_mean(rows), "D")
    return days.select("period", F.lag("period").over(Window.orderBy("period_start")).alias("previous_period"))


@query("a16_daily_route_mean", compose(f"""
    SELECT {OBS} AS obs_date, CAST({he('sum(i6)', 'count(i6)')} AS BIGINT) / 1000000.0 AS index_value FROM routes
    WHERE i6 IS NOT NULL GROUP BY obs_date""", "routes"))
def _(t):
    rows = t.run.routes.filter("index_value is not null")
    return series.daily_mean(rows).withColumn("index_value", F.bround("index_value", 6))


_MONTHS = {
    "ours": f"""SELECT year(obs_date) AS y, month(obs_date) AS m, CAST({he('sum(i6)', 'count(*)')} AS HUGEINT) AS v6
                FROM routes WHERE i6 IS NOT NULL GROUP BY ALL""",
    "bench": f"""SELECT year(o_orderdate) AS y, month(o_orderdate) AS m,
                 CAST({he('CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS HUGEINT) * 10000', 'count(*)')} AS HUGEINT) AS v6
                 FROM orders GROUP BY ALL""",
    **{f"{n}_moves": f"""SELECT y, m, {hes('(v6 - p6) * 100000000', 'p6')} AS pct6
                FROM (SELECT *, lag(v6) OVER (ORDER BY y, m) AS p6 FROM {n}) WHERE p6 IS NOT NULL AND p6 <> 0""" for n in ("ours", "bench")},
    "aligned": "SELECT y, m, o.pct6 AS a, b.pct6 AS b FROM ours_moves o JOIN bench_moves b USING (y, m)",
}


def _two_series(t):
    rows = t.run.routes.filter("index_value is not null")
    ours = series.monthly_average(rows)
    orders = t.table("orders").select(
        F.to_date("o_orderdate").alias("obs_date"),
        (F.round(F.col("o_totalprice") * 100).cast("bigint").cast("decimal(16,0)") / 100).cast("decimal(16,2)").alias("v"))
    return ours, series.monthly_average(orders, "v")


@query("a11_monthly_average", compose("""
    SELECT CAST(y AS BIGINT) AS year, CAST(m AS BIGINT) AS month, v6 / 1000000.0 AS value FROM bench""", "routes", extra=_MONTHS))
def _(t):
    return _two_series(t)[1]


@query("a11b_monthly_movements", compose("""
    SELECT CAST(y AS BIGINT) AS year, CAST(m AS BIGINT) AS month, pct6 / 1000000.0 AS movement_pct FROM bench_moves""", "routes", extra=_MONTHS))
def _(t):
    return series.monthly_movements(_two_series(t)[1])


@query("j7_aligned_months", compose("""
    SELECT CAST(y AS BIGINT) AS year, CAST(m AS BIGINT) AS month, printf('%d-%02d', y, m) AS label, a / 1000000.0 AS own_pct,
           b / 1000000.0 AS benchmark_pct, (a - b) / 1000000.0 AS error,
           CAST(CASE WHEN a = 0 OR b = 0 THEN a = b ELSE (a > 0) = (b > 0) END AS BIGINT) AS same_direction FROM aligned""", "routes", extra=_MONTHS))
def _(t):
    return series.aligned_movements(*_two_series(t))


@query("o2_shared_months", compose("SELECT CAST(y AS BIGINT) AS year, CAST(m AS BIGINT) AS month FROM ours JOIN bench USING (y, m)", "routes", extra=_MONTHS))
def _(t):
    a, b = _two_series(t)
    return a.select("year", "month").intersect(b.select("year", "month"))


@query("a11c_backtest", compose(f"""
    SELECT count(*) AS aligned_months, CAST(count(*) >= 3 AS BIGINT) AS sufficient,
           {he('sum(abs(a - b))', 'count(*)')} / 1000000.0 AS mae,
           round_even(sqrt(sum(((a - b) / 1000000.0) * ((a - b) / 1000000.0)) / count(*)), 6) AS rmse,
           {he('count(*) FILTER (CASE WHEN a = 0 OR b = 0 THEN a = b ELSE (a > 0) = (b > 0) END) * 10000', 'count(*)')} / 100.0 AS directional_agreement_pct,
           'Movements only: index levels have different base periods.' AS limitation FROM aligned""", "routes", extra=_MONTHS))
def _(t):
    return series.compare_movements(*_two_series(t))


@query("a11c_backtest_insufficient", compose("""
    SELECT count(*) AS aligned_months, CAST(0 AS BIGINT) AS sufficient, 'Only ' || count(*) || ' aligned month(s); 1000 are required.' AS limitation
    FROM aligned""", "routes", extra=_MONTHS))
def _(t):
    return series.compare_movements(*_two_series(t), min_months=1000).select("aligned_months", "sufficient", "limitation")


# Observations are quarterly in these tables; 92 days before the last quarter is the previous one.
_MOVES = {"moves": f"""
    SELECT route, now6, then6, {hes('(now6 - then6) * 10000', 'then6')} AS pct2, (now6 - then6) * 100.0 / then6 AS pct FROM (
      SELECT route, max(i6) FILTER (obs_date = (SELECT max(obs_date) FROM routes WHERE i6 IS NOT NULL)) AS now6,
             max(i6) FILTER (obs_date = (SELECT max(obs_date) FROM routes WHERE i6 IS NOT NULL) - 92) AS then6 FROM routes GROUP BY route)
    WHERE now6 IS NOT NULL AND then6 IS NOT NULL""",
    "banded": """SELECT *, CASE WHEN pct >= 5 THEN 'SHARP_RISE' WHEN pct >= 1 THEN 'RISE' WHEN pct > -1 THEN 'STABLE'
                 WHEN pct > -5 THEN 'FALL' ELSE 'SHARP_FALL' END AS band FROM moves"""}
_GAP = 92


@query("j6_two_date_comparison", compose("""
    SELECT route, now6 / 1000000.0 AS index_value, then6 / 1000000.0 AS previous_index_value, pct2 / 100.0 AS change_pct, band FROM banded""",
    "routes", extra=_MOVES))
def _(t):
    return series.two_date_comparison(t.run.routes, _GAP)


@query("a22_movers_summary", compose(f"""
    SELECT count(*) AS routes, count(*) FILTER (pct2 > 0) AS rising, count(*) FILTER (pct2 <= 0) AS falling,
           {hes('sum(pct2)', 'count(*)')} / 100.0 AS mean_change_pct, arg_max(route, (abs(pct2), route)) AS biggest_mover FROM moves""",
    "routes", extra=_MOVES))
def _(t):
    return series.movers_summary(series.two_date_comparison(t.run.routes, _GAP))


@query("t7_ranked_movers", compose("""
    SELECT route, pct2 / 100.0 AS change_pct, row_number() OVER (ORDER BY pct2 DESC, route) AS place FROM moves""", "routes", extra=_MOVES))
def _(t):
    from pyspark.sql import Window
    ranked = reads.ranked_movers(series.two_date_comparison(t.run.routes, _GAP))
    order = Window.orderBy(F.desc("change_pct"), "route")
    return ranked.select("route", "change_pct", F.row_number().over(order).cast("bigint").alias("place"))


@query("p9_movement_bands", compose(f"""
    SELECT route, {OBS} AS obs_date, CASE WHEN p >= 5 THEN 'SHARP_RISE' WHEN p >= 1 THEN 'RISE' WHEN p > -1 THEN 'STABLE'
           WHEN p > -5 THEN 'FALL' ELSE 'SHARP_FALL' END AS band
    FROM (SELECT route, obs_date, CAST((i6 - p6) AS DOUBLE) * 100 / p6 AS p FROM routes WHERE i6 IS NOT NULL AND p6 IS NOT NULL)""", "routes"))
def _(t):
    moved = t.run.routes.filter("index_value is not null and prev_index_value is not null")
    change = (F.col("index_value") - F.col("prev_index_value")).cast("double") * 100 / F.col("prev_index_value").cast("double")
    return moved.select("route", "obs_date", movement_band(change).alias("band"))


_WINDOW = {**_DAILY, "w": """
    SELECT CAST(arg_max(i6, d) AS DOUBLE) / 1000000 AS latest_value,
           CAST(arg_max(i6, d) FILTER (d <= (SELECT max(d) FROM daily6) - 7) AS DOUBLE) / 1000000 AS base_value,
           count(*) AS days FROM daily6"""}


@query("a17_contribution_range", compose("""
    SELECT latest_value, base_value, days, round_even(mv, 6) AS movement_pct, least(lo, hi) AS min_bps, greatest(lo, hi) AS max_bps,
           round_even(8.796 * mv, 2) AS transport_division_bps, CAST(greatest(lo, hi) >= 10 AS BIGINT) AS is_material
    FROM (SELECT *, round_even(0.15 * mv, 2) AS lo, round_even(0.60 * mv, 2) AS hi
          FROM (SELECT *, (latest_value - base_value) / base_value * 100 AS mv FROM w))""", extra=_WINDOW))
def _(t):
    moved = series.window_movement(_event_days(t), 7)
    return series.contribution_range(moved, F.col("movement_pct")).withColumn("movement_pct", F.bround("movement_pct", 6))


@query("a18_scenarios", f"""
    SELECT p_partkey, fu / 1000.0 AS from_fuel_pct, de / 1000.0 AS from_demand_pct, (fu + de + di * 1000) / 1000.0 AS total_fare_change_pct,
           least({hes('(fu + de + di * 1000) * 15', '1000')}, {hes('(fu + de + di * 1000) * 60', '1000')}) / 100.0 AS min_bps,
           greatest({hes('(fu + de + di * 1000) * 15', '1000')}, {hes('(fu + de + di * 1000) * 60', '1000')}) / 100.0 AS max_bps
    FROM (SELECT p_partkey, {hes('(p_size - 25) * 245', '1')} AS fu, {hes('(p_partkey % 41 - 20) * 450', '1')} AS de, p_partkey % 5 - 2 AS di FROM part)""")
def _(t):
    shocks = t.table("part").select(
        "p_partkey", (F.col("p_size") - 25).alias("fuel_change_pct"), (F.col("p_partkey") % 41 - 20).alias("demand_change_pct"),
        (F.col("p_partkey") % 5 - 2).alias("direct_fare_shock_pct"))
    return series.scenarios(shocks).select(
        "p_partkey", "from_fuel_pct", "from_demand_pct", "total_fare_change_pct", "min_bps", "max_bps")


@query("j8_undirected_routes", compose("""
    SELECT least(origin, destination) || '-' || greatest(origin, destination) AS pair, count(*) AS directions,
           CAST(bool_or(origin = 'ASIA') AS BIGINT) AS any_active, string_agg(route, ',' ORDER BY route) AS members
    FROM (SELECT DISTINCT route, origin, destination FROM q) GROUP BY ALL""", "q"))
def _(t):
    routes = t.quotes.select("route", (F.col("source") == "ASIA").alias("active")).distinct()
    return series.undirected_routes(routes)


# -- listings ----------------------------------------------------------------------


@query("t1_latest_quotes", compose("""
    SELECT quote_id, strftime(collected_at, '%Y-%m-%d %H:%M:%S') AS collected_at, route, bucket, carrier, flight_no, total_fare
    FROM q ORDER BY q.collected_at DESC, quote_id LIMIT 20""", "q"))
def _(t):
    return t.parts.latest_quotes(20).select(
        "quote_id", "collected_at", "route", "bucket", "carrier", "flight_no", "total_fare")


@query("t1_latest_quotes_route", compose("""
    SELECT quote_id, strftime(collected_at, '%Y-%m-%d %H:%M:%S') AS collected_at, total_fare
    FROM q WHERE route = 'ASIA-EUROPE' ORDER BY q.collected_at DESC, quote_id LIMIT 50""", "q"))
def _(t):
    return t.parts.latest_quotes(50, "asia-europe").select("quote_id", "collected_at", "total_fare")


@query("t2_latest_route_rows", compose(f"""
    SELECT route, {OBS} AS obs_date, i6 / 1000000.0 AS index_value, (i6 - p6) / 1000000.0 AS movement, input_quote_count
    FROM routes WHERE i6 IS NOT NULL ORDER BY routes.obs_date DESC, route LIMIT 100""", "routes"))
def _(t):
    return reads.latest_route_rows(t.index_rows.routes).select("route", "obs_date", "index_value", "movement", "input_quote_count")


@query("t3_latest_headline", compose(f"""
    SELECT {day('max(obs_date)')} AS obs_date, arg_max(i6, obs_date) / 1000000.0 AS index_value, CAST(NULL AS VARCHAR) AS reason FROM headline""", "headline"))
def _(t):
    return reads.latest_headline(t.run.headline, t.run.refused)


@query("t4_flagged_observations", compose(f"""
    SELECT e.route, e.bucket, {day('e.obs_date')} AS obs_date, e.pair_key, rule_id, quote_id, flight_no, total_fare
    FROM (SELECT route, bucket, obs_date, pair_key, CASE WHEN out_small THEN 'EXTREME_SMALL_N_FLAGGED' ELSE 'EXTREME_MAD_FLAGGED' END AS rule_id, cur_c
          FROM judged WHERE out_small OR out_large
          UNION ALL SELECT route, bucket, obs_date, pair_key, 'IMPLAUSIBLE_RELATIVE', cur_c FROM pairs WHERE NOT plausible) e
    JOIN q ON q.route = e.route AND q.bucket = e.bucket AND q.collected_date = e.obs_date AND q.pair_key = e.pair_key AND fare_c = e.cur_c
    ORDER BY e.obs_date DESC, e.route, e.bucket, e.pair_key, quote_id LIMIT 100""", "judged"))
def _(t):
    events = screening.cleaning_events(screening.screen(t.pairs))
    return reads.flagged_observations(events, t.quotes).select(
        "route", "bucket", "obs_date", "pair_key", "rule_id", "quote_id", "flight_no", "total_fare")


@query("t5_route_history", compose(f"""
    SELECT route, {OBS} AS obs_date, i6 / 1000000.0 AS index_value, (i6 - p6) / 1000000.0 AS movement,
           (SELECT CAST(w8 AS BIGINT) FROM weights WHERE weights.route = routes.route) / 100000000.0 AS weight,
           CAST(0 AS BIGINT) AS is_proxy, 'DGCA popular-routes list' AS rung_meaning
    FROM routes WHERE route = 'ASIA-EUROPE' AND i6 IS NOT NULL""", "routes", "weights"))
def _(t):
    return reads.route_history(t.index_rows.routes, t.index_rows.weights, "asia-europe").select(
        "route", "obs_date", "index_value", "movement", "weight", "is_proxy", "rung_meaning")


@query("t6_latest_jobs", """
    SELECT job_id, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS started_at, count(*) AS requests FROM (SELECT event_id // 5 AS job_id, ts FROM events)
    GROUP BY job_id ORDER BY max(ts) DESC, job_id LIMIT 15""")
def _(t):
    jobs = _outcomes(t).groupBy("job_id").agg(F.max("ts").alias("started_at"), F.count("*").alias("requests"))
    return reads.newest(jobs, "started_at", ["job_id"], 15)


@query("j2_dimension_joins", compose(f"""
    SELECT bucket, CAST(b.days AS BIGINT) AS days, r.route, w8::BIGINT / 100000000.0 AS weight, count(*) AS quotes FROM q r
    JOIN (VALUES ('T1', 1), ('T7', 7), ('T15', 15), ('T21', 21), ('T30', 30), ('T45', 45)) b(bucket, days) USING (bucket)
    LEFT JOIN weights USING (route) GROUP BY ALL""", "q", "weights"))
def _(t):
    from indexwright.schemas import lead_time_buckets
    buckets = F.broadcast(lead_time_buckets(t.spark).select("bucket", "days"))
    counts = t.quotes.groupBy("bucket", "route").agg(F.count("*").alias("quotes"))
    return counts.join(buckets, "bucket").join(t.weights.select("route", "weight"), "route", "left")


@query("v_result_with_versions", compose("""
    SELECT route, CAST(w8 AS BIGINT) / 100000000.0 AS weight, (SELECT 'v' || max(year(o_orderdate)) FROM orders) AS methodology_version,
           (SELECT 'w' || max(year(o_orderdate)) FROM orders) AS weight_set_version, 'LIVE_COLLECTED,SIMULATED_DEMO' AS provenances,
           'OFFLINE_DEMO' AS mode FROM weights""", "weights"))
def _(t):
    years = t.table("orders").select(F.year("o_orderdate").alias("y")).distinct()
    def versions(mark):
        return years.select(F.concat(F.lit(mark), F.col("y").cast("string")).alias("version"), F.make_date("y", F.lit(1), F.lit(1)).alias("effective_from"))
    return reads.with_versions(t.weights.select("route", "weight"), versions("v"), versions("w"), quality.provenance_mode(t.quotes))


# -- lineage -------------------------------------------------------------------------
# Raw quote = quote, response = order, request = (route, bucket, day), source = region.


def _chain_tables(t, gaps: bool):
    """The collection chain of all quotes; with gaps, some rows lack what they should point to."""
    q = t.quotes.withColumn("raw_quote_id", F.sha2(F.concat(F.lit("raw"), F.col("quote_id")), 256)).withColumn(
        "request_id", F.sha2(F.concat_ws("|", "route", "bucket", F.date_format("collected_date", "yyyy-MM-dd")), 256)).withColumn(
        "response_id", F.concat_ws("/", "order_key", "request_id"))
    answered, decided, named = F.lit(True), F.lit("ALLOWED"), F.col("source")
    if gaps:
        answered = ~F.col("response_id").startswith("1")
        decided = F.when(F.month("collected_date") != 7, "ALLOWED")
        named = F.when(F.col("source") != "AFRICA", F.col("source"))
    raw = q.select("raw_quote_id", F.when(answered, F.col("response_id")).alias("response_id"))
    responses = q.select("response_id", "request_id").distinct()
    requests = q.select("request_id").distinct()
    decisions = q.select("request_id", decided.alias("decision"), F.col("collected_date").alias("decided_at")).distinct()
    sources = q.select(named.alias("source")).distinct()
    return q.drop("request_id", "response_id"), raw, responses, requests, decisions, sources


@query("j3_lineage", compose(f"""
    SELECT {day('h.obs_date')} AS obs_date, c.route, q.bucket, q.quote_id, q.total_fare, h.i6 / 1000000.0 AS index_value,
           c.c6 / 1000000.0 AS contribution, 'ALLOWED' AS decision,
           CASE WHEN e.quote_id IS NULL THEN '' ELSE 'TAG' END AS cleaning_rules
    FROM headline h JOIN contrib c ON c.obs_date = h.obs_date JOIN q ON q.collected_date = h.obs_date AND q.route = c.route
    LEFT JOIN (SELECT quote_id FROM q WHERE part_key % 9 = 0) e ON e.quote_id = q.quote_id""", "headline", "contrib"))
def _(t):
    q, raw, responses, requests, decisions, sources = _chain_tables(t, gaps=False)
    q_sources = t.quotes.select(
        F.sha2(F.concat_ws("|", "route", "bucket", F.date_format("collected_date", "yyyy-MM-dd")), 256).alias("request_id"),
        "source").distinct()
    heads = t.run.headline.withColumn("bucket", F.lit(None).cast("string"))
    tags = t.quotes.filter(F.col("part_key") % 9 == 0).select("quote_id", F.lit("TAG").alias("rule_id"))
    traced = lineage.lineage(
        heads, t.run.contributions, q, raw, responses, requests.join(q_sources, "request_id"), decisions, sources,
        tags.unionByName(tags))
    return traced.select("obs_date", "route", "bucket", "quote_id", "total_fare", "index_value", "contribution", "decision", "cleaning_rules")


@query("j3b_quote_provenance", compose("""
    SELECT quote_id, CASE WHEN raw_ok AND dec_ok THEN 'ALLOWED' END AS decision, CAST(raw_ok AND dec_ok AND source <> 'AFRICA' AS BIGINT) AS chain_complete
    FROM (SELECT quote_id, source, NOT starts_with(CAST(order_key AS VARCHAR), '1') AS raw_ok, month(collected_date) <> 7 AS dec_ok FROM q)""", "q"))
def _(t):
    q, *tables = _chain_tables(t, gaps=True)
    return lineage.quote_provenance(q, *tables).select("quote_id", "decision", "chain_complete")
