"""Index core: matching, screens, chain, aggregation, weights, error, imputation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from indexwright.functions.labels import is_proxy, rung_meaning
from indexwright.operators import aggregate, imputation, matching, screening, uncertainty, weights
from indexwright.operators.elementary import chain, elementary, stratum_days, stratum_index
from indexwright.operators.quantiles import ranked_quantiles
from indexwright.plans.index_run import stratum_table
from indexwright.plans.replay import input_hash, observation_hashes, replay_check, with_input_hash
from indexwright.plans.sensitivity import threshold_sweep
from registry.base import query
from registry.sql_parts import chain_parts, compose, day, he, hes

OBS = day("obs_date")


@query("w1_collection_calendar", compose(
    f"SELECT {day('d')} AS collected_date, day_no, {day('prev_date')} AS prev_date, {day('next_date')} AS next_date FROM days",
    "days"))
def _(t):
    return matching.collection_calendar(t.quotes)


@query("j1_matched_pairs", compose(f"""
    SELECT route, bucket, {OBS} AS obs_date, pair_key, prev_c / 100.0 AS previous_fare, cur_c / 100.0 AS current_fare,
           CAST(n AS BIGINT) AS quotes FROM matched WHERE prev_c IS NOT NULL AND cur_c IS NOT NULL""", "matched"))
def _(t):
    return t.matched.filter("status = 'PAIRED'").drop("status")


@query("o1_unmatched_products", compose(f"""
    SELECT route, bucket, {OBS} AS obs_date, count(*) FILTER (prev_c IS NULL) AS new_products,
           count(*) FILTER (cur_c IS NULL) AS gone_products,
           count(*) FILTER (prev_c IS NOT NULL AND cur_c IS NOT NULL) AS paired_products
    FROM matched GROUP BY ALL""", "matched"))
def _(t):
    def n(status):
        return F.count(F.when(F.col("status") == status, 1))
    return t.matched.groupBy("route", "bucket", "obs_date").agg(
        n("NEW").alias("new_products"), n("GONE").alias("gone_products"), n("PAIRED").alias("paired_products"))


@query("j1_flight_key_pairs", compose(f"""
    SELECT {OBS} AS obs_date, count(*) AS pairs, CAST(sum(f) AS BIGINT) AS current_cents, CAST(sum(pf) AS BIGINT) AS previous_cents
    FROM (SELECT c.d AS obs_date, c.f, p.f AS pf
          FROM (SELECT route, bucket, k, d, f FROM byk) c
          JOIN (SELECT byk.*, next_date FROM byk JOIN days USING (d)) p
            ON p.route = c.route AND p.bucket = c.bucket AND p.k = c.k AND p.next_date = c.d)
    GROUP BY obs_date""", "days", extra={"byk": """
      SELECT route, bucket, carrier || '|' || coalesce(flight_no, '?') || '|' || coalesce(fare_brand, '?') AS k,
             collected_date AS d, min(fare_c) AS f FROM q GROUP BY ALL"""}))
def _(t):
    q = t.quotes.withColumn("flight_key", matching.flight_key())
    m = matching.match_periods(q, "flight_key").filter("status = 'PAIRED'")
    return m.groupBy("obs_date").agg(
        F.count("*").alias("pairs"),
        (F.sum("current_fare") * 100).cast("bigint").alias("current_cents"),
        (F.sum("previous_fare") * 100).cast("bigint").alias("previous_cents"))


@query("a2_implausible_pairs", compose(f"""
    SELECT route, bucket, {OBS} AS obs_date, pair_key, round_even(relative, 6) AS relative
    FROM pairs WHERE NOT plausible""", "pairs"))
def _(t):
    return t.pairs.filter("not plausible").select(
        "route", "bucket", "obs_date", "pair_key", F.bround("relative", 6).alias("relative"))


@query("w7_stratum_quantiles", compose(f"""
    SELECT route, bucket, {OBS} AS obs_date, n, round_even(p5, 9) AS p5, round_even(med, 9) AS median,
           round_even(p95, 9) AS p95, round_even(mad, 9) AS mad, round_even(mean_ad, 9) AS mean_ad FROM spread""", "spread"))
def _(t):
    return screening.stratum_spread(t.pairs).groupBy("route", "bucket", "obs_date").agg(
        F.first("n").alias("n"),
        *[F.bround(F.first(c), 9).alias(c) for c in ("p5", "median", "p95", "mad", "mean_ad")])


@query("w7_ranked_quantiles", compose(f"""
    SELECT {OBS} AS obs_date, round_even(quantile_cont(lr, 0.05), 9) AS p5, round_even(median(lr), 9) AS median,
           round_even(quantile_cont(lr, 0.95), 9) AS p95, count(*) AS group_rows
    FROM pairs WHERE plausible GROUP BY obs_date""", "pairs"))
def _(t):
    ranked = ranked_quantiles(
        t.pairs.filter("plausible"), ["obs_date"], "log_relative",
        {"p5": 0.05, "median": 0.5, "p95": 0.95})
    return ranked.select("obs_date", *[F.bround(c, 9).alias(c) for c in ("p5", "median", "p95")], "group_rows")


def _screened(small: bool, mode: str) -> str:
    flag = mode == "FLAG"
    if small:
        rule, out = ("EXTREME_SMALL_N_FLAGGED" if flag else "OUTLIER_WINSORISE_P5_P95"), "out_small"
        kept, observed = "1", "relative" if flag else "lr"
        threshold = "NULL" if flag else "clamped"
        final = "lr" if flag else "clamped"
    else:
        rule, out = ("EXTREME_MAD_FLAGGED" if flag else "OUTLIER_MAD_LOG_RELATIVE"), "out_large"
        kept, observed, threshold = ("1" if flag else "0"), "relative", "3.5"
        final = "lr" if flag else "NULL"
    return compose(f"""
      SELECT route, bucket, {OBS} AS obs_date, pair_key, CAST({kept} AS BIGINT) AS kept, '{rule}' AS rule_id,
             round_even({observed}, 6) AS observed, round_even(CAST({threshold} AS DOUBLE), 6) AS threshold,
             round_even(CAST({final} AS DOUBLE), 6) AS screened_log
      FROM judged WHERE {out}""", "judged")


def _verdicts(t, mode, rules):
    return screening.screen(t.pairs, mode).filter(F.col("rule_id").isin(*rules)).select(
        "route", "bucket", "obs_date", "pair_key", "kept", "rule_id",
        *[F.bround(c, 6).alias(c) for c in ("observed", "threshold", "screened_log")])


@query("a2b_small_n_flagged", _screened(True, "FLAG"))
def _(t):
    return _verdicts(t, "FLAG", ["EXTREME_SMALL_N_FLAGGED"])


@query("a2b_small_n_winsorised", _screened(True, "REJECT"))
def _(t):
    return _verdicts(t, "REJECT", ["OUTLIER_WINSORISE_P5_P95"])


@query("a2c_mad_flagged", _screened(False, "FLAG"))
def _(t):
    return _verdicts(t, "FLAG", ["EXTREME_MAD_FLAGGED"])


@query("a2c_mad_rejected", _screened(False, "REJECT"))
def _(t):
    return _verdicts(t, "REJECT", ["OUTLIER_MAD_LOG_RELATIVE"])


@query("a2d_cleaning_events", compose(f"""
    SELECT route, bucket, {OBS} AS obs_date, pair_key, CAST(1 AS BIGINT) AS kept, CAST(1 AS BIGINT) AS flagged,
           round_even(relative, 6) AS observed, CASE WHEN out_large THEN CAST(3.5 AS DOUBLE) END AS threshold,
           CASE WHEN out_small THEN 'EXTREME_SMALL_N_FLAGGED' ELSE 'EXTREME_MAD_FLAGGED' END AS rule_id
    FROM judged WHERE out_small OR out_large
    UNION ALL
    SELECT route, bucket, {OBS}, pair_key, 0, 0, round_even(relative, 6), CAST(100.0 AS DOUBLE), 'IMPLAUSIBLE_RELATIVE'
    FROM pairs WHERE NOT plausible""", "judged"))
def _(t):
    return screening.cleaning_events(screening.screen(t.pairs)).drop("reason", "current_fare").withColumn(
        "observed", F.bround("observed", 6))


@query("a1_elementary", compose(f"""
    SELECT route, bucket, {OBS} AS obs_date, raw_quotes, pairs, accepted, rejected,
           CASE WHEN accepted >= 3 THEN round_even(exp(mean_log), 6) END AS gm_relative,
           CAST(accepted < 3 AS BIGINT) AS insufficient FROM stats""", "stats"))
def _(t):
    return elementary(stratum_days(t.matched)).select(
        "route", "bucket", "obs_date", "raw_quotes", "pairs", "accepted", "rejected", "gm_relative", "insufficient")


@query("a1_elementary_flag_counts", compose(f"""
    SELECT r.route, r.bucket, {day('r.obs_date')} AS obs_date, r.accepted, r.rejected,
           coalesce(f.flagged, 0) AS flagged, CAST(r.rejected AS BIGINT) AS implausible
    FROM stats r LEFT JOIN (SELECT route, bucket, obs_date, count(*) AS flagged FROM judged
                            WHERE out_small OR out_large GROUP BY ALL) f USING (route, bucket, obs_date)""",
    "stats", "judged"))
def _(t):
    return stratum_days(t.matched, with_flags=True).select(
        "route", "bucket", "obs_date", "accepted", "rejected", "flagged", "implausible")


def _strata_sql(name: str) -> str:
    return compose(f"""
      SELECT route, bucket, {OBS} AS obs_date, index_value, prev_index_value, raw_quotes,
             CAST(input_quote_count AS BIGINT) AS input_quote_count, CAST(excluded_count AS BIGINT) AS excluded_count,
             CAST(insufficient AS BIGINT) AS insufficient FROM {name}""", name)


@query("a4_stratum_index", _strata_sql("strata"))
def stratum_index_query(t):
    return stratum_index(t.quotes)


@query("a4_stratum_index_reject", _strata_sql("strata_reject"))
def _(t):
    return stratum_index(t.quotes, mode="REJECT")


@query("a3_first_sightings", compose(f"""
    SELECT route, bucket, {OBS} AS obs_date, index_value, raw_quotes AS input_quote_count
    FROM strata WHERE prev_index_value IS NULL""", "strata"))
def _(t):
    return stratum_index(t.quotes).filter("prev_index_value is null").select(
        "route", "bucket", "obs_date", "index_value", "input_quote_count")


@query("a5_weighted_mean", compose(f"""
    SELECT {OBS} AS obs_date, i6 / 1000000.0 AS index_value, CASE WHEN have_all THEN pv / 1000000.0 END AS previous_index,
           CAST({he('w8', '100')} AS BIGINT) / 1000000.0 AS weight_total, routes_in_basket AS components
    FROM (SELECT h.*, (SELECT {he('sum(b.w8 * b.p6)', 'sum(b.w8)')} FROM basket b WHERE b.obs_date = h.obs_date) AS pv
          FROM head_all h)""", "head_all"))
def _(t):
    parts = aggregate.basket_components(t.run.routes, t.weights)
    return aggregate.weighted_arithmetic(parts, ["obs_date"]).drop("movement")


@query("a5c_movement", compose(f"""
    SELECT {OBS} AS obs_date, (i6 - (SELECT {he('sum(b.w8 * b.p6)', 'sum(b.w8)')} FROM basket b WHERE b.obs_date = h.obs_date))
           / 1000000.0 AS movement FROM head_all h WHERE have_all""", "head_all"))
def _(t):
    parts = aggregate.basket_components(t.run.routes, t.weights)
    return aggregate.weighted_arithmetic(parts, ["obs_date"]).filter("movement is not null").select("obs_date", "movement")


@query("a5b_contributions", compose(
    f"SELECT {OBS} AS obs_date, route, c6 / 1000000.0 AS contribution FROM contrib", "contrib"))
def _(t):
    parts = aggregate.basket_components(t.run.routes, t.weights)
    return aggregate.contributions(parts, ["obs_date"]).select("obs_date", "route", "contribution")


@query("w6_weight_total_per_date", compose(
    f"SELECT {OBS} AS obs_date, CAST(sum(w8) AS BIGINT) / 100000000.0 AS weight_total, count(*) AS routes FROM basket GROUP BY obs_date",
    "basket"))
def _(t):
    parts = aggregate.basket_components(t.run.routes, t.weights)
    return parts.groupBy("obs_date").agg(F.sum("weight").alias("weight_total"), F.count("*").alias("routes"))


@query("a6_route_index", compose(f"""
    SELECT route, {OBS} AS obs_date, i6 / 1000000.0 AS index_value, p6 / 1000000.0 AS prev_index_value,
           strata_computed, imputed_count, input_quote_count, excluded_count FROM routes""", "routes"))
def _(t):
    return t.run.routes.drop("raw_quotes")


@query("j5_previous_value", compose(f"""
    SELECT route, {OBS} AS obs_date, p6 / 1000000.0 AS previous FROM routes WHERE p6 IS NOT NULL""", "routes"))
def _(t):
    return aggregate.previous_of(t.run.routes, ["route"], "index_value", "previous").filter(
        "previous is not null").select("route", "obs_date", "previous")


@query("a6b_headline", compose(f"""
    SELECT {OBS} AS obs_date, i6 / 1000000.0 AS index_value, p6 / 1000000.0 AS prev_index_value, routes_in_basket,
           input_quote_count, excluded_count, imputed_count FROM headline""", "headline"))
def _(t):
    return t.run.headline


@query("a6b_refused_headlines", compose(f"""
    SELECT {OBS} AS obs_date, CASE WHEN h.i6 IS NULL
        THEN '{aggregate.REFUSED_EMPTY}' ELSE '{aggregate.REFUSED_SIMULATED}' END AS reason
    FROM head_days d LEFT JOIN head_all h USING (obs_date)
    WHERE h.i6 IS NULL OR obs_date IN (SELECT obs_date FROM sim_days)""", "head_days", "head_all", "sim_days"))
def _(t):
    return t.run.refused


@query("a6c_headline_contributions", compose(f"""
    SELECT {OBS} AS obs_date, route, CAST(w8 AS BIGINT) / 100000000.0 AS weight, c6 / 1000000.0 AS contribution FROM contrib
    WHERE obs_date NOT IN (SELECT obs_date FROM sim_days)""", "contrib", "sim_days"))
def _(t):
    return t.run.contributions


@query("a6c_barred_route_days", compose(f"""
    SELECT DISTINCT route, {day('collected_date')} AS obs_date FROM q WHERE provenance = 'SIMULATED_DEMO'""", "q"))
def _(t):
    return aggregate.simulated_days(t.quotes, by_route=True)


@query("o5_all_levels", compose(f"""
    SELECT {OBS} AS obs_date, 'STRATUM' AS level, route, bucket, index_value, prev_index_value,
           CAST(input_quote_count AS BIGINT) AS input_quote_count, CAST(excluded_count AS BIGINT) AS excluded_count,
           CAST(0 AS BIGINT) AS imputed_count, CAST(NULL AS BIGINT) AS routes_in_basket, '1' AS methodology_version,
           '1' AS weight_set_version, CAST(1 AS BIGINT) AS revision
    FROM strata WHERE index_value IS NOT NULL
    UNION ALL SELECT {OBS}, 'ROUTE', route, NULL, i6 / 1000000.0, p6 / 1000000.0, input_quote_count, excluded_count,
           imputed_count, NULL, '1', '1', 1 FROM routes WHERE i6 IS NOT NULL
    UNION ALL SELECT {OBS}, 'HEADLINE', NULL, NULL, i6 / 1000000.0, p6 / 1000000.0, input_quote_count, excluded_count,
           imputed_count, routes_in_basket, '1', '1', 1 FROM headline""", "strata", "routes", "headline"))
def _(t):
    return t.run.observations()


# -- imputation -----------------------------------------------------------------
# Strata that have too few accepted pairs on a collection day are missing; other
# buckets of their route, then other routes, are the donors.

_IMPUTE = {
    "gap_visits": chain_parts("stats", "gap")["gap_visits"][1],
    "firsts": "SELECT route, bucket, min(obs_date) AS first_date FROM gap_visits GROUP BY ALL",
    "grid": """SELECT f.route, f.bucket, f.first_date, c.obs_date FROM firsts f
               JOIN (SELECT DISTINCT obs_date FROM gap_visits) c ON c.obs_date >= f.first_date""",
    "own": """SELECT g.*, CASE WHEN g.obs_date > g.first_date THEN ln(v.gm) END AS own
              FROM grid g LEFT JOIN gap_visits v USING (route, bucket, obs_date)""",
    "donors": """SELECT o.*, r.rn, r.rs, a.dn, a.ds,
                   CASE WHEN r.rn > 0 THEN r.rs / r.rn WHEN a.dn > 0 THEN a.ds / a.dn END AS donor,
                   CASE WHEN r.rn > 0 THEN r.rn ELSE a.dn END AS donor_count,
                   row_number() OVER (PARTITION BY o.route, o.bucket ORDER BY o.obs_date) AS seq
                 FROM own o
                 JOIN (SELECT route, obs_date, sum(own) AS rs, count(own) AS rn FROM own GROUP BY ALL) r USING (route, obs_date)
                 JOIN (SELECT obs_date, sum(own) AS ds, count(own) AS dn FROM own GROUP BY ALL) a USING (obs_date)""",
    "fold": """SELECT route, bucket, obs_date, own, donor, donor_count, seq, CAST(100.0 AS DOUBLE) AS idx,
                 CAST(100.0 AS DOUBLE) AS held, CAST(NULL AS DOUBLE) AS prev, 0 AS run, FALSE AS imputed
               FROM donors WHERE seq = 1
               UNION ALL
               SELECT d.route, d.bucket, d.obs_date, d.own, d.donor, d.donor_count, d.seq,
                 CASE WHEN d.own IS NOT NULL THEN round_even(f.held * exp(d.own), 6)
                      WHEN d.donor IS NOT NULL AND f.run < 30 THEN round_even(f.held * exp(d.donor), 6) END,
                 coalesce(CASE WHEN d.own IS NOT NULL THEN round_even(f.held * exp(d.own), 6)
                      WHEN d.donor IS NOT NULL AND f.run < 30 THEN round_even(f.held * exp(d.donor), 6) END, f.held),
                 f.held,
                 CASE WHEN d.own IS NOT NULL THEN 0 WHEN d.donor IS NOT NULL AND f.run < 30 THEN f.run + 1 ELSE f.run END,
                 d.own IS NULL AND d.donor IS NOT NULL AND f.run < 30
               FROM fold f JOIN donors d ON d.route = f.route AND d.bucket = f.bucket AND d.seq = f.seq + 1""",
}


@query("a7_imputed_strata", compose(f"""
    SELECT route, bucket, {OBS} AS obs_date, idx AS index_value, prev AS prev_index_value,
           CASE WHEN imputed THEN 'Y' ELSE 'N' END AS imputation_code,
           CASE WHEN imputed THEN 'NO_FLIGHTS' ELSE 'NONE' END AS missing_reason,
           CASE WHEN imputed THEN donor_count ELSE 0 END AS donor_count,
           CASE WHEN imputed THEN round_even(exp(donor), 6) END AS movement_applied,
           CAST(run AS BIGINT) AS consecutive_imputations FROM fold""", "stats", extra=_IMPUTE))
def _(t):
    return imputation.impute_missing(stratum_days(t.matched))


@query("a7b_imputation_rate", compose(f"""
    SELECT {OBS} AS obs_date, count(*) AS strata, count(*) FILTER (imputed) AS imputed,
           {he('count(*) FILTER (imputed) * 1000', 'count(*)')} / 1000.0 AS imputation_rate
    FROM fold GROUP BY obs_date""", "stats", extra=_IMPUTE))
def _(t):
    counts = imputation.impute_missing(stratum_days(t.matched)).groupBy("obs_date").agg(
        F.count("*").alias("strata"), F.count(F.when(F.col("imputation_code") == "Y", 1)).alias("imputed"))
    return counts.withColumn("imputation_rate", imputation.imputation_rate(F.col("strata"), F.col("imputed")))


@query("a7_index_with_imputation", compose(f"""
    SELECT f.route, f.bucket, {day('f.obs_date')} AS obs_date, idx AS index_value, prev AS prev_index_value,
           CAST(coalesce(s.raw_quotes, 0) AS BIGINT) AS raw_quotes,
           CAST(CASE WHEN prev IS NOT NULL AND NOT imputed AND idx IS NOT NULL THEN s.accepted ELSE coalesce(s.raw_quotes, 0) END AS BIGINT)
             AS input_quote_count,
           CAST(CASE WHEN prev IS NULL THEN 0 ELSE coalesce(s.rejected, 0) END AS BIGINT) AS excluded_count,
           CAST(CASE WHEN prev IS NULL OR (NOT imputed AND idx IS NOT NULL) THEN 0 ELSE 1 END AS BIGINT) AS insufficient
    FROM fold f LEFT JOIN stats s ON s.route = f.route AND s.bucket = f.bucket AND s.obs_date = f.obs_date""",
    "stats", extra=_IMPUTE))
def _(t):
    return stratum_table(t.quotes, missing="impute")


# -- sampling error --------------------------------------------------------------
_T95 = "CASE accepted - 1 WHEN 1 THEN 12706 WHEN 2 THEN 4303 WHEN 3 THEN 3182 WHEN 4 THEN 2776 WHEN 5 THEN 2571 WHEN 6 THEN 2447 WHEN 7 THEN 2365 ELSE 1960 END"
_ERRORS = {
    "errs": """SELECT route, bucket, obs_date, i6, accepted,
        CAST(round(round_even(index_value * sqrt(var_log / s.accepted), 6) * 1000000) AS HUGEINT) AS se6
      FROM strata JOIN (SELECT route, bucket, obs_date, accepted, var_log FROM stats) s USING (route, bucket, obs_date)
      WHERE i6 IS NOT NULL AND s.accepted >= 2 AND prev_index_value IS NOT NULL"""}


def _with_error(t):
    stats = stratum_days(t.matched)
    strata = chain(stats).join(
        stats.select("route", "bucket", "obs_date", "accepted", "var_log"), ["route", "bucket", "obs_date"])
    return uncertainty.stratum_error(strata.filter("index_value is not null and prev_index_value is not null"))


@query("a8_stratum_error", compose(f"""
    SELECT route, bucket, {OBS} AS obs_date, i6 / 1000000.0 AS index_value, accepted, se6 / 1000000.0 AS standard_error,
           {hes(f'i6 * 1000 - {_T95} * se6', '1000')} / 1000000.0 AS lower_95,
           {hes(f'i6 * 1000 + {_T95} * se6', '1000')} / 1000000.0 AS upper_95,
           {he('se6 * 100000', 'i6')} / 1000.0 AS relative_error_pct
    FROM errs""", "strata", "stats", extra=_ERRORS))
def _(t):
    return _with_error(t).select(
        "route", "bucket", "obs_date", "index_value", "accepted", "standard_error", "lower_95", "upper_95",
        "relative_error_pct")


@query("a8b_aggregate_error", compose(f"""
    SELECT route, {OBS} AS obs_date, count(se6) AS components_with_error,
           round_even(sqrt(sum(0.166667 * 0.166667 * (se6 / 1000000.0) * (se6 / 1000000.0))) / sum(0.166667::DOUBLE), 6) AS standard_error
    FROM errs GROUP BY ALL""", "strata", "stats", extra=_ERRORS))
def _(t):
    rows = _with_error(t).withColumn("weight", F.lit(0.166667))
    return uncertainty.aggregate_error(rows, ["route", "obs_date"])


# -- weights ---------------------------------------------------------------------
@query("a9_traffic_weights", compose(f"""
    SELECT route, CAST(w8 AS BIGINT) / 100000000.0 AS weight, CAST(2 AS BIGINT) AS evidence_rung,
           'quote volumes' AS evidence_ref FROM weights""", "weights"))
def _(t):
    return t.weights


@query("w5_residue_route", compose("""
    SELECT route, CAST(w8 - s8 AS BIGINT) / 100000000.0 AS residue FROM weights JOIN shares USING (route) WHERE w8 <> s8""",
    "weights"))
def _(t):
    raw = t.traffic.withColumn("share", F.col("volume"))
    total = raw.agg(F.sum("volume").alias("n")).scalar()
    share = F.bround(F.col("volume").cast("decimal(20,0)") / total.cast("decimal(13,0)"), 8)
    return raw.join(t.weights, "route").withColumn(
        "residue", (F.col("weight") - share).cast("decimal(12,8)")).filter("residue <> 0").select("route", "residue")


@query("a9b_equal_weights", compose("""
    SELECT route, (5000000 + CASE WHEN row_number() OVER (ORDER BY route DESC) = 1 THEN 100000000 - 5000000 * count(*) OVER () ELSE 0 END)
           / 100000000.0 AS weight, CAST(4 AS BIGINT) AS evidence_rung, 'no traffic data' AS evidence_ref
    FROM (SELECT DISTINCT route FROM q)""", "q"))
def _(t):
    return weights.equal_weights(t.quotes, "no traffic data")


@query("j10_gravity_weights", compose(f"""
    SELECT route, volume, (s8 + CASE WHEN row_number() OVER (ORDER BY s8 DESC, route DESC) = 1
           THEN 100000000 - sum(s8) OVER () ELSE 0 END)::BIGINT / 100000000.0 AS weight
    FROM (SELECT route, CAST(volume AS DOUBLE) AS volume,
                 {he('volume * 100000000', '(SELECT sum(volume) FROM gravity)')}::HUGEINT AS s8 FROM gravity)""", "q", extra={
    "through": "SELECT origin AS airport, count(*)::HUGEINT AS passengers FROM q GROUP BY origin",
    "gravity": """SELECT r.route, o.passengers * d.passengers AS volume FROM (SELECT DISTINCT route, origin, destination FROM q) r
                  JOIN through o ON o.airport = r.origin JOIN through d ON d.airport = r.destination"""}))
def _(t):
    through = t.quotes.groupBy(F.col("source").alias("airport")).agg(F.count("*").alias("passengers"))
    traffic = weights.gravity_traffic(t.quotes.select("route").distinct(), through)
    shares = weights.weights_from_traffic(traffic, 3, "throughput product")
    return traffic.join(shares.select("route", "weight"), "route")


@query("o3_airports_without_data", compose("""
    SELECT DISTINCT destination AS airport FROM q WHERE destination NOT IN (
        SELECT origin FROM q GROUP BY origin HAVING count(*) > (SELECT count(*) / 5.0 FROM q))""", "q"))
def _(t):
    counts = t.quotes.groupBy(F.col("source").alias("airport")).agg(F.count("*").alias("passengers"))
    busy = counts.filter(F.col("passengers") > counts.agg(F.sum("passengers") / 5).scalar())
    return weights.airports_without_data(t.quotes.select("route").distinct(), busy)


_SETS = {"sets": """
    SELECT source AS weight_set, route, CASE WHEN source = 'ASIA' THEN w8 ELSE w8 * 2 END AS w8,
           CASE WHEN route LIKE '%AFRICA' THEN 5 ELSE 2 END AS evidence_rung,
           CASE WHEN source = 'EUROPE' THEN ' ' ELSE 'volumes' END AS evidence_ref
    FROM (SELECT DISTINCT source, route FROM q) JOIN weights USING (route)
    UNION ALL SELECT 'ALL', route, w8, 2, 'volumes' FROM weights
    UNION ALL SELECT 'EUROPE', min(route), 100, 1, 'twice' FROM weights WHERE route LIKE 'EUROPE%'"""}


def _weight_sets(t):
    by_source = t.quotes.select(F.col("source").alias("weight_set"), "route").distinct().join(t.weights, "route")
    doubled = by_source.select(
        "weight_set", "route",
        F.when(F.col("weight_set") == "ASIA", F.col("weight")).otherwise(F.col("weight") * 2).cast("decimal(10,8)").alias("weight"),
        F.when(F.col("route").endswith("AFRICA"), 5).otherwise(2).alias("evidence_rung"),
        F.when(F.col("weight_set") == "EUROPE", " ").otherwise("volumes").alias("evidence_ref"))
    whole = t.weights.select(F.lit("ALL").alias("weight_set"), "route", "weight", "evidence_rung", F.lit("volumes").alias("evidence_ref"))
    twice = t.weights.filter(F.col("route").startswith("EUROPE")).agg(F.min("route").alias("route")).select(
        F.lit("EUROPE").alias("weight_set"), "route", F.lit("0.000001").cast("decimal(10,8)").alias("weight"),
        F.lit(1).alias("evidence_rung"), F.lit("twice").alias("evidence_ref"))
    return doubled.unionByName(whole).unionByName(twice)


@query("a9c_weight_violations", compose("""
    SELECT weight_set, rule, CAST(violations AS BIGINT) AS violations FROM (
      SELECT weight_set, 'duplicate_route' AS rule, count(*) AS violations
        FROM (SELECT weight_set, route FROM sets GROUP BY ALL HAVING count(*) > 1) GROUP BY ALL
      UNION ALL SELECT weight_set, 'non_positive_weight', count(*) FILTER (w8 <= 0) FROM sets GROUP BY weight_set
      UNION ALL SELECT weight_set, 'bad_evidence_rung', count(*) FILTER (evidence_rung NOT BETWEEN 1 AND 4) FROM sets GROUP BY weight_set
      UNION ALL SELECT weight_set, 'missing_evidence_ref', count(*) FILTER (trim(evidence_ref) = '') FROM sets GROUP BY weight_set
      UNION ALL SELECT weight_set, 'not_closed', CASE WHEN sum(w8) <> 100000000 THEN 1 ELSE 0 END FROM sets GROUP BY weight_set)
    WHERE violations > 0""", "q", "weights", extra=_SETS))
def _(t):
    return weights.validate_weights(_weight_sets(t), ["weight_set"])


@query("a9d_weight_set_summary", compose("""
    SELECT weight_set, CAST(sum(w8) AS BIGINT) / 100000000.0 AS total, CAST(max(evidence_rung) AS BIGINT) AS worst_rung,
           CAST(bool_or(evidence_rung >= 3) AS BIGINT) AS any_proxy, count(*) AS routes FROM sets GROUP BY weight_set""",
    "q", "weights", extra=_SETS))
def _(t):
    return weights.weight_set_summary(_weight_sets(t), ["weight_set"])


@query("p11_rung_labels", compose("""
    SELECT weight_set, route, CAST(evidence_rung AS BIGINT) AS evidence_rung, CAST(evidence_rung >= 3 AS BIGINT) AS is_proxy,
           CASE evidence_rung WHEN 1 THEN 'DGCA per-city-pair passenger volumes' WHEN 2 THEN 'DGCA popular-routes list'
                WHEN 3 THEN 'Airport-throughput proxy' WHEN 4 THEN 'Equal weights - not derived from traffic data'
                ELSE 'unknown' END AS rung_meaning FROM sets""", "q", "weights", extra=_SETS))
def _(t):
    return _weight_sets(t).select(
        "weight_set", "route", "evidence_rung", is_proxy(F.col("evidence_rung")).alias("is_proxy"),
        rung_meaning(F.col("evidence_rung")).alias("rung_meaning"))


# -- digests, replay, sensitivity --------------------------------------------------
_TREE = {
    "leaf": """SELECT route, bucket, collected_date, sha256(pair_key || ':' || printf('%d.%02d', fare_c // 100, fare_c % 100) || '*' || count(*)) AS digest
               FROM q GROUP BY route, bucket, collected_date, pair_key, fare_c""",
    "node5": "SELECT route, bucket, collected_date, left(digest, 5) AS place, sha256(string_agg(digest, '|' ORDER BY digest)) AS digest FROM leaf GROUP BY ALL",
    "node2": "SELECT route, bucket, collected_date, left(place, 2) AS top, sha256(string_agg(digest, '|' ORDER BY place)) AS digest FROM node5 GROUP BY ALL",
    "tree": "SELECT route, bucket, collected_date, sha256(string_agg(digest, '|' ORDER BY top)) AS input_hash FROM node2 GROUP BY ALL",
}


@query("a12_input_hash", compose("""
    SELECT route, bucket, strftime(collected_date, '%Y-%m-%d') AS collected_date, count(*) AS quotes,
           any_value(input_hash) AS input_hash FROM q JOIN tree USING (route, bucket, collected_date) GROUP BY ALL""", "q", extra=_TREE))
def _(t):
    return input_hash(t.quotes, ["route", "bucket", "collected_date"])


_LEVEL_TREE = {
    "per_level": """SELECT 'STRATUM' AS level, route, bucket, collected_date AS obs_date, pair_key, fare_c FROM q
                    UNION ALL SELECT 'ROUTE', route, NULL, collected_date, pair_key, fare_c FROM q
                    UNION ALL SELECT 'HEADLINE', NULL, NULL, collected_date, pair_key, fare_c FROM q""",
    "lv_leaf": """SELECT level, route, bucket, obs_date, sha256(pair_key || ':' || printf('%d.%02d', fare_c // 100, fare_c % 100) || '*' || count(*)) AS digest
                  FROM per_level GROUP BY level, route, bucket, obs_date, pair_key, fare_c""",
    "lv_node5": "SELECT level, route, bucket, obs_date, left(digest, 5) AS place, sha256(string_agg(digest, '|' ORDER BY digest)) AS digest FROM lv_leaf GROUP BY ALL",
    "lv_node2": "SELECT level, route, bucket, obs_date, left(place, 2) AS top, sha256(string_agg(digest, '|' ORDER BY place)) AS digest FROM lv_node5 GROUP BY ALL",
    "lv_tree": "SELECT level, route, bucket, obs_date, sha256(string_agg(digest, '|' ORDER BY top)) AS input_hash FROM lv_node2 GROUP BY ALL",
    "lv_rows": """SELECT 'STRATUM' AS level, route, bucket, obs_date, index_value FROM strata WHERE index_value IS NOT NULL
                  UNION ALL SELECT 'ROUTE', route, NULL, obs_date, i6 / 1000000.0 FROM routes WHERE i6 IS NOT NULL
                  UNION ALL SELECT 'HEADLINE', NULL, NULL, obs_date, i6 / 1000000.0 FROM headline""",
}


@query("a12_observation_hashes", compose(f"""
    SELECT {OBS.replace('obs_date', 'o.obs_date')} AS obs_date, o.level, o.route, o.bucket, o.index_value, coalesce(t.input_hash, sha256('')) AS input_hash
    FROM lv_rows o LEFT JOIN lv_tree t ON t.level = o.level AND t.obs_date = o.obs_date
     AND t.route IS NOT DISTINCT FROM o.route AND t.bucket IS NOT DISTINCT FROM o.bucket""", "q", "strata", "routes", "headline", extra=_LEVEL_TREE))
def _(t):
    rows = with_input_hash(t.run.observations(), observation_hashes(t.quotes))
    return rows.select("obs_date", "level", "route", "bucket", "index_value", "input_hash")


@query("a12b_replay_mismatches", compose(f"""
    SELECT coalesce(a.route, b.route) AS route, coalesce(a.bucket, b.bucket) AS bucket,
           strftime(coalesce(a.obs_date, b.obs_date), '%Y-%m-%d') AS obs_date,
           a.index_value AS stored_value, b.index_value AS recomputed_value
    FROM (SELECT * FROM strata WHERE index_value IS NOT NULL) a
    FULL JOIN (SELECT * FROM strata_reject WHERE index_value IS NOT NULL) b
      ON a.route = b.route AND a.bucket = b.bucket AND a.obs_date = b.obs_date
    WHERE a.index_value IS DISTINCT FROM b.index_value""", "strata", "strata_reject"))
def _(t):
    stored = stratum_index(t.quotes).filter("index_value is not null")
    again = stratum_index(t.quotes, mode="REJECT").filter("index_value is not null")
    return replay_check(stored, again, ["route", "bucket", "obs_date"])[0]


@query("a12b_replay_verdict", compose("""
    SELECT count(DISTINCT obs_date) AS days_replayed, count(*) AS values_compared, CAST(0 AS BIGINT) AS mismatches,
           CAST(count(*) > 0 AS BIGINT) AS reproducible FROM strata WHERE index_value IS NOT NULL""", "strata"))
def _(t):
    stored = stratum_index(t.quotes).filter("index_value is not null")
    again = stratum_index(t.quotes.repartition(5, "pair_key")).filter("index_value is not null")
    return replay_check(stored, again, ["route", "bucket", "obs_date"])[1]


_KS = [2.5, 3.0, 3.5, 4.0, 5.0, 1000000.0]


def _sweep_sql(reject: bool) -> str:
    tables, deps, rows = {}, ["raw", "judged"], []
    for i, k in enumerate(_KS):
        keep = f"n_pairs < 5 OR score <= {k}" if reject else "TRUE"
        value = "CASE WHEN n_pairs < 5 THEN clamped ELSE lr END" if reject else "lr"
        tables[f"st{i}"] = f"""
          SELECT r.*, coalesce(k.accepted, 0) AS accepted, k.mean_log, r.pairs - coalesce(k.accepted, 0) AS rejected
          FROM raw r LEFT JOIN (SELECT route, bucket, obs_date, count(*) AS accepted, avg({value}) AS mean_log
                                FROM judged WHERE {keep} GROUP BY ALL) k USING (route, bucket, obs_date)"""
        for name, (_, body) in chain_parts(f"st{i}", f"ch{i}").items():
            tables[name] = body
        rows.append(f"""
          SELECT CAST({k} AS DOUBLE) AS k, route, bucket, arg_max(i6, obs_date) FILTER (i6 IS NOT NULL) AS final,
                 sum(excluded_count) AS rejected, sum(insufficient) AS insufficient FROM ch{i} GROUP BY route, bucket""")
    tables["finals"] = " UNION ALL ".join(rows)
    tables["summary"] = f"""SELECT k, {he('sum(final)', '100 * count(final)')} AS m4, count(*) AS strata,
        CAST(sum(rejected) AS BIGINT) AS rejected, CAST(sum(insufficient) AS BIGINT) AS insufficient FROM finals GROUP BY k"""
    return compose(f"""
      SELECT k, m4 / 10000.0 AS mean_index, strata, rejected, insufficient,
             {hes('(m4 - b) * 100000', 'b')} / 1000.0 AS drift_pct
      FROM summary, (SELECT m4 AS b FROM summary WHERE k = 3.5)""", *deps, extra=tables)


@query("a19_threshold_sweep", _sweep_sql(False))
def _(t):
    return threshold_sweep(t.quotes)


@query("a19_threshold_sweep_reject", _sweep_sql(True))
def _(t):
    return threshold_sweep(t.quotes, mode="REJECT")


@query("w2_lag_within_series", compose(f"""
    SELECT route, bucket, {OBS} AS obs_date, index_value,
           lag(index_value) OVER (PARTITION BY route, bucket ORDER BY obs_date) AS before
    FROM strata WHERE index_value IS NOT NULL""", "strata"))
def _(t):
    rows = stratum_index(t.quotes).filter("index_value is not null")
    series = Window.partitionBy("route", "bucket").orderBy("obs_date")
    return rows.select("route", "bucket", "obs_date", "index_value", F.lag("index_value").over(series).alias("before"))


@query("w4_imputation_runs", compose(f"""
    SELECT route, bucket, CAST(max(run) AS BIGINT) AS longest_run, count(*) FILTER (imputed) AS imputed_days
    FROM fold GROUP BY ALL""", "stats", extra=_IMPUTE))
def _(t):
    return imputation.impute_missing(stratum_days(t.matched)).groupBy("route", "bucket").agg(
        F.max("consecutive_imputations").alias("longest_run"),
        F.count(F.when(F.col("imputation_code") == "Y", 1)).alias("imputed_days"))


@query("a24_near_duplicates", compose(f"""
    SELECT x.quote_id, x.kept_quote_id, route, bucket, strftime(collected_date, '%Y-%m-%d') AS collected_date,
           'NEAR_DUPLICATE_COLLAPSED' AS rule_id
    FROM (SELECT *, min(quote_id) OVER (PARTITION BY source, carrier, mdep, fare_brand, f2, collected_date) AS kept_quote_id
          FROM (SELECT *, date_trunc('year', departure_at) AS mdep, fare_c // 100000 AS f2 FROM q)
          WHERE flight_no IS NULL) x WHERE quote_id <> kept_quote_id""", "q"))
def _(t):
    # Departures at yearly grain and fares in thousands, so that the tables hold repeated offers.
    coarse = t.quotes.withColumn("departure_at", F.date_trunc("year", "departure_at")).withColumn(
        "total_fare", F.floor(F.col("total_fare") / 1000).cast("decimal(12,2)"))
    return matching.collapse_near_duplicates(coarse)[1]
