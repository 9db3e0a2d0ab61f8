"""Data-quality and operations reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from indexwright.functions.labels import freshness
from indexwright.schemas import lead_time_buckets


def fare_parts(quotes: DataFrame) -> DataFrame:
    """What each day adds to fare profiles, by route and bucket: counts, sums, least and greatest fares."""
    return quotes.groupBy("collected_date", "route", "bucket").agg(
        F.count("*").alias("quotes"), F.sum("total_fare").alias("sum_fare"),
        F.min("total_fare").alias("min_fare"), F.max("total_fare").alias("max_fare"))


def lead_time_profile(quotes: DataFrame, route: str | None = None) -> DataFrame:
    """Fare level per bucket on the latest day, relative to the 21-day bucket.

    The latest day is a scalar subquery on the date column; only that day is read
    from a table partitioned by collection date.
    """
    latest = quotes.agg(F.max("collected_date").alias("d")).scalar()
    return _profile(fare_parts(quotes.filter(F.col("collected_date") == latest)), route)


def profile_of_parts(parts: DataFrame, route: str | None = None) -> DataFrame:
    """The same profile from stored ``fare_parts``."""
    latest = parts.agg(F.max("collected_date").alias("d")).scalar()
    return _profile(parts.filter(F.col("collected_date") == latest), route)


def _profile(day: DataFrame, route: str | None) -> DataFrame:
    if route is not None:
        day = day.filter(F.col("route") == route.upper())
    mean = F.sum("sum_fare").cast("decimal(24,2)") / F.sum("quotes").cast("decimal(13,0)")
    per_bucket = day.groupBy("bucket").agg(
        F.sum("quotes").alias("quotes"),
        F.min("min_fare").alias("min_fare"),
        mean.alias("mean_fare"),
        F.max("max_fare").alias("max_fare"),
    )
    # At most six rows from here on.
    buckets = lead_time_buckets(day.sparkSession).drop("lam")
    base = F.max(F.when(F.col("bucket") == "T21", F.col("mean_fare"))).over(Window.partitionBy())
    joined = per_bucket.join(F.broadcast(buckets), "bucket").withColumn("_base", base)
    relative = F.bround(F.col("mean_fare").cast("double") / F.col("_base").cast("double") * 100, 1)
    return joined.select(
        "bucket", "days", "cpi_comparable", "quotes", "min_fare",
        F.bround("mean_fare", 6).cast("decimal(18,6)").alias("mean_fare"), "max_fare",
        relative.alias("relative_to_t21"),
    )


def quality_counts(quotes: DataFrame) -> DataFrame:
    """Counts by status, provenance and confidence and in total, from one scan."""
    return counts_of_parts(quotes.withColumn("observations", F.lit(1)))


def counts_of_parts(parts: DataFrame) -> DataFrame:
    """The same counts from stored ``quality_parts``: rows that stand for ``observations`` quotes."""
    n = F.col("observations")
    sets = parts.groupingSets(
        [["quality_status"], ["provenance"], ["component_confidence"], []],
        "quality_status", "provenance", "component_confidence",
    ).agg(
        F.coalesce(F.sum(n), F.lit(0)).alias("quotes"),
        F.coalesce(F.sum(F.when(F.col("imputation_code") == "Y", n)), F.lit(0)).alias("imputed"),
        F.coalesce(F.sum(F.when(F.col("quality_status") == "COMPLETE", n)), F.lit(0)).alias("complete"),
        F.grouping_id().alias("_g"),
    )
    dimension = (
        F.when(F.col("_g") == 3, "quality_status")
        .when(F.col("_g") == 5, "provenance")
        .when(F.col("_g") == 6, "component_confidence")
        .otherwise("total")
    )
    code = F.coalesce("quality_status", "provenance", "component_confidence", F.lit(""))
    return sets.select(dimension.alias("dimension"), code.alias("code"), "quotes", "imputed", "complete")


def _pct(part: Column, whole: Column) -> Column:
    value = (part * 100).cast("decimal(22,2)") / F.nullif(whole.cast("decimal(13,0)"), F.lit(0))
    return F.coalesce(F.bround(value, 2), F.lit(0)).cast("decimal(7,2)")


def quality_rates(quotes: DataFrame, strata: DataFrame) -> DataFrame:
    """Totals and guarded rates: rejection, imputation and completeness."""
    q = quotes.agg(
        F.count("*").alias("quotes"),
        F.count(F.when(F.col("imputation_code") == "Y", 1)).alias("quotes_imputed"),
        F.count(F.when(F.col("quality_status") == "COMPLETE", 1)).alias("complete"),
    )
    s = strata.agg(
        F.count("index_value").alias("strata_computed"),
        F.coalesce(F.sum(F.when(F.col("index_value").isNotNull(), F.col("input_quote_count"))), F.lit(0))
        .alias("quotes_used"),
        F.coalesce(F.sum(F.when(F.col("index_value").isNotNull(), F.col("excluded_count"))), F.lit(0))
        .alias("quotes_excluded"),
        F.coalesce(F.sum("insufficient"), F.lit(0)).alias("strata_insufficient"),
    )
    # Two single-row tables side by side.
    both = q.withColumn("_s", s.select(F.struct(*s.columns).alias("s")).scalar()).select("*", "_s.*").drop("_s")
    return both.select(
        "quotes", "quotes_imputed", "strata_computed", "quotes_used", "quotes_excluded",
        "strata_insufficient",
        _pct(F.col("quotes_excluded"), F.col("quotes_used") + F.col("quotes_excluded")).alias("rejection_pct"),
        _pct(F.col("quotes_imputed"), F.col("quotes")).alias("imputation_pct"),
        _pct(F.col("complete"), F.col("quotes")).alias("complete_pct"),
    )


def daily_quality(quotes: DataFrame) -> DataFrame:
    """Quotes and quotes that are not complete, per collection day."""
    return quotes.groupBy("collected_date").agg(
        F.count("*").alias("quotes"),
        F.count(F.when(F.col("quality_status") != "COMPLETE", 1)).alias("not_complete"),
    )


SUMMARY_KEYS = [
    "collected_date", "provenance", "quality_status", "component_confidence", "imputation_code",
]


def quality_parts(quotes: DataFrame) -> DataFrame:
    """What each day adds to quality reports, by the codes of its quotes."""
    return quotes.groupBy(*SUMMARY_KEYS).agg(
        F.count("*").alias("observations"), F.count("total_fare").alias("priced"), F.sum("total_fare").alias("sum_fare"),
        F.min("total_fare").alias("min_fare"), F.max("total_fare").alias("max_fare"))


def quality_summary(quotes: DataFrame) -> DataFrame:
    """The rollup behind the quality page."""
    return summary_of_parts(quality_parts(quotes))


def summary_of_parts(parts: DataFrame) -> DataFrame:
    """The same rollup from stored ``quality_parts``, which have one row for each of its rows."""
    mean = F.col("sum_fare").cast("decimal(24,6)") / F.col("priced").cast("decimal(11,0)")
    return parts.select(
        *SUMMARY_KEYS, "observations", "min_fare", F.bround(mean, 6).cast("decimal(18,6)").alias("mean_fare"), "max_fare")


def refresh_quality_summary(quotes: DataFrame, path: str, days: list | None = None) -> None:
    """Recompute the summary of the given days (all when None) and overwrite those."""
    changed = quotes if days is None else quotes.filter(F.col("collected_date").isin(days))
    (
        quality_summary(changed)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("collected_date")
        .parquet(path)
    )


def provenance_mode(quotes: DataFrame) -> DataFrame:
    """Distinct provenances and whether any of them is simulated."""
    # At most one row per provenance code.
    codes = quotes.select("provenance").distinct().agg(
        F.array_sort(F.collect_set("provenance")).alias("provenances")
    )
    return codes.withColumn(
        "mode",
        F.when(F.array_contains("provenances", "SIMULATED_DEMO"), "OFFLINE_DEMO").otherwise("LIVE"),
    )


def observation_age(observed: DataFrame, now: Column, at: str = "collected_at", by: list[str] | None = None) -> DataFrame:
    """Newest observation, of each group if asked for, its age in hours and the freshness verdict."""
    seconds = F.unix_timestamp(now) - F.unix_timestamp(F.col("latest_at"))
    age = F.bround(seconds / 3600, 1)
    return (
        observed.groupBy(*(by or [])).agg(F.max(at).alias("latest_at"))
        .withColumn("age_hours", age)
        .withColumn("freshness", freshness(F.col("age_hours")))
    )


def latest_per_group(rows: DataFrame, group: list[str], at: list[str], keep: list[str]) -> DataFrame:
    """The newest row of every group by one combining aggregation, no sort."""
    newest = F.max(F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(at)], *keep))
    return rows.groupBy(*group).agg(newest.alias("_n")).select(*group, *[F.col(f"_n.{c}") for c in keep])


def run_status(outcomes: DataFrame) -> DataFrame:
    """Per job: outcome counts, quotes, and the status a reader should see.

    A run in which everything was refused still succeeded; only failures make it
    partial or failed.
    """
    def n(status: str) -> Column:
        return F.count(F.when(F.col("status") == status, 1))

    counts = outcomes.groupBy("job_id").agg(
        F.count("*").alias("requests_total"),
        n("COLLECTED").alias("collected"),
        n("BLOCKED").alias("blocked"),
        n("DEFERRED").alias("deferred"),
        n("FAILED").alias("failed"),
        F.sum("quotes").alias("quotes"),
    )
    return counts.withColumn(
        "job_status",
        F.when((F.col("failed") > 0) & (F.col("collected") > 0), "PARTIAL")
        .when(F.col("failed") > 0, "FAILED")
        .otherwise("SUCCESS"),
    )


def operations(
    responses: DataFrame, decisions: DataFrame, sources: DataFrame, quotes: DataFrame, now: Column
) -> DataFrame:
    """Counters, freshness and alerts in one row.

    ``responses`` has http_status, ``decisions`` has decision, ``sources`` has
    enabled, ``quotes`` has collected_at. Each table is aggregated once to a
    single row and the rows are put side by side.
    """
    status = F.col("http_status")
    parts = {
        "_r": responses.agg(
            F.count("*").alias("requests"),
            F.count(F.when(status.isNull() | (status >= 400), 1)).alias("failed_responses"),
        ),
        "_d": decisions.agg(
            F.count("*").alias("decisions"),
            F.count(F.when(F.col("decision").startswith("BLOCKED"), 1)).alias("blocked"),
        ),
        "_s": sources.agg(
            F.count("*").alias("sources_total"), F.count(F.when(F.col("enabled"), 1)).alias("sources_enabled")
        ),
    }
    row = observation_age(quotes, now)
    for name, part in parts.items():
        row = row.withColumn(name, part.select(F.struct(*part.columns).alias("p")).scalar())
    flat = row.select("latest_at", "age_hours", "freshness", "_r.*", "_d.*", "_s.*")
    alerts = F.array_compact(
        F.array(
            F.when(F.col("freshness").isin("STALE", "OVERDUE"),
                   F.concat(F.when(F.col("freshness") == "STALE", "warning").otherwise("critical"),
                            F.lit(": latest observation is "), F.lower("freshness"))),
            F.when(F.col("failed_responses") > 0,
                   F.concat(F.lit("warning: failed responses "), F.col("failed_responses").cast("string"))),
            F.when(F.col("blocked") > 0,
                   F.concat(F.lit("info: refused requests "), F.col("blocked").cast("string"))),
            F.when(F.col("sources_enabled") == 0, F.lit("critical: no source is enabled")),
        )
    )
    return flat.withColumn("alerts", alerts)


def mix(rows: DataFrame, column: str) -> DataFrame:
    """Row counts per code of a column."""
    return rows.groupBy(column).agg(F.count("*").alias("rows"))


def permission_summary(verdicts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sources that permit a search path, and whether all failed the same way.

    ``verdicts`` has source, path, allowed and outcome. When every source is
    unreachable the network is suspected and no source counts as permitting.
    """
    per_source = verdicts.groupBy("source").agg(
        F.coalesce(F.bool_or(F.when(F.col("path") != "/", F.col("allowed"))), F.lit(False)).alias("permits"),
        F.bool_and(F.col("outcome").isin("FORBIDDEN", "UNAVAILABLE")).alias("unreachable"),
    )
    suspected = per_source.agg(F.bool_and("unreachable").alias("network_suspected"))
    return per_source.withColumn("permits", F.col("permits") & ~suspected.scalar()), suspected
