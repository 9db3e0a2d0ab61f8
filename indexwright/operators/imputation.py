"""Moving a missing stratum by what comparable strata did."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from indexwright.schemas import BASE_INDEX, STRATUM, VALUE

MAX_CONSECUTIVE = 30


def donor_movements(stats: DataFrame, min_quotes: int = 3) -> DataFrame:
    """Every stratum on every collection day since its first, with its donors.

    ``own`` is the log movement where the stratum was measured, ``route_log`` the
    mean over the other buckets of its route and ``other_log`` the mean over the
    other routes. The grid is strata times days: a dimension product, small next
    to the quotes.
    """
    visited = stats.filter(F.col("raw_quotes") > 0)
    days = visited.select("obs_date").distinct().agg(
        F.array_sort(F.collect_set("obs_date")).alias("days")
    )
    first = visited.groupBy(*STRATUM).agg(F.min("obs_date").alias("first_date"))
    grid = (
        # One row holding the calendar.
        first.withColumn("days", days.scalar())
        .select(*STRATUM, "first_date", F.explode("days").alias("obs_date"))
        .filter(F.col("obs_date") >= F.col("first_date"))
    )
    measured = visited.select(
        *STRATUM, "obs_date",
        F.when(F.col("accepted") >= min_quotes, F.col("mean_log")).alias("own"),
    )
    on_grid = grid.join(measured, [*STRATUM, "obs_date"], "left").withColumn(
        "own", F.when(F.col("obs_date") > F.col("first_date"), F.col("own"))
    )
    # A route-day has one row per bucket and a day one per route and bucket.
    by_route = on_grid.groupBy("route", "obs_date").agg(
        F.sum("own").alias("_rs"), F.count("own").alias("_rn")
    )
    by_day = on_grid.groupBy("obs_date").agg(F.sum("own").alias("_ds"), F.count("own").alias("_dn"))
    joined = on_grid.join(by_route, ["route", "obs_date"]).join(by_day, "obs_date")
    # For a missing stratum "own" is NULL, so the totals are already its donors'.
    return joined.select(
        *STRATUM, "obs_date", "first_date", "own",
        F.when(F.col("_rn") > 0, F.col("_rs") / F.col("_rn")).alias("route_log"),
        F.when(F.col("_rn") > 0, F.col("_rn")).otherwise(F.col("_dn")).alias("donor_count"),
        F.when((F.col("_rn") == 0) & (F.col("_dn") > 0), F.col("_ds") / F.col("_dn")).alias("other_log"),
    )


def impute_missing(
    stats: DataFrame, min_quotes: int = 3, max_consecutive: int = MAX_CONSECUTIVE
) -> DataFrame:
    """Chained strata in which missing days move with their donors.

    The run of consecutive imputations is carried in the fold; past the limit, or
    without donors, the index stays NULL and the last value is kept for later.
    """
    donors = donor_movements(stats, min_quotes)
    day = F.struct(
        "obs_date", "own", F.coalesce("route_log", "other_log").alias("donor"), "donor_count"
    )
    series = donors.groupBy(*STRATUM).agg(F.array_sort(F.collect_list(day)).alias("days"))
    observed = "d.own is not null"
    can_impute = f"(d.own is null and d.donor is not null and acc.run < {max_consecutive})"
    value = f"""case when acc.last is null then {BASE_INDEX}D
                     when {observed} then bround(acc.last * exp(d.own), 6)
                     when {can_impute} then bround(acc.last * exp(d.donor), 6) end"""
    run = f"""case when acc.last is null or {observed} then 0
                   when {can_impute} then acc.run + 1 else acc.run end"""
    fold = f"""
      aggregate(days,
        named_struct('last', cast(null as double), 'run', 0,
          'out', cast(array() as array<struct<idx:double,prev:double,run:int,imputed:boolean>>)),
        (acc, d) -> named_struct(
          'last', coalesce({value}, acc.last),
          'run', {run},
          'out', concat(acc.out, array(named_struct('idx', {value}, 'prev', acc.last,
             'run', {run}, 'imputed', acc.last is not null and {can_impute})))),
        acc -> acc.out)
    """
    rows = series.withColumn("links", F.expr(fold)).select(
        *STRATUM, F.explode(F.arrays_zip("days", "links")).alias("z")
    )
    imputed = F.col("z.links.imputed")
    return rows.select(
        *STRATUM,
        F.col("z.days.obs_date").alias("obs_date"),
        F.col("z.links.idx").cast(VALUE).alias("index_value"),
        F.col("z.links.prev").cast(VALUE).alias("prev_index_value"),
        F.when(imputed, "Y").otherwise("N").alias("imputation_code"),
        F.when(imputed, "NO_FLIGHTS").otherwise("NONE").alias("missing_reason"),
        F.when(imputed, F.col("z.days.donor_count")).otherwise(0).alias("donor_count"),
        F.when(imputed, F.bround(F.exp("z.days.donor"), 6).cast(VALUE)).alias("movement_applied"),
        F.col("z.links.run").alias("consecutive_imputations"),
    )


def imputation_rate(total: Column, imputed: Column) -> Column:
    share = imputed.cast("decimal(20,0)") / F.nullif(total.cast("decimal(13,0)"), F.lit(0))
    return F.coalesce(F.bround(share, 3), F.lit(0)).cast("decimal(6,3)")
