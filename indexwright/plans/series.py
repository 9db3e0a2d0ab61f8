"""Daily, weekly and monthly series, comparisons, back-tests and contributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from indexwright.functions.labels import movement_band
from indexwright.functions.rounding import mean_of, percent_change
from indexwright.schemas import VALUE

# Assumed airfare weights in the basket and the division weight, in percent.
MIN_AIRFARE_WEIGHT = "0.15"
MAX_AIRFARE_WEIGHT = "0.60"
TRANSPORT_DIVISION_WEIGHT = "8.796"
MATERIAL_BPS = 10

# Default coefficients of a scenario.
FUEL_SHARE = "0.35"
PASS_THROUGH = "0.70"
DEMAND_ELASTICITY = "0.45"

MIN_ALIGNED_MONTHS = 3


def daily_mean(observations: DataFrame, value: str = "index_value") -> DataFrame:
    """Unweighted mean of all values of a day (for example of all routes)."""
    total = F.sum(F.col(value)).cast("decimal(24,6)") / F.count(value).cast("decimal(11,0)")
    return observations.groupBy("obs_date").agg(total.cast("decimal(30,16)").alias(value))


def to_frequency(daily: DataFrame, freq: str, value: str = "index_value") -> DataFrame:
    """Period means of a daily series with coverage and movement.

    ``freq`` is D, W (ISO weeks) or M. Rows of the same day all enter the mean;
    the previous period is the last one observed, whatever lies between.
    """
    day = F.col("obs_date")
    start = {"D": day, "W": F.trunc(day, "week"), "M": F.trunc(day, "month")}[freq]
    end = {"D": day, "W": F.date_add(start, 6), "M": F.last_day(day)}[freq]
    label = {
        "D": F.date_format(day, "yyyy-MM-dd"),
        "W": F.format_string("%d-W%02d", F.extract(F.lit("YEAROFWEEK"), day), F.weekofyear(day)),
        "M": F.date_format(day, "yyyy-MM"),
    }[freq]
    cast = F.col(value).cast("decimal(30,16)")
    mean = F.bround(
        F.sum(cast).cast("decimal(34,16)").cast("decimal(28,14)") / F.count(cast).cast("decimal(7,0)"), 6
    ).cast(VALUE)
    periods = daily.groupBy(
        start.alias("period_start"), end.alias("period_end"), label.alias("period")
    ).agg(mean.alias("index_value"), F.count_distinct(day).alias("days_observed"))
    # One row per period of the calendar: the unpartitioned order is bounded.
    order = Window.orderBy("period_start")
    length = F.datediff("period_end", "period_start") + 1
    share = (F.col("days_observed") * 100).cast("decimal(12,2)") / length.cast("decimal(5,0)")
    return (
        periods.withColumn("previous_index_value", F.lag("index_value").over(order))
        .withColumn("days_in_period", length)
        .withColumn("coverage_pct", F.bround(share, 1).cast("decimal(6,1)"))
        .withColumn("is_complete", F.col("days_observed") >= length)
        .withColumn("movement", (F.col("index_value") - F.col("previous_index_value")).cast(VALUE))
        .withColumn(
            "movement_pct",
            percent_change(F.col("index_value"), F.col("previous_index_value"), 3).cast("decimal(12,3)"),
        )
    )


def monthly_average(daily: DataFrame, value: str = "index_value") -> DataFrame:
    """Mean per calendar month at six decimals."""
    return daily.groupBy(
        F.year("obs_date").alias("year"), F.month("obs_date").alias("month")
    ).agg(mean_of(F.col(value)).cast("decimal(14,6)").alias("value"))


def monthly_movements(months: DataFrame) -> DataFrame:
    """Percent change between consecutive months that are present."""
    order = Window.orderBy("year", "month")  # one row per month
    before = F.lag("value").over(order)
    step = ((F.col("value") - F.col("_before")) * 100).cast("decimal(20,6)")
    return (
        months.withColumn("_before", before)
        .filter(F.col("_before").isNotNull() & (F.col("_before") != 0))
        .select(
            "year", "month",
            F.bround(step / F.col("_before").cast("decimal(14,6)"), 6).cast("decimal(18,6)").alias("movement_pct"),
        )
    )


def aligned_movements(ours: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Months in which both series have a movement, with error and direction."""
    a = monthly_movements(ours).withColumnRenamed("movement_pct", "own_pct")
    b = monthly_movements(benchmark).withColumnRenamed("movement_pct", "benchmark_pct")
    flat = (F.col("own_pct") == 0) | (F.col("benchmark_pct") == 0)
    return a.join(b, ["year", "month"]).select(
        "year", "month",
        F.format_string("%d-%02d", "year", "month").alias("label"),
        "own_pct", "benchmark_pct",
        (F.col("own_pct") - F.col("benchmark_pct")).alias("error"),
        F.when(flat, F.col("own_pct") == F.col("benchmark_pct"))
        .otherwise(F.signum("own_pct") == F.signum("benchmark_pct"))
        .alias("same_direction"),
    )


def compare_movements(
    ours: DataFrame, benchmark: DataFrame, min_months: int = MIN_ALIGNED_MONTHS
) -> DataFrame:
    """One row of back-test metrics, or the limitation that prevents them."""
    aligned = aligned_movements(ours, benchmark)
    n = F.col("aligned_months")
    enough = n >= min_months
    count = n.cast("decimal(6,0)")
    metrics = aligned.agg(
        F.count("*").alias("aligned_months"),
        F.sum(F.abs("error")).cast("decimal(26,6)").alias("_abs"),
        F.sum((F.col("error") * F.col("error")).cast("decimal(36,12)")).alias("_sq"),
        F.count(F.when(F.col("same_direction"), 1)).alias("_same"),
    )
    return metrics.select(
        "aligned_months",
        enough.alias("sufficient"),
        F.when(enough, F.bround(F.col("_abs") / count, 6)).cast("decimal(18,6)").alias("mae"),
        F.when(enough, F.bround(F.sqrt(F.col("_sq").cast("double") / n), 6)).cast("decimal(18,6)").alias("rmse"),
        F.when(enough, F.bround((F.col("_same") * 100).cast("decimal(12,2)") / count, 2))
        .cast("decimal(6,2)").alias("directional_agreement_pct"),
        F.when(n == 0, "No overlapping months: no comparison is possible.")
        .when(~enough, F.concat(
            F.lit("Only "), n.cast("string"), F.lit(f" aligned month(s); {min_months} are required.")))
        .otherwise("Movements only: index levels have different base periods.")
        .alias("limitation"),
    )


def two_date_comparison(routes: DataFrame, days: int) -> DataFrame:
    """Each route's latest index against its value exactly ``days`` days before.

    The latest date is a scalar subquery, so only two dates are read when the
    table is partitioned by date. A route-day that could not be computed is no
    value, so the latest date is one that has some. Routes without both values are left out.
    """
    routes = routes.filter(F.col("index_value").isNotNull())
    latest = routes.agg(F.max("obs_date").alias("d")).scalar()
    earlier = F.date_sub(latest, days)
    return two_dates(
        routes.filter((F.col("obs_date") == latest) | (F.col("obs_date") == earlier)), latest
    )


def two_dates(rows: DataFrame, latest: Column) -> DataFrame:
    """Conditional maximum per route over rows of two dates."""
    now = F.max(F.when(F.col("obs_date") == latest, F.col("index_value")))
    then = F.max(F.when(F.col("obs_date") != latest, F.col("index_value")))
    change = percent_change(F.col("index_value"), F.col("previous_index_value"), 8)
    return (
        rows.groupBy("route")
        .agg(now.alias("index_value"), then.alias("previous_index_value"))
        .filter(F.col("index_value").isNotNull() & F.col("previous_index_value").isNotNull())
        .withColumn("change_pct", F.bround(change, 2).cast("decimal(12,2)"))
        .withColumn("band", movement_band(change))
    )


def movers_summary(comparison: DataFrame) -> DataFrame:
    """Rising and falling counts, mean move and the biggest mover (ties by route)."""
    change = F.col("change_pct")
    return comparison.agg(
        F.count("*").alias("routes"),
        F.count(F.when(change > 0, 1)).alias("rising"),
        F.count(F.when(change <= 0, 1)).alias("falling"),
        F.max(F.struct(F.abs("change_pct").alias("size"), "route")).alias("_top"),
        F.bround(F.sum("change_pct").cast("decimal(20,2)") / F.count("*").cast("decimal(8,0)"), 2)
        .cast("decimal(12,2)").alias("mean_change_pct"),
    ).select("routes", "rising", "falling", "mean_change_pct", F.col("_top.route").alias("biggest_mover"))


def window_movement(daily: DataFrame, days: int, value: str = "index_value") -> DataFrame:
    """Movement from the last day at least ``days`` back (else the first) to the latest."""
    cutoff = F.date_sub(daily.agg(F.max("obs_date").alias("d")).scalar(), days)
    cells = daily.agg(
        F.max_by(value, "obs_date").alias("latest_value"),
        F.coalesce(
            F.max_by(F.when(F.col("obs_date") <= cutoff, F.col(value)),
                     F.when(F.col("obs_date") <= cutoff, F.col("obs_date"))),
            F.min_by(value, "obs_date"),
        ).alias("base_value"),
        F.count("*").alias("days"),
    ).filter("days >= 2")
    change = ((F.col("latest_value") - F.col("base_value")) * 100).cast("decimal(26,14)")
    return cells.withColumn(
        "movement_pct", (change / F.col("base_value").cast("decimal(16,10)")).cast("decimal(20,8)")
    )


def contribution_range(
    rows: DataFrame,
    movement: Column,
    low: str = MIN_AIRFARE_WEIGHT,
    high: str = MAX_AIRFARE_WEIGHT,
) -> DataFrame:
    """Basis points of headline inflation for a movement, over the assumed weights."""
    if float(low) > float(high) or float(low) < 0:
        raise ValueError("weights must satisfy 0 <= low <= high")

    def bps(weight: str) -> Column:
        return F.bround(F.lit(weight).cast("decimal(6,3)") * movement, 2).cast("decimal(14,2)")

    return (
        rows.withColumn("min_bps", F.least(bps(low), bps(high)))
        .withColumn("max_bps", F.greatest(bps(low), bps(high)))
        .withColumn("transport_division_bps", bps(TRANSPORT_DIVISION_WEIGHT))
        .withColumn("is_material", F.col("max_bps") >= MATERIAL_BPS)
    )


def scenarios(rows: DataFrame) -> DataFrame:
    """Fuel, demand and direct shocks of each row as a fare change and its contribution.

    Needs fuel_change_pct, demand_change_pct and direct_fare_shock_pct as decimals;
    fuel_share, pass_through and demand_elasticity may override the defaults.
    """
    have = set(rows.columns)
    out = rows
    for name, default in (
        ("fuel_share", FUEL_SHARE), ("pass_through", PASS_THROUGH), ("demand_elasticity", DEMAND_ELASTICITY),
    ):
        given = F.col(name) if name in have else F.lit(None)
        out = out.withColumn(name, F.coalesce(given.cast("decimal(5,2)"), F.lit(default).cast("decimal(5,2)")))
    pct = "decimal(9,3)"
    fuel = F.col("fuel_change_pct").cast(pct) * F.col("fuel_share") * F.col("pass_through")
    demand = F.col("demand_change_pct").cast(pct) * F.col("demand_elasticity")
    out = (
        out.withColumn("from_fuel_pct", F.bround(fuel, 3).cast("decimal(12,3)"))
        .withColumn("from_demand_pct", F.bround(demand, 3).cast("decimal(12,3)"))
        .withColumn(
            "total_fare_change_pct",
            (F.col("from_fuel_pct") + F.col("from_demand_pct") + F.col("direct_fare_shock_pct").cast(pct))
            .cast("decimal(12,3)"),
        )
    )
    caveats = F.array(
        F.lit("The basket weight of airfare is assumed, not measured."),
        F.concat(F.lit("Fuel share "), F.col("fuel_share").cast("string"), F.lit(" and pass-through "),
                 F.col("pass_through").cast("string"), F.lit(" are assumptions.")),
        F.concat(F.lit("Demand elasticity "), F.col("demand_elasticity").cast("string"), F.lit(" is an assumption.")),
        F.lit("Channels are additive and contemporaneous."),
        F.lit("Arithmetic model, not a forecast."),
    )
    return contribution_range(out, F.col("total_fare_change_pct")).withColumn("caveats", caveats)


def undirected_routes(routes: DataFrame) -> DataFrame:
    """Both directions of a pair as one row: count, any active, ordered members."""
    a, b = F.split("route", "-")[0], F.split("route", "-")[1]
    pair = F.concat_ws("-", F.least(a, b), F.greatest(a, b))
    # A pair has at most its two directions.
    return routes.groupBy(pair.alias("pair")).agg(
        F.count("*").alias("directions"),
        F.bool_or("active").alias("any_active"),
        F.array_sort(F.collect_list("route")).alias("members"),
    )
