"""Building and checking route weight sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from indexwright.functions.labels import is_proxy
from indexwright.schemas import WEIGHT

CLOSURE_TOLERANCE = "0.000000001"


def weights_from_traffic(
    traffic: DataFrame, rung: int, evidence_ref: str, group: list[str] | None = None
) -> DataFrame:
    """Shares of traffic at eight decimals that sum to exactly one.

    The rounding residue goes to the largest weight (of equals, the greatest
    route). A non-positive volume stops the job. Totals and the largest route come
    from one combining aggregation per weight set, not from a window over it.
    """
    group = group or []
    positive = F.when(
        F.col("volume") <= 0,
        F.raise_error(F.concat(F.lit("non-positive traffic for "), F.col("route"))),
    ).otherwise(F.col("volume").cast("decimal(28,0)"))
    source = traffic.select(*group, "route", positive.alias("volume"))
    total = source.groupBy(*group).agg(F.sum("volume").cast("decimal(28,0)").alias("_total"))
    scaled = _with(source, total, group).withColumn("_w", _share(F.col("volume"), F.col("_total")))
    closing = scaled.groupBy(*group).agg(
        (F.lit(1).cast(WEIGHT) - F.sum("_w")).cast(WEIGHT).alias("_residue"),
        F.max(F.struct("_w", "route")).alias("_largest"),
    )
    residue = F.when(F.col("route") == F.col("_largest.route"), F.col("_residue")).otherwise(
        F.lit(0).cast(WEIGHT)
    )
    return _with(scaled, closing, group).select(
        *group,
        "route",
        (F.col("_w") + residue).cast(WEIGHT).alias("weight"),
        F.lit(rung).alias("evidence_rung"),
        F.lit(evidence_ref).alias("evidence_ref"),
    )


def _share(value: Column, total: Column) -> Column:
    """value/total to eight decimals, half-even, in whole numbers only.

    The remainder decides the rounding, so products of two passenger counts do
    not lose digits to a decimal quotient.
    """
    scaled = value.cast("decimal(28,0)") * F.lit(10**8).cast("decimal(9,0)")
    whole = F.call_function("div", scaled.cast("decimal(37,0)"), total)
    rest = F.pmod(scaled.cast("decimal(37,0)"), total) * 2
    up = (rest > total) | ((rest == total) & (whole % 2 == 1))
    return ((whole + F.when(up, 1).otherwise(0)).cast("decimal(10,0)") / F.lit(10**8)).cast(WEIGHT)


def _with(rows: DataFrame, totals: DataFrame, group: list[str]) -> DataFrame:
    """Attach per-group totals; with no group the totals are a single row."""
    if group:
        return rows.join(totals, group)
    single = totals.select(F.struct(*totals.columns).alias("_t")).scalar()
    return rows.withColumn("_t", single).select("*", "_t.*").drop("_t")


def equal_weights(routes: DataFrame, reason: str) -> DataFrame:
    """The last resort: every route the same, labelled as such."""
    ones = routes.select("route").distinct().withColumn("volume", F.lit(1))
    return weights_from_traffic(ones, 4, reason)


def gravity_traffic(routes: DataFrame, throughput: DataFrame) -> DataFrame:
    """Product of the two end points' throughput as a stand-in for route traffic."""
    ends = routes.select(
        "route",
        F.substring_index("route", "-", 1).alias("origin"),
        F.substring_index("route", "-", -1).alias("destination"),
    )
    left = throughput.select(F.col("airport").alias("origin"), F.col("passengers").alias("_o"))
    right = throughput.select(F.col("airport").alias("destination"), F.col("passengers").alias("_d"))
    product = F.col("_o").cast("decimal(14,0)") * F.col("_d").cast("decimal(14,0)")
    return ends.join(left, "origin").join(right, "destination").select(
        "route", product.cast("decimal(28,0)").alias("volume")
    )


def airports_without_data(routes: DataFrame, throughput: DataFrame) -> DataFrame:
    """End points that have no throughput figure; such routes cannot be weighted."""
    ends = routes.select(F.explode(F.split("route", "-")).alias("airport")).distinct()
    return ends.join(throughput, "airport", "left_anti")


def validate_weights(weights: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Violations of a weight set, one row per broken rule; empty means valid."""
    group = group or []
    per_route = weights.groupBy(*group, "route").agg(
        F.count("*").alias("n"),
        F.sum(F.when(F.col("weight") > 0, 0).otherwise(1)).alias("bad_weight"),
        F.sum(F.when(F.col("evidence_rung").between(1, 4), 0).otherwise(1)).alias("bad_rung"),
        F.sum(
            F.when(F.length(F.trim(F.coalesce("evidence_ref", F.lit("")))) > 0, 0).otherwise(1)
        ).alias("no_evidence"),
        F.sum("weight").alias("weight"),
    )
    sets = per_route.groupBy(*group).agg(
        F.sum("n").alias("routes"),
        F.count(F.when(F.col("n") > 1, 1)).alias("duplicate_route"),
        F.sum("bad_weight").alias("non_positive_weight"),
        F.sum("bad_rung").alias("bad_evidence_rung"),
        F.sum("no_evidence").alias("missing_evidence_ref"),
        F.when(
            F.abs(F.sum("weight") - 1) > F.lit(CLOSURE_TOLERANCE).cast("decimal(12,9)"), 1
        ).otherwise(0).alias("not_closed"),
    ).withColumn("empty_set", F.when(F.coalesce("routes", F.lit(0)) == 0, 1).otherwise(0))
    rules = [
        "empty_set", "duplicate_route", "non_positive_weight", "bad_evidence_rung",
        "missing_evidence_ref", "not_closed",
    ]
    found = F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).cast("long").alias("violations")) for r in rules])
    return (
        sets.select(*group, F.explode(found).alias("v")).select(*group, "v.*").filter("violations > 0")
    )


def weight_set_summary(weights: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Total, weakest evidence rung and whether any weight is a proxy."""
    return weights.groupBy(*(group or [])).agg(
        F.sum("weight").alias("total"),
        F.max("evidence_rung").alias("worst_rung"),
        F.bool_or(is_proxy(F.col("evidence_rung"))).alias("any_proxy"),
        F.count("*").alias("routes"),
    )
