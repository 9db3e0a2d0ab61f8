"""Sampling error of strata and of their aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from indexwright.schemas import VALUE

# Two-sided 95% Student t by degrees of freedom, then the normal one.
T_95 = {1: 12.706, 2: 4.303, 3: 3.182, 4: 2.776, 5: 2.571, 6: 2.447, 7: 2.365}
NORMAL_95 = 1.96


def _multiplier(n: Column) -> Column:
    factor = F.lit(NORMAL_95).cast("decimal(6,3)")
    for freedom, t in T_95.items():
        factor = F.when(n - 1 == freedom, F.lit(t).cast("decimal(6,3)")).otherwise(factor)
    return factor


def stratum_error(frame: DataFrame) -> DataFrame:
    """Standard error, 95% interval and relative error of stratum indices.

    Needs index_value, accepted (pairs) and var_log (sample variance of their log
    relatives). Fewer than two pairs have no error, not a zero one.
    """
    se = F.bround(
        F.col("index_value").cast("double") * F.sqrt(F.col("var_log") / F.col("accepted")), 6
    ).cast(VALUE)
    half = _multiplier(F.col("accepted")) * F.col("standard_error")
    return (
        frame.withColumn(
            "standard_error", F.when((F.col("accepted") >= 2) & F.col("index_value").isNotNull(), se)
        )
        .withColumn("lower_95", F.bround(F.col("index_value") - half, 6).cast(VALUE))
        .withColumn("upper_95", F.bround(F.col("index_value") + half, 6).cast(VALUE))
        .withColumn(
            "relative_error_pct",
            F.bround(
                (F.col("standard_error") * 100).cast("decimal(17,6)") / F.col("index_value"), 3
            ).cast("decimal(12,3)"),
        )
    )


def aggregate_error(components: DataFrame, group: list[str]) -> DataFrame:
    """sqrt(sum((w/W)^2 se^2)) over the components that have an error.

    Independence is assumed, so this is a lower bound. NULL when no component has
    an error.
    """
    usable = F.col("standard_error").isNotNull()
    w = F.when(usable, F.col("weight").cast("double"))
    se = F.col("standard_error").cast("double")
    return components.groupBy(*group).agg(
        F.bround(F.sqrt(F.sum(w * w * se * se)) / F.nullif(F.sum(w), F.lit(0.0)), 6)
        .cast(VALUE)
        .alias("standard_error"),
        F.count("standard_error").alias("components_with_error"),
    )
