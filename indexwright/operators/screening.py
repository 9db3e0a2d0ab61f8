"""Screens for broken and extreme price relatives.

Implausible pairs always leave first. Of the rest, small strata (fewer than five
pairs) are compared with their own 5th and 95th percentile and larger ones by a
robust z-score around the median. FLAG keeps extremes and marks them, REJECT
drops them (or pulls them in, for small strata).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from indexwright.operators.durable import settle
from indexwright.operators.quantiles import ranked_quantiles
from indexwright.schemas import STRATUM_DAY

FLAG, REJECT = "FLAG", "REJECT"
DEFAULT_K = 3.5
SMALL_N = 5

# Consistency constants of the MAD and of its mean-deviation fallback.
MAD_SCALE = 1.4826
MEAN_AD_SCALE = 1.253314

# The rules a verdict can name.
RULE_IMPLAUSIBLE = "IMPLAUSIBLE_RELATIVE"
RULE_SMALL_FLAG = "EXTREME_SMALL_N_FLAGGED"
RULE_SMALL_CLAMP = "OUTLIER_WINSORISE_P5_P95"
RULE_MAD_FLAG = "EXTREME_MAD_FLAGGED"
RULE_MAD_DROP = "OUTLIER_MAD_LOG_RELATIVE"

#: Logs of two equal ratios can differ in the last bit; distances below this are zero.
TINY = 1e-12


def stratum_spread(pairs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Plausible pairs with ``n``, ``p5``, ``p95``, ``median``, ``mad`` and ``mean_ad``.

    ``pairs`` is read more than once and should be a stored table. Quantiles are
    selected by rank, for strata of any size alike; what a stratum's pairs are told
    is one row a stratum, joined back to them.
    """
    keys = keys or STRATUM_DAY
    plausible = pairs.filter("plausible")
    lr = F.col("log_relative")
    centre = ranked_quantiles(plausible, keys, "log_relative", {"p5": 0.05, "median": 0.5, "p95": 0.95}).withColumnRenamed("group_rows", "n")
    centre = settle(centre, "centres")
    distances = plausible.select(*keys, lr).join(centre.select(*keys, "median"), keys).select(*keys, F.abs(lr - F.col("median")).alias("_dev"))
    mads = ranked_quantiles(distances, keys, "_dev", {"mad": 0.5}).drop("group_rows")
    means = distances.groupBy(*keys).agg(F.avg("_dev").alias("mean_ad"))
    spread = centre.join(mads, keys).join(means, keys)
    return plausible.join(spread, keys).select(*pairs.columns, "n", "p5", "p95", "median", "mad", "mean_ad")


def robust_score() -> Column:
    """Distance from the stratum median in robust standard deviations.

    Zero dispersion by both measures means every relative is the same: score 0.
    """
    scale = (
        F.when(F.col("mad") > TINY, F.col("mad") * MAD_SCALE)
        .when(F.col("mean_ad") > TINY, F.col("mean_ad") * MEAN_AD_SCALE)
    )
    return F.coalesce(F.abs(F.col("log_relative") - F.col("median")) / scale, F.lit(0.0))


def screen(
    pairs: DataFrame,
    mode: str = FLAG,
    k: float = DEFAULT_K,
    small_n: int = SMALL_N,
    keys: list[str] | None = None,
) -> DataFrame:
    """Every pair with its verdict: kept, flagged, rule, observed, threshold.

    ``screened_log`` is the log relative that enters the mean (pulled in to the
    percentile bound where REJECT winsorises), NULL for pairs that are dropped.
    """
    lr = F.col("log_relative")
    spread = stratum_spread(pairs, keys).withColumn("score", robust_score())
    small = F.col("n") < small_n
    clamped = F.least(F.greatest(lr, F.col("p5")), F.col("p95"))
    outside_small = small & (F.abs(lr - clamped) > TINY)
    outside_large = ~small & (F.col("score") > k)
    flagging = F.lit(mode == FLAG)

    judged = spread.select(
        *pairs.columns,
        (~outside_large | flagging).alias("kept"),
        (flagging & (outside_small | outside_large)).alias("flagged"),
        F.when(outside_small, RULE_SMALL_FLAG if mode == FLAG else RULE_SMALL_CLAMP)
        .when(outside_large, RULE_MAD_FLAG if mode == FLAG else RULE_MAD_DROP)
        .alias("rule_id"),
        F.when(outside_small & ~flagging, lr)
        .when(outside_small | outside_large, F.col("relative"))
        .alias("observed"),
        F.when(outside_small & ~flagging, clamped)
        .when(outside_large, F.lit(float(k)))
        .alias("threshold"),
        F.when(outside_large & ~flagging, F.lit(None).cast("double"))
        .when(outside_small & ~flagging, clamped)
        .otherwise(lr)
        .alias("screened_log"),
        F.when(~small, F.col("score")).alias("score"),
        F.col("n"),
    )
    impossible = pairs.filter(~F.col("plausible")).select(
        *pairs.columns,
        F.lit(False).alias("kept"),
        F.lit(False).alias("flagged"),
        F.lit(RULE_IMPLAUSIBLE).alias("rule_id"),
        F.col("relative").alias("observed"),
        F.lit(100.0).alias("threshold"),
        F.lit(None).cast("double").alias("screened_log"),
        F.lit(None).cast("double").alias("score"),
        F.lit(None).cast("long").alias("n"),
    )
    return judged.unionByName(impossible)


def cleaning_events(screened: DataFrame) -> DataFrame:
    """The verdicts worth recording, with a reason in words."""
    reason = (
        F.when(F.col("rule_id") == RULE_IMPLAUSIBLE, F.lit(
            "ratio below 0.01 or above 100"))
        .when(F.col("rule_id") == RULE_SMALL_FLAG, F.format_string(
            "n=%d: extreme for this stratum, kept and counted", F.col("n")))
        .when(F.col("rule_id") == RULE_SMALL_CLAMP, F.format_string(
            "n=%d: log relative pulled from %.6f to %.6f", F.col("n"), F.col("observed"), F.col("threshold")))
        .when(F.col("rule_id") == RULE_MAD_FLAG, F.format_string(
            "modified z-score %.2f exceeds k=%.1f, kept and counted", F.col("score"), F.col("threshold")))
        .otherwise(F.format_string(
            "modified z-score %.2f exceeds k=%.1f", F.col("score"), F.col("threshold")))
    )
    return screened.filter(F.col("rule_id").isNotNull()).select(
        "route", "bucket", "obs_date", "pair_key", "kept", "flagged",
        "observed", "threshold", "rule_id", reason.alias("reason"), "current_fare",
    )
