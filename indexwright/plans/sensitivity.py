"""How much of the index is the outlier rule's doing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from indexwright.functions.rounding import mean_of
from indexwright.operators.durable import settle
from indexwright.operators.elementary import MIN_QUOTES, chain
from indexwright.operators.matching import PAIRED, match_periods, relatives
from indexwright.operators.screening import (
    DEFAULT_K,
    FLAG,
    SMALL_N,
    robust_score,
    stratum_spread,
)
from indexwright.schemas import STRATUM_DAY

# Thresholds compared; the last one disables rejection.
THRESHOLDS = [2.5, 3.0, 3.5, 4.0, 5.0, 1_000_000.0]


def threshold_sweep(
    quotes: DataFrame, key: str = "pair_key", mode: str = FLAG, thresholds: list[float] | None = None,
    min_quotes: int = MIN_QUOTES,
) -> DataFrame:
    """Rerun the chain for several thresholds in one job.

    The score of a pair does not depend on the threshold, so all thresholds are
    conditional aggregates over the same pairs; rows multiply only once they are
    stratum-days.
    """
    ks = thresholds or THRESHOLDS
    matched = settle(match_periods(quotes, key), "sweep")
    raw = matched.groupBy(*STRATUM_DAY).agg(
        F.sum("quotes").alias("raw_quotes"),
        F.count(F.when(F.col("status") == PAIRED, 1)).alias("pairs"),
    )
    lr = F.col("log_relative")
    if mode == FLAG:
        kept_logs = [F.when(F.col("plausible"), lr)] * len(ks)
        rows = relatives(matched)
    else:
        rows = stratum_spread(relatives(matched), STRATUM_DAY).withColumn("score", robust_score())
        clamped = F.least(F.greatest(lr, F.col("p5")), F.col("p95"))
        small = F.col("n") < SMALL_N
        kept_logs = [F.when(small, clamped).when(F.col("score") <= k, lr) for k in ks]
    aggregates = []
    for i, kept in enumerate(kept_logs):
        aggregates += [F.avg(kept).alias(f"m{i}"), F.count(kept).alias(f"a{i}")]
    means = rows.groupBy(*STRATUM_DAY).agg(*aggregates)
    per_k = F.array(*[
        F.struct(F.lit(float(k)).alias("k"), F.col(f"m{i}").alias("mean_log"),
                 F.coalesce(F.col(f"a{i}"), F.lit(0)).alias("accepted"))
        for i, k in enumerate(ks)
    ])
    stats = (
        raw.join(means, STRATUM_DAY, "left")
        .withColumn("v", F.explode(per_k))
        .select(F.concat_ws("#", F.col("v.k").cast("string"), "route").alias("route"),
                "bucket", "obs_date", "raw_quotes", "v.*", "pairs")
        .withColumn("rejected", F.col("pairs") - F.col("accepted"))
    )
    chained = chain(stats, min_quotes).withColumn(
        "k", F.substring_index("route", "#", 1).cast("double")
    )
    last = chained.groupBy("k", "route", "bucket").agg(
        F.max_by("index_value", F.when(F.col("index_value").isNotNull(), F.col("obs_date"))).alias("final"),
        F.sum("excluded_count").alias("rejected"),
        F.sum("insufficient").alias("insufficient"),
    )
    summary = last.groupBy("k").agg(
        mean_of(F.col("final"), 4).alias("mean_index"),
        F.count("*").alias("strata"),
        F.sum("rejected").alias("rejected"),
        F.sum("insufficient").alias("insufficient"),
    )
    base = summary.filter(F.col("k") == DEFAULT_K).select("mean_index").scalar()
    drift = ((F.col("mean_index") - F.col("_base")) * 100).cast("decimal(20,6)")
    return summary.withColumn("_base", base).withColumn(
        "drift_pct", F.bround(drift / F.col("_base").cast("decimal(14,4)"), 3).cast("decimal(12,3)")
    ).drop("_base")
