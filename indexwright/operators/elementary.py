"""Elementary index: geometric mean of relatives per stratum-day, then the chain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from indexwright.operators.durable import settle
from indexwright.operators.matching import (
    PAIRED,
    match_periods,
    plausible_log,
    relatives,
)
from indexwright.operators.screening import DEFAULT_K, FLAG, screen
from indexwright.schemas import BASE_INDEX, STRATUM, STRATUM_DAY, VALUE

MIN_QUOTES = 3


def stratum_days(
    matched: DataFrame, mode: str = FLAG, k: float = DEFAULT_K, with_flags: bool = False
) -> DataFrame:
    """Counts and mean log relative per (route, bucket, day).

    Flagged extremes stay in the mean, so in FLAG mode the index needs no
    percentiles: one combining aggregation is enough. The screen itself runs only
    for REJECT, or when the flag counts are asked for.
    """
    paired = F.col("status") == PAIRED
    if mode == FLAG and not with_flags:
        log_relative = F.when(paired, plausible_log())
        return (
            matched.groupBy(*STRATUM_DAY)
            .agg(
                F.sum("quotes").alias("raw_quotes"),
                F.count(F.when(paired, 1)).alias("pairs"),
                F.count(log_relative).alias("accepted"),
                F.avg(log_relative).alias("mean_log"),
                F.var_samp(log_relative).alias("var_log"),
            )
            .withColumn("rejected", F.col("pairs") - F.col("accepted"))
            .withColumn("implausible", F.col("rejected"))
        )
    matched = settle(matched, "matched")
    raw = matched.groupBy(*STRATUM_DAY).agg(
        F.sum("quotes").alias("raw_quotes"), F.count(F.when(paired, 1)).alias("pairs")
    )
    judged = screen(relatives(matched), mode, k)
    means = judged.groupBy(*STRATUM_DAY).agg(
        F.count("screened_log").alias("accepted"),
        F.avg("screened_log").alias("mean_log"),
        F.var_samp("screened_log").alias("var_log"),
        F.count(F.when(~F.col("kept"), 1)).alias("rejected"),
        F.count(F.when(~F.col("plausible"), 1)).alias("implausible"),
        F.count(F.when(F.col("flagged"), 1)).alias("flagged"),
    )
    return raw.join(means, STRATUM_DAY, "left").fillna(
        0, ["accepted", "rejected", "implausible", "flagged"]
    )


def elementary(stats: DataFrame, min_quotes: int = MIN_QUOTES) -> DataFrame:
    """Stratum-days that have pairs, with the geometric mean or the reason for none."""
    enough = F.col("accepted") >= min_quotes
    return stats.withColumn(
        "insufficient", ~enough
    ).withColumn(
        "gm_relative", F.when(enough, F.bround(F.exp("mean_log"), 6).cast(VALUE))
    ).withColumn(
        "reason",
        F.when(F.col("pairs") == 0, "no product was seen on both days")
        .when(~enough, F.format_string(
            "%d pairs kept, %d needed", F.col("accepted"), F.lit(min_quotes))),
    )


def chain(stats: DataFrame, min_quotes: int = MIN_QUOTES, states: DataFrame | None = None) -> DataFrame:
    """Chain every stratum through its days, rounding at each link.

    A series is folded in one array of at most one element per collection day.
    The first day a stratum is quoted is 100; a day without a usable mean leaves
    the index NULL and the next usable day links onto the last value before it.
    ``states`` holds the last value (``state``) of strata whose earlier days are
    not in ``stats``: their chains go on from there. Values are rounded at each
    link, so this gives what folding all days gives.
    """
    visited = stats.filter(F.col("raw_quotes") > 0)
    day = F.struct(
        "obs_date", "raw_quotes", "accepted", "rejected",
        F.when(F.col("accepted") >= min_quotes, F.exp("mean_log")).alias("gm"),
    )
    series = visited.groupBy(*STRATUM).agg(F.array_sort(F.collect_list(day)).alias("days"))
    if states is None:
        series = series.withColumn("state", F.lit(None).cast(VALUE))
    else:
        series = series.join(states.select(*STRATUM, "state"), STRATUM, "left")
    link = f"""
        aggregate(
          days,
          named_struct('last', cast(state as double),
                       'out', cast(array() as array<struct<idx:double,prev:double>>)),
          (acc, d) -> named_struct(
            'last', coalesce(
                case when acc.last is null then {BASE_INDEX}D
                     when d.gm is not null then bround(acc.last * d.gm, 6) end, acc.last),
            'out', concat(acc.out, array(named_struct(
                'idx', case when acc.last is null then {BASE_INDEX}D
                            when d.gm is not null then bround(acc.last * d.gm, 6) end,
                'prev', acc.last)))),
          acc -> acc.out)
    """
    rows = series.withColumn("links", F.expr(link)).select(
        *STRATUM, F.explode(F.arrays_zip("days", "links")).alias("z")
    )
    first = F.col("z.links.prev").isNull()
    return rows.select(
        *STRATUM,
        F.col("z.days.obs_date").alias("obs_date"),
        F.col("z.links.idx").cast(VALUE).alias("index_value"),
        F.when(~first, F.col("z.links.prev").cast(VALUE)).alias("prev_index_value"),
        F.col("z.days.raw_quotes").alias("raw_quotes"),
        # The first sighting and an insufficient day count what was collected,
        # a measured day counts the pairs that entered the mean.
        F.when(first | F.col("z.links.idx").isNull(), F.col("z.days.raw_quotes"))
        .otherwise(F.col("z.days.accepted"))
        .alias("input_quote_count"),
        F.when(first, 0).otherwise(F.col("z.days.rejected")).alias("excluded_count"),
        F.when(F.col("z.links.idx").isNull(), 1).otherwise(0).alias("insufficient"),
    )


def stratum_index(
    quotes: DataFrame,
    key: str = "pair_key",
    mode: str = FLAG,
    k: float = DEFAULT_K,
    min_quotes: int = MIN_QUOTES,
) -> DataFrame:
    """Quotes to chained stratum indices over the whole history, in one plan."""
    return chain(stratum_days(match_periods(quotes, key), mode, k), min_quotes)
