"""The daily index over the whole history: strata, routes, headline, contributions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from indexwright.operators.aggregate import (
    headline_contributions,
    headline_index,
    route_index,
    simulated_days,
)
from indexwright.operators.durable import settle
from indexwright.operators.elementary import MIN_QUOTES, chain, stratum_days
from indexwright.operators.imputation import impute_missing
from indexwright.operators.matching import match_periods
from indexwright.operators.screening import DEFAULT_K, FLAG
from indexwright.schemas import OBSERVATION, STRATUM_DAY


@dataclass(frozen=True)
class IndexRun:
    """Results of one run; every member is a DataFrame."""

    strata: DataFrame
    routes: DataFrame
    headline: DataFrame
    refused: DataFrame
    contributions: DataFrame

    def observations(
        self, methodology: str = "1", weight_set: str = "1", revision: int = 1
    ) -> DataFrame:
        """All three levels in one table, one row per stored observation."""
        strata = self.strata.filter(F.col("index_value").isNotNull()).withColumn(
            "imputed_count", F.lit(0)
        ).withColumn("level", F.lit("STRATUM"))
        routes = self.routes.filter(F.col("index_value").isNotNull()).withColumn("level", F.lit("ROUTE"))
        top = self.headline.withColumn("level", F.lit("HEADLINE"))
        union = strata.unionByName(routes, allowMissingColumns=True).unionByName(
            top, allowMissingColumns=True
        )
        stamped = (
            union.withColumn("methodology_version", F.lit(methodology))
            .withColumn("weight_set_version", F.lit(weight_set))
            .withColumn("revision", F.lit(revision))
        )
        return stamped.select(
            *[F.col(f.name).cast(f.dataType).alias(f.name) for f in OBSERVATION.fields]
        )


def stratum_table(
    quotes: DataFrame,
    key: str = "pair_key",
    mode: str = FLAG,
    k: float = DEFAULT_K,
    min_quotes: int = MIN_QUOTES,
    missing: str = "drop",
    days: DataFrame | None = None,
) -> DataFrame:
    """Stratum observations; ``missing`` is "drop" or "impute".

    Strata do not depend on one another but for the calendar, so those of some
    routes can be had from their quotes and the calendar of all (``days``).
    """
    stats = stratum_days(match_periods(quotes, key, days), mode, k)
    if missing == "drop":
        return chain(stats, min_quotes)
    stats = settle(stats, "stratum-days")
    imputed = impute_missing(stats, min_quotes)
    joined = imputed.join(
        stats.select(*STRATUM_DAY, "raw_quotes", "accepted", "rejected"), STRATUM_DAY, "left"
    )
    first = F.col("prev_index_value").isNull()
    raw = F.coalesce("raw_quotes", F.lit(0))
    observed = (F.col("imputation_code") == "N") & F.col("index_value").isNotNull() & ~first
    return joined.select(
        *STRATUM_DAY,
        "index_value",
        "prev_index_value",
        raw.alias("raw_quotes"),
        F.when(observed, F.col("accepted")).otherwise(raw).alias("input_quote_count"),
        F.when(first, 0).otherwise(F.coalesce("rejected", F.lit(0))).alias("excluded_count"),
        F.when(observed | first, 0).otherwise(1).alias("insufficient"),
    )


def run_index(
    quotes: DataFrame,
    weights: DataFrame,
    key: str = "pair_key",
    mode: str = FLAG,
    k: float = DEFAULT_K,
    min_quotes: int = MIN_QUOTES,
    missing: str = "drop",
) -> IndexRun:
    """Quotes and weights to all index levels.

    The stratum table is written once (it is a stored result anyway) and the
    levels above read it; they shuffle observations, not quotes.
    """
    strata = settle(stratum_table(quotes, key, mode, k, min_quotes, missing), "strata")
    routes = route_index(strata)
    barred = simulated_days(quotes, by_route=True)
    barred = settle(barred, "simulated-route-days")
    headline, refused = headline_index(routes, weights, barred.select("obs_date").distinct())
    shares = headline_contributions(routes, weights, refused, barred)
    return IndexRun(strata, routes, headline, refused, shares)


