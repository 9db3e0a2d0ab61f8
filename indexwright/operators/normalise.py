"""Canonical quotes: validation, component state, quality score."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from indexwright.functions.text import blank_to_null, parse_money
from indexwright.schemas import MONEY, SCORE

COMPONENTS = ["base_fare", "taxes", "udf", "convenience_fee"]
# Component kind recorded for each component column.
COMPONENT_KIND = {"base_fare": "BASE", "taxes": "TAX", "udf": "UDF", "convenience_fee": "CONVENIENCE"}


def _component_sum() -> Column:
    zero = F.lit(0).cast(MONEY)
    return reduce(lambda a, b: a + b, [F.coalesce(F.col(c), zero) for c in COMPONENTS])


def component_state(quotes: DataFrame) -> DataFrame:
    """Confidence, status and missing reason from the component breakdown.

    A breakdown that exceeds the total is marked, never rejected: the total is
    still the price paid.
    """
    none = reduce(lambda a, b: a & b, [F.col(c).isNull() for c in COMPONENTS])
    over = _component_sum() > F.col("total_fare")
    under = _component_sum() < F.col("total_fare")
    partial = none | over
    return quotes.withColumns({
        "component_sum": F.when(~none, _component_sum()),
        "components_exceed_total": ~none & over,
        "component_confidence": F.when(partial, "LOW").when(under, "MEDIUM").otherwise("HIGH"),
        "quality_status": F.when(partial, "PARTIAL").otherwise("COMPLETE"),
        "missing_reason": F.when(partial, "PARTIAL_COMPONENTS").otherwise("NONE"),
    })


def quality_score(quotes: DataFrame) -> DataFrame:
    """How much of an observation is known, between 0 and 1. Never a weight."""
    def deduct(amount: str, when: Column) -> Column:
        return F.when(when, F.lit(amount).cast(SCORE)).otherwise(F.lit("0.000").cast(SCORE))

    no_parts = F.col("component_sum").isNull()
    score = (
        F.lit("1.000").cast(SCORE)
        - deduct("0.250", F.col("flight_no").isNull())
        - deduct("0.150", F.col("fare_brand").isNull())
        - deduct("0.200", no_parts)
        - deduct("0.100", ~no_parts & (F.col("component_confidence") == "LOW"))
        - deduct("0.500", F.col("provenance") == "SIMULATED_DEMO")
    )
    return quotes.withColumn(
        "quality_score", F.greatest(score, F.lit("0.000").cast(SCORE)).cast(SCORE)
    )


def normalise(offers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Offers with text amounts to canonical quotes and rejects with a reason.

    Expects text columns carrier, flight_no, fare_brand, total_fare, currency and
    any of the component columns; other columns pass through untouched.
    """
    have = set(offers.columns)
    amount = {c: parse_money(F.col(c)) if c in have else F.lit(None).cast("decimal(18,6)")
              for c in ["total_fare", *COMPONENTS]}
    currency = F.upper(F.trim(F.coalesce(F.col("currency"), F.lit("INR"))))
    carrier = F.upper(F.trim(F.coalesce(F.col("carrier"), F.lit(""))))
    unreadable = [
        F.when(F.col(c).isNotNull() & amount[c].isNull(), f"{c} is not a parseable amount")
        for c in COMPONENTS if c in have
    ]
    reason = F.coalesce(
        F.when(F.length(carrier) != 2, "carrier code is not two characters"),
        F.when(amount["total_fare"].isNull(), "total_fare is not a parseable amount"),
        F.when(amount["total_fare"] <= 0, "total_fare must be positive"),
        F.when(currency != "INR", "currency is out of scope"),
        *unreadable,
    )
    checked = offers.withColumn("reject_reason", reason)
    rejected = checked.filter(F.col("reject_reason").isNotNull())
    others = [c for c in offers.columns
              if c not in {"carrier", "flight_no", "fare_brand", "total_fare", "currency", *COMPONENTS}]
    accepted = checked.filter(F.col("reject_reason").isNull()).select(
        *others,
        carrier.alias("carrier"),
        blank_to_null(F.col("flight_no")).alias("flight_no"),
        blank_to_null(F.col("fare_brand")).alias("fare_brand"),
        currency.alias("currency"),
        *[F.bround(a, 2).cast(MONEY).alias(c) for c, a in amount.items()],
    )
    return component_state(accepted), rejected


def fare_components(quotes: DataFrame) -> DataFrame:
    """One row per known component of a quote."""
    kinds = F.array(*[
        F.struct(F.lit(kind).alias("component"), F.col(c).alias("amount"))
        for c, kind in COMPONENT_KIND.items()
    ])
    return (
        quotes.select("quote_id", F.explode(kinds).alias("k"))
        .select("quote_id", "k.*")
        .filter(F.col("amount").isNotNull())
    )
