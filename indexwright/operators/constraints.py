"""Row and key constraints as expectations over a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from indexwright.schemas import ENUMS

IATA = "^[A-Z]{3}$"
ROUTE = "^[A-Z]{3}-[A-Z]{3}$"


def quote_rules(route_pattern: str = ROUTE) -> dict[str, Column]:
    """What must hold for every stored quote."""
    def allowed(name: str, optional: bool = False) -> Column:
        inside = F.col(name).isin(*ENUMS[name])
        return inside | F.col(name).isNull() if optional else inside

    ends = F.split("route", "-")
    parts = ["base_fare", "taxes", "udf", "convenience_fee"]
    non_negative = F.lit(True)
    for part in parts:
        non_negative = non_negative & (F.coalesce(F.col(part), F.lit(0)) >= 0)
    return {
        "route_format": F.col("route").rlike(route_pattern),
        "route_ends_differ": ends[0] != ends[1],
        "positive_fare": F.col("total_fare") > 0,
        "currency_inr": F.col("currency") == "INR",
        "provenance_known": allowed("provenance"),
        "quality_status_known": allowed("quality_status"),
        "confidence_known": allowed("component_confidence", optional=True),
        "imputation_known": allowed("imputation_code"),
        "missing_reason_known": allowed("missing_reason"),
        "imputed_or_sourced": (F.col("imputation_code") == "Y") | F.col("quote_id").isNotNull(),
        "travel_after_collected": F.col("travel_date") > F.col("collected_date"),
        "components_not_negative": non_negative,
    }


def weight_rules() -> dict[str, Column]:
    return {
        "evidence_rung": F.col("evidence_rung").between(1, 4),
        "weight_range": (F.col("weight") > 0) & (F.col("weight") <= 1),
    }


def observation_rules() -> dict[str, Column]:
    return {
        "positive_index": F.col("index_value") > 0,
        "level_known": F.col("level").isin(*ENUMS["level"]),
        "headline_has_no_ref": (F.col("level") != "HEADLINE") | F.col("route").isNull(),
        "stratum_has_bucket": (F.col("level") != "STRATUM") | F.col("bucket").isNotNull(),
    }


def publication_rules() -> dict[str, Column]:
    """What must hold for a figure's publication record; a blank name or reason is none."""
    def given(name: str) -> Column:
        return F.length(F.trim(F.coalesce(F.col(name), F.lit("")))) > 0

    return {
        "state_known": F.col("state").isin("PENDING", "APPROVED", "PUBLISHED", "WITHDRAWN"),
        "approval_is_attributed": (F.col("state") == "PENDING") | (given("approved_by") & F.col("approved_at").isNotNull()),
        "revision_has_reason": F.col("supersedes_id").isNull() | given("revision_reason"),
        "withdrawal_has_reason": ~F.col("state").eqNullSafe(F.lit("WITHDRAWN")) | given("withdrawn_reason"),
    }


def _broken(rule: Column) -> Column:
    """Unknown counts as broken: a constraint on absent data is not satisfied."""
    return ~F.coalesce(rule, F.lit(False))


def check(frame: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Violation counts of all rules from one pass over the table."""
    counts = frame.agg(*[F.count(F.when(_broken(r), 1)).alias(n) for n, r in rules.items()])
    pairs = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n in rules])
    return counts.select(F.explode(pairs).alias("c")).select("c.*")


def quarantine(frame: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Violating rows with the names of the rules they break."""
    broken = F.array_compact(F.array(*[F.when(_broken(r), F.lit(n)) for n, r in rules.items()]))
    return frame.withColumn("broken_rules", broken).filter(F.size("broken_rules") > 0)


def duplicate_keys(frame: DataFrame, keys: list[str], nulls_equal: bool) -> DataFrame:
    """Keys held by more than one row.

    With ``nulls_equal`` false a NULL differs from every other NULL, so rows with
    one cannot be duplicates.
    """
    rows = frame if nulls_equal else frame.dropna(subset=keys)
    return rows.groupBy(*keys).agg(F.count("*").alias("copies")).filter("copies > 1")
