"""Matching the same priced product on consecutive collection days.

Every quote is sent to the two days it takes part in: its own, as the current
fare, and the next collection day, as the previous fare. One aggregation on
(route, bucket, product, day) then yields the pairs, the products that are new
and the ones that are gone. It combines before the shuffle, so a product that
holds a large share of all quotes costs one row per map task, and no sort or
window over quotes is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from indexwright.functions.text import keyed
from indexwright.schemas import MONEY

PAIRED, NEW, GONE = "PAIRED", "NEW", "GONE"


def flight_key() -> Column:
    """Product identity by flight: carrier, flight number and fare brand."""
    return keyed(F.col("carrier"), F.col("flight_no"), F.col("fare_brand"))


def collection_calendar(quotes: DataFrame) -> DataFrame:
    """Collection days with their predecessor and successor over the whole table.

    One row per calendar day on which anything was collected, so the unpartitioned
    window runs on at most a few thousand rows whatever the size of the table.
    """
    order = Window.orderBy("collected_date")
    return quotes.select("collected_date").distinct().select(
        "collected_date",
        F.row_number().over(order).alias("day_no"),
        F.lag("collected_date").over(order).alias("prev_date"),
        F.lead("collected_date").over(order).alias("next_date"),
    )


def match_periods(
    quotes: DataFrame, key: str = "pair_key", calendar: DataFrame | None = None
) -> DataFrame:
    """One row per (route, bucket, product, day): lowest fares and the raw count.

    ``status`` is PAIRED when the product was quoted on both days, NEW when only
    on ``obs_date`` and GONE when only on the collection day before it.
    """
    days = calendar if calendar is not None else collection_calendar(quotes)
    # Bounded by the number of calendar days, hence safe to ship to every task.
    days = F.broadcast(days.select("collected_date", "next_date"))
    none = F.lit(None).cast(MONEY)
    roles = F.array(
        F.struct(
            F.col("collected_date").alias("obs_date"),
            F.lit(None).cast(MONEY).alias("previous_fare"),
            F.col("total_fare").alias("current_fare"),
            F.lit(1).alias("quotes"),
        ),
        F.struct(
            F.col("next_date").alias("obs_date"),
            F.col("total_fare").alias("previous_fare"),
            none.alias("current_fare"),
            F.lit(0).alias("quotes"),
        ),
    )
    sides = (
        quotes.join(days, "collected_date")
        .select("route", "bucket", F.col(key).alias("pair_key"), F.explode(roles).alias("r"))
        .select("route", "bucket", "pair_key", "r.*")
        .filter(F.col("obs_date").isNotNull())
    )
    merged = sides.groupBy("route", "bucket", "obs_date", "pair_key").agg(
        F.min("previous_fare").alias("previous_fare"),
        F.min("current_fare").alias("current_fare"),
        F.sum("quotes").alias("quotes"),
    )
    return merged.withColumn(
        "status",
        F.when(F.col("previous_fare").isNull(), NEW)
        .when(F.col("current_fare").isNull(), GONE)
        .otherwise(PAIRED),
    )


def is_plausible() -> Column:
    """Within [1/100, 100] of the previous fare, on the exact decimals."""
    return (F.col("current_fare") * 100 >= F.col("previous_fare")) & (
        F.col("current_fare") <= F.col("previous_fare") * 100
    )


def price_relative() -> Column:
    """Current over previous fare; a non-positive price stops the job."""
    broken = (F.col("previous_fare") <= 0) | (F.col("current_fare") <= 0)
    refused = F.raise_error(F.concat(F.lit("non-positive price in pair "), F.col("pair_key")))
    return F.when(broken, refused).otherwise(
        F.col("current_fare").cast("double") / F.col("previous_fare").cast("double")
    )


def plausible_log() -> Column:
    """Log relative of a plausible pair, NULL for an implausible one."""
    relative = price_relative()
    return F.when(relative.isNotNull() & is_plausible(), F.log(relative))


def relatives(matched: DataFrame) -> DataFrame:
    """Pairs with their price relative, its log and the plausibility verdict."""
    return (
        matched.filter(F.col("status") == PAIRED)
        .withColumn("relative", price_relative())
        .withColumn("log_relative", F.log(F.col("relative")))
        .withColumn("plausible", is_plausible())
    )


def collapse_near_duplicates(quotes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Quotes without a flight number that repeat the same offer, collapsed to one.

    Returns the surviving quotes and one log row per collapsed quote. The survivor
    is the smallest quote id, found by an aggregation that combines before the
    shuffle; the log joins back to one row per group, which adaptive skew handling
    can split.
    """
    offer = ["source", "carrier", "departure_at", "fare_brand", "total_fare", "collected_date"]
    loose = quotes.filter(F.col("flight_no").isNull())
    repeated = (
        loose.groupBy(*[F.col(c).alias(f"_{c}") for c in offer])
        .agg(F.min("quote_id").alias("kept_quote_id"), F.count("*").alias("copies"))
        .filter(F.col("copies") > 1)
    )
    same_offer = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in offer]
    log = (
        loose.join(repeated, same_offer)
        .filter(F.col("quote_id") != F.col("kept_quote_id"))
        .select(
            "quote_id", "kept_quote_id", "route", "bucket", "collected_date",
            F.lit("NEAR_DUPLICATE_COLLAPSED").alias("rule_id"),
        )
    )
    survivors = quotes.join(log.select("quote_id"), "quote_id", "left_anti")
    return survivors, log
