"""Product specification: what a traveller buys, apart from the flight number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from indexwright.functions.labels import departure_band
from indexwright.functions.text import keyed

# The characteristics of a product, in the order of the match key.
FIELDS = [
    "route", "carrier", "cabin", "trip_type", "routing", "departure_band",
    "fare_brand", "baggage_kg", "refundability", "changeability", "passenger_type",
]
# What an absent characteristic counts as.
DEFAULTS = {
    "cabin": "ECONOMY", "trip_type": "ONE_WAY", "refundability": "UNKNOWN",
    "changeability": "UNKNOWN", "passenger_type": "ADULT",
}


def routing(stops: Column) -> Column:
    return (
        F.when(stops.isNull() | (stops == 0), "DIRECT")
        .when(stops == 1, "ONE_STOP")
        .otherwise("MULTI_STOP")
    )


def specification(quotes: DataFrame) -> DataFrame:
    """Add the eleven characteristics, the match key, its hash and completeness.

    Columns a source does not have count as unknown.
    """
    have = set(quotes.columns)

    def given(name: str) -> Column:
        return F.col(name) if name in have else F.lit(None).cast("string")

    out = quotes
    for name, default in DEFAULTS.items():
        out = out.withColumn(name, F.upper(F.coalesce(given(name), F.lit(default))))
    stops = F.col("stops") if "stops" in have else F.lit(None).cast("int")
    departure = F.col("departure_at") if "departure_at" in have else F.lit(None).cast("timestamp")
    out = (
        out.withColumn("carrier", F.upper("carrier"))
        .withColumn("routing", routing(stops))
        .withColumn("departure_band", departure_band(departure))
        .withColumn("baggage_kg", given("baggage_kg").cast("int"))
    )
    key = keyed(*[F.col(c) for c in FIELDS])
    return (
        out.withColumn("match_key", key)
        .withColumn("match_hash", F.substring(F.sha2(F.col("match_key"), 256), 1, 16))
        .withColumn(
            "fully_specified",
            F.col("fare_brand").isNotNull()
            & F.col("baggage_kg").isNotNull()
            & (F.col("refundability") != "UNKNOWN")
            & (F.col("changeability") != "UNKNOWN"),
        )
    )


def differences(left: str, right: str) -> Column:
    """Names of the characteristics in which two joined specifications differ."""
    named = [
        F.when(~F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")), F.lit(c)) for c in FIELDS
    ]
    return F.array_compact(F.array(*named))
