"""Column types, table schemas and the fixed code lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

MONEY = T.DecimalType(12, 2)
INDEX = T.DecimalType(12, 6)
#: Index values while computing; a stored observation must fit INDEX.
VALUE = T.DecimalType(18, 6)
WEIGHT = T.DecimalType(10, 8)
LAMBDA = T.DecimalType(8, 6)
SCORE = T.DecimalType(4, 3)
BENCHMARK = T.DecimalType(14, 4)

BASE_INDEX = 100.0

STRATUM = ["route", "bucket"]
STRATUM_DAY = ["route", "bucket", "obs_date"]

QUOTE = T.StructType(
    [
        T.StructField("quote_id", T.StringType(), False),
        T.StructField("source", T.StringType()),
        T.StructField("route", T.StringType(), False),
        T.StructField("bucket", T.StringType(), False),
        T.StructField("carrier", T.StringType()),
        T.StructField("flight_no", T.StringType()),
        T.StructField("fare_brand", T.StringType()),
        T.StructField("pair_key", T.StringType(), False),
        T.StructField("total_fare", MONEY),
        T.StructField("base_fare", MONEY),
        T.StructField("taxes", MONEY),
        T.StructField("udf", MONEY),
        T.StructField("convenience_fee", MONEY),
        T.StructField("currency", T.StringType()),
        T.StructField("collected_date", T.DateType(), False),
        T.StructField("collected_at", T.TimestampType()),
        T.StructField("departure_at", T.TimestampType()),
        T.StructField("provenance", T.StringType()),
        T.StructField("imputation_code", T.StringType()),
    ]
)

OBSERVATION = T.StructType(
    [
        T.StructField("obs_date", T.DateType(), False),
        T.StructField("level", T.StringType(), False),
        T.StructField("route", T.StringType()),
        T.StructField("bucket", T.StringType()),
        T.StructField("index_value", INDEX),
        T.StructField("prev_index_value", INDEX),
        T.StructField("input_quote_count", T.LongType()),
        T.StructField("excluded_count", T.LongType()),
        T.StructField("imputed_count", T.LongType()),
        T.StructField("routes_in_basket", T.LongType()),
        T.StructField("methodology_version", T.StringType()),
        T.StructField("weight_set_version", T.StringType()),
        T.StructField("revision", T.IntegerType()),
    ]
)

# Lead-time buckets (code, days, weight, comparable with the official series).
LEAD_TIME_BUCKETS = [
    ("T1", 1, "0.166667", False),
    ("T7", 7, "0.166667", False),
    ("T15", 15, "0.166667", False),
    ("T21", 21, "0.166667", True),
    ("T30", 30, "0.166667", False),
    ("T45", 45, "0.166667", False),
]

# What each evidence rung of a weight means.
RUNG_MEANING = {
    1: "DGCA per-city-pair passenger volumes",
    2: "DGCA popular-routes list",
    3: "Airport-throughput proxy",
    4: "Equal weights - not derived from traffic data",
}
PROXY_RUNG = 3

# Month names in order.
MONTHS = [
    "January", "February", "March", "April", "May", "June",
    "July", "August", "September", "October", "November", "December",
]

# Allowed codes of the enumerated columns.
ENUMS = {
    "provenance": [
        "LIVE_COLLECTED", "LICENSED_API", "OFFICIAL_STATISTIC",
        "PUBLIC_HISTORICAL", "SIMULATED_DEMO",
    ],
    "quality_status": ["COMPLETE", "PARTIAL", "SUSPICIOUS", "UNUSABLE"],
    "component_confidence": ["HIGH", "MEDIUM", "LOW"],
    "imputation_code": ["N", "Y"],
    "missing_reason": [
        "NONE", "SCRAPER_FAILURE", "SOURCE_BLOCKED", "NO_FLIGHTS", "SOLD_OUT",
        "PARSE_FAILURE", "PARTIAL_COMPONENTS", "CHAIN_GAP",
    ],
    "level": ["STRATUM", "ROUTE", "HEADLINE"],
}


def lead_time_buckets(spark: SparkSession) -> DataFrame:
    """The six-row bucket dimension; always safe to broadcast."""
    return spark.createDataFrame(
        LEAD_TIME_BUCKETS, "bucket string, days int, lam string, cpi_comparable boolean"
    ).selectExpr("bucket", "days", "cast(lam as decimal(8,6)) as lam", "cpi_comparable")
