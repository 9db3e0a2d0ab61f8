"""Official benchmark series and airport throughput."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from indexwright.schemas import BENCHMARK, MONTHS

ROWS = """struct<rows: array<struct<year: string, month: string, sector: string, item: string,
  index: string, imputation: string>>, item: struct<item_name: string>>"""


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Whole JSON documents as one row each; reference files are a few kilobytes."""
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("body"))


def benchmark_rows(documents: DataFrame) -> DataFrame:
    """All rows of stored benchmark documents with numeric months."""
    doc = F.from_json("body", ROWS)
    names = F.create_map(*[F.lit(x) for i, m in enumerate(MONTHS, 1) for x in (m, i)])
    return (
        documents.select(F.explode(doc["rows"]).alias("r"))
        .select("r.*")
        .select(
            F.col("year").cast("int").alias("year"),
            F.try_element_at(names, F.initcap(F.trim("month"))).alias("month"),
            "sector", "item",
            F.col("index").cast(BENCHMARK).alias("value"),
            "imputation",
        )
    )


def benchmark_series(rows: DataFrame, sector: str = "Combined") -> DataFrame:
    """The monthly series of one sector."""
    return rows.filter(F.col("sector") == sector).select("year", "month", "value", "item", "imputation")


def benchmark_integrity(series: DataFrame, item: str) -> DataFrame:
    """One row: months, span, gaps, foreign items, imputed months, and whether it may be used."""
    place = F.col("year") * 12 + F.col("month")
    return series.agg(
        F.count("*").alias("months"),
        (F.max(place) - F.min(place) + 1).alias("span"),
        F.count(F.when(~F.col("item").eqNullSafe(F.lit(item)), 1)).alias("foreign_rows"),
        F.count(F.when(F.col("imputation") == "Y", 1)).alias("imputed_months"),
    ).select(
        "months", F.coalesce("span", F.lit(0)).alias("span"),
        (F.coalesce("span", F.lit(0)) != F.col("months")).alias("has_gaps"),
        "foreign_rows", "imputed_months",
        ((F.col("months") > 0) & (F.col("foreign_rows") == 0)).alias("usable"),
    )


def airport_throughput(documents: DataFrame) -> DataFrame:
    """Passengers per airport from a document holding a code-to-count object."""
    airports = F.from_json(F.get_json_object("body", "$.airports"), "map<string,bigint>")
    return documents.select(F.explode(airports).alias("airport", "passengers"))
