"""The collection plan and the identity of a search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from indexwright.functions.text import search_hash
from indexwright.schemas import LEAD_TIME_BUCKETS


def collection_plan(sources: DataFrame, routes: DataFrame, collected: Column) -> DataFrame:
    """Every enabled source, active route and lead-time bucket for a day.

    The product is what a plan is. Sources are attached to each route as an array
    (sources are a handful of rows) and exploded, as are the six buckets.
    """
    codes = sources.filter("enabled").agg(F.array_sort(F.collect_set("source")).alias("s"))
    buckets = F.array(*[
        F.struct(F.lit(code).alias("bucket"), F.lit(days).alias("days"))
        for code, days, _, _ in LEAD_TIME_BUCKETS
    ])
    plan = (
        routes.filter("active")
        .select("route", codes.scalar().alias("_s"))
        .select("route", F.explode("_s").alias("source"))
        .select("source", "route", F.explode(buckets).alias("b"))
        .select("source", "route", "b.bucket", F.col("b.days").alias("lead_time_days"))
        .withColumn("collected_date", collected)
        .withColumn("travel_date", F.date_add("collected_date", F.col("lead_time_days")))
    )
    return with_search_hash(plan)


def with_search_hash(plan: DataFrame) -> DataFrame:
    return plan.withColumn(
        "query_hash",
        search_hash(*[F.col(c) for c in ("source", "route", "bucket", "travel_date", "collected_date")]),
    )


def new_searches(plan: DataFrame, done: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Planned searches not yet made, and those that are duplicates of made ones."""
    known = done.select("query_hash").distinct()
    return (
        plan.dropDuplicates(["query_hash"]).join(known, "query_hash", "left_anti"),
        plan.join(known, "query_hash", "left_semi").withColumn("status", F.lit("DUPLICATE")),
    )
