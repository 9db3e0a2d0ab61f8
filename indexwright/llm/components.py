"""Connected components of an edge table, in rounds over tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from indexwright.operators.durable import settle


def _are_stars(edges: DataFrame) -> bool:
    """Whether every larger end has one smaller end, which is no larger end itself."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or (up = 1 and down = 1)").isEmpty()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``node, component`` for every node with an edge; the component is its smallest node.

    Alternate rounds: each node links its larger neighbours to the smallest node
    around it, then itself and its smaller ones. Each round only combines and
    joins, and ends when the edges are stars around the smallest nodes.
    """
    both = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    held = settle(both, "edges")
    while not _are_stars(held):
        around = held.unionByName(held.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = around.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = settle(large, "edges")
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_least, "u").select(F.col("v").alias("x"), "m").filter("x <> m").unionByName(small_least.select(F.col("u").alias("x"), "m"))
        held = settle(small.select(F.col("x").alias("u"), F.col("m").alias("v")).distinct(), "edges")
    return held.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        held.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
