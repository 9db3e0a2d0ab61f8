"""Exact quantiles within groups, whatever the size of a group.

Equal values of a group are merged, and what is left is parted by ranges of
(group, value) into pieces of like size, so a large group lies in many pieces and
a small one in one or two. Sums of the pieces before it give a piece the rank it
starts with; values are ranked only inside the pieces that hold a wanted rank.
Every group takes this one way, and no task has more than a piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from indexwright.operators.durable import settle


def ranked_quantiles(rows: DataFrame, keys: list[str], value: str, wanted: dict[str, float]) -> DataFrame:
    """Linear-interpolated quantiles per group, and ``group_rows``, the number of its values.

    ``wanted`` maps column names to fractions. Null values are not counted. The
    pieces are stored, since the ranges are sampled anew each time they are asked for.
    """
    merged = rows.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    placed = settle(merged.repartitionByRange(*keys, "_v").withColumn("_piece", F.spark_partition_id()), "pieces")
    group = Window.partitionBy(*keys)
    # A group has at most as many pieces as there are partitions.
    pieces = (
        placed.groupBy(*keys, "_piece").agg(F.sum("_n").alias("_in"))
        .withColumn("_upto", F.sum("_in").over(group.orderBy("_piece").rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_all", F.sum("_in").over(group))
        .withColumn("_before", F.col("_upto") - F.col("_in"))
    )
    ranks = []
    for name, fraction in wanted.items():
        place = F.lit(fraction) * (F.col("_all") - 1)
        for end, rank in (("lo", F.floor(place)), ("hi", F.ceil(place))):
            ranks.append(F.struct(F.lit(name).alias("q"), F.lit(end).alias("end"), rank.cast("long").alias("rank")))
    targets = pieces.withColumn("_targets", F.filter(
        F.array(*ranks), lambda t: (t["rank"] >= F.col("_before")) & (t["rank"] < F.col("_upto"))
    )).filter(F.size("_targets") > 0).select(*keys, "_piece", "_before", "_all", "_targets")
    inside = Window.partitionBy(*keys, "_piece").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    picked = (
        placed.join(targets, [*keys, "_piece"])
        .withColumn("_upto", F.col("_before") + F.sum("_n").over(inside))
        .withColumn("_t", F.explode(F.filter("_targets", lambda t: (
            t["rank"] < F.col("_upto")) & (t["rank"] >= F.col("_upto") - F.col("_n")))))
    )
    columns = []
    for name, fraction in wanted.items():
        lo = F.max(F.when((F.col("_t.q") == name) & (F.col("_t.end") == "lo"), F.col("_v")))
        hi = F.max(F.when((F.col("_t.q") == name) & (F.col("_t.end") == "hi"), F.col("_v")))
        place = F.lit(fraction) * (F.max("_all") - 1)
        part = place - F.floor(place)
        columns.append((lo * (F.lit(1.0) - part) + hi * part).alias(name))
    return picked.groupBy(*keys).agg(*columns, F.max("_all").alias("group_rows"))
