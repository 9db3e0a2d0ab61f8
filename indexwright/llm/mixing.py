"""Mixing sources to target weights by systematic sampling.

Within a source each document is expected target / source size times. The
expected copies are summed in a fixed order (documents of like size together),
one offset of the source is added, and a document is taken once for each whole
number its sum crosses. Sums need a document's rank only, which is the count of
all earlier buckets and its place in its own; a bucket is a size class and a
hash prefix, so no source, however large, is sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WEIGHTS = (5, 2, 1)
#: A source is taken at most so many times its size.
MOST = 3
#: Hexadecimal digits of the hash by which a size class is divided.
DIGITS = 2


def count_words(text: Column) -> Column:
    """Number of maximal runs without the six ASCII spaces; 0 for a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _class(size: Column) -> Column:
    """Four classes an octave, as an integer that grows with the size."""
    bits = F.char_length(F.bin(size))
    return F.when(size < 4, size).otherwise(bits * 4 + F.call_function("shiftright", size, (bits - 3).cast("int")) - 4).cast("int")


def source_targets(docs: DataFrame, source: str, size: str, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``mix_key``, ``source_size`` and ``target`` of each source.

    Sources by code point, null last, get the weights in turn. Shares are filled
    like vessels: in ascending order of limit by weight, a source whose limit is
    below its share of what is left stops there, and the rest share on.
    """
    totals = docs.groupBy(_key(source).alias("mix_key")).agg(F.sum(size).alias("source_size"))
    # One row for each source from here on.
    ordered = totals.withColumn("place", F.row_number().over(Window.orderBy("mix_key")))
    weighed = ordered.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("place") - 1) % len(weights)) + 1))
    filling = Window.orderBy(F.col("source_size") * float(most) / F.col("weight"), "mix_key")
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    levels = weighed.withColumns({
        "left_over": F.sum("source_size").over(everything) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0)),
        "open_weight": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
    }).withColumn("level", F.col("left_over").cast("double") / F.col("open_weight")).withColumn(
        "full", F.col("source_size") * most <= F.col("weight") * F.col("level"))
    level = F.max(F.when(~F.col("full"), F.col("level"))).over(everything)
    return levels.withColumn("common", level).select(
        "mix_key", "source_size",
        F.when(F.col("full"), (F.col("source_size") * most).cast("double")).otherwise(F.col("weight") * F.col("common")).alias("target"),
    )


def _key(source: str) -> Column:
    """A source as a string that is never null and puts null last."""
    return F.coalesce(F.concat(F.lit("0"), F.col(f"`{source}`").cast("string")), F.lit("1"))


def mix(docs: DataFrame, size: str = "size", source: str = "source", doc_id: str = "doc_id",
        weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Add ``source_size``, ``target`` and ``copies`` (how often each row is taken).

    ``size`` is a column of whole numbers; null counts as 0, as does a negative one. A null source is a
    source of its own; a null document id is an id. Rows that tie in everything
    are alike, so whichever of them is taken the result is the same. Added names
    replace columns of the same name; an empty table stays empty.
    """
    added = ["source_size", "target", "copies"]
    framed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in added]).alias("row"),
        _key(source).alias("mix_key"),
        F.greatest(F.coalesce(F.col(f"`{size}`"), F.lit(0)), F.lit(0)).cast("long").alias("words"),
        F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")).alias("name"),
    )
    slim = docs.select(F.col(f"`{source}`").alias("mix_source"),
                       F.greatest(F.coalesce(F.col(f"`{size}`"), F.lit(0)), F.lit(0)).cast("long").alias("words"))
    targets = source_targets(slim, "mix_source", "words", weights, most)
    bucket = {"size_class": _class(F.col("words")), "prefix": F.substring(F.md5("name"), 1, DIGITS)}
    keys = ["mix_key", "size_class", "prefix"]
    counts = docs.select(
        _key(source).alias("mix_key"), F.greatest(F.coalesce(F.col(f"`{size}`"), F.lit(0)), F.lit(0)).cast("long").alias("words"),
        F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")).alias("name"),
    ).withColumns(bucket).groupBy(*keys).count()
    earlier = Window.partitionBy("mix_key").orderBy("size_class", "prefix").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("earlier", F.coalesce(F.sum("count").over(earlier), F.lit(0))).join(targets, "mix_key").select(
        *keys, "earlier", "source_size", "target",
        F.coalesce(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)), F.lit(0.0)).alias("expected"),
        (F.conv(F.substring(F.md5(F.concat(F.lit("offset:"), F.col("mix_key"))), 1, 5), 16, 10).cast("double") / 1048576).alias("offset"),
    )
    within = Window.partitionBy(*keys).orderBy("words", F.md5("name"), "name")
    ranked = framed.withColumns(bucket).withColumn("within", F.row_number().over(within)).join(starts, keys)
    rank = F.col("earlier") + F.col("within")
    crossed = F.floor(rank * F.col("expected") + F.col("offset")) - F.floor((rank - 1) * F.col("expected") + F.col("offset"))
    return ranked.select("row.*", "source_size", "target", F.least(crossed, F.lit(most)).cast("long").alias("copies"))


def emit(mixed: DataFrame) -> DataFrame:
    """Each row as many times as ``copies`` says, without the three columns ``mix`` added."""
    rest = [F.col(f"`{c}`") for c in mixed.columns if c not in ("source_size", "target", "copies")]
    times = mixed.filter("copies > 0").withColumn("mix_turn", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return times.select(*rest)
