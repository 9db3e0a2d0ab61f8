"""Daily incremental ingest as a stream of quote files.

Each run takes whatever has arrived and stops. Offers that are already stored are
dropped, however late they come. Beside quotes and index values two small tables
are kept: the collection days, and each stratum's last value in each month (its
chain state). A stratum that receives quotes is folded anew from the month of the
earliest of them, onto the state before it; what is older is not read. Days whose
value changed are appended as the next revision, and a day that can no longer be
computed gets a revision without a value.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from indexwright.operators.durable import settle
from indexwright.operators.elementary import chain, stratum_days
from indexwright.operators.matching import collection_calendar, match_periods
from indexwright.schemas import INDEX, STRATUM, STRATUM_DAY, VALUE


def quote_stream(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def revised_strata(
    touched: DataFrame, quotes: DataFrame, stored: DataFrame, key: str = "pair_key"
) -> DataFrame:
    """Rows to append after late or new quotes, from whole series.

    ``touched`` holds the strata that received quotes. Their whole series is
    recomputed, because a late quote moves every later link of its chain; strata
    that received nothing are not read beyond the semi-join. The calendar is that
    of all quotes. ``run_incremental`` gets the same rows from chain states.
    """
    days = collection_calendar(quotes)
    strata = touched.select(*STRATUM).distinct()
    affected = quotes.join(strata, STRATUM, "left_semi")
    fresh = chain(stratum_days(match_periods(affected, key, days))).filter("index_value is not null")
    return revisions(fresh, stored.join(strata, STRATUM, "left_semi"))


def revisions(fresh: DataFrame, stored: DataFrame) -> DataFrame:
    """Days whose newest stored value differs from the fresh one, with the next revision.

    A stored value that the fresh run does not have is revised to NULL.
    """
    newest = stored.groupBy(*STRATUM_DAY).agg(
        F.max_by("index_value", "revision").alias("stored_value"), F.max("revision").alias("stored_revision")
    )
    joined = fresh.select(*STRATUM_DAY, F.col("index_value").cast(INDEX).alias("index_value")).join(newest, STRATUM_DAY, "full")
    return joined.filter(~F.col("index_value").eqNullSafe(F.col("stored_value"))).select(
        *STRATUM_DAY, "index_value", (F.coalesce("stored_revision", F.lit(0)) + 1).cast("int").alias("revision"),
    )


def month_of(day: str) -> Column:
    return F.trunc(day, "month").alias("month")


def newest_states(chains: DataFrame) -> DataFrame:
    """``route, bucket, month, state``: of each month's states that of the last batch."""
    return chains.groupBy(*STRATUM, "month").agg(F.max_by("state", "batch").alias("state"))


def chain_states(fresh: DataFrame, starts: DataFrame | None = None, chains: DataFrame | None = None) -> DataFrame:
    """Last value of each stratum in each month that has one.

    With ``starts`` and the ``chains`` stored so far, months from a stratum's start
    on that have lost all their values get a NULL state, which hides the old one.
    """
    last = fresh.groupBy(*STRATUM, month_of("obs_date")).agg(F.max_by("index_value", "obs_date").cast(VALUE).alias("state"))
    if chains is None:
        return last
    held = newest_states(chains).filter("state is not null").join(starts, STRATUM).filter("month >= start")
    gone = held.join(last, [*STRATUM, "month"], "left_anti").select(*STRATUM, "month", F.lit(None).cast(VALUE).alias("state"))
    return last.unionByName(gone)


def refold_starts(arrived: DataFrame, known_days: DataFrame, chains: DataFrame) -> DataFrame:
    """``route, bucket, start``: the first of the month from which a chain is folded anew.

    Strata start at their earliest arrival. A new collection day between known ones
    becomes the predecessor of the next one for every stratum, so all start there.
    """
    first = arrived.groupBy(*STRATUM).agg(F.min("collected_date").alias("day"))
    day = first_inserted_day(arrived, known_days)
    if day is not None:
        others = chains.select(*STRATUM).distinct().withColumn("day", F.lit(day))
        first = first.unionByName(others).groupBy(*STRATUM).agg(F.min("day").alias("day"))
    return first.select(*STRATUM, F.trunc("day", "month").alias("start"))


def resumed_strata(
    starts: DataFrame, first: date, quotes: DataFrame, calendar: DataFrame, chains: DataFrame, key: str = "pair_key"
) -> DataFrame:
    """Index values of strata from their start on, chained onto the states before.

    ``first`` is the earliest start. Quotes are read from the collection day before
    it on, which prunes the partitions of a table stored by that day.
    """
    before = calendar.filter(F.col("collected_date") < F.lit(first)).agg(F.max("collected_date")).first()[0]
    following = F.broadcast(calendar.select("collected_date", "next_date"))  # one row a calendar day
    # A quote counts as a current fare from the start on, or as the previous fare of such a day.
    counts = F.coalesce("next_date", "collected_date") >= F.col("start")
    used = quotes.filter(F.col("collected_date") >= F.lit(before or first)).join(starts, STRATUM).join(
        following, "collected_date").filter(counts).select(*STRATUM, "collected_date", key, "total_fare")
    stats = stratum_days(match_periods(used, key, calendar)).join(starts, STRATUM).filter("obs_date >= start")
    states = newest_states(chains).filter("state is not null").join(starts, STRATUM).filter("month < start")
    states = states.groupBy(*STRATUM).agg(F.max_by("state", "month").alias("state"))
    return chain(stats, states=states).filter("index_value is not null")


def unseen(arrived: DataFrame, earlier: DataFrame, identity: list[str]) -> DataFrame:
    """Arrivals that are not stored yet, each once.

    An identity includes its collection day, so only the days that arrive are read
    from the stored quotes.
    """
    once = arrived.dropDuplicates(identity)
    # At most one row a calendar day; as literals they prune the stored partitions.
    days = [r["collected_date"] for r in arrived.select("collected_date").distinct().collect()]
    held = earlier.filter(F.col("collected_date").isin(days)).select(*identity)
    return once.join(held, identity, "left_anti")


def run_incremental(
    spark: SparkSession,
    arrivals: str,
    quote_table: str,
    index_table: str,
    state: str,
    schema: T.StructType,
    identity: list[str] | None = None,
    key: str = "pair_key",
):
    """Take all new arrivals, store their quotes and append revised indices.

    Returns the finished query. Quotes are stored by batch and collection day, index
    values by batch and month; the collection days are beside the quotes
    (``-days``), the chain states beside the index (``-chains``). A batch that is
    replayed after a failure compares itself with earlier batches only and writes
    the same files again under the same number, so nothing doubles.
    """
    identity = identity or ["query_hash", "ordinal"]
    stored_schema = T.StructType([*schema.fields, T.StructField("batch", T.IntegerType())])
    day_table, chain_table = f"{quote_table.rstrip('/')}-days", f"{index_table.rstrip('/')}-chains"

    def each(batch: DataFrame, number: int) -> None:
        earlier = _stored(spark, quote_table, stored_schema, number)
        unseen(batch, earlier, identity).write.mode("overwrite").partitionBy("collected_date").parquet(f"{quote_table}/batch={number}")
        seen = _stored(spark, quote_table, stored_schema, number + 1)
        arrived = seen.filter(F.col("batch") == number)
        known = _stored(spark, day_table, DAYS, number)
        fresh_days = arrived.select("collected_date").distinct().join(known, "collected_date", "left_anti")
        fresh_days.coalesce(1).write.mode("overwrite").parquet(f"{day_table}/batch={number}")
        chains = _stored(spark, chain_table, CHAINS, number)
        starts = settle(refold_starts(arrived, known, chains), "starts")
        first = starts.agg(F.min("start")).first()[0]
        if first is None:
            return
        calendar = collection_calendar(_stored(spark, day_table, DAYS, number + 1))
        fresh = settle(resumed_strata(starts, first, seen, calendar, chains, key), "resumed")
        stored = _stored(spark, index_table, STORED, number).filter(F.col("month") >= F.lit(first))
        rows = revisions(fresh, stored.join(starts, STRATUM).filter("obs_date >= start"))
        rows.withColumn("month", month_of("obs_date")).write.mode("overwrite").partitionBy("month").parquet(f"{index_table}/batch={number}")
        chain_states(fresh, starts, chains).write.mode("overwrite").parquet(f"{chain_table}/batch={number}")

    query = (
        quote_stream(spark, arrivals, schema)
        .writeStream.foreachBatch(each)
        .option("checkpointLocation", state)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def first_inserted_day(arrived: DataFrame, known_days: DataFrame) -> date | None:
    """The earliest new collection day that is not later than all known ones."""
    newest = known_days.agg(F.max("collected_date").alias("d")).first()["d"]
    days = arrived.filter(F.col("collected_date") < F.lit(newest)).select("collected_date").distinct()
    return days.join(known_days, "collected_date", "left_anti").agg(F.min("collected_date")).first()[0]


def inserts_a_day(arrived: DataFrame, known_days: DataFrame) -> bool:
    """Whether arrivals put a new collection day before days already collected."""
    return first_inserted_day(arrived, known_days) is not None


STORED = T.StructType([
    T.StructField("route", T.StringType()), T.StructField("bucket", T.StringType()), T.StructField("obs_date", T.DateType()),
    T.StructField("index_value", INDEX), T.StructField("revision", T.IntegerType()), T.StructField("month", T.DateType()),
    T.StructField("batch", T.IntegerType()),
])
DAYS = T.StructType([T.StructField("collected_date", T.DateType()), T.StructField("batch", T.IntegerType())])
CHAINS = T.StructType([
    T.StructField("route", T.StringType()), T.StructField("bucket", T.StringType()), T.StructField("month", T.DateType()),
    T.StructField("state", VALUE), T.StructField("batch", T.IntegerType()),
])


def _stored(spark: SparkSession, path: str, schema: T.StructType, before: int) -> DataFrame:
    """Rows of the batches before a number; none where nothing is stored yet."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path).filter(F.col("batch") < before)
