"""Durable intermediates: a table written once and read by several branches."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from indexwright.session import checkpoint_dir


#: Has Spark remove an execution's shuffle files when it ends, not when the driver collects its garbage.
REMOVE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Writes in here leave no shuffle files: nothing reads those of a finished write."""
    before = spark.conf.get(REMOVE_SHUFFLES, None)
    spark.conf.set(REMOVE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.unset(REMOVE_SHUFFLES) if before is None else spark.conf.set(REMOVE_SHUFFLES, before)


def settle(frame: DataFrame, name: str) -> DataFrame:
    """Write an intermediate to the shared folder and read it back.

    Used where several branches would otherwise recompute the same joins and
    shuffles. The table is in the folder the cluster shares, so it outlives any
    executor, and being columnar each branch reads only the columns it needs.
    """
    return settle_rounds([frame], name)


def settle_rounds(frames: Iterable[DataFrame], name: str) -> DataFrame:
    """The same for the rows of several frames, written one after the other.

    The shuffles of one are gone before the next begins, so a job that is dealt out
    over rounds has those of one round on disk at a time.
    """
    path = None
    for frame in frames:
        spark, schema = frame.sparkSession, frame.schema
        path = path or f"{checkpoint_dir(spark)}/indexwright/{name}-{uuid.uuid4().hex}"
        with shuffles_removed(spark):
            frame.write.mode("append").option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)
