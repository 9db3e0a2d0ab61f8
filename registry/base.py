"""Registration of queries, their inputs, and how results are presented."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from indexwright.operators.durable import settle
from indexwright.operators.matching import match_periods, relatives
from indexwright.operators.weights import equal_weights, weights_from_traffic
from indexwright.plans.index_run import IndexRun, run_index
from indexwright.session import apply_settings, checkpoint_dir
from indexwright.sources.star_quotes import StarTables, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


#: The tables for readers of each folder, which one application stores once.
_STORED: dict[tuple[str, str], StarTables] = {}


class Inputs:
    """The driver tables of one folder and what is commonly derived from them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = apply_settings(spark)
        self.folder = folder

    def table(self, name: str) -> DataFrame:
        return table(self.spark, self.folder, name)

    @cached_property
    def stored(self) -> StarTables:
        """The folder's tables for readers; the lines of quotes are stored when first asked for."""
        key = (self.spark.sparkContext.applicationId, self.folder)
        if key not in _STORED:
            tables = StarTables(self.spark, f"{checkpoint_dir(self.spark)}/indexwright/read-{uuid.uuid4().hex}")
            tables.put_lines(self.folder)
            _STORED[key] = tables
        return _STORED[key]

    @cached_property
    def parts(self) -> StarTables:
        """The same with what each day adds to reports."""
        if not self.stored.has("quality"):
            self.stored.refresh_parts()
        return self.stored

    @cached_property
    def index_rows(self) -> StarTables:
        """The same with the rows of routes and two weight sets, the newer in use."""
        if not self.stored.has("weights"):
            older = equal_weights(self.quotes, "placeholder").withColumn("effective_from", F.lit("2020-01-01").cast("date"))
            newer = self.weights.withColumn("effective_from", F.lit("2024-01-01").cast("date"))
            self.stored.put_index(self.run.routes, older.unionByName(newer))
        return self.stored

    @cached_property
    def quotes(self) -> DataFrame:
        return self.stored.quotes

    @cached_property
    def matched(self) -> DataFrame:
        return match_periods(self.quotes)

    @cached_property
    def pairs(self) -> DataFrame:
        """Matched pairs as a stored table; the screens read it more than once."""
        return settle(relatives(self.matched), "pairs")

    @cached_property
    def traffic(self) -> DataFrame:
        """Quotes per route, standing in for a stored table of passenger volumes."""
        return settle(self.quotes.groupBy("route").agg(F.count("*").alias("volume")), "traffic")

    @cached_property
    def weights(self) -> DataFrame:
        return weights_from_traffic(self.traffic, 2, "quote volumes")

    @cached_property
    def run(self) -> IndexRun:
        return run_index(self.quotes, self.weights)


def present(frame: DataFrame) -> DataFrame:
    """Plain columns that any SQL engine returns alike: numbers, text and flags."""
    columns = []
    for field in frame.schema.fields:
        column = F.col(f"`{field.name}`")
        kind = field.dataType
        if isinstance(kind, (T.DecimalType, T.FloatType)):
            column = column.cast("double")
        elif isinstance(kind, (T.IntegerType, T.ShortType, T.ByteType)):
            column = column.cast("bigint")
        elif isinstance(kind, T.DateType):
            column = F.date_format(column, "yyyy-MM-dd")
        elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            column = F.date_format(column, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(kind, T.ArrayType):
            column = F.array_join(column, ",")
        elif isinstance(kind, T.BooleanType):
            column = column.cast("int").cast("bigint")
        columns.append(column.alias(field.name))
    return frame.select(*columns)


def query(name: str, sql: str | None = None):
    """Register a function of the inputs under a name, with its SQL statement."""
    def register(build: Callable[[Inputs], DataFrame]):
        QUERIES[name] = lambda spark, folder: present(build(Inputs(spark, folder)))
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register
