"""Tables that readers use: quotes by collection day, what can be added up per day, and the index rows.

Everything a day contributes to a report is kept as mergeable parts (counts, sums,
least, greatest), so a report adds up parts instead of reading quotes, and a
changed day replaces its own partitions alone. Quotes are only ever added, so a
day that has been stored never becomes empty.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from indexwright.plans.quality import fare_parts, quality_parts

DAY = "collected_date"


@dataclass(frozen=True)
class ReadTables:
    """A folder with the tables ``quotes``, ``fares`` and ``quality`` (by day), ``routes`` (by route) and ``weights``."""

    spark: SparkSession
    path: str

    def _write(self, rows: DataFrame, name: str, by: str) -> None:
        """Replace the partitions that ``rows`` have; large ones are split over tasks and files."""
        (rows.hint("rebalance", F.col(by)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy(by).parquet(f"{self.path}/{name}"))

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def has(self, name: str) -> bool:
        try:
            self._read(name)
        except AnalysisException as error:
            if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return False
        return True

    def put_quotes(self, quotes: DataFrame, days: list | None = None) -> None:
        """Store the quotes of the given days (all when None) in place of what these days had."""
        changed = quotes if days is None else quotes.filter(F.col(DAY).isin(days))
        self._write(changed, "quotes", DAY)

    def refresh_parts(self, days: list | None = None) -> None:
        """Add up the stored quotes of the given days (all when None) anew."""
        changed = self.quotes if days is None else self.quotes.filter(F.col(DAY).isin(days))
        self._write(fare_parts(changed), "fares", DAY)
        self._write(quality_parts(changed), "quality", DAY)

    def put_index(self, routes: DataFrame, weights: DataFrame) -> None:
        """Store the rows of routes and the weights of all weight sets."""
        self._write(routes, "routes", "route")
        weights.write.mode("overwrite").parquet(f"{self.path}/weights")

    @property
    def quotes(self) -> DataFrame:
        return self._read("quotes")

    @property
    def fares(self) -> DataFrame:
        return self._read("fares")

    @property
    def quality(self) -> DataFrame:
        return self._read("quality")

    @property
    def routes(self) -> DataFrame:
        return self._read("routes")

    @property
    def weights(self) -> DataFrame:
        return self._read("weights")

    def latest_quotes(self, n: int = 50, route: str | None = None) -> DataFrame:
        """The newest quotes, read from the newest days that hold ``n`` of them.

        The parts say how many quotes each day has, so the first day needed is known
        before any quote is read, and older partitions are not opened.
        """
        parts, rows = self.fares, self.quotes
        if route is not None:
            parts, rows = (x.filter(F.col("route") == route.upper()) for x in (parts, rows))
        days = parts.groupBy(DAY).agg(F.sum("quotes").alias("quotes"))
        # Days of a calendar, newest first: the day that completes the n-th quote is the last one needed.
        held = days.agg(F.array_sort(F.collect_list(F.struct(DAY, "quotes"))).alias("d")).select(F.reverse("d").alias("d"))
        first = held.select(F.aggregate(
            "d", F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("date").alias("day")),
            lambda a, x: F.when(a["n"] >= n, a).otherwise(F.struct((a["n"] + x["quotes"]).alias("n"), x[DAY].alias("day"))),
            lambda a: a["day"]).alias("day")).scalar()
        return rows.filter(F.col(DAY) >= first).orderBy(F.desc("collected_at"), "quote_id").limit(n)
