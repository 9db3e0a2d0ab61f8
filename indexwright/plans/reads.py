"""Listing queries: latest rows, one series, flagged observations, movers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from indexwright.functions.labels import is_proxy, rung_meaning
from indexwright.plans.quality import latest_per_group
from indexwright.schemas import VALUE


def _with_movement(rows: DataFrame) -> DataFrame:
    return rows.withColumn("movement", (F.col("index_value") - F.col("prev_index_value")).cast(VALUE))


def latest_quotes(quotes: DataFrame, n: int = 50, route: str | None = None) -> DataFrame:
    """The newest quotes; the quote id makes the order total."""
    rows = quotes if route is None else quotes.filter(F.col("route") == route.upper())
    return rows.orderBy(F.desc("collected_at"), "quote_id").limit(n)


def latest_route_rows(routes: DataFrame, n: int = 100) -> DataFrame:
    stored = routes.filter(F.col("index_value").isNotNull())
    return _with_movement(stored.orderBy(F.desc("obs_date"), "route").limit(n))


def latest_headline(headline: DataFrame, refused: DataFrame) -> DataFrame:
    """The newest headline; when there is none, the reason of the newest refusal."""
    value = headline.agg(
        F.max("obs_date").alias("obs_date"), F.max_by("index_value", "obs_date").alias("index_value")
    )
    reason = refused.agg(F.max_by("reason", "obs_date").alias("r")).scalar()
    return value.withColumn(
        "reason",
        F.when(F.col("index_value").isNull(), F.coalesce(reason, F.lit("no observations"))),
    )


def flagged_observations(events: DataFrame, quotes: DataFrame, key: str = "pair_key", n: int = 100) -> DataFrame:
    """Newest flagged or removed pairs with the quotes behind them.

    The quotes of a pair are those at its collapsed (lowest) fare on the day. A
    pair has at least one, so the newest ``n`` events are taken before the join.
    """
    order = [F.desc("obs_date"), "route", "bucket", "pair_key"]
    q = quotes.select(
        "quote_id", "route", "bucket", F.col("collected_date").alias("obs_date"),
        F.col(key).alias("pair_key"), "carrier", "flight_no", "total_fare",
    )
    newest_events = events.withColumnRenamed("current_fare", "total_fare").orderBy(*order).limit(n)
    return (
        q.join(F.broadcast(newest_events), ["route", "bucket", "obs_date", "pair_key", "total_fare"])
        .orderBy(*order, "quote_id")
        .limit(n)
    )


def route_history(routes: DataFrame, weights: DataFrame, code: str) -> DataFrame:
    """One route's index history with its newest weight and the evidence behind it."""
    rows = _with_movement(
        routes.filter((F.col("route") == code.upper()) & F.col("index_value").isNotNull())
    )
    newest = latest_per_group(
        weights.filter(F.col("route") == code.upper()), ["route"], ["effective_from"],
        ["weight", "evidence_rung", "evidence_ref"],
    )
    return (
        rows.join(newest, "route", "left")
        .withColumn("is_proxy", is_proxy(F.col("evidence_rung")))
        .withColumn("rung_meaning", rung_meaning(F.col("evidence_rung")))
        .orderBy("obs_date")
    )


def newest(rows: DataFrame, at: str, tie: list[str], n: int) -> DataFrame:
    """Top n by time with a total order."""
    return rows.orderBy(F.desc(at), *tie).limit(n)


def ranked_movers(comparison: DataFrame) -> DataFrame:
    """Routes by change, largest rise first."""
    return comparison.orderBy(F.desc("change_pct"), "route")


def with_versions(rows: DataFrame, methodologies: DataFrame, weight_sets: DataFrame, provenance: DataFrame) -> DataFrame:
    """Stamp a result with the newest versions, the provenances and the mode.

    The newest version is the last to take effect, whatever the observation date.
    """
    m = methodologies.agg(F.max_by("version", "effective_from").alias("v")).scalar()
    w = weight_sets.agg(F.max_by("version", "effective_from").alias("v")).scalar()
    p = provenance.select(F.struct("provenances", "mode").alias("p")).scalar()
    return (
        rows.withColumn("methodology_version", m)
        .withColumn("weight_set_version", w)
        .withColumn("_p", p)
        .select("*", "_p.*")
        .drop("_p")
    )
