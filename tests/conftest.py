import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from indexwright.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", "8", partitions=4)
    session.sparkContext.setLogLevel("OFF")
    yield session


@pytest.fixture
def pairs_of(spark):
    """Matched pairs of one stratum-day from (key, previous, current) rows."""
    def build(rows, bucket="T7", route="DEL-BOM", day="2026-07-02"):
        data = [(route, bucket, day, k, str(p), str(c)) for k, p, c in rows]
        return spark.createDataFrame(
            data, "route string, bucket string, d string, pair_key string, p string, c string"
        ).selectExpr(
            "route", "bucket", "cast(d as date) obs_date", "pair_key",
            "cast(p as decimal(12,2)) previous_fare", "cast(c as decimal(12,2)) current_fare",
            "1L as quotes", "'PAIRED' as status",
        )
    return build


@pytest.fixture
def quotes_of(spark):
    """Quotes from (route, bucket, key, day, fare[, provenance]) rows."""
    def build(rows):
        data = [(*r, "LIVE_COLLECTED")[:6] if len(r) == 5 else r for r in rows]
        return spark.createDataFrame(
            [(str(i), *map(str, r)) for i, r in enumerate(data)],
            "quote_id string, route string, bucket string, pair_key string, d string, fare string, provenance string",
        ).selectExpr(
            "quote_id", "route", "bucket", "pair_key", "cast(d as date) collected_date",
            "cast(fare as decimal(12,2)) total_fare", "provenance",
        )
    return build
