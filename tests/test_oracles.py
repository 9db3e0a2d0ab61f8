"""Registered queries against SQL on the smallest driver tables.

A selection runs by default; ``ALL_QUERIES=1`` runs every one.
"""

import os

import pytest

import __spark_entry__ as entry
from check import compare, connect

FOLDER = "/root/testdata/sf0.001"
SELECTED = [
    "j1_matched_pairs", "a4_stratum_index", "a6b_headline", "a7_imputed_strata", "a9c_weight_violations",
    "a13_lead_time_profile", "a14_quality_counts", "j6_two_date_comparison", "k2_current_published",
    "r3_admission_verdicts", "s1_availability_json", "s6_supplied_rejected",
]
NAMES = sorted(entry.oracle_sql()) if os.environ.get("ALL_QUERIES") else SELECTED


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, duck, name):
    note = compare(entry.queries()[name](spark, FOLDER), duck, entry.oracle_sql()[name])
    assert not note.replace(" EMPTY", ""), note


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
