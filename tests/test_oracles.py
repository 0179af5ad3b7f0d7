"""Registered queries next to their SQL on the smallest scale.

A representative part runs by default; PARCELBOOK_ALL_ORACLES=1 runs every query.
"""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from check import connect, near, table  # noqa: E402

from __spark_entry__ import entry, oracle_sql, queries  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
SOME = [
    "p02_bound_filter", "j05_shifted_year_join", "j07_leave_group_out", "j13_unique_match", "j16_calendar_spine", "j18_point_in_polygon",
    "g04_complete_periods", "g06_local_aggregates", "g13_index_quantiles", "g15_repeated_median", "g16_weighted_cuts", "g20_cross_tabulation",
    "w02_average_rank", "w06_consecutive_change", "w08_calendar_lags", "k03_place_key", "k08_strict_number", "k22_anchor_disambiguation",
    "s04_json_series", "s05_dimensional_cube", "s07_melt_measures", "m08_region_year_mart", "m18_gap_with_bounds", "m21_era_profile",
    "e05_group_centred_ranks", "e10_clustered_ols", "e17_two_stage", "e23_predicted_shock", "v05_weighted_quintiles", "v08_margin_suppression",
    "x03_polygon_measure", "x08_footprint_assignment", "q02_hierarchy", "q13_exact_recompute",
]


def names():
    known = oracle_sql()
    return sorted(known) if os.environ.get("PARCELBOOK_ALL_ORACLES") else [n for n in SOME if n in known]


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", names())
def test_query_matches_sql(spark, duck, name):
    df = queries()[name](spark, FOLDER)
    got = table(df.columns, [tuple(r) for r in df.collect()])
    cur = duck.execute(oracle_sql()[name])
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == sorted(df.columns)
    want = table(columns, cur.fetchall())
    assert got == want or near(got, want)


def test_registry_is_consistent(spark):
    assert set(oracle_sql()) <= set(queries())
    assert entry(spark).count() > 0
