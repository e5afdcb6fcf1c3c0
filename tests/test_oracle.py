"""Every registered query against its SQL twin at the smallest scale."""

import os

import pytest

from __spark_entry__ import entry
from check import compare, connect
from panelmill.catalog import ORACLE, QUERIES, load_all

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables not present")

load_all()
TWINS = ORACLE
# Fits that need more than the ten areas of the smallest scale.
LARGER = "/root/testdata/sf0.01"
WIDE = ["m2_wage_models", "m5_degree_models", "k5_interaction_by_year", "m8_score_models", "m9_choice_slices", "m14_choice_windows", "m15_outcome_models", "d19_move_propensity"]
# Queries that take quantiles: also with many ranges to each group.
QUANTILES = [
    "a11_median", "a12_quantiles", "a24_profile", "p15_above_global_quantile", "w10_median_split", "w11_quantile_flag",
    "w12_quantile_bin", "k1_box_stats", "k2_density", "d8_herfindahl", "d10_share_change_by_bin", "d12_hub_flows", "d16_quartile_changes",
]


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("key", sorted(set(QUERIES) - set(WIDE)))
def test_query_equals_twin(spark, duck, key):
    verdict = compare(spark, duck, QUERIES[key], TWINS.get(key), FOLDER)
    assert not verdict.startswith("FAIL"), verdict


@pytest.mark.skipif(not os.path.isdir(LARGER), reason="driver tables not present")
@pytest.mark.parametrize("key", WIDE)
def test_wide_fit_equals_twin(spark, key):
    verdict = compare(spark, connect(LARGER), QUERIES[key], TWINS[key], LARGER)
    assert not verdict.startswith("FAIL"), verdict


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(TWINS)


@pytest.mark.parametrize("key", QUANTILES)
def test_many_ranges_equal_twin(spark, duck, large, key):
    verdict = compare(spark, duck, QUERIES[key], TWINS[key], FOLDER)
    assert not verdict.startswith("FAIL"), verdict


def test_entry_has_rows(spark):
    df = entry(spark)
    assert df.columns == ["area", "yr", "exp", "w", "emp", "del_w"]
    assert df.count() > 0


def test_every_inventory_id_is_registered():
    counts = {"s": 10, "p": 18, "j": 17, "a": 25, "w": 17, "o": 4, "u": 3, "r": 4, "f": 18, "m": 16, "k": 10, "d": 24}
    have = {key.split("_")[0] for key in QUERIES}
    assert not [f"{c}{i}" for c, n in counts.items() for i in range(1, n + 1) if f"{c}{i}" not in have]
