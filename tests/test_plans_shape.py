"""What the optimizer makes of the operators: pruning, pushdown, no cross joins, no Python on relational paths."""

import os

import pytest

from panelmill.catalog import QUERIES, load_all

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables not present")


def plan(spark, key):
    return QUERIES[key](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()


def test_scan_reads_only_used_columns(spark):
    text = plan(spark, "a3_weighted_mean")
    assert "l_extendedprice" in text and "l_linestatus" not in text and "l_discount" not in text


def test_year_ranges_reach_the_scan(spark):
    assert "GreaterThanOrEqual(l_shipdate" in plan(spark, "d6_long_difference")


load_all()
RELATIONAL = [k for k in QUERIES if k[0] in "pjwaufro" or k[:2] in ("d5", "d6", "d7", "d8", "d9") or k.startswith("d1")]


@pytest.mark.parametrize("key", [k for k in RELATIONAL if k != "d1_exposure_scores" and not k.startswith(("u2", "d19_move_prop"))])
def test_relational_queries_stay_in_the_jvm_without_cross_joins(spark, key):
    text = plan(spark, key)
    assert "Python" not in text and "MapInPandas" not in text
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_panel_takes_one_shuffle(spark):
    assert plan(spark, "d5_area_panel").count("Exchange hashpartitioning") == 1


def test_changes_of_several_measures_share_one_sort(spark):
    text = plan(spark, "w3_log_change")
    assert text.count("Sort [") == 1 and text.count("Exchange hashpartitioning") == 2
