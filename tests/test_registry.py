"""Registered queries against their SQL twins at the smallest scale."""

import os

import pytest
from conftest import SMALL

import __spark_entry__ as entry_module
import check

ALL = entry_module.queries()
TWINS = entry_module.oracle_sql()
# A spread over the families; BACKFLOW_ALL=1 runs every registered query.
SAMPLE = [
    "f_01_basic_volume", "f_03_consecutive_returns", "f_05_recency", "f_07_adjacency", "f_10_monetary", "f_14_summary_features", "f_16_recent_vs_avg",
    "jn_03_adjacent_pairs", "jn_04_similar_emails", "ag_09_percentiles", "wn_04_running_sum_range", "snk_02_upsert_keep_new", "dq_03_validate_silver",
    "pf_06_consecutive_profile", "im_04_fill_by_name", "scl_01_robust_scale", "fs_08_information_value", "c_01_dbscan", "c_06_silhouette", "c_21_segment_types", "f_20_create_all_features",
]
NAMES = sorted(ALL) if os.environ.get("BACKFLOW_ALL") else SAMPLE


@pytest.fixture(scope="module")
def con():
    return check.connect(SMALL)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_twin(spark, con, name):
    _, problems = check.compare(spark, con, SMALL, name, ALL[name], TWINS.get(name))
    assert not problems


def test_selection_and_correlations_take_all_features_and_groups(spark, con):
    from backflow.operators import prepare as pre

    features = [c for group in pre.CLUSTER_GROUPS.values() for c in group]
    found = {r.feature: r for r in ALL["fs_09_advanced_selection"](spark, SMALL).collect()}
    assert sorted(found) == sorted(features) and all(r.removed == (r.flags >= 2) for r in found.values())
    assert {m for r in found.values() for m in r.methods.split(",")} & {"low_importance", "unstable", "low_iv"}
    _, problems = check.compare(spark, con, SMALL, "pf_12", ALL["pf_12_line_group_correlations"], TWINS["pf_12_line_group_correlations"])
    assert not problems
    pairs = sum(len(c) * (len(c) - 1) // 2 for c in pre.CLUSTER_GROUPS.values())
    assert sum(ALL[f"pf_12_{kind}group_correlations"](spark, SMALL).count() for kind in ("", "line_")) == pairs


def test_twins_belong_to_queries():
    assert TWINS.keys() <= ALL.keys()


def test_flagship(spark):
    df = entry_module.entry(spark)
    assert 0 < len(df.collect()) <= 20
