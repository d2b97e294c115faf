"""Plan shape: pruned scans, no cross products, no unpartitioned sorts of lines."""

import pytest
from conftest import SMALL

import __spark_entry__ as entry_module


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["f_01_basic_volume", "f_03_consecutive_returns", "f_05_recency", "f_07_adjacency", "f_09_trend", "jn_03_adjacent_pairs", "so_03_dedupe_keep_last", "jn_04_similar_emails", "wn_01_row_number"])
def test_no_cross_products(spark, name):
    text = plan_of(entry_module.queries()[name](spark, SMALL))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_scans_read_only_needed_columns(spark):
    text = plan_of(entry_module.queries()["f_01_basic_volume"](spark, SMALL))
    assert "l_extendedprice" not in text and "p_name" not in text and "l_shipdate" not in text


def test_top_k_per_group_limits_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan_of(entry_module.queries()["so_02_top_k_per_group"](spark, SMALL))


def test_cluster_without_checkpoint_folder_is_refused(monkeypatch):
    from backflow import session

    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Conf:
        get = staticmethod(lambda key, default: default)

    class Frame:
        sparkSession = type("S", (), {"sparkContext": Context(), "conf": Conf()})()

    with pytest.raises(RuntimeError):
        session.checkpoint(Frame())


def test_the_full_build_reads_the_lines_once(spark):
    text = plan_of(entry_module.queries()["f_20_create_all_features"](spark, SMALL))
    assert "FileScan" not in text and "Scan parquet" not in text  # every group starts from the checkpointed lines


def test_substrings_of_ids_are_not_sent_out(spark):
    """The ids are small, what is made of them is hundreds of times that: estimates from the ids must not choose a broadcast."""
    text = plan_of(entry_module.queries()["jn_04_similar_emails"](spark, SMALL))
    assert "Broadcast" not in text and "SortMergeJoin" in text


def test_the_full_build_keeps_no_unused_line_columns(spark):
    """The lines are stored as a compressed table with the columns that some feature group reads, not checkpointed as whole rows."""
    from pathlib import Path

    from backflow.plans import layers
    from backflow.session import shared_folder
    from backflow.sources.order_lines import order_lines

    folder = Path(shared_folder(spark).removeprefix("file:"))
    before = set(folder.glob("lines-*"))
    layers.merged_features(order_lines(spark, SMALL))
    (table,) = set(folder.glob("lines-*")) - before
    assert not {"sku", "units_returned_flag", "return_no"} & set(spark.read.parquet(str(table)).columns)
