"""Forest importances by one shuffle, and shuffle files that go with their job."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from backflow.operators import forest, prepare as pre
from backflow.plans import layers
from backflow.session import checkpoint
from backflow.sources.order_lines import ORDER_LINES_SQL, order_lines
from conftest import SMALL, rows


def shuffles(spark) -> int:
    """Shuffles whose files are kept."""
    return spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses().size()


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def judged(spark):
    """The target is mostly ``a``, a little ``b`` and never ``c``; ``d`` is constant."""
    rng = np.random.default_rng(1)
    x = rng.random((600, 3))
    data = [(f"c{i}", *map(float, v), 1.0, float((v[0] > 0.4) + 0.3 * (v[1] > 0.7))) for i, v in enumerate(x)]
    return checkpoint(spark.createDataFrame(data, "customer_emailid string, a double, b double, c double, d double, feature_completeness_score double"))


COLS = ["a", "b", "c", "d"]


def test_importances_follow_the_target_and_not_the_layout(judged):
    found = dict(rows(pre.rf_importance(judged, COLS, trees=30)))
    assert sum(found.values()) == pytest.approx(1.0) and found["a"] > found["b"] > found["c"] and found["d"] == 0.0
    assert dict(rows(pre.rf_importance(judged.repartition(7, "b"), COLS, trees=30))) == pytest.approx(found, abs=0.05)
    spread = {r.feature: r for r in pre.importance_stability(judged, COLS, folds=3, trees=10).collect()}
    assert spread["a"].mean_importance > spread["b"].mean_importance and spread["a"].stability < 0.5


def test_a_forest_takes_as_many_jobs_at_any_depth(spark, judged):
    """Before, each level of the trees was a pass over the rows at least."""
    jobs = []
    for depth in (3, 25):
        spark.sparkContext.setJobGroup(f"depth{depth}", "")
        pre.rf_importance(judged, COLS, trees=5, depth=depth)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"depth{depth}")))
    spark.sparkContext._jsc.clearJobGroup()
    assert jobs[0] == jobs[1] > 0


def test_a_tree_takes_the_best_cut_of_each_node():
    rng = np.random.default_rng(3)
    bins, y, weight = rng.integers(0, 6, (200, 2)).astype(np.uint8), rng.random(200), rng.poisson(1.0, 200).astype(np.uint8)

    def gain(at, bound, rows_):
        left = bins[rows_, at] <= bound
        if not left.any() or left.all():
            return 0.0
        spread = lambda m: (weight[rows_][m] * (y[rows_][m] - np.average(y[rows_][m], weights=weight[rows_][m])) ** 2).sum()
        return spread(left | ~left) - spread(left) - spread(~left)

    # One feature of two is tried in a node; at depth 1 the whole gain is that of its best bound.
    drawn = np.flatnonzero(weight)
    got = forest.tree_importance(bins, y, weight, 1, np.random.default_rng(0))
    at = int(got.argmax())
    assert got[at] == pytest.approx(max(gain(at, b, drawn) for b in range(6))) and got[1 - at] == 0.0
    # Grown to the end on one feature, no spread is left but that of rows with equal bins.
    one = bins[:, :1]
    whole = forest.tree_importance(one, y, weight, 30, np.random.default_rng(0)).sum()
    cells = [drawn[one[drawn, 0] == c] for c in np.unique(one[drawn])]
    inside = sum((weight[c] * (y[c] - np.average(y[c], weights=weight[c])) ** 2).sum() for c in cells)
    total = (weight * (y - np.average(y, weights=weight)) ** 2).sum()
    assert whole == pytest.approx(total - inside)


def test_few_values_have_bins_of_their_own(spark):
    df = spark.createDataFrame([(float(i % 3), float(i)) for i in range(1000)], "few double, many double").repartition(4)
    few, many = forest.bin_edges(df, ["few", "many"])
    assert few.tolist() == [0.0, 1.0] and len(many) == forest.BINS - 1 and abs(many[15] - 500) < 5


def test_shuffle_files_of_a_checkpoint_go_with_its_job(spark):
    df = spark.range(1000).groupBy((F.col("id") % 10).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    before = shuffles(spark)
    done = checkpoint(df.join(df.withColumnRenamed("n", "m"), "k"))
    assert shuffles(spark) <= before and done.count() == 10


def test_the_full_build_leaves_no_pile_of_shuffles(spark):
    before = shuffles(spark)
    layers.merged_features(order_lines(spark, SMALL))
    assert shuffles(spark) - before <= 12


@pytest.mark.parametrize("name", ["f_07_adjacency", "f_14_summary_features", "f_14_summary_features_notebook", "pf_12_line_group_correlations"])
def test_only_finished_customer_rows_are_left_for_the_last_job(spark, name):
    df = entry_module.queries()[name](spark, SMALL)
    assert "Window" not in plan(df) and not any(SMALL in f for f in df.inputFiles())


def test_lines_are_those_of_the_text_with_repeated_and_absent_keys(spark, tmp_path):
    tables = {
        "lineitem": ("l_orderkey long, l_partkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string",
                     [(1, 7, 1, 3.0, 9.5, "R"), (1, 7, 1, 3.0, 9.5, "R"), (2, 8, 7, 1.0, 2.0, "N"), (2, None, 1, 1.0, 2.0, "N"), (None, 7, 1, 1.0, 2.0, "A"), (3, 7, 2, 1.0, 2.0, "A"), (9, 7, 2, 1.0, 2.0, "A")]),
        "orders": ("o_orderkey long, o_custkey long, o_orderdate timestamp_ntz", [(1, 4, None), (2, 5, None), (2, 4, None), (3, None, None)]),
        "customer": ("c_custkey long, c_name string", [(4, "Customer#4"), (4, "Customer#04"), (5, None), (None, "Customer#0")]),
        "part": ("p_partkey long, p_name string, p_brand string, p_type string, p_size int", [(7, "n", "b", "t", 1), (7, "n", "b", "u", 2), (8, None, "b", "t", 3)]),
    }
    for name, (schema, data) in tables.items():
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    frames = {name: spark.read.parquet(f"{tmp_path}/{name}.parquet") for name in tables}
    expected = spark.sql(ORDER_LINES_SQL, **frames)
    got = order_lines(spark, str(tmp_path))
    assert got.schema == expected.schema and sorted(map(repr, got.collect())) == sorted(map(repr, expected.collect())) and got.count() == 11
