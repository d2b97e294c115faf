"""Clustering operators against plain numpy."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from backflow.operators import dbscan as db, kmeans as km, metrics, outliers, prepare as pre


def frame(spark, points, labels=None):
    data = [(i, [float(x) for x in p], int(labels[i]) if labels is not None else 0) for i, p in enumerate(points)]
    return spark.createDataFrame(data, "id int, v array<double>, label int")


def reference_dbscan(points, eps, need):
    d = np.sqrt(((points[:, None, :] - points[None, :, :]) ** 2).sum(axis=2)) <= eps
    core = d.sum(axis=1) >= need
    label = np.full(len(points), -1)
    number = 0
    for i in range(len(points)):
        if not core[i] or label[i] >= 0:
            continue
        stack = [i]
        while stack:
            p = stack.pop()
            for q in np.flatnonzero(d[p]):
                if label[q] < 0:
                    label[q] = number
                    if core[q]:
                        stack.append(q)
        number += 1
    return label, core


def points_with_copies(seed=0, n=160, dims=3):
    rng = np.random.default_rng(seed)
    blobs = rng.normal(size=(n, dims)) * 0.25 + rng.integers(0, 3, size=(n, 1)) * 1.5
    # A third of all points are copies of one point.
    return np.vstack([blobs, np.repeat(blobs[:1], n // 2, axis=0), rng.uniform(-3, 6, size=(20, dims))])


@pytest.mark.parametrize("block_rows", [1000, 25])
def test_dbscan_equals_reference(spark, block_rows):
    points = points_with_copies()
    expected, core = reference_dbscan(points, 0.3, 5)
    got = {r["id"]: (r["cluster"], r["is_core"]) for r in db.dbscan(frame(spark, points), 0.3, 5, block_rows=block_rows).collect()}
    assert len(got) == len(points)
    assert [got[i] for i in range(len(points))] == list(zip(expected.tolist(), core.tolist()))


def test_pivot_bounds_leave_out_pairs_and_lose_none(spark):
    """Blobs along many coordinates, none of which tells them apart alone: the grid keeps most pairs, the pivots few."""
    rng = np.random.default_rng(21)
    centres = rng.choice([-1.0, 1.0], size=(16, 64))
    points = np.round(np.concatenate([c + rng.normal(scale=0.04, size=(25, 64)) for c in centres]), 6)
    df = frame(spark, points)
    grid = db.compared_pairs(df, 0.6, pivots=1, block_rows=10).first()
    bound = db.compared_pairs(df, 0.6, pivots=32, block_rows=10).first()
    assert bound["points"] == 400 and bound["all_pairs"] == 400 * 399 // 2
    assert bound["compared"] < 0.1 * bound["all_pairs"] and bound["compared"] < 0.5 * grid["compared"]
    expected, core = reference_dbscan(points, 0.6, 5)
    got = {r["id"]: (r["cluster"], r["is_core"]) for r in db.dbscan(df, 0.6, 5, block_rows=10).collect()}
    assert got == {i: (expected[i], core[i]) for i in range(400)}


def test_dbscan_keeps_rows_without_a_vector_and_empty_tables(spark):
    schema = "id int, v array<double>, extra string"
    rows = [(i, [0.1 * i, 0.0], "x") for i in range(4)] + [(9, None, None), (10, None, "y")]
    got = {r["id"]: (r["cluster"], r["is_core"]) for r in db.dbscan(spark.createDataFrame(rows, schema), 0.15, 2).collect()}
    assert got == {**{i: (0, True) for i in range(4)}, 9: (-1, False), 10: (-1, False)}
    assert db.dbscan(spark.createDataFrame([], schema), 0.15, 2).collect() == []


@pytest.mark.parametrize("pivots", [1, 7, 64])
def test_dbscan_at_the_limit_of_the_radius(spark, pivots):
    """Lattice points exactly one radius apart, copies among them, far from the origin."""
    points = np.array([(1000.0 + 0.5 * x, -2000.0 + 0.5 * y) for x in range(6) for y in range(6)] + [(1000.0, -2000.0)] * 3 + [(1900.0, 0.0)])
    expected, core = reference_dbscan(points, 0.5, 4)
    got = {r["id"]: (r["cluster"], r["is_core"]) for r in db.dbscan(frame(spark, points), 0.5, 4, block_rows=4, pivots=pivots).collect()}
    assert got == {i: (expected[i], core[i]) for i in range(len(points))}


def test_dbscan_all_noise_and_one_chain(spark):
    far = np.arange(5)[:, None] * 10.0
    assert {r["cluster"] for r in db.dbscan(frame(spark, far), 0.5, 2).collect()} == {-1}
    chain = np.arange(60)[:, None] * 0.4
    assert {r["cluster"] for r in db.dbscan(frame(spark, chain), 0.5, 2, block_rows=8).collect()} == {0}


def test_connected_components_on_a_long_path(spark):
    v = spark.range(64).withColumnRenamed("id", "v")
    edges = spark.range(63).where("id <> 40").select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    comps = {r["v"]: r["comp"] for r in db.connected_components(v, edges).collect()}
    assert {comps[i] for i in range(41)} == {0} and {comps[i] for i in range(41, 64)} == {41}


def test_sub_dbscan_splits_only_where_parts_appear(spark):
    a = np.vstack([np.zeros((6, 2)) + np.arange(6)[:, None] * 0.01, 5 + np.arange(6)[:, None] * 0.01 + np.zeros((6, 2))])
    b = 50 + np.arange(12)[:, None] * 0.01 + np.zeros((12, 2))
    tiny = np.array([[100.0, 100.0]] * 2)
    points = np.vstack([a, b, tiny])
    df = frame(spark, points)
    labels = df.select("id", F.when(F.col("id") < 12, 0).when(F.col("id") < 24, 1).otherwise(2).alias("cluster"))
    out, info = db.sub_dbscan(df, labels, 0.3, 3)
    final = {r["id"]: r["final_id"] for r in out.collect()}
    assert {final[i] for i in range(6)} == {1001} and {final[i] for i in range(6, 12)} == {1002}
    assert {final[i] for i in range(12, 24)} == {1} and {final[i] for i in (24, 25)} == {2}
    assert {r["cluster"]: r["sub_clusters"] for r in info.collect()} == {0: 2, 1: 1, 2: 0}


def silhouette_reference(x, y):
    d = ((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2)
    out = []
    for i in range(len(x)):
        same = (y == y[i]) & (np.arange(len(x)) != i)
        if not same.any():
            out.append(0.0)
            continue
        a = d[i][same].mean()
        b = min(d[i][y == c].mean() for c in set(y) if c != y[i])
        out.append((b - a) / max(a, b))
    return float(np.mean(out))


def test_quality_metrics_equal_numpy(spark):
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(size=(40, 4)), rng.normal(size=(30, 4)) + 2, np.repeat(rng.normal(size=(1, 4)), 15, axis=0), rng.normal(size=(1, 4)) + 9])
    y = np.array([0] * 40 + [1] * 30 + [2] * 15 + [3])
    df = frame(spark, x, y)
    assert metrics.silhouette(df).first()[0] == pytest.approx(silhouette_reference(x, y), abs=1e-9)
    mid = np.array([x[y == c].mean(axis=0) for c in range(4)])
    w = sum(((x[y == c] - mid[c]) ** 2).sum() for c in range(4))
    b = sum((y == c).sum() * ((mid[c] - x.mean(axis=0)) ** 2).sum() for c in range(4))
    assert metrics.calinski_harabasz(df).first()[0] == pytest.approx((b / 3) / (w / (len(x) - 4)), rel=1e-9)
    s = [np.sqrt(((x[y == c] - mid[c]) ** 2).sum(axis=1)).mean() for c in range(4)]
    worst = [max((s[i] + s[j]) / np.linalg.norm(mid[i] - mid[j]) for j in range(4) if j != i) for i in range(4)]
    assert metrics.davies_bouldin(df).first()[0] == pytest.approx(np.mean(worst), rel=1e-9)


def test_kmeans_finds_planted_clusters_and_choose_k(spark):
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(size=(40, 2)) * 0.1 + c for c in ((0, 0), (5, 5), (0, 9))])
    df = frame(spark, x).select("id", "v")
    search = km.kmeans_search(df, [2, 3, 4], n_init=2)
    k, found = km.choose_k(search)
    assert k == 3 and found["silhouette"] == 3
    labels, figures = km.kmeans_final(df, 3, df.where("id = 0").select("id"))
    got = {r["id"]: r["cluster"] for r in labels.collect()}
    assert got[0] == -1 and len({got[i] for i in range(1, 40)}) == 1 and figures["silhouette_score"] > 0.9


def test_choose_k_falls_back_to_the_other_score(spark):
    search = spark.createDataFrame([(2, 9.0, 0.2, 5.0, 1.0), (3, 5.0, 0.25, 6.0, 1.0), (4, 4.0, 0.1, 9.0, 2.0)], "k int, inertia double, silhouette double, calinski_harabasz double, davies_bouldin double")
    assert km.choose_k(search)[0] == 3
    assert km.choose_k(search, min_silhouette=0.05)[0] == 3
    assert km.choose_k(search.withColumn("silhouette", F.when(F.col("k") == 3, 0.28).when(F.col("k") == 4, 0.27).otherwise(0.1)), 0.275)[0] == 3


def test_pca_shares(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(80, 3)) * [5, 1, 0.1]
    table = km.pca_explained(frame(spark, x), 3).orderBy("component").collect()
    values = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1]
    assert [r["explained"] for r in table] == pytest.approx(list(values / values.sum()), rel=1e-6)
    assert table[-1]["cumulative"] == pytest.approx(1.0)


def test_isolation_forest_flags_a_planted_outlier(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 3))
    x[17] = [14.0, -13.0, 15.0]
    df = spark.createDataFrame([(str(i), *map(float, p)) for i, p in enumerate(x)], "customer_emailid string, a double, b double, c double")
    out = outliers.isolation_forest(df, ["a", "b", "c"], contamination=0.05)
    scored = out.orderBy("outlier_score").collect()
    assert scored[0]["customer_emailid"] == "17" and scored[0]["outlier_flag"]
    assert abs(sum(r["outlier_flag"] for r in scored) / 600 - 0.05) < 0.01
    assert all(-1 <= r["outlier_score"] < 0 for r in scored)
    again = outliers.isolation_forest(df.repartition(3), ["a", "b", "c"], contamination=0.05).orderBy("outlier_score").first()
    assert again["outlier_score"] == pytest.approx(scored[0]["outlier_score"], abs=1e-12)


def test_tree_samples_are_bounded(spark):
    df = spark.range(5000).select(F.col("id").cast("string").alias("customer_emailid"), F.rand(1).alias("a"))
    sizes = [r["count"] for r in outliers.tree_samples(df, ["a"], "customer_emailid", 10, 64, 7).groupBy("tree").count().collect()]
    assert sizes == [64] * 10


def test_tree_samples_take_the_smallest_names_of_all_rows(spark):
    """The threshold loses none of the wanted candidates: same draw as sorting all rows."""
    md5 = lambda text: hashlib.md5(text.encode()).hexdigest()
    ids = [f"k{i}" for i in range(3000)]
    df = spark.createDataFrame([(k, float(i)) for i, k in enumerate(ids)], "customer_emailid string, a double")
    got = {}
    for r in outliers.tree_samples(df, ["a"], "customer_emailid", 5, 8, 7, spread=16).collect():
        got.setdefault(r["tree"], set()).add(int(r["v"][0]))
    pool = sorted((md5(f"7:{k}"), i) for i, k in enumerate(ids))[:16 * 8]
    assert got == {t: {i for _, i in sorted((md5(f"{t}:{h}"), i) for h, i in pool)[:8]} for t in range(5)}


def test_stored_forest_replays_by_joins(spark):
    rng = np.random.default_rng(12)
    x = np.round(rng.normal(size=(300, 2)), 1)
    rows = [(str(i), *map(float, p)) for i, p in enumerate(x)] + [("copy", *map(float, x[0])), ("hole", None, 0.3)]
    df = spark.createDataFrame(rows, "customer_emailid string, a double, b double")
    forest = outliers.fit_forest(df, ["a", "b"], trees=12, sample=32).cache()
    fast = {r[0]: r["outlier_score"] for r in outliers.score_forest(df, forest, ["a", "b"], 32).collect()}
    slow = {r[0]: r["outlier_score"] for r in outliers.replay_forest(df, forest, ["a", "b"], 32).collect()}
    assert fast.keys() == slow.keys() and max(abs(fast[k] - slow[k]) for k in fast) < 1e-11
    assert fast["copy"] == fast["0"]


def test_isolation_forest_of_no_one_and_like_rows(spark):
    schema = "customer_emailid string, a double, outlier_flags string"
    assert outliers.isolation_forest(spark.createDataFrame([], schema), ["a"]).collect() == []
    same = outliers.isolation_forest(spark.createDataFrame([(str(i), 2.0, "x") for i in range(40)], schema), ["a"], trees=5).collect()
    assert len({r["outlier_score"] for r in same}) == 1 and not any(r["outlier_flag"] for r in same)
    one = outliers.isolation_forest(spark.createDataFrame([(None, None, "x")], schema), ["a"], trees=3).collect()
    assert len(one) == 1 and one[0]["outlier_score"] == -1.0


def numbers(spark, cols):
    n = len(next(iter(cols.values())))
    data = [(str(i), *[float(v[i]) for v in cols.values()]) for i in range(n)]
    return spark.createDataFrame(data, "customer_emailid string, " + ", ".join(f"{c} double" for c in cols))


def test_selection_steps(spark):
    rng = np.random.default_rng(9)
    a, b, c = rng.normal(size=(3, 300))
    df = numbers(spark, {"a": a, "a2": a * 2 + 0.01 * b, "b": b, "c": c, "flat": np.ones(300)})
    assert pre.drop_correlated(df, ["a", "a2", "b", "c", "flat"]) == ["a", "b", "c", "flat"]
    assert pre.drop_low_variance(df, ["a", "flat"]) == ["a"]
    x = np.column_stack([a, a * 2 + 0.01 * b, c])
    expected = [1 / (1 - (1 - ((x[:, i] - np.delete(x, i, 1) @ np.linalg.lstsq(np.delete(x, i, 1), x[:, i], rcond=None)[0]) ** 2).sum() / (x[:, i] ** 2).sum())) for i in range(3)]
    got = [r["vif"] for r in pre.vif(df, ["a", "a2", "c"]).collect()]
    assert got == pytest.approx(expected, rel=1e-5)
    iv = {r["feature"]: r["iv"] for r in pre.information_value(df, ["a", "c"], F.col("a") > 0.5).collect()}
    assert iv["a"] > 1 > iv["c"]
    assert pre.correlated_to_drop([("p", "q"), ("q", "r"), ("r", "s")]) == ["q", "r"]
    kept = {r["feature"]: r["removed"] for r in pre.consolidate(spark, ["p", "q"], {"m1": ["p"], "m2": ["p", "q"]}).collect()}
    assert kept == {"p": True, "q": False}


def test_scaling_of_constant_columns(spark):
    df = numbers(spark, {"a": [1, 2, 3, 4], "flat": [5, 5, 5, 5]})
    for method, expected in (("robust", [-1.0, -1 / 3, 1 / 3, 1.0]), ("standard", [-1.3416407864998738, -0.4472135954999579, 0.4472135954999579, 1.3416407864998738])):
        got = pre.scale(df, ["a", "flat"], method).orderBy("customer_emailid").collect()
        assert [r["a_scaled"] for r in got] == pytest.approx(expected) and {r["flat_scaled"] for r in got} == {0.0}
    with pytest.raises(ValueError):
        pre.scaling_stats(df, ["a"], "minmax")


def test_imputation_rules(spark):
    df = spark.createDataFrame([("a", None, 4.0, None), ("b", 2.0, None, 6.0), ("c", 4.0, 8.0, 2.0)], "customer_emailid string, x_score double, some_days double, return_rate double")
    filled = pre.fill_by_name(df, ["x_score", "some_days", "return_rate"]).orderBy("customer_emailid").collect()
    assert [tuple(r)[1:] for r in filled] == [(3.0, 4.0, 0.0), (2.0, 6.0, 6.0), (4.0, 8.0, 2.0)]
    assert pre.mean_fill(df, ["x_score"]).where("customer_emailid = 'a'").first()["x_score"] == 3.0
    flags = pre.imputation_flags(df, ["x_score", "return_rate"]).orderBy("customer_emailid").first()
    assert (flags["imputed_columns"], flags["imputed_count"]) == ("x_score,return_rate", 2)


def test_starts_are_drawn_from_all_rows_and_weighted(spark):
    import numpy as np
    from pyspark.sql import functions as F

    from backflow.operators import kmeans

    # A third of the rows are copies of one point; one far point stands after 9,000 others.
    df = spark.range(9001).select("id", F.when(F.col("id") == 9000, F.array(F.lit(1e3), F.lit(1e3))).when(F.col("id") % 3 == 0, F.array(F.lit(5.0), F.lit(5.0)))
                                  .otherwise(F.array((F.col("id") % 97) / 97.0, (F.col("id") % 89) / 89.0)).alias("v")).repartition(5)
    points, weights = kmeans._drawn_points(df, 20, 7, "v")
    assert len(points) <= 20 * kmeans.ROUNDS and weights.sum() == 9001
    assert len(np.unique(points, axis=0)) == len(points)
    at = {tuple(p): w for p, w in zip(points.tolist(), weights)}
    assert at[1e3, 1e3] == 1 and at[5.0, 5.0] == 3000
    again = kmeans._drawn_points(df.repartition(2), 20, 7, "v")
    assert np.array_equal(points, again[0]) and np.array_equal(weights, again[1])
    inertia, centers = kmeans.fit_kmeans(df, [3], n_init=3)[3]
    assert sorted(np.round(centers[:, 0], 1).tolist()) == [0.5, 5.0, 1000.0] and inertia < 1000
    same = spark.range(50).select("id", F.array(F.lit(1.0), F.lit(2.0)).alias("v"))
    assert kmeans.fit_kmeans(same, [2], n_init=2)[2][0] == 0.0


def test_quality_of_fits_equals_the_metrics_and_passes_read_packed_blocks(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(700, 4)) + 1e3, rng.normal(size=(900, 4)) * 2, [[9e3, 0, 0, 0]]])
    df = frame(spark, x).repartition(40)
    found, blocks, shift = km._fitted(df, [2, 3, 5], 3, km.MAX_ITER, 7, km.TOL, "v")
    # As many parts of sums as cores, whatever the partitions of the input; every row once.
    assert blocks.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    assert sum(len(b["b"]) for b in blocks.collect()) == x.size * 8
    good = km.fit_quality(blocks, {k: c for k, (_, c) in found.items()})
    for k, (inertia, centers) in found.items():
        labelled = km.with_labels(df, centers + shift, "id")
        at, gaps = km._nearest(x, centers + shift)
        assert inertia == pytest.approx(gaps.sum(), rel=1e-9) and good[k]["sizes"] == {i: n for i, n in enumerate(np.bincount(at, minlength=k).tolist()) if n}
        assert good[k]["silhouette"] == pytest.approx(metrics.silhouette_value(labelled), rel=1e-6)
        assert good[k]["calinski_harabasz"] == pytest.approx(metrics.calinski_harabasz(labelled).first()[0], rel=1e-6)
        assert good[k]["davies_bouldin"] == pytest.approx(metrics.davies_bouldin(labelled).first()[0], rel=1e-6)


def test_a_point_goes_to_a_task_once_for_each_part_not_for_each_block(spark):
    """One cell of 40 blocks that all meet: each point used to be sent some 40 times."""
    rng = np.random.default_rng(4)
    df = frame(spark, rng.uniform(0, 0.1, size=(400, 3)))
    folded = df.select(F.lit(0).alias("grp"), "v", F.col("id").alias("key"), F.lit(1.0).alias("w"))
    located, pairs = db._located(df, folded, 0.5, "v", 2, 10, 1)
    assert pairs.count() == located.select("b").distinct().count() * (located.select("b").distinct().count() + 1) // 2
    assert db._sent(located, pairs).count() <= 400 * (db.PARTS + 2)
    assert pairs.distinct().count() == pairs.count()
