"""Isolation forest: trees grow in parallel tasks, scoring streams through batches."""

from __future__ import annotations

from hashlib import md5

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from backflow.functions.expressions import ID, with_row
from backflow.operators.quantiles import quantile_row
from backflow.session import checkpoint

TREE = "tree int, node int, feature int, split double, left int, right int, path double"


def average_path(n: float) -> float:
    """Mean depth of an unsuccessful search in a binary tree of ``n`` points."""
    if n <= 1:
        return 0.0
    return 1.0 if n == 2 else 2.0 * (np.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n


def draw(seed: int, tree: int, node: int, what: str) -> float:
    """A uniform number in [0, 1) named by its place in the forest: the first 52 bits of an MD5."""
    return int(md5(f"{seed}:{tree}:{node}:{what}".encode()).hexdigest()[:13], 16) / float(1 << 52)


def _grow(points: np.ndarray, seed: int, tree: int, limit: int) -> list[tuple]:
    """Nodes (node, feature, split, left, right, path) numbered as in a heap from 1; a leaf has feature -1.

    Axis and cut of a node come from :func:`draw`, so a tree depends on its points and its name alone,
    not on the order of the points or on the task.
    """
    nodes: list[tuple] = []
    work = [(np.arange(len(points)), 0, 1)]
    while work:
        rows, depth, node = work.pop()
        part = points[rows]
        leaf = (node, -1, 0.0, -1, -1, depth + average_path(len(rows)))
        if depth >= limit or len(rows) <= 1:
            nodes.append(leaf)
            continue
        low, high = part.min(axis=0), part.max(axis=0)
        open_dims = np.flatnonzero(high > low)
        if not len(open_dims):
            nodes.append(leaf)
            continue
        dim = int(open_dims[int(draw(seed, tree, node, "axis") * len(open_dims))])
        cut = float(low[dim] + draw(seed, tree, node, "cut") * (high[dim] - low[dim]))
        below = part[:, dim] < cut
        if not below.any():
            nodes.append(leaf)
            continue
        nodes.append((node, dim, cut, 2 * node, 2 * node + 1, 0.0))
        work += [(rows[below], depth + 1, 2 * node), (rows[~below], depth + 1, 2 * node + 1)]
    return nodes


def _vector(cols: list[str]):
    return F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols])


def tree_samples(df: DataFrame, cols: list[str], key: str, trees: int, sample: int, seed: int, total: int | None = None, spread: int = 64) -> DataFrame:
    """``sample`` rows per tree without replacement, all trees in one pass.

    Every row is hashed once. The rows below a threshold on that hash, about ``spread * sample`` of them
    whatever the input, are the candidates; only these are hashed once more for each tree, and a tree takes
    its ``sample`` smallest. Rows beyond the first ``spread * sample`` by hash are kept out, so the draw does
    not depend on the threshold's slack. ``total`` is the row count, where it is known.
    """
    total = df.count() if total is None else total
    pool = spread * sample
    first = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(key).cast("string"), F.lit(""))))
    # Six standard deviations above the wanted number; a binomial count falls short once in a billion draws.
    share = min(1.0, (pool + 6.0 * pool ** 0.5 + 64.0) / max(total, 1))
    top = F.conv(F.substring("h", 1, 13), 16, 10).cast("bigint") <= F.lit(int(share * (1 << 52)))
    hashed = df.select(_vector(cols).alias("v"), first.alias("h")).where(top)
    named = [F.md5(F.concat_ws(":", F.lit(str(t)), F.col("h"))) for t in range(trees)]
    candidates = hashed.orderBy("h", "v").limit(pool)
    dealt = candidates.select("v", F.posexplode(F.array(*named)).alias("tree", "d"))
    order = F.row_number().over(Window.partitionBy("tree").orderBy("d", "v"))
    return dealt.withColumn("_n", order).where(F.col("_n") <= sample).select("tree", "v")


def fit_forest(df: DataFrame, cols: list[str], key: str = ID, trees: int = 100, sample: int = 256, seed: int = 42, total: int | None = None) -> DataFrame:
    """Tree nodes as rows; a group holds at most ``sample`` points."""

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        points = np.array(pdf["v"].tolist(), dtype=float)
        limit = int(np.ceil(np.log2(max(sample, 2))))
        out = pd.DataFrame(_grow(points, seed, tree, limit), columns=["node", "feature", "split", "left", "right", "path"])
        out.insert(0, "tree", tree)
        return out

    return tree_samples(df, cols, key, trees, sample, seed, total).groupBy("tree").applyInPandas(grow, TREE)


def score_forest(df: DataFrame, forest: DataFrame, cols: list[str], sample: int = 256) -> DataFrame:
    """Adds ``outlier_score`` = -2^(-mean path / c(sample)), rounded to 12 places so that like rows tie.

    The forest is at most trees * (2 * sample - 1) nodes whatever the data, so it
    is collected once and shipped to the tasks.
    """
    packed = []
    for _, g in forest.toPandas().groupby("tree"):
        nodes = g.set_index("node")
        wide = nodes.reindex(range(nodes.index.max() + 1))
        packed.append({"feature": wide["feature"].fillna(-1).to_numpy(dtype=int), "split": wide["split"].to_numpy(), "path": wide["path"].to_numpy()})
    n = df.sparkSession.sparkContext.broadcast(packed)
    norm = average_path(sample) or 1.0

    def score(v: pd.Series) -> pd.Series:
        points = np.array(v.tolist(), dtype=float)
        if not len(points):
            return pd.Series([], dtype=float)
        total = np.zeros(len(points))
        for tree in n.value:
            at = np.ones(len(points), dtype=int)
            while True:
                dim = tree["feature"][at]
                inner = np.flatnonzero(dim >= 0)
                if not len(inner):
                    break
                node = at[inner]
                at[inner] = 2 * node + (points[inner, dim[inner]] >= tree["split"][node])
            total += tree["path"][at]
        return pd.Series(np.round(-np.power(2.0, -(total / max(len(n.value), 1)) / norm), 12))

    return df.withColumn("outlier_score", F.pandas_udf(score, "double")(_vector(cols)))


def replay_forest(df: DataFrame, forest: DataFrame, cols: list[str], sample: int = 256, key: str = ID) -> DataFrame:
    """(key, outlier_score) by walking stored nodes with joins: one level a step, the row's path in each tree summed.

    Same result as :func:`score_forest` in DataFrame operations alone; every row meets every tree, so it is
    the way to audit a stored forest rather than the fast one. ``key`` names rows uniquely.
    """
    nodes = F.broadcast(forest.select("tree", "node", "feature", "split", "path"))  # at most trees * (2 * sample - 1) rows
    depth = int(np.ceil(np.log2(max(sample, 2))))
    last = forest.select(F.max("tree")).scalar()
    trees = F.explode(F.sequence(F.lit(0), last)).alias("tree")
    here = df.select(F.col(key).alias("k"), _vector(cols).alias("v"), trees).withColumns({"node": F.lit(1), "at": F.lit(0.0)})
    for _ in range(depth + 1):
        seen = here.join(nodes, ["tree", "node"], "left")
        step = F.when(F.get("v", F.col("feature")) < F.col("split"), 2 * F.col("node")).otherwise(2 * F.col("node") + 1)
        here = seen.select(
            "tree", "k", "v", F.when(F.col("feature") >= 0, step).otherwise(F.lit(0)).alias("node"),
            F.when(F.col("feature") == -1, F.col("path")).otherwise(F.col("at")).alias("at"),
        )
    norm = average_path(sample) or 1.0
    return here.groupBy("k").agg(F.round(-F.pow(F.lit(2.0), -(F.avg("at") / norm)), 12).alias("outlier_score")).withColumnRenamed("k", key)


def isolation_forest(
    df: DataFrame, cols: list[str], contamination: float = 0.05, key: str = ID, trees: int = 100, sample: int = 256, seed: int = 42
) -> DataFrame:
    """Adds ``outlier_score`` and ``outlier_flag`` (score below the contamination quantile).

    The input runs once, into a checkpoint; size, draw and scores start from there, and scores are kept for the cut.
    """
    fixed = checkpoint(df)
    total = fixed.count()
    size = max(min(sample, total), 1)
    scored = checkpoint(score_forest(fixed, fit_forest(fixed, cols, key, trees, size, seed, total), cols, size))
    cut = quantile_row(scored, {"at": ("outlier_score", contamination)})
    return with_row(scored, cut, "_cut").withColumn("outlier_flag", F.col("outlier_score") < F.col("_cut.at")).drop("_cut")


def describe_outliers(df: DataFrame) -> DataFrame:
    return df.groupBy("outlier_flag").agg(
        F.count(F.lit(1)).alias("customers"), F.avg("return_rate").alias("avg_return_rate"),
        F.avg("sales_order_no_nunique").alias("avg_order_count"), F.avg("customer_lifetime_days").alias("avg_lifetime_days"),
    )
