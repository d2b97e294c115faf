"""Feature importances of random regression forests, for many forests in one pass over the rows.

The method is that of the forest library: values fall into at most ``BINS`` bins a feature, each tree draws its rows with a Poisson weight,
each node chooses among a third of the features by the variance that a cut takes away. The library grows all trees level by level and adds up a
table of all nodes' bins over the tasks in each pass; deep trees have about as many nodes as rows, so passes and tables grow with both.

Here rows are cut to one byte a feature and packed into blocks. Each of a fixed number of tasks gets all blocks once and grows its share of
the trees to the end, so there is one shuffle, whatever depth and number of trees. A task holds a byte a feature of each row, the
target, and about forty bytes a row for the tree at work; only importances and bin edges reach the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from backflow.session import checkpoint

#: Bins of a feature, and how far a cut may lie from its exact rank, as a share of the rows.
BINS = 32
RANK_ERROR = 0.001
#: Rows of a packed block, and nodes whose bins are counted together.
PACKED = 16_384
NODES = 16_384


def bin_edges(df: DataFrame, cols: list[str]) -> list[np.ndarray]:
    """Per column the greatest values of all its bins but the last: all values where there are at most ``BINS``, else even ranks."""

    def few(batches):
        found = [np.zeros(0)] * len(cols)
        for batch in batches:
            for i in range(len(cols)):
                found[i] = np.unique(np.concatenate([found[i], batch.column(i).to_numpy(zero_copy_only=False)]))[:BINS + 1]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(cols)), pa.int32()), pa.array([v.tolist() for v in found], pa.list_(pa.float64()))], names=["i", "v"])

    # A task names at most one value more than there are bins: enough to tell that there are too many.
    values: list[set] = [set() for _ in cols]
    for row in df.select(*cols).mapInArrow(few, "i int, v array<double>").groupBy("i").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("v")))), 1, BINS + 1).alias("v")).collect():
        values[row.i] = set(row.v)
    many = [c for c, v in zip(cols, values) if len(v) > BINS]
    cuts = dict(zip(many, df.approxQuantile(many, [i / BINS for i in range(1, BINS)], RANK_ERROR))) if many else {}
    return [np.unique(cuts[c]) if c in cuts else np.array(sorted(v)[:-1], dtype=float) for c, v in zip(cols, values)]


def _packed(df: DataFrame, cols: list[str], edges: list[np.ndarray]) -> DataFrame:
    """(n, b): blocks of rows, first the bins of all, then folds, then targets."""

    def pack(batches):
        for batch in batches:
            if any(batch.column(i).null_count for i in (len(cols), len(cols) + 1)):
                raise ValueError("a row has no target")
            # An edge belongs to the bin below it.
            bins = np.stack([np.searchsorted(e, batch.column(i).to_numpy(zero_copy_only=False)) for i, e in enumerate(edges)], axis=1).astype(np.uint8)
            fold, y = batch.column(len(cols)).to_numpy().astype(np.uint8), batch.column(len(cols) + 1).to_numpy()
            for at in range(0, len(y), PACKED):
                part = slice(at, at + PACKED)
                block = bins[part].tobytes() + fold[part].tobytes() + y[part].tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([len(y[part])], pa.int32()), pa.array([block], pa.binary())], names=["n", "b"])

    return df.select(*cols, "_fold", "_y").mapInArrow(pack, "n int, b binary")


def _unpacked(blocks: list[tuple[int, bytes]], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bins, folds and targets of all rows, in an order that goes by the rows alone."""
    total = sum(n for n, _ in blocks)
    bins, fold, y = np.empty((total, width), np.uint8), np.empty(total, np.uint8), np.empty(total)
    at = 0
    for n, b in blocks:
        bins[at:at + n] = np.frombuffer(b, np.uint8, n * width).reshape(n, width)
        fold[at:at + n] = np.frombuffer(b, np.uint8, n, n * width)
        y[at:at + n] = np.frombuffer(b, float, n, n * (width + 1))
        at += n
    blocks.clear()
    whole = np.concatenate([bins, fold[:, None], y.view(np.uint8).reshape(-1, 8)], axis=1)
    order = whole.view(f"V{width + 9}").ravel().argsort()
    return bins[order], fold[order], y[order]


def tree_importance(bins: np.ndarray, y: np.ndarray, weight: np.ndarray, depth: int, rng: np.random.Generator) -> np.ndarray:
    """Summed gains per feature of one tree; ``weight`` says how often each row was drawn.

    All nodes of a level are cut together. Rows stay in the order of their nodes, so that a stretch of nodes is a stretch of rows.
    """
    width = bins.shape[1]
    tried = -(-width // 3)
    gains = np.zeros(width)
    rows = np.flatnonzero(weight)
    sizes = np.array([len(rows)] if len(rows) else [], np.int64)
    for _ in range(depth):
        if not len(sizes):
            break
        # Nodes of one target have nothing to gain, nor have those of one row.
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        level = y[rows]
        mixed = np.maximum.reduceat(level, starts) > np.minimum.reduceat(level, starts)
        rows, sizes = rows[np.repeat(mixed, sizes)], sizes[mixed]
        if not len(sizes):
            break
        ends = np.cumsum(sizes)
        kept_rows, kept_sizes = [], []
        for first in range(0, len(sizes), NODES):
            part = sizes[first:first + NODES]
            here = rows[ends[first] - sizes[first]:ends[first + len(part) - 1]]
            found = _cut(bins, y, weight, here, part, tried, rng)
            if found is None:
                continue
            feature, gain, here, part = found
            gains += np.bincount(feature, gain, width)
            kept_rows.append(here)
            kept_sizes.append(part)
        if not kept_rows:
            break
        rows, sizes = np.concatenate(kept_rows), np.concatenate(kept_sizes)
    return gains


def _cut(bins: np.ndarray, y: np.ndarray, weight: np.ndarray, rows: np.ndarray, sizes: np.ndarray, tried: int, rng: np.random.Generator):
    """The best cut of each node: its feature and gain, the rows by child, and the sizes of the children. None where no node is cut."""
    count, width = len(sizes), bins.shape[1]
    node = np.repeat(np.arange(count), sizes)
    w = weight[rows].astype(float)
    wy = w * y[rows]
    mass, total = np.bincount(node, w, count), np.bincount(node, wy, count)
    # Targets less their node's mean: what a cut takes away is then a sum of two terms, without a difference of large numbers.
    wy -= w * (total / mass)[node]
    spread = np.bincount(node, wy * wy / w, count)
    chosen = rng.random((count, width)).argpartition(tried - 1, axis=1)[:, :tried] if tried < width else np.tile(np.arange(width), (count, 1))
    flat, base, spot = bins.reshape(-1), rows * width, node * BINS
    best, feature, limit = np.zeros(count), np.zeros(count, np.int64), np.zeros(count, np.int64)
    for j in range(tried):
        f = chosen[:, j]
        key = spot + flat[base + f[node]]
        left = np.bincount(key, w, count * BINS).reshape(count, BINS).cumsum(axis=1)[:, :-1]
        s = np.bincount(key, wy, count * BINS).reshape(count, BINS).cumsum(axis=1)[:, :-1]
        right = mass[:, None] - left
        two = (left > 0) & (right > 0)
        gain = np.where(two, s * s / np.where(two, left, 1), 0) + np.where(two, s * s / np.where(two, right, 1), 0)
        at = gain.argmax(axis=1)
        most = gain[np.arange(count), at]
        better = most > best
        best, feature, limit = np.where(better, most, best), np.where(better, f, feature), np.where(better, at, limit)
    cut = best > 1e-12 * spread
    if not cut.any():
        return None
    inside = cut[node]
    node, rows, base = node[inside], rows[inside], base[inside]
    child = 2 * (np.cumsum(cut) - 1)[node] + (flat[base + feature[node]] > limit[node])
    return feature[cut], best[cut], rows[np.argsort(child, kind="stable")], np.bincount(child, minlength=2 * int(cut.sum()))


def importances(df: DataFrame, cols: list[str], runs: list[tuple[int | None, int]], trees: int, depth: int) -> np.ndarray:
    """A row of importances for each run ``(fold left out, seed)``; ``df`` has ``cols``, a target ``_y`` and a small number ``_fold``.

    Importances of a tree add up to 1 before trees are averaged, as in the library.
    """
    spark, width = df.sparkSession, len(cols)
    data = checkpoint(df.select(*[F.col(c).cast("double").alias(c) for c in cols], F.col("_fold").cast("int").alias("_fold"), F.col("_y").cast("double").alias("_y")))
    wanted = [(run, tree) for run in range(len(runs)) for tree in range(trees)]
    tasks = min(len(wanted), max(spark.sparkContext.defaultParallelism, 1))
    blocks = _packed(data, cols, bin_edges(data, cols)).withColumn("task", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))))

    def grow(batches):
        task, held = None, []
        for batch in batches:
            for n, b, task in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                held.append((n, b))
        if task is None:
            return
        bins, fold, y = _unpacked(held, width)
        shares: dict[int, np.ndarray] = {}
        for run, tree in wanted[task::tasks]:
            out, seed = runs[run]
            rng = np.random.default_rng([seed, tree])
            weight = rng.poisson(1.0, len(y)).astype(np.uint8)
            if out is not None:
                weight[fold == out] = 0
            gains = tree_importance(bins, y, weight, depth, rng)
            shares[run] = shares.get(run, np.zeros(width)) + gains / (gains.sum() or 1.0)
        yield pa.RecordBatch.from_arrays([pa.array([task] * len(shares), pa.int32()), pa.array(list(shares), pa.int32()), pa.array([v.tolist() for v in shares.values()], pa.list_(pa.float64()))], names=["task", "run", "v"])

    added = np.zeros((len(runs), width))
    for row in sorted(blocks.repartitionById(tasks, F.col("task")).mapInArrow(grow, "task int, run int, v array<double>").collect(), key=lambda r: (r.run, r.task)):
        added[row.run] += row.v
    whole = added.sum(axis=1, keepdims=True)
    return added / np.where(whole > 0, whole, 1.0)
