"""Centroid clustering on MLlib, model choice and projections."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F

from backflow.session import checkpoint


def to_vectors(df: DataFrame, cols: list[str], key: str) -> DataFrame:
    """(id, v array<double>) from feature columns; NULL counts as 0."""
    return df.select(F.col(key).alias("id"), F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols]).alias("v"))


def _features(df: DataFrame, vec: str = "v") -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return df.withColumn("features", array_to_vector(F.col(vec)))


# Rows drawn in a round for each centre of the largest k, and rounds; the first draws evenly.
DRAWN = 32
ROUNDS = 4
# A start ends after so many moves, or when no centre moves further than that.
MAX_ITER = 500
TOL = 1e-4


def _starts(points: np.ndarray, weights: np.ndarray, k: int, rng: np.random.Generator, steps: int = 10) -> np.ndarray:
    """k centres out of weighted points, each drawn with weight times squared distance to those before it, then moved among the points."""
    picked = [points[rng.choice(len(points), p=weights / weights.sum())]]
    gaps = ((points - picked[0]) ** 2).sum(axis=1)
    while len(picked) < k:
        pull = gaps * weights
        at = rng.choice(len(points), p=pull / pull.sum()) if pull.sum() > 0 else rng.integers(len(points))
        picked.append(points[at])
        gaps = np.minimum(gaps, ((points - picked[-1]) ** 2).sum(axis=1))
    centers = np.array(picked)
    for _ in range(steps):
        one = np.zeros((k, len(points)))
        one[_nearest(points, centers)[0], np.arange(len(points))] = weights
        mass = one.sum(axis=1)
        centers = np.where(mass[:, None] > 0, one @ points / np.maximum(mass, 1e-300)[:, None], centers)
    return centers


def _matrix(column: pa.Array) -> np.ndarray:
    """The rows of a vector column, read from the batch's own buffer."""
    if column.null_count:
        raise ValueError("a row has no vector")
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def _rows(batches):
    for batch in batches:
        if batch.num_rows:
            yield batch, _matrix(batch.column(0))


def _drawn_points(df: DataFrame, most: int, seed: int, vec: str) -> tuple[np.ndarray, np.ndarray]:
    """At most ``most * ROUNDS`` rows drawn from all, and how many rows are nearest to each.

    Each round draws ``most`` rows, a row with its squared distance to those drawn before as weight: of -log(u) / weight, u drawn by a
    hash of the row, the smallest values win. A task keeps its ``most`` smallest, so no round brings more to the driver, and
    copies of a drawn row weigh nothing in the next one.
    """
    points = np.zeros((0, 0))
    for step in range(ROUNDS):
        known = points

        def race(batches):
            best, rows = np.zeros(0), None
            for batch, x in _rows(batches):
                u = ((batch.column(1).to_numpy().astype(np.uint64) >> np.uint64(11)).astype(float) + 0.5) / 2.0**53
                gaps = _nearest(x, known)[1] if len(known) else np.ones(len(x))
                with np.errstate(divide="ignore"):
                    best, rows = np.concatenate([best, -np.log(u) / gaps]), x if rows is None else np.concatenate([rows, x])
                first = np.argsort(best, kind="stable")[:most]
                first = first[np.isfinite(best[first])]
                best, rows = best[first], rows[first]
            yield pa.RecordBatch.from_arrays([pa.array(best), pa.array([] if rows is None else rows.tolist(), pa.list_(pa.float64()))], names=["r", "v"])

        named = df.select(vec, F.xxhash64(*[F.col(c) for c in df.columns], F.lit(seed), F.lit(step)).alias("h"))
        drawn = [r["v"] for r in named.mapInArrow(race, "r double, v array<double>").orderBy("r", "v").limit(most).collect()]
        if not drawn:
            break
        points = np.unique(np.concatenate([points.reshape(-1, len(drawn[0])), np.array(drawn)]), axis=0)
    final = points

    def count(batches):
        total = np.zeros(len(final))
        for _, x in _rows(batches):
            total += np.bincount(_nearest(x, final)[0], minlength=len(final))
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["s"])

    mass = df.select(vec).mapInArrow(count, "s array<double>").agg(Summarizer.sum(array_to_vector("s"))).first()[0]
    return points, mass.toArray()


def _nearest(x: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centre of each row, ties to the first, and the squared distance to it."""
    gaps = np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ centers.T + (centers * centers).sum(axis=1), 0)
    at = gaps.argmin(axis=1)
    return at, ((x - centers[at]) ** 2).sum(axis=1)


# Rows of a packed block.
PACKED = 1024


def _packed(df: DataFrame, vec: str, shift: np.ndarray) -> DataFrame:
    """(b): blocks of at most ``PACKED`` rows less ``shift`` as bytes, dealt evenly over the cores.

    A pass then reads matrices, and brings as many parts of its sums together as there are cores, whatever the number of rows.
    """

    def pack(batches):
        for _, x in _rows(batches):
            for at in range(0, len(x), PACKED):
                yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(x[at:at + PACKED] - shift).tobytes()], pa.binary())], names=["b"])

    return checkpoint(df.select(vec).repartition(max(df.sparkSession.sparkContext.defaultParallelism, 1)).mapInArrow(pack, "b binary"))


def _blocks(batches, width: int):
    for batch in batches:
        for b in batch.column(0):
            yield np.frombuffer(b.as_py()).reshape(-1, width)


def _by_k(runs: dict) -> list[tuple[list, np.ndarray]]:
    """Names and stacked centres (start, centre, coordinate) of the starts of each k."""
    ks = sorted({run[0] for run in runs})
    named = [[run for run in runs if run[0] == k] for k in ks]
    return [(names, np.stack([runs[run] for run in names])) for names in named]


def _place(x: np.ndarray, size: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, start): number of the nearest centre, ties to the first, and the squared distance to it, of all starts by one matrix product."""
    flat = centers.reshape(-1, x.shape[1])
    gaps = ((flat * flat).sum(axis=1) - 2 * (x @ flat.T)).reshape(len(x), *centers.shape[:2])
    at = gaps.argmin(axis=2)
    return at, np.maximum(np.take_along_axis(gaps, at[:, :, None], 2)[:, :, 0] + size[:, None], 0)


def _moved_sums(blocks: DataFrame, runs: dict, width: int) -> dict:
    """Per start a table with a row for each centre: its rows' sum, their number and their squared distances."""
    shipped = blocks.sparkSession.sparkContext.broadcast(_by_k(runs))

    def sums(batches):
        groups = shipped.value
        totals = [np.zeros((c.shape[0] * c.shape[1], width + 2)) for _, c in groups]
        for x in _blocks(batches, width):
            size = (x * x).sum(axis=1)
            wide = np.concatenate([x, np.ones((len(x), 1))], axis=1)
            for (_, c), total in zip(groups, totals):
                at, gaps = _place(x, size, c)
                one = np.zeros((len(x), *c.shape[:2]))
                np.put_along_axis(one, at[:, :, None], 1.0, 2)
                total[:, :-1] += one.reshape(len(x), -1).T @ wide
                np.put_along_axis(one, at[:, :, None], gaps[:, :, None], 2)
                total[:, -1] += one.sum(axis=0).ravel()
        found = [(run, t) for (names, c), total in zip(groups, totals) for run, t in zip(names, total.reshape(len(names), -1))]
        columns = [[run[0] for run, _ in found], [run[1] for run, _ in found], [t.tolist() for _, t in found]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.list_(pa.float64())))], names=["k", "i", "s"])

    parts = blocks.mapInArrow(sums, "k int, i int, s array<double>")
    added = parts.groupBy("k", "i").agg(Summarizer.sum(array_to_vector("s")).alias("s")).collect()
    shipped.unpersist()
    return {(row.k, row.i): row.s.toArray().reshape(-1, width + 2) for row in added}


def _fitted(df: DataFrame, ks: list[int], n_init: int, max_iter: int, seed: int, tol: float, vec: str) -> tuple[dict, DataFrame, np.ndarray]:
    """:func:`fit_kmeans` with centres less the returned shift, and the packed rows."""
    points, weights = _drawn_points(df, DRAWN * max(ks), seed, vec)
    shift = weights @ points / weights.sum()
    blocks = _packed(df, vec, shift)
    runs = {(k, i): _starts(points, weights, k, np.random.default_rng([seed, k, i])) - shift for k in ks for i in range(n_init)}
    costs: dict[tuple[int, int], float] = {}
    moving = dict(runs)
    for step in range(max_iter + 1):
        still = {}
        for run, table in _moved_sums(blocks, moving, len(shift)).items():
            old, count = moving[run], table[:, -2]
            costs[run], runs[run] = float(table[:, -1].sum()), old
            new = np.where(count[:, None] > 0, table[:, :-2] / np.maximum(count, 1)[:, None], old)
            if step < max_iter and np.sqrt(((new - old) ** 2).sum(axis=1)).max() > tol:
                still[run] = new
        moving = still
        if not moving:
            break
    best = {k: min((run for run in costs if run[0] == k), key=lambda run: (costs[run], run)) for k in ks}
    return {k: (costs[run], runs[run]) for k, run in best.items()}, blocks, shift


def fit_kmeans(df: DataFrame, ks: list[int], n_init: int = 20, max_iter: int = MAX_ITER, seed: int = 42, tol: float = TOL, vec: str = "v") -> dict[int, tuple[float, np.ndarray]]:
    """Per k the inertia and centres of the cheapest of ``n_init`` starts.

    All starts of all k move together: a pass over the rows gives each task's sums per centre of every start that still
    moves, which are added up by start, so the number of passes is that of the slowest start and not the sum over all. Starts come
    from rows drawn over several rounds from all rows, weighted by the rows near them. A start ends when no centre moves more than ``tol``.
    Rows are packed into blocks once, and a pass is two matrix products a block.
    """
    found, _, shift = _fitted(df, ks, n_init, max_iter, seed, tol, vec)
    return {k: (cost, centers + shift) for k, (cost, centers) in found.items()}


def _added(parts: DataFrame) -> dict[int, np.ndarray]:
    return {row.k: row.s.toArray() for row in parts.groupBy("k").agg(Summarizer.sum(array_to_vector("s")).alias("s")).collect()}


def fit_quality(blocks: DataFrame, fits: dict[int, np.ndarray]) -> dict[int, dict]:
    """Per k the sizes, silhouette (squared distances), Calinski-Harabasz and Davies-Bouldin figures of packed rows at their nearest centres.

    The formulas of :mod:`~backflow.operators.metrics` for all k together: one pass for sums per cluster, one for distances to their means.
    """
    width = len(next(iter(fits.values()))[0])
    one_of = lambda at, k: np.eye(k)[at]

    def rows(totals):
        return pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array([t.ravel().tolist() for t in totals.values()], pa.list_(pa.float64()))], names=["k", "s"])

    def sums(batches):
        totals = {k: np.zeros((k, width + 2)) for k in fits}
        for x in _blocks(batches, width):
            size = (x * x).sum(axis=1)
            wide = np.concatenate([x, np.ones((len(x), 1)), size[:, None]], axis=1)
            for k, c in fits.items():
                totals[k] += one_of(_place(x, size, c[None])[0][:, 0], k).T @ wide
        yield rows(totals)

    tables = {k: t.reshape(k, -1) for k, t in _added(blocks.mapInArrow(sums, "k int, s array<double>")).items()}

    def spreads(batches):
        # A row for each cluster: distances to its mean, their squares, silhouette scores.
        totals = {k: np.zeros((k, 3)) for k in fits}
        for x in _blocks(batches, width):
            size = (x * x).sum(axis=1)
            for k, c in fits.items():
                n, s, q = tables[k][:, width], tables[k][:, :width], tables[k][:, -1]
                at, row = _place(x, size, c[None])[0][:, 0], np.arange(len(x))
                square = ((x - (s / np.maximum(n, 1)[:, None])[at]) ** 2).sum(axis=1)
                far = np.maximum(n * size[:, None] - 2 * (x @ s.T) + q, 0)
                other = np.where(n > 0, far / np.maximum(n, 1), np.inf)
                other[row, at] = np.inf
                a, b = far[row, at] / np.maximum(n[at] - 1, 1), other.min(axis=1)
                most = np.maximum(a, b)
                scored = (n[at] > 1) & np.isfinite(b) & (most > 0)
                score = np.where(scored, (np.where(scored, b, 0) - a) / np.where(scored, most, 1), 0)
                totals[k] += one_of(at, k).T @ np.stack([np.sqrt(square), square, score], axis=1)
        yield rows(totals)

    out = {}
    for k, t in _added(blocks.mapInArrow(spreads, "k int, s array<double>")).items():
        n, spread = tables[k][:, width], t.reshape(k, 3)
        held = np.flatnonzero(n)
        mean, total = tables[k][held, :width] / n[held, None], n.sum()
        grand = tables[k][:, :width].sum(axis=0) / total
        between, within = (n[held] * ((mean - grand) ** 2).sum(axis=1)).sum(), spread[:, 1].sum()
        wide = spread[held, 0] / n[held]
        gap = np.sqrt(((mean[:, None] - mean[None]) ** 2).sum(axis=2))
        near = [max(((wide[i] + wide[j]) / gap[i, j] for j in range(len(held)) if gap[i, j] > 0), default=None) for i in range(len(held))]
        near = [x for x in near if x is not None]
        out[k] = {
            "sizes": {int(i): int(n[i]) for i in held}, "silhouette": float(spread[:, 2].sum() / total),
            "calinski_harabasz": float(between / (len(held) - 1) / (within / (total - len(held)))) if len(held) > 1 and total > len(held) and within > 0 else None,
            "davies_bouldin": float(np.mean(near)) if near else None,
        }
    return out


def with_labels(df: DataFrame, centers: np.ndarray, key: str, vec: str = "v") -> DataFrame:
    """(key, v, label): each row with its nearest centre's number."""
    kind = df.schema[key].dataType.simpleString()

    def assign(batches):
        for batch in batches:
            at = _nearest(_matrix(batch.column(1)), centers)[0] if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(at, pa.int32())], names=[key, vec, "label"])

    return df.select(key, vec).mapInArrow(assign, f"`{key}` {kind}, {vec} array<double>, label int")


def kmeans_search(df: DataFrame, ks: list[int], n_init: int = 20, key: str = "id", seed: int = 42) -> DataFrame:
    """One row per k: inertia, silhouette (squared distances), Calinski-Harabasz, Davies-Bouldin."""
    found, blocks, _ = _fitted(checkpoint(df.select(key, "v")), ks, n_init, MAX_ITER, seed, TOL, "v")
    good = fit_quality(blocks, {k: centers for k, (_, centers) in found.items()})
    rows = [(k, inertia, good[k]["silhouette"], good[k]["calinski_harabasz"], good[k]["davies_bouldin"]) for k, (inertia, _) in found.items()]
    return df.sparkSession.createDataFrame(rows, "k int, inertia double, silhouette double, calinski_harabasz double, davies_bouldin double")


def choose_k(search: DataFrame, min_silhouette: float = 0.3) -> tuple[int, dict[str, int]]:
    """Best silhouette, unless it is below the limit and the Calinski-Harabasz optimum reaches it."""
    rows = search.orderBy("k").collect()
    ks = [r["k"] for r in rows]
    col = lambda name: np.array([r[name] for r in rows], dtype=float)
    at = lambda i: ks[int(i)]
    found = {"silhouette": at(np.argmax(col("silhouette"))), "calinski_harabasz": at(np.argmax(col("calinski_harabasz"))), "davies_bouldin": at(np.argmin(col("davies_bouldin")))}
    bend = np.diff(col("inertia"), 2)
    if len(bend):
        # The second difference at position i describes the bend two steps on.
        found["elbow"] = at(np.argmax(bend) + 2)
    score = dict(zip(ks, col("silhouette")))
    best = found["silhouette"]
    if score[best] < min_silhouette and score[found["calinski_harabasz"]] >= min_silhouette:
        best = found["calinski_harabasz"]
    return best, found


def kmeans_final(df: DataFrame, k: int, noise: DataFrame | None = None, n_init: int = 20, key: str = "id", seed: int = 42) -> tuple[DataFrame, dict]:
    """(key, cluster) for every row, -1 for the rows of ``noise``, and quality figures."""
    clean = df.join(noise.select(key), key, "left_anti") if noise is not None else df
    data = checkpoint(clean.select(key, "v"))
    found, blocks, shift = _fitted(data, [k], n_init, MAX_ITER, seed, TOL, "v")
    inertia, centers = found[k][0], found[k][1] + shift
    labelled = with_labels(data, centers, key)
    good = fit_quality(blocks, {k: found[k][1]})[k]
    figures = {
        "inertia": inertia, "silhouette_score": good["silhouette"],
        "calinski_harabasz_score": good["calinski_harabasz"], "davies_bouldin_score": good["davies_bouldin"],
        "cluster_sizes": good["sizes"], "small_clusters": sorted(c for c, n in good["sizes"].items() if n < 10),
        "centers": centers.tolist(),
    }
    full = df.select(key).join(labelled.select(key, F.col("label").alias("cluster")), key, "left")
    return full.select(key, F.coalesce("cluster", F.lit(-1)).cast("int").alias("cluster")), figures


def pca(df: DataFrame, k: int = 10, vec: str = "v") -> tuple[DataFrame, DataFrame]:
    """Projection (id, pca array) and (component, explained, cumulative) rows."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import vector_to_array

    data = _features(df, vec)
    model = PCA(k=k, inputCol="features", outputCol="_p").fit(data)
    shares = [float(x) for x in model.explainedVariance.toArray()]
    rows = [(i + 1, s, float(np.sum(shares[: i + 1]))) for i, s in enumerate(shares)]
    table = df.sparkSession.createDataFrame(rows, "component int, explained double, cumulative double")
    projected = model.transform(data).withColumn("pca", vector_to_array("_p")).drop("_p", "features")
    return projected, table


def pca_explained(df: DataFrame, k: int = 10, vec: str = "v") -> DataFrame:
    return pca(df, k, vec)[1]
