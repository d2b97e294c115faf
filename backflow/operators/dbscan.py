"""Density clustering as distributed block joins and connected components."""

from __future__ import annotations

from functools import reduce
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from backflow.session import checkpoint


def _grid_dims(df: DataFrame, vec: str, dims: int) -> list[int]:
    """Coordinates with the largest variance (one number per coordinate reaches the driver)."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Summarizer

    held = df.where(F.col(vec).isNotNull())
    if held.isEmpty():
        return [0]
    spread = held.agg(Summarizer.variance(array_to_vector(F.col(vec))).alias("s")).first()["s"]
    return [int(i) for i in np.argsort(-spread.toArray(), kind="stable")[:dims]]


def dense_index(df: DataFrame, order: str, name: str) -> DataFrame:
    """Consecutive numbers from 0 in ``order``, without a global window.

    The sorted rows are checkpointed, so partition numbers are fixed; a running
    number per partition plus the sizes of the partitions before it is the rank.
    """
    fixed = checkpoint(df.orderBy(order)).withColumn("_part", F.spark_partition_id())
    numbered = fixed.withColumn("_at", F.row_number().over(Window.partitionBy("_part").orderBy(order)))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per partition.
    sizes = fixed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    return numbered.join(F.broadcast(sizes.select("_part", "_off")), "_part").withColumn(name, (F.col("_off") + F.col("_at") - 1).cast("int")).drop("_part", "_at", "_off")


def connected_components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(v, comp): comp is the smallest vertex of the component.

    Every round takes the smallest label among neighbours and then follows the
    label once (pointer jumping), so long chains collapse in few rounds. Each
    round is checkpointed; only the number of changed labels reaches the driver.
    """
    both = checkpoint(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = checkpoint(vertices.select("v", F.col("v").alias("comp")))
    while True:
        near = both.join(labels, both["b"] == labels["v"]).groupBy("a").agg(F.min("comp").alias("m"))
        best = labels.join(near, labels["v"] == near["a"], "left").select("v", F.col("comp").alias("old"), F.least("comp", F.coalesce("m", "comp")).alias("comp"))
        best = checkpoint(best)
        jump = best.select(F.col("v").alias("t"), F.col("comp").alias("far"))
        moved = checkpoint(best.join(jump, best["comp"] == jump["t"], "left").select("v", "old", F.least("comp", F.coalesce("far", "comp")).alias("comp")))
        changed = moved.where("old <> comp").limit(1).count()
        labels = moved.select("v", "comp")
        if not changed:
            return labels


def pick_pivots(df: DataFrame, vec: str, pivots: int, sample: int = 2048) -> np.ndarray:
    """Far-apart vectors of a sample bounded by ``sample`` rows (the smallest hashes): each next one is farthest from those before.

    The sample decides how tight the bounds are, never which pairs are found.
    """
    rows = df.where(F.col(vec).isNotNull()).select(F.col(vec).alias("v"), F.xxhash64(vec).alias("h")).orderBy("h", "v").limit(sample).collect()
    x = np.array([r["v"] for r in rows], dtype=float)
    if not len(x):
        return np.zeros((0, 0))
    chosen, gap = [0], np.sqrt(((x - x[0]) ** 2).sum(axis=1))
    while len(chosen) < min(pivots, len(x)) and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, np.sqrt(((x - x[chosen[-1]]) ** 2).sum(axis=1)))
    return x[chosen]


def _pivot_gaps(pivots: np.ndarray):
    """Column function: distances of a vector to all pivots."""

    def gaps(v: pd.Series) -> pd.Series:
        x = np.array(v.tolist(), dtype=float)
        if not len(x):
            return pd.Series([], dtype=object)
        return pd.Series(list(np.stack([np.sqrt(((x - p) ** 2).sum(axis=1)) for p in pivots], axis=1)))

    return F.pandas_udf(gaps, "array<double>")


def _numbered_blocks(cells: DataFrame, where: list[str], rows: int) -> DataFrame:
    """(where.., blk, b, part): all blocks of the cells with a number, in parts of blocks side by side in the order of the cells, about ``rows`` rows each.

    No global window: rows are counted inside each partition of the sorted blocks and added to those of the partitions before it.
    """
    blocks = cells.withColumn("blk", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(*where, "blk", (F.col("n") / F.col("blocks")).alias("n"))
    fixed = checkpoint(blocks.orderBy(*where, "blk").withColumn("b", F.monotonically_increasing_id())).withColumn("_at", F.spark_partition_id())
    upto = Window.partitionBy("_at").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    # One row per partition.
    sizes = fixed.groupBy("_at").agg(F.sum("n").alias("_n")).select("_at", F.coalesce(F.sum("_n").over(before), F.lit(0.0)).alias("_off"))
    counted = fixed.withColumn("_n", F.coalesce(F.sum("n").over(upto), F.lit(0.0))).join(F.broadcast(sizes), "_at")
    return counted.select(*where, "blk", "b", F.floor((F.col("_off") + F.col("_n")) / F.lit(float(rows))).cast("bigint").alias("part"))


# Rows that a task holds of each of its two parts, and tasks that a small table is cut for, in parts.
PART_ROWS, PARTS = 16384, 12


def _tasks(points: DataFrame, block_rows: int, axes: list[str], pivots: int, eps: float) -> tuple[DataFrame, DataFrame]:
    """Points with their block, and block pairs that can hold neighbours (each pair once) with the task that compares them.

    A cell is a grid cell, cut by nearest pivot where it has more rows than a block. Two cells can hold neighbours where their grid cells are
    equal or touch and, by the triangle inequality, their ranges of distances to each pivot are no further apart than
    ``eps``. Cells meet by grid cell, at most ``pivots`` squared pairs for each two of those, whatever the rows. A task has all such
    pairs between the blocks of two parts, so a block goes to a part's tasks once and not once for each pair.
    """
    where = ["grp", *axes, "region"]
    least = F.array(*[F.min(F.get("gaps", F.lit(i))) for i in range(pivots)])
    most = F.array(*[F.max(F.get("gaps", F.lit(i))) for i in range(pivots)])
    size = F.count(F.lit(1))
    cells = points.groupBy(*where).agg(size.alias("n"), F.ceil(size / F.lit(float(block_rows))).cast("int").alias("blocks"), least.alias("lo"), most.alias("hi"))
    cells = checkpoint(cells)
    total = cells.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    blocks = checkpoint(_numbered_blocks(cells, where, min(PART_ROWS, max(block_rows, -(-total // PARTS)))))
    placed = points.drop("gaps").join(cells.select(*where, "blocks"), where).withColumn("blk", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    placed = placed.join(blocks.drop("part"), [*where, "blk"]).select("grp", "key", "v", "w", "b")
    # Half of the neighbourhood: every unordered cell pair appears once.
    steps = [s for s in product((-1, 0, 1), repeat=len(axes)) if s >= (0,) * len(axes)]
    offsets = F.explode(F.array(*[F.struct(*[F.lit(x).alias(f"s{i}") for i, x in enumerate(s)]) for s in steps]))
    left = cells.withColumn("s", offsets).select(
        *where, F.col("lo").alias("la"), F.col("hi").alias("ha"), *[(F.col(a) + F.col(f"s.s{i}")).alias(f"n_{a}") for i, a in enumerate(axes)]
    )
    right = cells.select(F.col("grp").alias("g2"), *[F.col(a).alias(f"r_{a}") for a in [*axes, "region"]], F.col("lo").alias("lb"), F.col("hi").alias("hb"))
    touch = reduce(lambda x, y: x & y, [F.col(f"n_{a}") == F.col(f"r_{a}") for a in axes], F.col("grp") == F.col("g2"))
    same_grid = reduce(lambda x, y: x & y, [F.col(a) == F.col(f"r_{a}") for a in axes], F.lit(True))
    same = same_grid & (F.col("region") == F.col("r_region"))
    # Rounding of the distances is allowed for.
    limit = lambda far: F.lit(float(eps)) + F.lit(1e-9) * (F.lit(1.0) + far)
    apart = lambda low, high: F.exists(F.zip_with(low, high, lambda x, y: x - y > limit(x)), lambda out: out)
    near = (
        left.join(right, touch)
        .where(~same_grid | (F.col("region") <= F.col("r_region")))
        .where(~apart(F.col("lb"), F.col("ha")) & ~apart(F.col("la"), F.col("hb")))
        .select(*where, *[f"r_{a}" for a in [*axes, "region"]], same.alias("same"))
    )
    one = blocks.select(*where, F.col("b").alias("x"), F.col("part").alias("px"))
    two = blocks.select("grp", *[F.col(a).alias(f"r_{a}") for a in [*axes, "region"]], F.col("b").alias("y"), F.col("part").alias("py"))
    pairs = near.join(one, where).join(two, ["grp", *[f"r_{a}" for a in [*axes, "region"]]]).where(~F.col("same") | (F.col("x") <= F.col("y")))
    return placed, pairs.select(F.least("px", "py").alias("p"), F.greatest("px", "py").alias("q"), "x", "y")


def _located(df: DataFrame, folded: DataFrame, eps: float, vec: str, grid_dims: int, block_rows: int, pivots: int) -> tuple[DataFrame, DataFrame]:
    """Points (grp, key, v, w, b) in numbered blocks, and block pairs (p, q, x, y) of the tasks (p, q)."""
    dims = _grid_dims(df, vec, grid_dims)
    axes = [f"c{i}" for i in range(len(dims))]
    cell = {a: F.floor(F.element_at("v", d + 1) / F.lit(float(eps))).cast("bigint") for a, d in zip(axes, dims)}
    chosen = pick_pivots(df, vec, pivots)
    gaps = _pivot_gaps(chosen)(F.col("v")) if len(chosen) else F.array(F.lit(0.0))
    points = checkpoint(folded.withColumns(cell).withColumn("gaps", gaps))
    # As many regions as a grid cell has blocks; the first pivots lie farthest apart.
    cuts = F.least(F.ceil(F.count(F.lit(1)) / F.lit(float(block_rows))), F.lit(max(len(chosen), 1))).cast("int").alias("cuts")
    open_to = F.slice("gaps", F.lit(1), F.col("cuts"))
    near = F.array_position(open_to, F.array_min(open_to)).cast("int") - 1
    cut = points.join(points.groupBy("grp", *axes).agg(cuts), ["grp", *axes]).withColumn("region", near).drop("cuts")
    placed, pairs = _tasks(checkpoint(cut), block_rows, axes, max(len(chosen), 1), eps)
    return checkpoint(placed), checkpoint(pairs)


def _sent(points: DataFrame, pairs: DataFrame) -> DataFrame:
    """Each point once for each task that has its block."""
    end = lambda c: pairs.select(F.col("p").alias("to_p"), F.col("q").alias("to_q"), F.col(c).alias("b"))
    ends = end("x").unionByName(end("y")).distinct()
    return points.join(ends, "b")


def compared_pairs(df: DataFrame, eps: float = 0.5, vec: str = "v", grid_dims: int = 2, block_rows: int = 1000, pivots: int = 32) -> DataFrame:
    """One row (points, compared, all_pairs): pairs of different vectors that :func:`dbscan` measures, and how many there are."""
    folded = df.where(F.col(vec).isNotNull()).select(F.lit(0).alias("grp"), F.col(vec).alias("v")).distinct().withColumn("key", F.xxhash64("v")).withColumn("w", F.lit(1.0))
    located, pairs = _located(df, folded, eps, vec, grid_dims, block_rows, pivots)
    sizes = located.groupBy("b").agg(F.count(F.lit(1)).alias("n"))
    of = lambda c: sizes.select(F.col("b").alias(c), F.col("n").alias(f"n_{c}"))
    per_task = pairs.join(of("x"), "x").join(of("y"), "y")
    one = F.when(F.col("x") == F.col("y"), F.col("n_x") * (F.col("n_x") - 1) / 2).otherwise(F.col("n_x") * F.col("n_y")).cast("bigint")
    n = sizes.select(F.coalesce(F.sum("n"), F.lit(0))).scalar()
    return per_task.agg(F.coalesce(F.sum(one), F.lit(0)).alias("compared")).select(n.alias("points"), "compared", (n * (n - 1) / 2).cast("bigint").alias("all_pairs"))


def _close(x0: np.ndarray, y0: np.ndarray, eps: float) -> tuple[np.ndarray, np.ndarray]:
    """The (i, j) index pairs of rows of ``x0`` and ``y0`` within ``eps``.

    Inner products by matrix product name the candidates with room for rounding; distances of
    those near the limit are then taken coordinate by coordinate, which decides.
    """
    middle = y0.mean(axis=0)
    x, y = x0 - middle, y0 - middle
    sx, sy = (x ** 2).sum(axis=1), (y ** 2).sum(axis=1)
    hits = []
    step = max(16, (1 << 16) // len(y))
    for lo in range(0, len(x), step):
        size = sx[lo:lo + step, None] + sy[None, :]
        square = size - 2.0 * (x[lo:lo + step] @ y.T)
        room = 1e-9 * (1.0 + size + eps * eps)
        sure = square <= eps * eps - room
        i, j = np.nonzero(~sure & (square <= eps * eps + room))
        for at in range(0, len(i), 65536):
            p, q = i[at:at + 65536], j[at:at + 65536]
            sure[p, q] = np.sqrt(((x0[p + lo] - y0[q]) ** 2).sum(axis=1)) <= eps
        i, j = np.nonzero(sure)
        hits.append((i + lo, j))
    return np.concatenate([h[0] for h in hits]), np.concatenate([h[1] for h in hits])


# Distances that one step of a task looks at together.
STEP = 1 << 20


def _steps(rows: pd.DataFrame, pairs: pd.DataFrame, eps: float):
    """Close rows of a task as steps (alone, i, j) of places in ``rows``, which are sorted by block.

    A block meets its partners some at a time. ``alone``: a block with itself, where each pair is there in both orders and each row with itself.
    """
    names, first = np.unique(rows["b"].to_numpy(), return_index=True)
    ends = dict(zip(names.tolist(), zip(first.tolist(), [*first[1:].tolist(), len(rows)])))
    v = np.array(rows["v"].tolist(), dtype=float)
    for x, partners in pairs.groupby("x")["y"]:
        if x not in ends:
            # A block can stay without points; its pairs then have no hits.
            continue
        lo, hi = ends[x]
        others, held = [], 0
        for y in [*partners.tolist(), None]:
            if y == x:
                i, j = _close(v[lo:hi], v[lo:hi], eps)
                yield True, i + lo, j + lo
            elif y in ends:
                others.append(np.arange(*ends[y]))
                held += len(others[-1])
            if others and (y is None or held * (hi - lo) >= STEP):
                at = np.concatenate(others)
                i, j = _close(v[lo:hi], v[at], eps)
                yield False, i + lo, at[j]
                others, held = [], 0


class _Forest:
    """Spanning forest over numbered points: a dense block links in fewer edges than points."""

    def __init__(self, n: int):
        self.parent, self.kept = np.arange(n), []

    def roots(self) -> np.ndarray:
        while True:
            up = self.parent[self.parent]
            if (up == self.parent).all():
                return up
            self.parent = up

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        roots = self.roots()
        open_to = roots[i] != roots[j]
        i, j = i[open_to], j[open_to]
        # One pair of points for each two parts that are linked here.
        _, at = np.unique(roots[i] * len(roots) + roots[j], return_index=True)

        def root(k: int) -> int:
            while self.parent[k] != k:
                k = self.parent[k]
            return k

        for p, q in zip(i[at].tolist(), j[at].tolist()):
            rp, rq = root(p), root(q)
            if rp != rq:
                self.parent[max(rp, rq)] = min(rp, rq)
                self.kept.append((p, q))


def dbscan(
    df: DataFrame, eps: float = 0.5, min_samples: int = 5, key: str = "id", vec: str = "v", group: str | None = None,
    grid_dims: int = 2, block_rows: int = 1000, pivots: int = 32,
) -> DataFrame:
    """(key, cluster, is_core): Euclidean density clusters, noise -1.

    Copies of a vector fold into one weighted point. Points fall into grid cells
    of width ``eps`` on the widest coordinates, large ones cut further by their nearest of up to
    ``pivots`` reference vectors; cells whose distances to some pivot differ by more than
    ``eps`` never meet, and a cell is split into blocks of about ``block_rows``. Blocks side by side form
    parts of at most ``PART_ROWS`` rows, and a task compares those blocks of two bounded parts that can hold neighbours, whatever the skew. Tasks return neighbour
    counts, then spanning-forest edges between core points, never all pairs.
    Clusters number from 0 by their smallest core key; a border point joins the
    smallest-numbered cluster it touches. With ``group`` the clustering runs
    inside each group and numbers start anew per group. Rows without a vector are noise.
    """
    source = df.select(F.col(key).alias("id0"), F.col(vec).alias("v"), (F.col(group) if group else F.lit(0)).cast("int").alias("grp"))
    folded = source.where("v IS NOT NULL").groupBy("grp", "v").agg(F.min("id0").alias("key"), F.count(F.lit(1)).cast("double").alias("w"))
    kind = dict(folded.dtypes)["key"]
    located, pairs = _located(df, folded, eps, vec, grid_dims, block_rows, pivots)

    def count(rows: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["b", "key"], ignore_index=True)
        w, n = rows["w"].to_numpy(), np.zeros(len(rows))
        for alone, i, j in _steps(rows, pairs, eps):
            n += np.bincount(i, weights=w[j], minlength=len(rows))
            if not alone:
                n += np.bincount(j, weights=w[i], minlength=len(rows))
        return pd.DataFrame({"key": rows["key"], "grp": rows["grp"], "n": n})

    tasks = lambda points: _sent(points, pairs).groupBy("to_p", "to_q").cogroup(pairs.groupBy("p", "q"))
    counts = tasks(located).applyInPandas(count, f"key {kind}, grp int, n double").groupBy("key", "grp").agg(F.sum("n").alias("n"))
    marked = checkpoint(located.join(counts, ["key", "grp"]).withColumn("core", F.col("n") >= min_samples).drop("n"))

    def link(rows: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["b", "key"], ignore_index=True)
        core, forest = rows["core"].to_numpy(dtype=bool), _Forest(len(rows))
        border = [np.zeros(0, dtype=int)]
        for alone, i, j in _steps(rows, pairs, eps):
            forest.link(i[core[i] & core[j]], j[core[i] & core[j]])
            for p, q in ((i, j),) if alone else ((i, j), (j, i)):
                edge = ~core[p] & core[q]
                # Core points of one tree are in one cluster, so one of them stands for all.
                if edge.any():
                    border.append(np.unique(p[edge] * len(rows) + forest.roots()[q[edge]]))
        at, by = np.divmod(np.concatenate(border), len(rows))
        touched = np.stack(np.divmod(np.unique(at * len(rows) + forest.roots()[by]), len(rows)), axis=1)
        inner = np.array(forest.kept, dtype=int).reshape(-1, 2)
        both = np.concatenate([inner, touched])
        key = rows["key"].to_numpy()
        return pd.DataFrame({"a": key[both[:, 0]], "b": key[both[:, 1]], "core": np.arange(len(both)) < len(inner), "grp": rows["grp"].to_numpy()[both[:, 0]]})

    edges = checkpoint(tasks(marked).applyInPandas(link, f"a {kind}, b {kind}, core boolean, grp int"))
    # Keys are unique per group only through their vector, so a vertex is (grp, key).
    vertex = lambda c: F.struct("grp", F.col(c).alias("key"))
    cores = marked.where("core").select(F.struct("grp", "key").alias("v"))
    comps = connected_components(cores, edges.where("core").select(vertex("a").alias("a"), vertex("b").alias("b")))
    roots = comps.select("comp").distinct()
    ranked = dense_index(roots, "comp", "rank").select("comp", F.col("comp.grp").alias("grp"), "rank")
    first = ranked.groupBy("grp").agg(F.min("rank").alias("base"))
    numbered = ranked.join(first, "grp").select("comp", (F.col("rank") - F.col("base")).cast("int").alias("cluster"))
    core_label = comps.join(numbered, "comp").select(F.col("v.grp").alias("grp"), F.col("v.key").alias("key"), "cluster")
    touched = edges.where(~F.col("core")).join(core_label.withColumnRenamed("key", "b"), ["grp", "b"])
    border = touched.groupBy("grp", F.col("a").alias("key")).agg(F.min("cluster").alias("cluster"))
    label = core_label.unionByName(border)
    per_vector = marked.select("grp", "key", "v", "core").join(label, ["grp", "key"], "left")
    return source.join(per_vector.drop("key"), ["grp", "v"], "left").select(
        F.col("id0").alias(key), *([F.col("grp").alias(group)] if group else []),
        F.coalesce("cluster", F.lit(-1)).alias("cluster"), F.coalesce("core", F.lit(False)).alias("is_core"),
    )


def dbscan_summary(labels: DataFrame, max_noise: float = 0.15) -> DataFrame:
    noise = F.avg(F.when(F.col("cluster") == -1, 1.0).otherwise(0.0))
    return labels.agg(
        F.countDistinct(F.when(F.col("cluster") != -1, F.col("cluster"))).alias("n_clusters"),
        F.count_if(F.col("cluster") == -1).alias("noise_points"), F.count_if(F.col("is_core")).alias("core_points"),
        noise.alias("noise_ratio"), (noise <= max_noise).alias("noise_acceptable"),
    )


def sub_dbscan(df: DataFrame, labels: DataFrame, eps: float = 0.3, min_samples: int = 3, key: str = "id", vec: str = "v") -> tuple[DataFrame, DataFrame]:
    """Refine each main cluster; (key, cluster, sub, final_id) and one info row per cluster.

    Clusters below ``3 * min_samples`` are left alone. Points move to
    ``(cluster + 1) * 1000 + sub + 1`` only where a cluster splits into more than
    one part; noise and unsplit points keep the main label.
    """
    main = labels.select(key, "cluster").where("cluster <> -1")
    sizes = main.groupBy("cluster").agg(F.count(F.lit(1)).alias("original_size"))
    big = sizes.where(F.col("original_size") >= 3 * min_samples).select("cluster")
    inside = df.join(main.join(F.broadcast(big), "cluster"), key)
    parts = checkpoint(_grouped(inside, eps, min_samples, key, vec))
    info = parts.groupBy("cluster").agg(
        F.countDistinct(F.when(F.col("sub") != -1, F.col("sub"))).alias("sub_clusters"), F.count_if(F.col("sub") == -1).alias("noise_points")
    )
    info = sizes.join(info, "cluster", "left").na.fill(0)
    split = info.where("sub_clusters > 1").select("cluster", F.lit(True).alias("split"))
    out = labels.select(key, "cluster").join(parts.select(key, "sub"), key, "left").join(split, "cluster", "left")
    moved = F.col("split") & (F.col("sub") != -1)
    final = F.when(moved, (F.col("cluster") + 1) * 1000 + F.col("sub") + 1).otherwise(F.col("cluster")).cast("int")
    return out.select(key, "cluster", F.when(moved, F.col("sub")).alias("sub"), final.alias("final_id")), info


def _grouped(inside: DataFrame, eps: float, min_samples: int, key: str, vec: str) -> DataFrame:
    found = dbscan(inside.withColumnRenamed("cluster", "main"), eps, min_samples, key, vec, group="main")
    return found.select(key, F.col("main").alias("cluster"), F.col("cluster").alias("sub"))
