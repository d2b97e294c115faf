"""Connected components of an edge table, by alternating stars.

Large star: every node links its larger neighbours to the smallest id near it. Small star: every node links its smaller
neighbours and itself to the smallest of them. Both keep the components; repeated, every component becomes a star
around its smallest id. Group minima combine before the shuffle and joins on hot nodes are split at run time, so
a component of any size passes through no single task. The driver sees one count and one checksum per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from backflow.llm.common import checkpoint, fewer

EDGES_A_TASK = 200_000


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b"), F.col("a")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").filter("v <> m").select(F.col("m").alias("a"), F.col("v").alias("b"))
    return moved.union(least.select(F.col("m").alias("a"), F.col("u").alias("b"))).distinct()


def _state(edges: DataFrame) -> tuple:
    """(rows, checksum) of the edges."""
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component_id) of every node that has an edge to another; component_id is the smallest id of its component.

    Edges are undirected; loops and edges with a null end count as none, repeated edges as one.
    """
    edges = edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), F.col(a).isNotNull().alias("x"), F.col(b).isNotNull().alias("y"))
    edges = checkpoint(fewer(edges.filter("x and y and a <> b").select("a", "b").distinct()))
    state = _state(edges)
    # Rounds over few edges need few tasks and files; the edges never become more than twice as many.
    parts = max(edges.sparkSession.sparkContext.defaultParallelism, -(-state[0] // EDGES_A_TASK))
    while True:
        edges = checkpoint(_small_star(_large_star(edges)).coalesce(parts))
        before, state = state, _state(edges)
        if state == before:
            break
    inner = edges.select(F.col("b").alias("id"), F.col("a").alias("component_id"))
    return inner.union(edges.select(F.col("a"), F.col("a"))).distinct()
