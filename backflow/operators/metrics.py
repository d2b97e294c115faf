"""Cluster quality on (id, v array<double>, label) frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def squared_distance(a: Column, b: Column) -> Column:
    gaps = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.aggregate(gaps, F.lit(0.0), lambda acc, x: acc + x)


def centers(df: DataFrame, label: str = "label", vec: str = "v") -> DataFrame:
    """(label, n, center) from mergeable per-cluster vector means."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    means = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"), Summarizer.mean(array_to_vector(F.col(vec))).alias("_m"))
    return means.select(label, "n", vector_to_array("_m").alias("center"))


def _with_center(df: DataFrame, c: DataFrame, label: str) -> DataFrame:
    # k rows, one per cluster label.
    return df.join(F.broadcast(c), label)


def calinski_harabasz(df: DataFrame, label: str = "label", vec: str = "v") -> DataFrame:
    """Between-cluster over within-cluster dispersion, one row."""
    c = centers(df, label, vec)
    within = _with_center(df, c, label).agg(F.sum(squared_distance(F.col(vec), F.col("center"))).alias("w"))
    grand = df.select(F.lit(0).alias("_all"), vec)
    middle = centers(grand, "_all", vec).select("center").scalar()
    total = F.col("n").cast("double")
    between = c.withColumn("_grand", middle).agg(
        F.sum(total * squared_distance(F.col("center"), F.col("_grand"))).alias("b"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("k")
    )
    score = F.try_divide(F.col("b") / (F.col("k") - 1), F.col("w") / (F.col("n") - F.col("k")))
    return between.withColumn("w", within.scalar()).select(score.alias("calinski_harabasz"))


def davies_bouldin(df: DataFrame, label: str = "label", vec: str = "v") -> DataFrame:
    """Mean over clusters of the worst (s_i + s_j) / d_ij, one row.

    Pairs are pairs of cluster centres, k rows against k rows.
    """
    c = centers(df, label, vec)
    spread = _with_center(df, c, label).groupBy(label).agg(F.avg(F.sqrt(squared_distance(F.col(vec), F.col("center")))).alias("s"))
    stats = c.join(spread, label).select(F.col(label).alias("i"), F.col("s").alias("si"), F.col("center").alias("ci"))
    others = stats.select(F.col("i").alias("j"), F.col("si").alias("sj"), F.col("ci").alias("cj"))
    pairs = stats.join(F.broadcast(others), F.col("i") != F.col("j"))
    ratio = F.try_divide(F.col("si") + F.col("sj"), F.sqrt(squared_distance(F.col("ci"), F.col("cj"))))
    return pairs.groupBy("i").agg(F.max(ratio).alias("r")).agg(F.avg("r").alias("davies_bouldin"))


def silhouette(df: DataFrame, label: str = "label", vec: str = "v") -> DataFrame:
    """Mean silhouette on squared Euclidean distances, one row; the same measure for every size.

    The squared distances of a point to a cluster add up to n |x|^2 - 2 x.S + Q, with the cluster's size n, vector sum S
    and sum of squared lengths Q. So one pass gives k rows of sums and a second one scores the points: linear, and no
    pair of points meets. A point alone in its cluster scores 0. Limits such as 0.3 are read on this scale,
    where values lie higher than with plain distances.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda acc, z: acc + z)
    points = df.select(F.col(label).alias("_label"), F.col(vec).alias("_v"), dot(F.col(vec), F.col(vec)).alias("_q"))
    sums = points.groupBy("_label").agg(F.count(F.lit(1)).cast("double").alias("n"), Summarizer.sum(array_to_vector(F.col("_v"))).alias("s"), F.sum("_q").alias("q"))
    # One row per cluster.
    clusters = sums.select(F.struct(F.col("_label").alias("label"), "n", vector_to_array("s").alias("s"), "q").alias("c")).agg(F.collect_list("c"))
    scored = points.withColumn("_c", clusters.scalar())
    total = lambda c: F.greatest(F.lit(0.0), c["n"] * F.col("_q") - 2.0 * dot(F.col("_v"), c["s"]) + c["q"])
    own = F.element_at(F.filter("_c", lambda c: c["label"] == F.col("_label")), 1)
    near = F.array_min(F.transform(F.filter("_c", lambda c: c["label"] != F.col("_label")), lambda c: total(c) / c["n"]))
    parts = scored.select(F.try_divide(total(own), own["n"] - 1.0).alias("a"), near.alias("b"))
    score = F.when(F.col("a").isNull(), 0.0).otherwise(F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)))
    return parts.agg(F.avg(score).alias("silhouette"))


def silhouette_value(df: DataFrame, label: str = "label", vec: str = "v") -> float:
    return float(silhouette(df, label, vec).first()[0])
