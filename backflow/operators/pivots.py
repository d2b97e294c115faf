"""Reshaping and small relational helpers used by profiles and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from backflow.session import checkpoint
from backflow.functions.expressions import ID, unpivot, with_row
from backflow.operators.ordered import with_running
from backflow.operators.quantiles import column_quantiles, quantile_row


def monthly_by_cluster(lines: DataFrame) -> DataFrame:
    """Returned quantity per cluster and calendar month, months as columns."""
    months = list(range(1, 13))
    known = lines.where(F.col("cluster").isNotNull()).withColumn("_month", F.month("order_date"))
    wide = known.groupBy("cluster").pivot("_month", months).agg(F.sum("return_qty"))
    return wide.na.fill(0).select("cluster", *[F.col(str(m)).cast("bigint").alias(f"m{m}") for m in months])


def segment_statistics(df: DataFrame, segment: str, cols: list[str]) -> DataFrame:
    """mean, median, std, min and max of many columns per segment."""
    aggs = []
    for c in cols:
        aggs += [
            F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std"),
            F.min(c).cast("double").alias(f"{c}_min"), F.max(c).cast("double").alias(f"{c}_max"),
        ]
    medians = column_quantiles(df, cols, {"median": 0.5}, [segment]).groupBy(segment).agg(
        *[F.max(F.when(F.col("feature") == c, F.col("median"))).alias(f"{c}_median") for c in cols]
    )
    return df.groupBy(segment).agg(*aggs).join(medians, segment, "left")


STAT_PROBS = {"p01": 0.01, "p10": 0.1, "p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99}


def feature_stats(df: DataFrame, cols: list[str]) -> DataFrame:
    """Long table of statistics per numeric column, with the 1 %/99 % outlier count."""
    long = unpivot(df, [], cols)
    n = F.count(F.lit(1))
    marks = column_quantiles(df, cols, STAT_PROBS)
    plain = long.groupBy("feature").agg(
        F.count("value").alias("count"),
        (n - F.count("value")).alias("null_count"),
        (100.0 * (n - F.count("value")) / n).alias("null_percent"),
        F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
    )
    # One row per column: bounded by the column list.
    outside = (
        long.join(F.broadcast(marks.select("feature", "p01", "p99")), "feature")
        .where((F.col("value") < F.col("p01")) | (F.col("value") > F.col("p99")))
        .groupBy("feature").agg(n.alias("outliers_count"))
    )
    return plain.join(marks, "feature", "left").join(outside, "feature", "left").na.fill(0, ["outliers_count"])


def running_sum_with_peers(df: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """Running sum where rows of the same instant share the result (RANGE frame).

    Rows fold to one per (key, instant) first, so peers never matter again.
    """
    folded = df.groupBy(key, ts).agg(F.sum(value).alias("_v"))
    return with_running(folded, key, ts, [], sums={"running": "_v"}).select(key, ts, F.col("running").cast("bigint").alias("running"))


def share_of_total(df: DataFrame, by: str) -> DataFrame:
    """Count and share per group; the window runs over one row per group."""
    counts = df.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    total = df.select(F.count(F.lit(1))).scalar()
    return counts.withColumn("percentage", 100.0 * F.col("n") / total)


def numbered_batches(df: DataFrame, size: int, key: str = ID) -> DataFrame:
    """(key, batch_id): the distinct keys in order, ``size`` to a batch, from 0.

    Keys are range-sorted; each range counts its own rows and starts where the ranges before it end, so no task sees all
    keys. The driver gets one count per range.
    """
    ranged = checkpoint(df.select(key).distinct().repartitionByRange(key).select(key, F.spark_partition_id().alias("_range")))
    sizes = {r["_range"]: r["n"] for r in ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).collect()}
    before, starts = 0, []
    for part in sorted(sizes):
        starts += [F.lit(part), F.lit(before).cast("bigint")]
        before += sizes[part]
    if not starts:
        return ranged.select(key, F.lit(0).cast("bigint").alias("batch_id"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(key)) - 1 + F.create_map(*starts)[F.col("_range")]
    return ranged.select(key, F.floor(place / size).alias("batch_id"))


def top_per_group(df: DataFrame, group: str, order: list[Column], k: int) -> DataFrame:
    """First ``k`` rows per group; Spark keeps k rows per task before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_rank")


def stacked(row: DataFrame, name: str = "metric", value: str = "value") -> DataFrame:
    """Turn a one-row frame of numbers into (metric, value) rows."""
    return unpivot(row, [], row.columns, name, value)


def equal_width_bins(df: DataFrame, col: str, n: int) -> DataFrame:
    """Right-closed bins of equal width; the minimum belongs to the first bin."""
    ends = df.agg(F.min(col).cast("double").alias("lo"), F.max(col).cast("double").alias("hi"))
    step = F.try_divide(F.col("_row.hi") - F.col("_row.lo"), F.lit(float(n)))
    bin_no = F.ceil(F.try_divide(F.col(col) - F.col("_row.lo"), step))
    safe = F.when(F.col(col).isNotNull(), F.greatest(F.lit(1), F.least(F.lit(n), F.coalesce(bin_no, F.lit(1)))))
    return with_row(df, ends).withColumn("bin", safe.cast("bigint")).drop("_row")


def quantile_bins(df: DataFrame, col: str, n: int) -> DataFrame:
    """Right-closed bins at exact quantiles; repeated edges are dropped."""
    wanted = {f"q{i}": (col, i / n) for i in range(n)}
    edges = F.array_distinct(F.array(*[F.col(f"_row.q{i}") for i in range(1, n)]))
    below = F.filter(edges, lambda e: (e > F.col("_row.q0")) & (e < F.col(col)))
    bin_no = F.when(F.col(col).isNotNull(), F.size(below) + 1)
    return with_row(df, quantile_row(df, wanted)).withColumn("bin", bin_no.cast("bigint")).drop("_row")
