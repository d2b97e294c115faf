"""Exact quantiles without putting a column into one task.

``percentile`` keeps every distinct value of a group in one buffer, which does
not hold for a global quantile over a large table. Here values fall into buckets
by exponent and leading mantissa bits, an order-preserving function of the value
alone. Bucket totals combine on the map side (their number is bounded by the
double format, not by the data) and tell which bucket holds a wanted rank. A bucket
that holds more rows than one task should sort is cut again, evenly between its least and
greatest value, until what holds the rank is small or one value; each cut leaves a
thousandth of the range. Only the values of the last buckets are shuffled, equal ones
folded into counts first, so a value held by a third of all rows is one row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from backflow.functions.expressions import any_of, unpivot
from backflow.session import checkpoint

# Buckets per power of two, and an offset that keeps bucket numbers of all
# positive doubles positive (the smallest exponent is -1074).
STEPS = 1024
SHIFT = 1100
LAST = 10_000_000
# Rows of a bucket that one task may sort.
BOUND = 1_000_000


def value_bucket(v: Column) -> Column:
    """Bucket number, non-decreasing in ``v``; an off-by-one logarithm at a
    power of two gives the same bucket through the mantissa term."""
    size = F.abs(v)
    exponent = F.floor(F.log2(size))
    mantissa = F.floor((size / F.pow(F.lit(2.0), exponent) - 1) * STEPS)
    number = (exponent + SHIFT) * STEPS + mantissa
    finite = F.when(v == 0, F.lit(0)).when(v > 0, number).otherwise(-number).cast("bigint")
    # Infinities and NaN, which Spark orders last, have end buckets of their own.
    ends = F.when(F.isnan(v), F.lit(LAST + 1)).when(v == float("inf"), F.lit(LAST)).when(v == float("-inf"), F.lit(-LAST))
    return ends.otherwise(F.when(~F.isnan(v) & (size != float("inf")), finite)).cast("bigint")


def exact_quantiles(
    df: DataFrame,
    groups: list[str],
    value: str,
    probs: dict[str, float],
    discrete: bool = False,
    bound: int = BOUND,
) -> DataFrame:
    """One row per group with a column per entry of ``probs``.

    Continuous quantiles interpolate linearly between neighbours; discrete ones
    return the first value whose cumulative share reaches the probability.
    NULLs are ignored; a group of NULLs only gives no row. No more than ``bound`` rows of
    different value are sorted together.
    """
    keys = groups or ["_all"]
    base = df if groups else df.withColumn("_all", F.lit(0))
    v = F.col(value).cast("double")
    # Cut once: the input feeds the bucket totals and the values of the hit buckets.
    narrow = checkpoint(base.where(F.col(value).isNotNull()).select(*keys, v.alias("_v")))
    valued = narrow.withColumn("_bucket", value_bucket(F.col("_v")))

    ranks: dict[str, Column] = {}
    for name, p in probs.items():
        if discrete:
            ranks[name] = F.greatest(F.ceil(F.col("_total") * F.lit(float(p))) - 1, F.lit(0))
        else:
            pos = (F.col("_total") - 1) * F.lit(float(p))
            ranks[f"_lo_{name}"], ranks[f"_hi_{name}"] = F.floor(pos), F.ceil(pos)

    def holds(start: Column, count: Column, rank: Column) -> Column:
        return (start <= rank) & (rank < start + count)

    def hits(totals: DataFrame, within: list[str], part: str, first: Column, total: Column) -> DataFrame:
        """Parts that hold a wanted rank, with the rows before them; ``first`` counts those before all parts of one ``within``."""
        upto = Window.partitionBy(*within).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
        placed = totals.withColumns({"_before": first + F.coalesce(F.sum("_size").over(upto), F.lit(0)), "_total": total})
        return placed.where(any_of([holds(F.col("_before"), F.col("_size"), r) for r in ranks.values()]))

    measures = [F.count(F.lit(1)).alias("_size"), F.min("_v").alias("_low"), F.max("_v").alias("_high")]
    hit = checkpoint(hits(valued.groupBy(*keys, "_bucket").agg(*measures), keys, "_bucket", F.lit(0), F.sum("_size").over(Window.partitionBy(*keys))))
    # At most two buckets per probability and group; the number of groups is the caller's, so the planner chooses the join.
    held = valued.join(hit, [*keys, "_bucket"]).drop("_bucket")
    wide = (F.col("_size") > bound) & (F.col("_low") < F.col("_high"))
    while not hit.where(wide).isEmpty():
        # Differences, quotients and floors keep the order, so equal parts of the range are in order too. The ends fall into different ones.
        part = F.least(F.floor((F.col("_v") - F.col("_low")) / (F.col("_high") - F.col("_low")) * STEPS), F.lit(STEPS - 1))
        cut = held.withColumn("_part", F.when(wide, part).otherwise(F.lit(0)).cast("int"))
        totals = cut.groupBy(*keys, F.col("_low").alias("_from"), "_part").agg(*measures, F.max("_before").alias("_first"), F.max("_total").alias("_total"))
        hit = checkpoint(hits(totals, [*keys, "_from"], "_part", F.col("_first"), F.col("_total")).drop("_first"))
        kept = cut.select(*keys, "_v", F.col("_low").alias("_from"), "_part")
        held = checkpoint(kept.join(hit, [*keys, "_from", "_part"]).drop("_from", "_part"))
    folded = held.groupBy(*keys, "_low", "_before", "_total", "_v").agg(F.count(F.lit(1)).alias("_n"))
    inside = Window.partitionBy(*keys, "_low").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    placed = folded.withColumn("_start", F.col("_before") + F.sum("_n").over(inside) - F.col("_n"))
    picked = placed.groupBy(*keys).agg(
        F.max("_total").alias("_total"),
        *[F.max(F.when(holds(F.col("_start"), F.col("_n"), r), F.col("_v"))).alias(n) for n, r in ranks.items()],
    )
    if not discrete:
        for name, p in probs.items():
            pos = (F.col("_total") - 1) * F.lit(float(p))
            lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
            picked = picked.withColumn(name, lo + (hi - lo) * (pos - F.floor(pos)))
    return picked.select(*groups, *probs)


def column_quantiles(df: DataFrame, cols: list[str], probs: dict[str, float], keys: list[str] | None = None) -> DataFrame:
    """(keys.., feature, quantile..) for several columns in one pass."""
    keys = keys or []
    return exact_quantiles(unpivot(df, keys, cols), [*keys, "feature"], "value", probs)


def quantile_row(df: DataFrame, wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """One row of named quantiles: ``{"p75_rate": ("return_rate", .75)}``."""
    cols = sorted({c for c, _ in wanted.values()})
    probs = {f"p_{str(p).replace('.', '_')}": p for p in sorted({p for _, p in wanted.values()})}
    by_prob = {p: name for name, p in probs.items()}
    long = column_quantiles(df, cols, probs)
    return long.agg(
        *[F.max(F.when(F.col("feature") == c, F.col(by_prob[p]))).alias(out) for out, (c, p) in wanted.items()]
    )


def quantile_scalar(df: DataFrame, col: str, p: float, discrete: bool = False) -> Column:
    """An exact quantile as an uncorrelated scalar subquery."""
    return exact_quantiles(df, [], col, {"q": p}, discrete).select("q").scalar()
