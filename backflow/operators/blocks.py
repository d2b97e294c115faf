"""Rows in one order over the whole table, cut into blocks of bounded size.

A range sort spreads any key over tasks, however many rows it has, as long as the sort columns tell rows apart. Consecutive rows of a
task are numbered; ``BITS`` fewer bits of that number name a block. What concerns a whole key then needs one row for each of its blocks, and
what concerns rows next to each other stays inside a block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from backflow.session import checkpoint, stored

ROW, BLOCK = "_row", "_block"


def in_blocks(df: DataFrame, order: list[str | Column], bits: int) -> DataFrame:
    """``df`` sorted by ``order``, with ``_row`` rising in that order and ``_block`` shared by at most ``2 ** bits`` rows.

    The sorted rows are written once: both numbers have to stay what they are in every later pass.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(ROW, F.monotonically_increasing_id())
    return stored(placed, "sorted").withColumn(BLOCK, F.shiftright(ROW, bits))


def near_pairs(rows: DataFrame, key: str, at: str, reach: int, ties: list[str], bits: int = 11) -> DataFrame:
    """Each pair of different rows of one ``key`` whose integer ``at`` differ by at most ``reach``, once.

    Columns but the key come twice, with ``_a`` for the row earlier in (at, ties) order and ``_b`` for the other. ``ties`` must
    tell rows of one key and ``at`` apart; rows without key or ``at`` are in no pair.

    Rows meet by block: those of one block, and those of two blocks of a key of which one begins at most ``reach`` after the
    other ends. Two blocks meet under a name of their own, so no task of the join gets more than one pair of blocks of ``2 ** bits`` rows for a
    name, whatever share of the rows one key or one ``at`` has.
    """
    others = [c for c in rows.columns if c != key]
    held = in_blocks(rows.where(F.col(key).isNotNull() & F.col(at).isNotNull()), [key, at, *ties], bits)
    side = lambda s: held.select(key, *[F.col(c).alias(f"{c}_{s}") for c in [*others, ROW, BLOCK]])
    a, b = side("a"), side("b")
    close = F.col(f"{at}_b") - F.col(f"{at}_a") <= reach
    within = a.withColumnRenamed(f"{BLOCK}_a", BLOCK).join(b.withColumnRenamed(f"{BLOCK}_b", BLOCK), [key, BLOCK]).where((F.col(f"{ROW}_a") < F.col(f"{ROW}_b")) & close)

    # Blocks are in order, so the earlier one of a pair ends before the later one begins.
    spans = held.groupBy(key, BLOCK).agg(F.min(at).alias("_from"), F.max(at).alias("_to"))
    stretch = lambda c: F.floor(F.col(c) / F.lit(max(reach, 1)))
    earlier = spans.select(key, F.col(BLOCK).alias(f"{BLOCK}_a"), "_to", F.explode(F.array(stretch("_to"), stretch("_to") + 1)).alias("_stretch"))
    later = spans.select(key, F.col(BLOCK).alias(f"{BLOCK}_b"), "_from", stretch("_from").alias("_stretch"))
    near = (F.col(f"{BLOCK}_a") < F.col(f"{BLOCK}_b")) & (F.col("_from") - F.col("_to") <= reach)
    met = checkpoint(earlier.join(later, [key, "_stretch"]).where(near).select(key, f"{BLOCK}_a", f"{BLOCK}_b"))
    across = a.join(met, [key, f"{BLOCK}_a"]).join(b.join(met, [key, f"{BLOCK}_b"]), [key, f"{BLOCK}_a", f"{BLOCK}_b"]).where(close)
    columns = [key, *[f"{c}_{s}" for s in "ab" for c in others]]
    return within.select(*columns).unionByName(across.select(*columns))
