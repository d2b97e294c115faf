"""Order-dependent columns that survive a key holding a large share of rows.

``Window.partitionBy(key).orderBy(ts)`` sorts a whole key in one task. Here the
rows are range-sorted by (key, ts, ties) and cut into blocks of consecutive rows,
so a key is cut wherever it is long, also inside one day or one instant. Sums, last
values and counts of each block are carried over to the next one by a window over
one row for each block of the key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from backflow.operators.blocks import BLOCK, ROW, in_blocks

# Rows of a key that one task orders; a key's window over blocks is that much shorter than the key.
BITS = 16


def with_running(
    df: DataFrame,
    key: str,
    ts: str,
    ties: list[str],
    sums: dict[str, str] | None = None,
    lags: dict[str, str] | None = None,
    row_number: str | None = None,
    size: str | None = None,
    bits: int = BITS,
) -> DataFrame:
    """Add running sums, previous values and row numbers per key in (ts, ties) order.

    ``sums`` maps an output name to the summed column (frame: start to current
    row), ``lags`` maps an output name to the column of the previous row, ``size``
    names a column for the number of rows of the key. Blocks hold at most ``2 ** bits`` rows; rows that agree on key, ts and ties are in no fixed order.
    """
    sums, lags = dict(sums or {}), dict(lags or {})
    work = in_blocks(df, [key, ts, *ties], bits)
    inside = Window.partitionBy(key, BLOCK).orderBy(ROW)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)

    added = {f"_s_{o}": F.sum(c).over(upto) for o, c in sums.items()}
    added |= {f"_l_{o}": F.lag(c).over(inside) for o, c in lags.items()}
    added["_pos"] = F.row_number().over(inside)
    local = work.withColumns(added)

    by_block = work.groupBy(key, BLOCK).agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.sum(c).alias(f"_d_{o}") for o, c in sums.items()],
        *[F.max_by(F.struct(c), ROW).alias(f"_e_{o}") for o, c in lags.items()],
    )
    blocks = Window.partitionBy(key).orderBy(BLOCK)
    earlier = blocks.rowsBetween(Window.unboundedPreceding, -1)
    carried = by_block.select(
        key,
        BLOCK,
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_rows_before"),
        F.sum("_rows").over(Window.partitionBy(key)).alias("_rows_all"),
        *[F.sum(f"_d_{o}").over(earlier).alias(f"_b_{o}") for o in sums],
        *[F.lag(f"_e_{o}").over(blocks).alias(f"_p_{o}") for o in lags],
    )
    joined = local.join(carried.withColumnsRenamed({key: "_key", BLOCK: "_kblock"}), F.col(key).eqNullSafe(F.col("_key")) & (F.col(BLOCK) == F.col("_kblock")))

    out = {o: F.coalesce(F.col(f"_b_{o}"), F.lit(0)) + F.coalesce(F.col(f"_s_{o}"), F.lit(0)) for o in sums}
    out |= {
        o: F.when(F.col("_pos") > 1, F.col(f"_l_{o}")).otherwise(F.col(f"_p_{o}").getField(c)) for o, c in lags.items()
    }
    if row_number:
        out[row_number] = (F.col("_rows_before") + F.col("_pos")).cast("bigint")
    if size:
        out[size] = F.col("_rows_all")
    return joined.select(*df.columns, *[expr.alias(name) for name, expr in out.items()])
