"""Shards of near equal bytes that keep equal texts together: minimax contiguous partition.

Rows with equal texts form a group that is never cut. Groups stand in the order of the first 60 bits of their text's
SHA-256 (texts that share these bits move together). The smallest capacity is searched by halving: a capacity fits if
greedy filling, in order, needs no more than the wanted number of shards. The cuts are those of the smallest one.

The driver holds the bytes of about ``CELLS`` cells of that order at a time, whatever the table's size. Cutting at cell
borders alone gives a capacity that surely fits, cutting anywhere in a cell one that no cut can beat; cuts of all capacities in between lie
in a few cells, and only these are split in the next pass, until every cell that a cut can meet is one group.

A group larger than an even share of what is left stands before all others and takes a shard of its own, since with it as
capacity the rest would fill few shards; the capacity of the other shards is searched without it.

DataFrame functions alone: no Python code runs in a task.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window, functions as F

from backflow.llm.common import partitions_for, stored

PLACE_BITS = 60
CELLS = 1 << 15
ROW_BYTES = 16
ROWS_A_TASK = 1_000_000


@dataclass(frozen=True)
class Plan:
    """Where shards begin. ``alone``: places of the groups with shards 0, 1, .. of their own; ``cuts``: first places of the shards after the next one."""

    shards: int
    capacity: int
    alone: tuple[int, ...] = ()
    cuts: tuple[int, ...] = ()

    def shard(self, place: Column) -> Column:
        later = sum([(place >= F.lit(c)).cast("int") for c in self.cuts], F.lit(len(self.alone)))
        own = F.lit(None).cast("int")
        for k, p in enumerate(self.alone):
            own = F.when(place == F.lit(p), F.lit(k)).otherwise(own)
        return F.coalesce(own, later).cast("int") if self.alone else later.cast("int")


@dataclass(frozen=True)
class Cell:
    """Groups next to each other: places of the first and the last, and their bytes."""

    first: int
    last: int
    size: int


def place(text: Column) -> Column:
    return F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, PLACE_BITS // 4), 16, 10).cast("long")


def _known(text_col: str) -> Column:
    return F.coalesce(F.col(f"`{text_col}`"), F.lit(""))


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_bytes: int = ROW_BYTES) -> DataFrame:
    """(id, size, crc, place, at) of every row; ``at`` tells equal rows apart and is only stable once stored."""
    text = _known(text_col)
    return docs.select(
        F.col(f"`{id_col}`").alias("id"), (F.octet_length(text) + F.lit(row_bytes)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("crc"), place(text).alias("place"), F.monotonically_increasing_id().alias("at"),
    )


def filled(before: list[int], cells: list[Cell], shards: int, capacity: int, anywhere: bool) -> list[int]:
    """Bytes before the end of each shard, filled greedily. ``before`` holds the bytes before each cell, and all of them at last.

    Cuts are cell borders, or with ``anywhere`` any point of a cell that holds more than one group.
    """
    ends, at = [], 0
    for _ in range(shards):
        k = bisect_right(before, at + capacity) - 1
        inside = anywhere and k < len(cells) and cells[k].first < cells[k].last
        at = min(at + capacity, before[-1]) if inside else before[k]
        ends.append(at)
    return ends


def smallest(before: list[int], cells: list[Cell], shards: int, anywhere: bool) -> int:
    """The smallest capacity that greedy filling can do with, found by halving."""
    low, high = -(-before[-1] // shards), before[-1]
    while low < high:
        middle = (low + high) // 2
        if filled(before, cells, shards, middle, anywhere)[-1] == before[-1]:
            high = middle
        else:
            low = middle + 1
    return low


def _cells(rows: DataFrame, shift: int) -> list[Cell]:
    """The bytes of each stretch of ``2 ** shift`` places that holds a group."""
    found = rows.groupBy(F.shiftright("place", shift).alias("cell")).agg(F.min("place").alias("first"), F.max("place").alias("last"), F.sum("size").alias("size"))
    return sorted((Cell(r["first"], r["last"], r["size"]) for r in found.collect()), key=lambda c: c.first)


def _stretches(hit: list[int]) -> list[tuple[int, int]]:
    """Runs of consecutive numbers as (first, last)."""
    out: list[tuple[int, int]] = []
    for k in hit:
        if out and out[-1][1] == k - 1:
            out[-1] = (out[-1][0], k)
        else:
            out.append((k, k))
    return out


def contiguous_cuts(rows: DataFrame, shards: int, cells: int = CELLS) -> tuple[int, tuple[int, ...]]:
    """(smallest capacity, first place of each shard after the first) for the groups of ``rows``."""
    width = cells.bit_length() - 1
    shift = PLACE_BITS - width
    held = _cells(rows, shift)
    if not held:
        return 0, ()
    while True:
        before = [0, *accumulate(c.size for c in held)]
        least, enough = smallest(before, held, shards, True), smallest(before, held, shards, False)
        hit: set[int] = set()
        for early, late in zip(filled(before, held, shards, least, False), filled(before, held, shards, enough, True)):
            hit.update(range(max(bisect_right(before, early) - 1, 0), min(bisect_left(before, late), len(held))))
        if all(held[k].first == held[k].last for k in hit):
            ends = filled(before, held, shards, enough, False)
            return enough, tuple(held[bisect_left(before, e)].first for e in ends if e < before[-1])
        # All cells that a cut can lie in are split anew: one stretch for each shard at most.
        shift = max(shift - max((cells // len(hit)).bit_length() - 1, 1), 0)
        inner = F.lit(False)
        for a, b in _stretches(sorted(hit)):
            inner = inner | F.col("place").between(held[a].first, held[b].last)
        held = sorted([c for k, c in enumerate(held) if k not in hit] + _cells(rows.where(inner), shift), key=lambda c: c.first)


def minimax_plan(rows: DataFrame, shards: int = 40, cells: int = CELLS) -> Plan:
    """The partition of the groups of ``rows`` (see :func:`sized`) that makes the largest shard as small as can be."""
    left = rows.agg(F.sum("size")).first()[0] or 0
    largest = rows.groupBy("place").agg(F.sum("size").alias("size")).orderBy(F.desc("size"), "place").limit(shards).collect()
    alone: list[int] = []
    top = 0
    for row in largest:
        if row["size"] * (shards - len(alone)) <= left:
            break
        alone.append(row["place"])
        left, top = left - row["size"], max(top, row["size"])
    others = rows.where(~F.col("place").isin(alone)) if alone else rows
    capacity, cuts = contiguous_cuts(others, shards - len(alone), cells)
    return Plan(shards, max(capacity, top), tuple(alone), cuts)


def shard_slots(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", row_bytes: int = ROW_BYTES, cells: int = CELLS) -> DataFrame:
    """Shard and place in it of every row: (id, size, text_crc32, shard, slot).

    A row counts the UTF-8 bytes of its text and ``row_bytes``. Equal texts share a shard; a null text counts as an empty
    one. Slots of a shard go from 0 without gaps, by the order of the groups, then by id (null first). Repeated rows stay, each with a slot
    of its own. Other columns are not read. An empty table gives an empty result; with fewer groups than shards, some
    shards stay empty.

    Rows are numbered by a range sort on (shard, group, id, row), so that a group or an id with a third of all rows is spread over tasks;
    what tells where the numbers of each task begin has a row for each task and shard in it.
    """
    rows = stored(sized(docs, id_col, text_col, row_bytes))
    plan = minimax_plan(rows, shards, cells)
    order = ["shard", "place", "id", "at"]
    parts = partitions_for(rows.count(), ROWS_A_TASK, docs.sparkSession)
    placed = rows.withColumn("shard", plan.shard(F.col("place"))).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    numbered = stored(placed.select("id", "size", "crc", "shard", F.monotonically_increasing_id().alias("row"))).withColumn("task", F.shiftright("row", 33))
    earlier = Window.partitionBy("shard").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    begins = numbered.groupBy("shard", "task").agg(F.count("*").alias("n"), F.min("row").alias("first"))
    begins = begins.select(F.col("shard").alias("s"), F.col("task").alias("t"), (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("shift"))
    # One row for each task and each shard in it: bounded by the number of tasks.
    joined = numbered.join(F.broadcast(begins), (F.col("shard") == F.col("s")) & (F.col("task") == F.col("t")))
    return joined.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("row") + F.col("shift")).alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = 40, text_col: str = "text", row_bytes: int = ROW_BYTES) -> Plan:
    """All rows and columns of ``docs`` as Parquet in folders ``shard=0``, ``shard=1``, .. of ``path``; the plan that was used.

    A column of ``docs`` named like the shard column is refused.
    """
    if "shard" in {c.lower() for c in docs.columns}:
        raise ValueError("a column named shard is in the way")
    plan = minimax_plan(stored(sized(docs.select(F.lit(None).cast("long").alias("_none"), F.col(f"`{text_col}`").alias("text")), "_none", "text", row_bytes)), shards)
    where = place(_known(text_col))
    # Rows of a shard are spread over tasks by a sort on place and id of the row, which also splits a hot group.
    spread = docs.withColumn("shard", plan.shard(where)).withColumn("_at", F.monotonically_increasing_id())
    spread.repartitionByRange("shard", "_at").drop("_at").write.partitionBy("shard").parquet(path)
    return plan


def oracle(crc32: str, shards: int = 40) -> str:
    """The SQL of the registered query; ``crc32`` is the SQL of a checksum of a hexadecimal string named ``hexed``."""
    return f"""WITH RECURSIVE sized AS (SELECT doc_id, strlen(coalesce(text, '')) + 16 AS size, hex(encode(coalesce(text, ''))) AS hexed, CAST('0x' || substr(sha256(coalesce(text, '')), 1, 15) AS BIGINT) AS place FROM documents),
 units AS (SELECT place, CAST(sum(size) AS BIGINT) AS size FROM sized GROUP BY place),
 ranked AS (SELECT *, row_number() OVER (ORDER BY size DESC, place) - 1 AS k, CAST(coalesce(sum(size) OVER (ORDER BY size DESC, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS larger, CAST(sum(size) OVER () AS BIGINT) AS total FROM units),
 tested AS (SELECT *, bool_and(size * ({shards} - k) > total - larger) OVER (ORDER BY k) AS alone FROM ranked),
 light AS (SELECT place, CAST(sum(size) OVER (ORDER BY place) - size AS BIGINT) AS before, CAST(sum(size) OVER (ORDER BY place) AS BIGINT) AS upto FROM tested WHERE NOT alone),
 known AS (SELECT list(upto ORDER BY upto) || [0] AS ends, max(upto) AS all_bytes, (SELECT count(*) FROM tested WHERE alone) AS n_alone FROM light),
 search(low, high) AS (SELECT CAST(ceil(all_bytes / ({shards} - n_alone)) AS BIGINT), all_bytes FROM known
  UNION ALL SELECT CASE WHEN fits THEN low ELSE middle + 1 END, CASE WHEN fits THEN middle ELSE high END
  FROM (SELECT low, high, middle, all_bytes = list_reduce(range({shards} - n_alone), lambda spot, k: list_max(list_filter(ends, lambda e: e <= spot + middle)), CAST(0 AS BIGINT)) AS fits
   FROM (SELECT low, high, (low + high) // 2 AS middle, k.* FROM search, known k WHERE low < high))),
 cuts(k, spot) AS (SELECT CAST(0 AS BIGINT), CAST(0 AS BIGINT) UNION ALL SELECT k + 1, list_max(list_filter(ends, lambda e: e <= spot + capacity)) FROM cuts, known, (SELECT min(high) AS capacity FROM search) WHERE k + 1 < {shards} - n_alone),
 shards AS (SELECT place, k AS shard FROM tested WHERE alone UNION ALL SELECT place, (SELECT n_alone FROM known) + (SELECT count(*) FROM cuts WHERE cuts.k > 0 AND cuts.spot <= light.before) FROM light)
 SELECT doc_id, size, {crc32} AS text_crc32, 'bytes' AS law, CAST(shard AS INTEGER) AS shard, row_number() OVER (PARTITION BY shard ORDER BY place, doc_id NULLS FIRST) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
 FROM sized JOIN shards USING (place)"""
