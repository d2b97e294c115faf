"""The prefix trie of conversations, with subtree figures by the Euler-tour technique.

A node is a distinct sequence of first turns. It is named by the smallest conversation that starts with it and its depth.
Its turns are compared by a polynomial of their digests modulo 2 ** 127 - 1, which can be carried on from one part of a conversation to the next.

Each node gives two arcs: one that enters it and one that leaves it. The arc into a node leads to the arc into its first child,
or else out of the node; the arc out of it leads into its next sibling, or else out of its parent. So the arcs are one list.
Ranking it gives each arc its number and, with weights on the arcs into nodes, the sums up to it; a subtree's sum is the
difference between the arc out of its top and the arc into it.

The list is ranked in three steps. Nodes are sorted by name, where the tour mostly goes from a row to one nearby, and every task joins the arcs it holds into
stretches. Stretches are then joined two by two, by a coin thrown for each, until few enough are left to be walked in one task; going back, each
stretch that was joined to another gets its sums from it.

All sorts are range sorts by keys that differ between any two rows, so a conversation, a node or a parent with a third of all rows
is spread over tasks; the driver gets one row for each task, to carry a sum or a neighbour over the border between two.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from backflow.llm.common import checkpoint, grouped_rows, partitions_for, stored

PRIME = (1 << 127) - 1
#: The point at which the polynomial is taken, and the number of ids joined into one row.
BASE = 0x2545F4914F6CDD1D9E3779B97F4A7C15
IDS_A_ROW = 8192
ROWS_A_TASK = 500_000
WALKED = 500_000
NO_IDS = hashlib.sha256(b"").hexdigest()
ROOT = bytes(16)


def _sorted(df: DataFrame, order: list, rows: int) -> DataFrame:
    """``df`` range-sorted and kept so, with the number of its task; rows next to each other stay so across passes."""
    parts = partitions_for(rows, ROWS_A_TASK, df.sparkSession)
    return checkpoint(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("task", F.spark_partition_id()))


# --- turns and prefixes -----------------------------------------------------------------


def numbered_turns(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, pos, size, digest, n_bytes): each turn, its number from 1 in its conversation and how many turns that has.

    Turns are ordered by ``turn`` (null first), then by role and text. Null role and text count as empty. Rows without a
    conversation belong to none and are left out.
    """
    known = lambda c: F.coalesce(F.col(f"`{c}`"), F.lit(""))
    rows = conversations.where(F.col(f"`{conv}`").isNotNull()).select(F.col(f"`{conv}`").cast("long").alias("conv"), F.col(f"`{turn}`").alias("turn"), known(role).alias("role"), known(text).alias("text"))
    rows = stored(rows.withColumn("at", F.monotonically_increasing_id()))
    order = ["conv", "turn", "role", "text", "at"]
    parts = partitions_for(rows.count(), ROWS_A_TASK, rows.sparkSession)
    # The length of the role parts it from the text.
    whole = F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")
    digest = F.unhex(F.substring(F.sha2(whole, 256), 1, 32))
    ordered = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    turns = stored(ordered.select("conv", digest.alias("digest"), F.octet_length("text").cast("long").alias("n_bytes"), F.monotonically_increasing_id().alias("row")))
    turns = turns.withColumn("task", F.shiftright("row", 33))
    begins = turns.groupBy("conv", "task").agg(F.count("*").alias("n"), F.min("row").alias("first"))
    whole_conv = Window.partitionBy("conv")
    earlier = whole_conv.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    begins = begins.select("conv", "task", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"), F.sum("n").over(whole_conv).alias("size"))
    return turns.join(begins, ["conv", "task"]).select("conv", (F.col("row") - F.col("first") + F.col("before") + 1).alias("pos"), "size", "digest", "n_bytes")


def with_shared_heads(turns: DataFrame, family: int = 5, most: int = 8) -> DataFrame:
    """Conversations rebuilt so that those of one family begin alike: (conv, pos, size, digest, n_bytes), and a row with pos 0 for each conversation.

    Conversation c, with h the CRC-32 of its decimal id modulo ``most + 1``, gets the first h turns of conversation c - c % family
    (all if it has fewer, none if there is none), then its own turns after the first h.
    """
    turns = checkpoint(turns)
    convs = turns.where("pos = 1").select("conv", "size", (F.crc32(F.col("conv").cast("string").cast("binary")) % (most + 1)).alias("h"), (F.col("conv") - F.col("conv") % family).alias("base"))
    lent = convs.select(F.col("conv").alias("base"), F.col("size").alias("base_size"))
    convs = convs.join(lent, "base", "left").withColumn("k", F.least("h", F.coalesce("base_size", F.lit(0))))
    convs = checkpoint(convs.select("conv", "base", "h", "k", (F.col("k") + F.greatest(F.col("size") - F.col("h"), F.lit(0))).alias("new_size")))
    # The hash of the id tells how many turns to leave out; only conversations whose base is short need to look theirs up.
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % (most + 1)
    late = turns.where(F.col("pos") > h)
    moved = convs.select("conv", (F.col("k") - F.col("h")).alias("move"), "new_size")
    own = late.join(moved, "conv").select("conv", (F.col("pos") + F.col("move")).alias("pos"), F.col("new_size").alias("size"), "digest", "n_bytes")
    first = turns.where(F.col("pos") <= most).select(F.col("conv").alias("base"), "pos", "digest", "n_bytes")
    heads = convs.where("k > 0").select("conv", "base", "k", F.col("new_size").alias("size")).join(first, "base").where("pos <= k").select("conv", "pos", "size", "digest", "n_bytes")
    empty = convs.select("conv", F.lit(0).cast("long").alias("pos"), F.col("new_size").alias("size"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("n_bytes"))
    return own.unionByName(heads).unionByName(empty)


def with_roots(turns: DataFrame) -> DataFrame:
    """``turns`` as they are, and a row with pos 0 for each conversation."""
    turns = checkpoint(turns)
    return turns.unionByName(turns.where("pos = 1").select("conv", F.lit(0).cast("long").alias("pos"), "size", F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("n_bytes")))


def _value(digest: bytes | None) -> int:
    return int.from_bytes(digest, "big") if digest else 0


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for a task: its first and last conversation, and polynomial and length of its part of the last one."""
    first = last = task = None
    total = length = 0
    for batch in batches:
        for conv, digest, t in zip(*(batch.column(c).to_pylist() for c in ("conv", "digest", "task"))):
            if first is None:
                first, task = conv, t
            if conv != last:
                last, total, length = conv, 0, 0
            total, length = (total * BASE + _value(digest)) % PRIME, length + 1
    if first is not None:
        yield pa.RecordBatch.from_pydict({"task": pa.array([task], pa.int32()), "first": [first], "last": [last], "total": [str(total)], "length": [length]})


def prefixes(rebuilt: DataFrame) -> DataFrame:
    """(conv, depth, node, parent, n_bytes, ends): the key of each prefix and of the one before it; ``ends`` marks the whole conversation."""
    rows = _sorted(rebuilt, ["conv", "pos"], rebuilt.count())
    parts = rows.select("conv", "digest", "task").mapInArrow(_parts, "task int, first long, last long, total string, length long").collect()
    carried: dict[int, int] = {}
    last, total = None, 0
    for part in sorted(parts, key=lambda p: p["task"]):
        own = int(part["total"])
        if part["first"] == last:
            carried[part["task"]] = total
            if part["last"] == last:
                own = (total * pow(BASE, part["length"], PRIME) + own) % PRIME
        last, total = part["last"], own

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, total, started = None, 0, False
        for batch in batches:
            node, parent = [], []
            for conv, digest, task in zip(*(batch.column(c).to_pylist() for c in ("conv", "digest", "task"))):
                if conv != last:
                    total = 0 if started else carried.get(task, 0)
                    last, started = conv, True
                parent.append(total.to_bytes(16, "big"))
                total = (total * BASE + _value(digest)) % PRIME
                node.append(total.to_bytes(16, "big"))
            depth, size = batch.column("pos"), batch.column("size")
            ends = np.asarray(depth) == np.asarray(size)
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv"), depth, pa.array(node, pa.binary()), pa.array(parent, pa.binary()), batch.column("n_bytes"), pa.array(ends)],
                names=["conv", "depth", "node", "parent", "n_bytes", "ends"],
            )

    return rows.select("conv", "pos", "size", "digest", "n_bytes", "task").mapInArrow(keys, "conv long, depth long, node binary, parent binary, n_bytes long, ends boolean")


# --- nodes --------------------------------------------------------------------------------


def _joined_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by node and conversation: up to ``IDS_A_ROW`` decimal ids of one node in a row."""
    out: list[tuple[int, bytes, int, str]] = []
    now, first, ids = None, 0, []
    for batch in batches:
        for depth, node, conv in zip(*(c.to_pylist() for c in batch.columns)):
            if (depth, node) != now or len(ids) == IDS_A_ROW:
                if ids:
                    out.append((*now, first, ",".join(ids)))
                now, first, ids = (depth, node), conv, []
            ids.append(str(conv))
        if len(out) > 1000:
            yield _id_rows(out)
            out = []
    if ids:
        out.append((*now, first, ",".join(ids)))
    yield _id_rows(out)


def _id_rows(out: list[tuple[int, bytes, int, str]]) -> pa.RecordBatch:
    columns = list(zip(*out)) or [[], [], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.int64(), pa.string()))], names=["depth", "node", "first", "ids"])


def _ids_hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by node and first id: the digest of each node's ids, one row held at a time."""
    now, state, out = None, None, []

    def done() -> None:
        if now is not None:
            out.append((*now, state.hexdigest()))

    for batch in batches:
        for depth, node, _, ids in zip(*(c.to_pylist() for c in batch.columns)):
            if (depth, node) != now:
                done()
                now, state = (depth, node), hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
    done()
    columns = list(zip(*out)) or [[], [], []]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.string()))], names=["depth", "node", "ends_sha256"])


def end_digests(rows: DataFrame) -> DataFrame:
    """(depth, node, ends_sha256) of the nodes where conversations end: SHA-256 of their decimal ids, ascending, comma-joined."""
    ended = rows.where("ends").select("depth", "node", "conv")
    parts = partitions_for(ended.count(), ROWS_A_TASK, rows.sparkSession)
    order = ["depth", "node", "conv"]
    joined = ended.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_joined_ids, "depth long, node binary, first long, ids string")
    return joined.repartition("depth", "node").sortWithinPartitions("depth", "node", "first").mapInArrow(_ids_hashed, "depth long, node binary, ends_sha256 string")


def _next_siblings(nodes: DataFrame, rows: int) -> DataFrame:
    """``nodes`` with the name of the next child of the same parent."""
    held, columns = _sorted(nodes, ["depth", "parent", "conv"], rows), nodes.columns
    firsts = held.groupBy("task").agg(F.min(F.struct("depth", "parent", "conv")).alias("f")).collect()
    follows, after = {}, None
    for r in sorted(firsts, key=lambda r: -r["task"]):
        follows[r["task"]], after = after, (r["f"]["depth"], bytes(r["f"]["parent"]), r["f"]["conv"])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = None
        for batch in batches:
            if not len(batch):
                continue
            if waiting is not None:
                yield answered(waiting, (batch.column("depth")[0].as_py(), batch.column("parent")[0].as_py(), batch.column("conv")[0].as_py()))
            waiting = batch
        if waiting is not None:
            yield answered(waiting, follows[waiting.column("task")[0].as_py()])

    def answered(batch: pa.RecordBatch, after: tuple | None) -> pa.RecordBatch:
        keys = list(zip(*(batch.column(c).to_pylist() for c in ("depth", "parent", "conv"))))
        later = [*keys[1:], after]
        names = [n[2] if n is not None and k[:2] == n[:2] else None for k, n in zip(keys, later)]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(names, pa.int64())], names=[*columns, "sibling"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in nodes.schema)
    return held.mapInArrow(look, f"{kinds}, sibling long")


def trie_nodes(rows: DataFrame) -> DataFrame:
    """One row for each node, from :func:`prefixes`, with the names of its parent, first child and next sibling."""
    rows = checkpoint(rows)
    nodes = rows.groupBy("depth", "node").agg(F.min("conv").alias("conv"), F.count("*").alias("n_convs"), F.max("n_bytes").alias("n_bytes"), F.max("parent").alias("parent"))
    nodes = checkpoint(nodes)
    kids = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("node")).agg(F.count("*").alias("n_children"), F.min("conv").alias("child"))
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("node").alias("parent"), F.col("conv").alias("parent_conv"))
    full = nodes.join(kids, ["depth", "node"], "left").join(end_digests(rows), ["depth", "node"], "left").join(above, ["depth", "parent"], "left")
    full = full.select("conv", "depth", "parent", "parent_conv", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "child", "n_bytes", F.coalesce("ends_sha256", F.lit(NO_IDS)).alias("ends_sha256"))
    return _next_siblings(full, nodes.count())


# --- the tour -----------------------------------------------------------------------------


SUMS = ["place", "leaves", "saved"]
_STRETCH = "conv long, step long, next_conv long, next_step long, place long, leaves long, saved long"


def _jumped(before: np.ndarray, ahead: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first arc of each arc's stretch, sums of the arcs before it in the stretch), by pointer jumping. ``before``: weights; ``ahead``: the arc after each, or -1."""
    n = len(ahead)
    back, sums = np.arange(n), np.zeros_like(before)
    linked = np.flatnonzero(ahead >= 0)
    back[ahead[linked]], sums[ahead[linked]] = linked, before[linked]
    while True:
        further = back[back]
        if np.array_equal(further, back):
            return back, sums
        sums += sums[back]
        back = further


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The arcs of a task's nodes, joined as far as they follow each other there.

    A row for each node, with the first arc of the stretches that its two arcs are in and the sums from there; and, with
    ``of_node`` false, a row for each stretch.
    """
    batches = [b for b in batches if len(b)]
    if not batches:
        return
    table = pa.Table.from_batches(batches)
    column = lambda c: table.column(c).to_numpy()
    conv, depth, n_convs, children, n_bytes = (column(c).astype(np.int64) for c in ("conv", "depth", "n_convs", "n_children", "n_bytes"))
    names = {c: (table.column(c).fill_null(0).to_numpy().astype(np.int64), table.column(c).is_valid().to_numpy()) for c in ("child", "sibling", "parent_conv")}
    n = len(conv)
    ids, number = np.unique(conv, return_inverse=True)
    deepest = int(depth.max()) + 1
    keys = number * (deepest + 1) + depth

    def row_of(c: np.ndarray, d: np.ndarray, there: np.ndarray) -> np.ndarray:
        """Row of node (c, d) in this task, or -1."""
        k = np.minimum(np.searchsorted(ids, c), len(ids) - 1)
        key = k * (deepest + 1) + d
        at = np.minimum(np.searchsorted(keys, key), n - 1)
        return np.where(there & (ids[k] == c) & (d >= 0) & (d < deepest) & (keys[at] == key), at, -1)

    (child, has_child), (sibling, has_sibling), (parent, has_parent) = names["child"], names["sibling"], names["parent_conv"]
    # Arc 2 i enters node i, arc 2 i + 1 leaves it. A step is twice the depth, and one more to leave.
    next_conv, next_step, known = np.zeros(2 * n, np.int64), np.zeros(2 * n, np.int64), np.ones(2 * n, bool)
    next_conv[::2], next_step[::2] = np.where(has_child, child, conv), np.where(has_child, 2 * depth + 2, 2 * depth + 1)
    next_conv[1::2], next_step[1::2] = np.where(has_sibling, sibling, parent), np.where(has_sibling, 2 * depth, 2 * depth - 1)
    known[1::2] = has_sibling | has_parent
    ahead = row_of(next_conv, next_step >> 1, known)
    ahead = np.where(ahead >= 0, 2 * ahead + (next_step & 1), -1)
    weights = np.zeros((2 * n, 3), dtype=np.int64)
    weights[:, 0] = 1
    weights[::2, 1], weights[::2, 2] = children == 0, (n_convs - 1) * n_bytes
    head, sums = _jumped(weights, ahead)
    arc_conv, arc_step = np.repeat(conv, 2), np.repeat(2 * depth, 2)
    arc_step[1::2] += 1
    tails = np.flatnonzero(ahead < 0)
    nothing = lambda rows, kind: pa.nulls(rows, kind)
    columns = {"of_node": pa.array(np.ones(n, bool))}
    columns |= {c: table.column(c).combine_chunks() for c in ("conv", "depth", "parent_conv", "n_convs", "n_children", "ends_sha256")}
    for side, at in (("in", slice(0, None, 2)), ("out", slice(1, None, 2))):
        columns |= {f"{side}_conv": arc_conv[head[at]], f"{side}_step": arc_step[head[at]]}
        columns |= {f"{side}_{s}": sums[at, k] for k, s in enumerate(SUMS)}
    columns |= {c: nothing(n, pa.int64()) for c in ("step", "next_conv", "next_step", *SUMS)}
    yield pa.RecordBatch.from_pydict({c: v if isinstance(v, (pa.Array, pa.ChunkedArray)) else pa.array(v) for c, v in columns.items()})
    m, start = len(tails), head[tails]
    row = {c: nothing(m, v.type if isinstance(v, pa.Array) else pa.int64()) for c, v in columns.items()}
    row |= {"of_node": pa.array(np.zeros(m, bool)), "conv": pa.array(arc_conv[start]), "step": pa.array(arc_step[start])}
    row |= {"next_conv": pa.array(next_conv[tails], mask=~known[tails]), "next_step": pa.array(next_step[tails], mask=~known[tails])}
    row |= {s: pa.array(sums[tails, k] + weights[tails, k]) for k, s in enumerate(SUMS)}
    yield pa.RecordBatch.from_pydict(row)


_LOCAL = (
    "of_node boolean, conv long, depth long, parent_conv long, n_convs long, n_children long, ends_sha256 string, in_conv long, in_step long, in_place long, in_leaves long, in_saved long, "
    "out_conv long, out_step long, out_place long, out_leaves long, out_saved long, step long, next_conv long, next_step long, place long, leaves long, saved long"
)


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums before each stretch of a whole list."""
    table = pa.Table.from_batches([b for b in batches if len(b)], schema=None) if (batches := [b for b in batches if len(b)]) else None
    if table is None:
        return
    keys = list(zip(table.column("conv").to_pylist(), table.column("step").to_pylist()))
    row = {k: i for i, k in enumerate(keys)}
    ahead = np.array([row.get(k, -1) for k in zip(table.column("next_conv").to_pylist(), table.column("next_step").to_pylist())])
    _, sums = _jumped(np.stack([table.column(s).to_numpy() for s in SUMS], axis=1), ahead)
    yield pa.RecordBatch.from_arrays([table.column("conv").combine_chunks(), table.column("step").combine_chunks(), *(pa.array(sums[:, k]) for k in range(3))], names=["conv", "step", *SUMS])


def list_ranks(stretches: DataFrame, walked: int = WALKED) -> DataFrame:
    """(conv, step, place, leaves, saved): the sums before each stretch of a list that (next_conv, next_step) links."""
    before = stretches.select(F.col("next_conv").alias("conv"), F.col("next_step").alias("step"), F.col("conv").alias("prev_conv"), F.col("step").alias("prev_step"))
    now = checkpoint(stretches.join(before.where("conv IS NOT NULL"), ["conv", "step"], "left"))
    joined: list[DataFrame] = []
    while now.count() > walked:
        coin = lambda c, s: F.xxhash64(c, s, F.lit(len(joined))).bitwiseAND(F.lit(1)) == 1
        # A stretch goes into the one before it if its own coin shows tails and that one's heads, so no two neighbours move at once.
        goes = F.col("prev_conv").isNotNull() & ~coin("conv", "step") & coin(F.col("prev_conv"), F.col("prev_step"))
        gone = now.where(goes)
        side = gone.select(
            F.col("conv").alias("next_conv"), F.col("step").alias("next_step"), F.col("next_conv").alias("over_conv"), F.col("next_step").alias("over_step"),
            F.lit(True).alias("hit"), *[F.col(s).alias(f"add_{s}") for s in SUMS],
        )
        grown = checkpoint(now.where(~goes).join(side, ["next_conv", "next_step"], "left"))
        taken = grown.where("hit")
        joined.append(taken.select(F.col("next_conv").alias("conv"), F.col("next_step").alias("step"), F.col("conv").alias("prev_conv"), F.col("step").alias("prev_step"), *SUMS))
        kept = grown.select(
            "conv", "step", "prev_conv", "prev_step",
            F.when(F.col("hit"), F.col("over_conv")).otherwise(F.col("next_conv")).alias("next_conv"), F.when(F.col("hit"), F.col("over_step")).otherwise(F.col("next_step")).alias("next_step"),
            *[(F.col(s) + F.coalesce(f"add_{s}", F.lit(0))).alias(s) for s in SUMS],
        )
        moved = gone.select(F.col("conv").alias("prev_conv"), F.col("step").alias("prev_step"), F.col("prev_conv").alias("further_conv"), F.col("prev_step").alias("further_step"))
        kept = kept.join(moved, ["prev_conv", "prev_step"], "left")
        now = checkpoint(kept.select("conv", "step", "next_conv", "next_step", *SUMS, F.coalesce("further_conv", "prev_conv").alias("prev_conv"), F.coalesce("further_step", "prev_step").alias("prev_step")))
    ranks = now.select(*[c.split()[0] for c in _STRETCH.split(", ")]).coalesce(1).mapInArrow(_walked, "conv long, step long, place long, leaves long, saved long")
    for level in reversed(joined):
        known = ranks.select(F.col("conv").alias("prev_conv"), F.col("step").alias("prev_step"), *[F.col(s).alias(f"r_{s}") for s in SUMS])
        found = level.join(known, ["prev_conv", "prev_step"]).select("conv", "step", *[(F.col(s) + F.col(f"r_{s}")).alias(s) for s in SUMS])
        ranks = checkpoint(ranks.unionByName(found))
    return ranks


def trie_figures(nodes: DataFrame, walked: int = WALKED) -> DataFrame:
    """(conv, depth, parent_conv, n_convs, n_children, n_leaves, saved, first, last, ends_sha256) of every node.

    ``first`` and ``last`` are the places in the tour of the arcs into and out of the node.
    """
    tour = _sorted(nodes.drop("parent"), ["conv", "depth"], nodes.count())
    local = stored(tour.drop("task").mapInArrow(_local, _LOCAL))
    stretches = local.where("NOT of_node").select(*[c.split()[0] for c in _STRETCH.split(", ")])
    ranks = checkpoint(list_ranks(stretches, walked))
    rows = local.where("of_node")
    for side in ("in", "out"):
        named = ranks.select(F.col("conv").alias(f"{side}_conv"), F.col("step").alias(f"{side}_step"), *[F.col(s).alias(f"{side}_from_{s}") for s in SUMS])
        rows = rows.join(named, [f"{side}_conv", f"{side}_step"])
    up_to = lambda side, s: F.col(f"{side}_from_{s}") + F.col(f"{side}_{s}")
    return rows.select(
        "conv", "depth", "parent_conv", "n_convs", "n_children", (up_to("out", "leaves") - up_to("in", "leaves")).alias("n_leaves"), (up_to("out", "saved") - up_to("in", "saved")).alias("saved"),
        up_to("in", "place").alias("first"), up_to("out", "place").alias("last"), "ends_sha256",
    )


def prefix_trie(turns: DataFrame, walked: int = WALKED) -> DataFrame:
    """The figures of all nodes of the trie of ``turns``: rows (conv, pos, size, digest, n_bytes), pos 0 for the conversation itself.

    An empty table gives an empty result; else there is a root, with all conversations, also those without turns.
    """
    return trie_figures(checkpoint(trie_nodes(prefixes(turns))), walked)


def oracle(crc32: str) -> str:
    """The SQL of the registered query; ``crc32`` is the SQL of a checksum of a hexadecimal string named ``hexed``."""
    return f"""WITH turns AS (SELECT conv_id, struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) AS v, turn FROM conversations WHERE conv_id IS NOT NULL),
 lists AS (SELECT conv_id, list(v ORDER BY turn NULLS FIRST, v.r, v.t) AS l, hex(encode(CAST(conv_id AS VARCHAR))) AS hexed FROM turns GROUP BY conv_id),
 drawn AS (SELECT conv_id, l, CAST({crc32} % 9 AS BIGINT) AS h FROM lists),
 rebuilt AS (SELECT c.conv_id, coalesce(b.l[1:c.h], []) || c.l[c.h + 1:] AS l FROM drawn c LEFT JOIN lists b ON b.conv_id = c.conv_id - c.conv_id % 5),
 nodes AS (SELECT l[1:d] AS k, d, min(conv_id) AS conv_id, count(*) AS n_convs FROM (SELECT conv_id, l, unnest(range(len(l) + 1)) AS d FROM rebuilt) GROUP BY l[1:d], d),
 kids AS (SELECT k[1:d - 1] AS k, d - 1 AS d, count(*) AS n FROM nodes WHERE d > 0 GROUP BY k[1:d - 1], d - 1),
 weighted AS (SELECT n.*, coalesce(kids.n, 0) AS n_children, CASE WHEN n.d = 0 THEN 0 ELSE (n_convs - 1) * strlen(n.k[n.d].t) END AS saved FROM nodes n LEFT JOIN kids ON kids.k = n.k AND kids.d = n.d),
 above AS (SELECT k[1:a] AS k, a AS d, count(*) FILTER (n_children = 0) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved FROM (SELECT *, unnest(range(d + 1)) AS a FROM weighted) GROUP BY k[1:a], a),
 ended AS (SELECT l AS k, len(l) AS d, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS digest FROM rebuilt GROUP BY l)
 SELECT w.conv_id, w.d AS depth, p.conv_id AS parent_conv_id, w.n_convs, n_children, n_leaves, a.saved AS saved_tokens, coalesce(digest, sha256('')) AS ends_sha256
 FROM weighted w JOIN above a ON a.k = w.k AND a.d = w.d LEFT JOIN nodes p ON w.d > 0 AND p.d = w.d - 1 AND p.k = w.k[1:w.d - 1] LEFT JOIN ended e ON e.k = w.k AND e.d = w.d"""
