"""Near-duplicate vectors by a pivot-permutation index.

A vector is described by its nearest reference points (pivots) in order. Inverted lists hold, for each label and pivot, the
vectors that have the pivot among their nearest. Two vectors of a list that share enough pivots are candidates, in the
list of the first pivot (by number) that they share, so each pair is looked at once; their cosine is then worked out
in double precision.

Vectors with equal label and values form a class, so copies, however many, are indexed as one row with a count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from backflow.llm.common import grouped_rows, stored
from backflow.llm.graph import components
from backflow.llm.neardup import Union

#: Pivots are this many vectors, far apart from one another, out of a sample of SAMPLE, the first by a hash of their values.
PIVOTS = 256
SAMPLE = 4_096
#: Nearest pivots that describe a vector, and how many two vectors must share.
NEAREST = 10
SHARED = 4
BLOCK = 2_000


def classes_of(vectors: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """(id, label, key, value): the usable rows; key names the values, value holds them as little-endian doubles."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = []
            for vector, label in zip(batch.column(2).to_pylist(), batch.column(1).to_pylist()):
                usable = label is not None and vector and all(x is not None for x in vector)
                values = np.array(vector, dtype="<f8") + 0.0 if usable else np.zeros(0)
                blobs.append(values.tobytes() if len(values) and np.isfinite(values).all() and values.any() else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(blobs, pa.binary())], names=["id", "label", "value"])

    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema}
    return vectors.select(id_col, label_col, vec_col).mapInArrow(judge, f"id {kinds[id_col]}, label {kinds[label_col]}, value binary")


def unit_rows(blobs: list[bytes]) -> np.ndarray:
    """Rows of equal length, each scaled to length 1 (by its largest value first, so that nothing overflows)."""
    rows = np.array([np.frombuffer(b, dtype="<f8") for b in blobs])
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def spread_out(rows: np.ndarray, count: int) -> np.ndarray:
    """``count`` of the rows, each the farthest from those before it, so that a crowd of like vectors gives few."""
    picked, nearest = [0], rows @ rows[0]
    while len(picked) < min(count, len(rows)):
        picked.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, rows @ rows[picked[-1]])
    return rows[picked]


def nearest_pivots(rows: np.ndarray, pivots: np.ndarray, count: int) -> np.ndarray:
    """Numbers of the ``count`` nearest pivots of each row by cosine, nearest first, ties by number."""
    return np.argsort(-(rows @ pivots.T), axis=1, kind="stable")[:, :count].astype(np.int32)


def list_links(mine: int, sides: np.ndarray, rows: np.ndarray, held: np.ndarray, shared: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of the linked pairs of one list block, i < j.

    ``held``: for each row 0/1 per pivot. ``sides``: block of each row; with two blocks, only pairs across them count.
    """
    found_i, found_j = [], []
    below = held[:, :mine].astype(np.float32)
    held = held.astype(np.float32)
    both_sides = len(np.unique(sides)) > 1  # across two blocks
    for at in range(0, len(rows), 512):
        part = slice(at, min(at + 512, len(rows)))
        # Enough shared pivots, and none of a smaller number than this list's.
        pick = (held[part] @ held.T >= shared) & (below[part] @ below.T == 0)
        pick &= np.arange(len(rows))[None, :] > np.arange(part.start, part.stop)[:, None]
        if both_sides:
            pick &= sides[part][:, None] != sides[None, :]
        i, j = np.nonzero(pick)
        if not len(i):
            continue
        i += at
        cosines = np.empty(len(i))
        for k in range(0, len(i), 100_000):
            cosines[k : k + 100_000] = np.einsum("ij,ij->i", rows[i[k : k + 100_000]], rows[j[k : k + 100_000]])
        near = cosines >= least
        found_i.append(i[near])
        found_j.append(j[near])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *found_i]), np.concatenate([none, *found_j])


def near_vectors(
    vectors: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", n_pivots: int = PIVOTS, nearest: int = NEAREST, shared: int = SHARED
) -> DataFrame:
    """(id, n_links, component_id, kept) of every row.

    Rows with equal labels are linked if the index finds them and their cosine is at least ``threshold``, never below it.
    component_id is the smallest id that links lead to, itself included; kept marks the row whose id that is.

    The pivots are chosen from a sample of SAMPLE vectors; every row is indexed. Rows whose label is null, or whose vector is null, empty,
    zero or holds null or non-finite values, link with nothing, as do vectors of different lengths with one another. A null id gets a null component, unless its copies have
    an id, and is kept only without one. Rows that share an id are one vector; the rows of a class without an id count as one.
    Other columns are not read. An empty table gives an empty result. Ids must be whole numbers.
    """
    kind = vectors.schema[id_col].dataType.simpleString()
    label_kind = vectors.schema[label_col].dataType.simpleString()
    named = F.sha2(F.concat(F.col("value"), F.lit("/").cast("binary"), F.col("label").cast("string").cast("binary")), 256)
    rows = stored(classes_of(vectors.withColumn(id_col, F.col(id_col).cast("long")), id_col, vec_col, label_col).withColumn("key", F.when(F.col("value").isNotNull(), named)))
    usable = rows.filter("key is not null")
    firsts = usable.groupBy("key", "id").agg(F.lit(1)).groupBy("key").agg(F.min("id").alias("id"), F.count("*").alias("copies")).filter("id is not null")
    values = usable.select("key", "id", "label", "value").dropDuplicates(["key", "id"])
    classes = stored(values.join(firsts, ["key", "id"]).select("key", F.col("id").alias("rep"), "label", "value", "copies", F.length("value").alias("width")))
    # Pivots by length of vector, from at most SAMPLE rows in all.
    sample: dict[int, list[bytes]] = {}
    for row in classes.select("width", "value", "key").orderBy(F.xxhash64("key"), "key").limit(SAMPLE).toLocalIterator():
        sample.setdefault(row.width, []).append(bytes(row.value))
    pivots = vectors.sparkSession.sparkContext.broadcast({width: spread_out(unit_rows(found), n_pivots) for width, found in sample.items()})

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths = np.array(batch.column(4).to_pylist())
            for width in np.unique(widths).tolist():
                part = batch.take(pa.array(np.flatnonzero(widths == width)))
                blobs, points = part.column(3).to_pylist(), pivots.value.get(width)
                # A length that the sample lacks has one list for all of it.
                near = np.zeros((len(part), 1), np.int32) if points is None else nearest_pivots(unit_rows(blobs), points, nearest)
                each = pa.array(np.repeat(np.arange(len(part)), near.shape[1]))
                lists = pa.array([x.tobytes() for x in near], pa.binary())
                columns = [part.column(k).take(each) for k in range(5)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(near.ravel(), pa.int32()), lists.take(each)], names=["rep", "label", "copies", "value", "width", "pivot", "near"])

    schema = f"rep long, label {label_kind}, copies long, value binary, width int, pivot int, near binary"
    postings = classes.select("rep", "label", "copies", "value", "width").mapInArrow(describe, schema)
    # Lists over the block size meet in pairs of blocks.
    by = ["label", "pivot", "width"]
    sized = postings.join(postings.groupBy(*by).agg(F.count("*").alias("n")), by)
    blocked = sized.withColumn("blocks", F.ceil(F.col("n") / BLOCK)).withColumn("block", F.pmod(F.xxhash64(F.lit(3), "rep"), F.col("blocks")))
    paired = blocked.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    units = paired.select(F.xxhash64(*by, low, high).alias("unit"), (low < high).alias("across"), "pivot", "rep", "block", "near", "value", "copies")

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for _, group in grouped_rows(batches, "unit"):
            n = len(group["rep"])
            if n < 2 or group["across"][0] and len(set(group["block"])) < 2:
                continue
            near = [np.frombuffer(x, dtype=np.int32) for x in group["near"]]
            held = np.zeros((n, 1 + max(int(x.max()) for x in near)), dtype=bool)
            for k, x in enumerate(near):
                held[k, x] = True
            i, j = list_links(group["pivot"][0], np.array(group["block"]), unit_rows(group["value"]), held, min(shared, len(near[0])), threshold)
            copies, union = np.array(group["copies"]), Union(n)
            links = np.bincount(i, copies[j], minlength=n) + np.bincount(j, copies[i], minlength=n)
            # A row per pair would grow with the square of a group: links are summed per vector, and a forest tells what is joined.
            out += [(group["rep"][k], None, int(links[k])) for k in np.flatnonzero(links)]
            out += [(group["rep"][a], group["rep"][b], 0) for a, b in zip(i.tolist(), j.tolist()) if union.join(a, b)]
            if len(out) > 20_000:
                yield as_batch(out)
                out = []
        yield as_batch(out)

    def as_batch(out: list[tuple]) -> pa.RecordBatch:
        columns = zip(*out) if out else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["a", "b", "links"])

    found = stored(units.repartition("unit").sortWithinPartitions("unit", "rep").mapInArrow(match, "a long, b long, links long"))
    joined = components(found.filter("b is not null"))
    links = found.filter("b is null").groupBy("a").agg(F.sum("links").alias("links"))
    of_class = (
        classes.select("key", "rep", "copies").join(links, F.col("rep") == links.a, "left").join(joined, F.col("rep") == joined.id, "left")
        .select("key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id"))
    )
    out = rows.select("id", "key").join(of_class, "key", "left")
    component = F.coalesce("component_id", "id")
    return out.select(
        F.col("id").cast(kind).alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.cast(kind).alias("component_id"),
        F.coalesce(F.col("id") == component, component.isNull()).alias("kept"),
    )
