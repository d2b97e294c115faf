"""Near-duplicate documents by an LSH forest of MinHash signatures, confirmed on full shingle sets.

1. Each text becomes the set of hashes of its word shingles. Texts with one set form a class, so exact copies, however many,
   go on as one row.
2. ``TREES`` orders: each tree has a signature of ``DEPTH`` minima of its own. Classes that share the first ``LEAST_DEPTH``
   minima of a tree lie in one region of its sorted order; a region with more than ``REGION`` classes is cut by
   the next minimum, and so on down to ``DEPTH``. What is still too large is compared in pairs of blocks.
3. In a region, a pair goes on if the minima of all trees put it near the limit. Each region gives a spanning forest of such pairs, never all pairs.
4. The forests' components are clusters that hold every link. The full sets of a cluster meet in one task (a large
   cluster in pairs of blocks), which counts exact overlaps and gives a spanning forest of the real links.
5. The components of the real links are the groups.

A pair at the limit of 0.75 misses all regions with a probability that is the product of 1 - 0.75**depth over the trees, with the
depth to which its region of that tree is cut: 2e-6 if none is cut beyond depth 3, 1e-4 if all are cut to depth 4, 2e-3 if all
are cut to depth 5, in between if some are, and less for nearer pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from backflow.llm.common import fewer, grouped_rows, slices, stored, texts_of
from backflow.llm.graph import components
from backflow.llm.words import WHITE, mixed, word_chunks

TREES = 24
DEPTH = 5
LEAST_DEPTH = 3
REGION = 512
BLOCK_SHINGLES = 1_000_000
# Estimated likeness from which a pair may be a link: the limit less about four standard errors of TREES * DEPTH minima.
SLACK = 0.16

_RNG = np.random.Generator(np.random.PCG64(4177))
_FACTORS = _RNG.integers(0, 1 << 31, TREES * DEPTH, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_SHIFTS = _RNG.integers(0, 1 << 32, TREES * DEPTH, dtype=np.uint32)
_PLACES = _RNG.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of ``size`` words in a row; a shorter text is one shingle, no words are none."""
    if not len(words):
        return words
    size = min(size, len(words))
    n = len(words) - size + 1
    sums = words[:n] * _PLACES[0]
    for k in range(1, size):
        sums += words[k : k + n] * _PLACES[k]
    return np.unique(mixed(sums + np.uint64(size)))


def signature(shingles: np.ndarray) -> np.ndarray:
    """TREES * DEPTH minima of a set that is not empty."""
    low = (shingles >> np.uint64(32)).astype(np.uint32)[:, None]
    least = (low[:512] * _FACTORS + _SHIFTS).min(axis=0)
    for at in range(512, len(low), 512):
        np.minimum(least, (low[at : at + 512] * _FACTORS + _SHIFTS).min(axis=0), out=least)
    return least


def _sets(texts: list[str], size: int) -> Iterator[np.ndarray]:
    for _, n, hashes, bounds in word_chunks(texts, WHITE):
        for k in range(n):
            yield shingle_set(hashes[bounds[k] : bounds[k + 1]], size)


def signed(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(id, n_shingles, set_key, sig); set_key and sig are null without words."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            counts, keys, sigs = [], [], []
            for shingles in _sets(texts_of(batch.column(1)), size):
                counts.append(len(shingles))
                if len(shingles):
                    # Two sums over the set, of differently mixed hashes, name it with 128 bits.
                    one, two = shingles.sum(dtype=np.uint64), mixed(shingles ^ _PLACES[63]).sum(dtype=np.uint64)
                    keys.append(np.array([one, two]).tobytes())
                    sigs.append(signature(shingles).tobytes())
                else:
                    keys.append(None)
                    sigs.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())], names=["id", "n_shingles", "set_key", "sig"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(sign, f"id {kind}, n_shingles long, set_key binary, sig binary")


def _prefixes(classes: DataFrame) -> DataFrame:
    """One row per class and tree: hashes of the first LEAST_DEPTH .. DEPTH minima."""
    names = [f"p{d}" for d in range(LEAST_DEPTH, DEPTH + 1)]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(batch)
            sigs = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype="<u4").reshape(n, TREES, DEPTH).astype(np.uint64)
            state = np.broadcast_to(mixed(np.arange(1, TREES + 1, dtype=np.uint64)), (n, TREES))
            columns = []
            for d in range(DEPTH):
                state = mixed(state * _PLACES[d] + sigs[:, :, d])
                if d + 1 >= LEAST_DEPTH:
                    columns.append(pa.array(state.ravel().view(np.int64)))
            reps = pa.array(np.repeat(batch.column(0).to_numpy(zero_copy_only=False), TREES), pa.int64())
            trees = pa.array(np.tile(np.arange(TREES, dtype=np.int32), n))
            yield pa.RecordBatch.from_arrays([reps, trees, *columns], names=["rep", "tree", *names])

    return classes.select("rep", "sig").mapInArrow(spread, "rep long, tree int, " + ", ".join(f"{n} long" for n in names))


def _regions(prefixes: DataFrame) -> DataFrame:
    """(rep, tree, region, n): the members of every region with at least two classes."""
    left, out = prefixes, None
    for d in range(LEAST_DEPTH, DEPTH + 1):
        key = f"p{d}"
        counts = left.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")
        counted = left.join(counts, key)
        if d == LEAST_DEPTH:
            counted = stored(counted)  # nearly all classes are alone in a tree and go here
            left = counted.drop("n")
            counts = counted.select(key, "n").distinct()
        last = d == DEPTH
        here = (counted if last else counted.filter(F.col("n") <= REGION)).select("rep", "tree", F.col(key).alias("region"), "n")
        out = here if out is None else out.union(here)
        if not last:
            # Only regions over the limit go on to the next minimum.
            left = left.join(counts.filter(F.col("n") > REGION).select(key), key)
    return out


def _blocked(members: DataFrame, n_blocks, by: str) -> DataFrame:
    """Adds (unit, block, cross): a region of one block is one unit; more blocks meet in pairs, each block with itself too."""
    return (
        members.withColumn("blocks", n_blocks)
        .withColumn("block", F.pmod(F.xxhash64(F.lit(5), "rep"), F.col("blocks")))
        .withColumn("other", F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int"))))
        .withColumn("unit", F.xxhash64(by, F.least("block", F.col("other").cast("long")), F.greatest("block", F.col("other").cast("long"))))
        .drop("blocks", "other")
    )


class Union:
    """Disjoint sets of 0 .. n - 1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        self.up[max(x, y)] = min(x, y)
        return x != y

    def labels(self) -> np.ndarray:
        return np.array([self.find(x) for x in range(len(self.up))])


def _edge_batch(edges: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*edges) if edges else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def region_forest(reps: np.ndarray, sigs: np.ndarray, least: float) -> list[tuple[int, int]]:
    """A spanning forest of the near pairs of a region. A pair that several trees hold is looked at in each: in one of them its region may be cut."""
    order = np.argsort(reps, kind="stable")
    reps, sigs = reps[order], sigs[order]
    labels, edges = np.arange(len(reps)), []
    for i in range(len(reps) - 1):
        other = i + 1 + np.flatnonzero(labels[i + 1 :] != labels[i])
        near = other[(sigs[other] == sigs[i]).sum(axis=(1, 2)) >= least * TREES * DEPTH]
        for k in near.tolist():
            if labels[k] != labels[i]:
                labels[labels == labels[k]] = labels[i]
                edges.append((int(reps[i]), int(reps[k])))
    return edges


def _near_pairs(classes: DataFrame, threshold: float) -> DataFrame:
    """(a, b): spanning forests of all regions; their components hold every link."""
    members = _blocked(_regions(_prefixes(classes)), F.ceil(F.col("n") / REGION), "region").select("unit", "rep")
    rows = members.join(classes.select("rep", "sig"), "rep").select("unit", "rep", "sig")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges: list[tuple[int, int]] = []
        for _, group in grouped_rows(batches, "unit"):
            sigs = np.frombuffer(b"".join(group["sig"]), dtype="<u4").reshape(len(group["rep"]), TREES, DEPTH)
            edges += region_forest(np.array(group["rep"], dtype=np.int64), sigs, threshold - SLACK)
            if len(edges) > 20_000:
                yield _edge_batch(edges)
                edges = []
        yield _edge_batch(edges)

    return rows.repartition("unit").sortWithinPartitions("unit", "rep").mapInArrow(compare, "a long, b long").distinct()


def linked_forest(sets: list[np.ndarray], numerator: int, denominator: int) -> list[tuple[int, int]]:
    """A spanning forest of the sets with ``denominator * |both| >= numerator * |either|``, exact.

    A set's overlaps with all others are counted at once through the postings of its shingles. Sets are worked off until those
    left all lie in one component: a link that was not looked at then joins what is joined already.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    _, codes = np.unique(np.concatenate(sets), return_inverse=True)
    owners = np.repeat(np.arange(n), sizes)
    order = np.argsort(codes, kind="stable")
    by_code = owners[order]
    first = np.concatenate([[0], np.cumsum(np.bincount(codes))])
    starts = np.concatenate([[0], np.cumsum(sizes)])
    union, links, left = Union(n), [], set(range(n))
    labels, step = np.arange(n), 1
    while len(left) > 1:
        waiting = np.fromiter(left, np.int64, len(left))
        kinds, counts = np.unique(labels[waiting], return_counts=True)
        if len(kinds) == 1:
            break
        # Outside the largest component; a few at first, since one set may join all.
        outside = np.sort(waiting[labels[waiting] != kinds[counts.argmax()]])[:step]
        step *= 2
        for a in outside.tolist():
            left.discard(a)
            mine = codes[starts[a] : starts[a + 1]]
            spans = first[mine + 1] - first[mine]
            at = np.repeat(first[mine] - (np.cumsum(spans) - spans), spans) + np.arange(spans.sum())
            both = np.bincount(by_code[at], minlength=n)
            for b in np.flatnonzero(denominator * both >= numerator * (sizes[a] + sizes - both)).tolist():
                if b != a and union.join(a, b):
                    links.append((a, b))
        labels = union.labels()
    return links


def _links(docs: DataFrame, classes: DataFrame, clusters: DataFrame, id_col: str, text_col: str, size: int, numerator: int, denominator: int) -> DataFrame:
    """(a, b): spanning forests of the exact links inside each cluster."""
    members = clusters.join(classes.select("rep", "n_shingles", "set_key"), clusters.id == F.col("rep")).select("rep", F.col("component_id").alias("cluster"), "n_shingles", "set_key")
    weight = members.groupBy("cluster").agg(F.sum("n_shingles").alias("weight"))
    members = _blocked(members.join(weight, "cluster"), F.ceil(F.col("weight") / BLOCK_SHINGLES), "cluster")
    once = members.select("rep").distinct()
    texts = docs.select(F.col(id_col).alias("rep"), F.col(text_col).alias("text")).join(once, "rep")

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            blobs = [s.tobytes() for s in _sets(texts_of(batch.column(1)), size)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(blobs, pa.binary())], names=["rep", "shingles"])

    sets = texts.mapInArrow(shingle, "rep long, shingles binary")
    rows = members.select("unit", "rep").join(sets, "rep").select("unit", "rep", "shingles")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges: list[tuple[int, int]] = []
        for _, group in grouped_rows(batches, "unit"):
            found = [(rep, np.frombuffer(s, dtype=np.uint64)) for rep, s in zip(group["rep"], group["shingles"]) if s]
            edges += [(found[i][0], found[j][0]) for i, j in linked_forest([s for _, s in found], numerator, denominator)] if found else []
            if len(edges) > 20_000:
                yield _edge_batch(edges)
                edges = []
        yield _edge_batch(edges)

    return rows.repartition("unit").sortWithinPartitions("unit", "rep").mapInArrow(confirm, "a long, b long").distinct()


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, numerator: int = 75, denominator: int = 100
) -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row.

    Words are runs without ASCII white space, A-Z as a-z; a text's set holds its distinct shingles of ``size`` words (a shorter
    text is one shingle). Two texts are linked if ``denominator * |both| >= numerator * |either|``. component_id is the
    smallest id that links lead to, itself included; kept marks the rows whose id that is.

    A text that is null, empty or without words has no shingles and links with nothing. A row without an id belongs to
    the component of its copies, or to none (null), and is kept only in the latter case. Repeated rows get the same answer each; rows that share an id
    count as one node. Other columns are not read. An empty table gives an empty result. ``id`` must be a whole number.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = stored(signed(docs.withColumn(id_col, F.col(id_col).cast("long")), id_col, text_col, size))
    worded = rows.filter("set_key is not null")
    reps = worded.groupBy("set_key").agg(F.min("id").alias("id")).filter("id is not null")
    classes = stored(worded.join(reps, ["set_key", "id"]).select(F.col("id").alias("rep"), "n_shingles", "set_key", "sig"))
    clusters = components(_near_pairs(classes, numerator / denominator))
    found = components(_links(docs.withColumn(id_col, F.col(id_col).cast("long")), classes, clusters, id_col, text_col, size, numerator, denominator))
    groups = classes.select("set_key", "rep").distinct().join(found, F.col("rep") == found.id, "left").groupBy("set_key").agg(F.min(F.coalesce("component_id", "rep")).alias("component_id"))
    # Stored, so that the join has two plain exchanges and the copies of one text can be split over tasks.
    out = rows.drop("sig").join(stored(groups), "set_key", "left")
    component = F.coalesce("component_id", "id")
    return fewer(out).select(F.col("id").cast(kind).alias(id_col), "n_shingles", component.cast(kind).alias("component_id"), F.coalesce(F.col("id") == component, component.isNull()).alias("kept"))
