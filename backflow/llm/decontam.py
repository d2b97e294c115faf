"""Benchmark passages in documents: a prefix-filtered containment join over windows of item words.

An item gives windows of ``window`` words in a row (a shorter item is one window). A window is contained where its
words occur in a row, so all of its shingles of up to ``SHINGLE`` words occur there, each at its own offset. Full
containment needs a prefix of one: the window's rarest shingle by its count over all documents. Documents are probed for
rare shingles only; the shingle's offset and the text's length bound where the window can lie, and the words there are
then compared one by one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from backflow.llm.common import slices, stored, texts_of
from backflow.llm.words import NOT_ALNUM, word_chunks

SHINGLE = 3
# Bytes of item text that one broadcast index is made from; more text is worked off in several indexes.
INDEX_BYTES = 4 << 20


class Windows:
    """The distinct windows of some items, as rows of word numbers, and their shingles."""

    def __init__(self, items: list[tuple[object, str]], window: int):
        self.item_ids = [k for k, _ in items]
        found: dict[bytes, list[int]] = {}
        hashes = [h[b[k] : b[k + 1]] for _, n, h, b in word_chunks([t for _, t in items], NOT_ALNUM) for k in range(n)]
        self.vocabulary = np.unique(np.concatenate([np.zeros(0, np.uint64), *hashes]))
        for item, words in enumerate(hashes):
            numbers = np.searchsorted(self.vocabulary, words).astype(np.int32)
            size = min(window, len(numbers))
            for at in range(len(numbers) - size + 1 if size else 0):
                found.setdefault(numbers[at : at + size].tobytes(), []).append(item)
        rows = [np.frombuffer(k, dtype=np.int32) for k in found]
        self.items = [np.unique(v) for v in found.values()]
        self.sizes = np.array([len(r) for r in rows], dtype=np.int64)
        self.words = np.full((len(rows), window), -1, dtype=np.int32)
        for k, r in enumerate(rows):
            self.words[k, : len(r)] = r
        # Every shingle of every window: its code, its window, its offset there. Codes of different lengths do not meet.
        codes, owners, offsets = [], [], []
        for q in range(1, SHINGLE + 1):
            mine = np.flatnonzero(self.sizes >= q if q == SHINGLE else self.sizes == q)
            for o in range(window - q + 1):
                at = mine[self.sizes[mine] >= o + q]
                codes.append(self.code(self.words[at, o : o + q].T))
                owners.append(at)
                offsets.append(np.full(len(at), o))
        self.codes, self.owners, self.offsets = np.concatenate(codes), np.concatenate(owners), np.concatenate(offsets)
        self.shingles, self.which = np.unique(self.codes, return_inverse=True)
        self.lengths = sorted({min(SHINGLE, int(n)) for n in self.sizes})
        # A word's number is found by a table over the low bits of its hash, then checked.
        bits = max(10, int(len(self.vocabulary) * 4).bit_length())
        self.mask = np.uint64((1 << bits) - 1)
        slots = (self.vocabulary & self.mask).astype(np.int64)
        self.clash = np.bincount(slots, minlength=1 << bits).max(initial=0) > 1
        self.table = np.full(1 << bits, -1, dtype=np.int32)
        self.table[slots] = np.arange(len(slots), dtype=np.int32)

    def code(self, words) -> np.ndarray:
        out = np.ones(len(words[0]), dtype=np.int64)
        for w in words:
            out = out * (len(self.vocabulary) + 1) + w
        return out

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each word in the items' vocabulary, -1 outside of it."""
        if not len(self.vocabulary):
            return np.full(len(hashes), -1, dtype=np.int32)
        if self.clash:
            at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1).astype(np.int32)
        else:
            at = self.table[(hashes & self.mask).astype(np.int64)]
        return np.where(self.vocabulary[at] == hashes, at, -1).astype(np.int32)

    def occurrences(self, numbers: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(word positions, shingle numbers) of the items' shingles in a run of words."""
        known = numbers >= 0
        for q in self.lengths:
            n = len(numbers) - q + 1
            if n <= 0:
                continue
            whole = known[:n].copy()
            for k in range(1, q):
                whole &= known[k : k + n]
            at = np.flatnonzero(whole)
            codes = self.code([numbers[at + k] for k in range(q)])
            place = np.minimum(np.searchsorted(self.shingles, codes), len(self.shingles) - 1)
            hit = self.shingles[place] == codes
            yield at[hit], place[hit]

    def anchored(self, counts: np.ndarray) -> None:
        """Chooses each window's rarest shingle; ``counts`` has the number of each shingle in all documents."""
        order = np.lexsort((self.offsets, self.codes, counts[self.which], self.owners))
        first = order[np.concatenate([[True], np.diff(self.owners[order]) != 0])] if len(order) else order
        first = first[np.argsort(self.which[first], kind="stable")]
        self.anchor_window, self.anchor_offset = self.owners[first], self.offsets[first]
        per = np.bincount(self.which[first], minlength=len(self.shingles))
        self.anchor_first, self.anchor_count = np.cumsum(per) - per, per

    def matches(self, numbers: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first word, window) of every occurrence of a window inside one text; ``owner`` is the text of each word."""
        starts, windows = [], []
        for at, shingle in self.occurrences(numbers):
            per = self.anchor_count[shingle]
            keep = per > 0
            at, shingle, per = at[keep], shingle[keep], per[keep]
            pick = np.repeat(self.anchor_first[shingle] - (np.cumsum(per) - per), per) + np.arange(per.sum())
            window = self.anchor_window[pick]
            start = np.repeat(at, per) - self.anchor_offset[pick]
            end = start + self.sizes[window]
            inside = (start >= 0) & (end <= len(numbers))
            start, window, end = start[inside], window[inside], end[inside]
            same = owner[start] == owner[end - 1]
            for k in range(self.words.shape[1]):
                word = self.words[window, k]
                same &= (word < 0) | (numbers[np.minimum(start + k, len(numbers) - 1)] == word)
            starts.append(start[same])
            windows.append(window[same])
        return np.concatenate([np.zeros(0, np.int64), *starts]), np.concatenate([np.zeros(0, np.int64), *windows])


def _shingle_counts(docs: DataFrame, text_col: str, index) -> np.ndarray:
    """How often each shingle of an index occurs in all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = index.value
        total = np.zeros(len(windows.shingles), dtype=np.int64)
        for batch in slices(batches):
            for _, _, hashes, _ in word_chunks(texts_of(batch.column(0)), NOT_ALNUM):
                for _, shingle in windows.occurrences(windows.numbers(hashes)):
                    total += np.bincount(shingle, minlength=len(total))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names=["shingle", "n"])

    counts = np.zeros(len(index.value.shingles), dtype=np.int64)
    for row in docs.select(text_col).mapInArrow(count, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[row.shingle] = row.n
    return counts


def _indexes(docs: DataFrame, items: DataFrame, item_id: str, item_text: str, text_col: str, window: int, limit: int):
    """Broadcast indexes over runs of items, each from at most ``limit`` bytes of text or one item."""
    context = docs.sparkSession.sparkContext

    def made(run):
        windows = Windows(run, window)
        first = context.broadcast(windows)
        windows.anchored(_shingle_counts(docs, text_col, first))
        first.unpersist()
        return context.broadcast(windows)

    run, size = [], 0
    for row in items.select(item_id, item_text).filter(F.col(item_text).isNotNull()).toLocalIterator():
        if run and size + len(row[1]) > limit:
            yield made(run)
            run, size = [], 0
        run.append((row[0], row[1]))
        size += len(row[1])
    yield made(run)


def contamination(
    docs: DataFrame, items: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", index_bytes: int = INDEX_BYTES, with_spans: bool = True
) -> DataFrame:
    """(id, n_words, n_hit, n_items, items_sha256, contaminated) of every row, with the hit word ``spans`` and ``items`` if asked for.

    Words are runs of ASCII letters, digits and anything beyond ASCII, A-Z as a-z. A document word inside any occurrence of a
    window is hit; spans are [first, end) word ranges without gaps. items are the sorted ids, as strings, of items with an occurring window.

    Null texts and items have no words; an item without words has no window. Null ids are kept, a null item id counts as no id and is left
    out of ``items``. Repeated document rows are answered each, repeated items count once per id. Other columns are not read. Empty tables work: without items nothing is hit.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    indexes = list(_indexes(docs, items, item_id, item_text, text_col, window, index_bytes))

    def hits(index, row_col: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            windows = index.value
            for batch in slices(batches):
                counts, spans, names = [], [], []
                for _, n, hashes, bounds in word_chunks(texts_of(batch.column(1)), NOT_ALNUM):
                    sizes = np.diff(bounds)
                    owner = np.repeat(np.arange(n), sizes)
                    start, window_of = windows.matches(windows.numbers(hashes), owner)
                    edge = np.bincount(start, minlength=len(hashes) + 1) - np.bincount(start + windows.sizes[window_of], minlength=len(hashes) + 1)
                    # Ends of texts are ends of spans: no window crosses them, but two spans may touch there.
                    covered = np.cumsum(edge)[: len(hashes)] > 0
                    counts += sizes.tolist()
                    text = owner[start] if len(start) else start
                    for k in range(n):
                        mine = window_of[text == k] if len(text) else text
                        if not len(mine):
                            spans.append([])
                            names.append([])
                            continue
                        turns = np.flatnonzero(np.diff(np.concatenate([[0], covered[bounds[k] : bounds[k + 1]].astype(np.int8), [0]])))
                        spans.append(turns.reshape(-1, 2).tolist())
                        ids = {windows.item_ids[i] for w in np.unique(mine) for i in windows.items[w].tolist()}
                        names.append(sorted(str(i) for i in ids if i is not None))
                arrays = [batch.column(0), pa.array(counts, pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array(names, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(arrays + ([batch.column(2)] if row_col else []), names=["id", "n_words", "spans", "items"] + ["row"] * row_col)

        return run

    schema = f"id {kind}, n_words long, spans array<array<long>>, items array<string>"
    if len(indexes) == 1:
        out = docs.select(id_col, text_col).mapInArrow(hits(indexes[0], False), schema)
    else:
        # Each index looks at all documents; what they find is put together by row.
        rows = stored(docs.select(id_col, text_col, F.monotonically_increasing_id().alias("row")))
        parts = [rows.mapInArrow(hits(index, True), schema + ", row long") for index in indexes]
        found = parts[0]
        for part in parts[1:]:
            found = found.union(part.filter(F.size("spans") > 0))
        out = found.groupBy("row").agg(F.first("id").alias("id"), F.max("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        merge = """aggregate(spans, cast(array() as array<array<bigint>>), (acc, s) ->
            case when size(acc) > 0 and element_at(acc, -1)[1] >= s[0]
            then concat(slice(acc, 1, size(acc) - 1), array(array(element_at(acc, -1)[0], greatest(element_at(acc, -1)[1], s[1])))) else concat(acc, array(s)) end)"""
        out = out.withColumn("spans", F.expr(merge)).drop("row")
    hit = F.expr("aggregate(spans, 0L, (n, s) -> n + s[1] - s[0])")
    out = out.select(
        F.col("id").alias(id_col), "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"), *(["spans", "items"] if with_spans else []),
    )
    return out


def clean(
    docs: DataFrame, items: DataFrame, window: int = 10, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", index_bytes: int = INDEX_BYTES
) -> DataFrame:
    """The rows of ``docs`` that hold no window of any item, with all columns, in one pass per index and without a shuffle."""
    at = docs.columns.index(text_col)

    def without(index):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                keep = []
                for _, n, hashes, bounds in word_chunks(texts_of(batch.column(at)), NOT_ALNUM):
                    owner = np.repeat(np.arange(n), np.diff(bounds))
                    start, _ = index.value.matches(index.value.numbers(hashes), owner)
                    keep.append(np.bincount(owner[start], minlength=n) == 0)
                if keep:
                    yield batch.filter(pa.array(np.concatenate(keep)))

        return run

    for index in list(_indexes(docs, items, item_id, item_text, text_col, window, index_bytes)):
        docs = docs.mapInArrow(without(index), docs.schema)
    return docs
