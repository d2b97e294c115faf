"""Best-fit-decreasing packing of token ids into a matrix, with a segment tree over capacities."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from backflow.llm.common import texts_of
from backflow.llm.tokens import word_tokenizer

WINDOW_TOKENS = 8_000_000


class CapacityTree:
    """Open bins by the room they have left. A node holds how many bins lie below it; leaves are amounts of room."""

    def __init__(self, most: int):
        self.size = 1 << max(1, most.bit_length())
        self.counts = [0] * (2 * self.size)
        self.bins: list[list[int]] = [[] for _ in range(most + 1)]

    def _add(self, room: int, by: int) -> None:
        at = room + self.size
        while at:
            self.counts[at] += by
            at >>= 1

    def put(self, room: int, name: int) -> None:
        self.bins[room].append(name)
        self._add(room, 1)

    def take_tightest(self, need: int) -> tuple[int, int] | None:
        """The bin with the least room that is at least ``need``, taken out, as (room, name)."""
        at = need + self.size
        while not self.counts[at]:  # climb to the first subtree on the right that holds a bin
            while at & 1:
                at >>= 1
            if at == 0:
                return None
            at += 1
        while at < self.size:
            at = 2 * at if self.counts[2 * at] else 2 * at + 1
        room = at - self.size
        self._add(room, -1)
        return room, self.bins[room].pop()


def best_fit_decreasing(lengths: list[int], length: int) -> list[list[int]]:
    """Bins of item numbers. Items by falling length, ties by number; each goes to the fullest bin that has room for it."""
    tree, bins = CapacityTree(length), []
    for item in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        found = tree.take_tightest(lengths[item])
        if found is None:
            found = (length, len(bins))
            bins.append([])
        room, name = found
        bins[name].append(item)
        if room > lengths[item]:
            tree.put(room - lengths[item], name)
    return bins


def packed_matrix(
    docs: DataFrame, length: int = 2048, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, pad_id: int = 0, window: int = WINDOW_TOKENS, path: str | None = None
) -> DataFrame:
    """Rows of a packed id matrix, one per sequence.

    sequence_id; n_tokens (before padding); segment_ids and segment_starts (document of each segment, and where in the
    document it starts); cu_seqlens (0, then the end of each segment); input_ids and position_ids: ``length`` little-endian
    numbers, of two bytes if ``id_bytes`` is 2, else four; position_ids start anew at 0 in each segment and in the padding.

    A document is its ids and the end id. One longer than ``length`` is split every ``length`` ids, so joining its segments by
    start restores it. Best fit runs over windows of about ``window`` ids of one task, which bounds memory by the window and one
    text, and needs no shuffle: the bins of a window are full but for its last few.

    A null or empty text is the end id alone; null ids are kept; repeated rows are packed each; other columns are not read;
    an empty table gives an empty result. Ties in length are ordered as the rows are read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["sequence_id", "n_tokens", "segment_ids", "segment_starts", "cu_seqlens", "id_bytes", "input_ids", "position_ids"]

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = word_tokenizer(path)
        width = tokenizer.width if length <= 1 << 16 else 4
        dtype = f"<u{width}"
        sequence = None
        end = np.array([end_id], dtype=dtype)
        ramp = np.arange(length, dtype=dtype)
        held: list[tuple] = []  # (id, start, ids)
        size, id_type = 0, None

        def rows() -> Iterator[pa.RecordBatch]:
            nonlocal sequence, held, size
            out: list[tuple] = []
            for items in best_fit_decreasing([len(x[2]) for x in held], length):
                parts = [held[k] for k in items]
                sizes = [len(p[2]) for p in parts]
                cuts = np.concatenate([[0], np.cumsum(sizes)])
                used = int(cuts[-1])
                ids = np.full(length, pad_id, dtype=dtype)
                ids[:used] = np.concatenate([p[2] for p in parts])
                places = np.concatenate([*(ramp[:n] for n in sizes), ramp[: length - used]])
                out.append((sequence, used, [p[0] for p in parts], [p[1] for p in parts], cuts.tolist(), width, ids.tobytes(), places.tobytes()))
                sequence += 1
                if len(out) == 512:
                    yield as_batch(out)
                    out = []
            if out:
                yield as_batch(out)
            held, size = [], 0

        def as_batch(out: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.list_(id_type), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int32(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

        for batch in batches:
            id_type = batch.schema.field(0).type
            if sequence is None and len(batch):
                sequence = batch.column(2)[0].as_py() << 40
            docs_of, at = batch.column(0).to_pylist(), 0
            for ids, bounds in tokenizer.encode(texts_of(batch.column(1))):
                for k in range(len(bounds) - 1):
                    whole = np.concatenate([ids[bounds[k] : bounds[k + 1]].astype(dtype), end])
                    held.extend((docs_of[at + k], start, whole[start : start + length]) for start in range(0, len(whole), length))
                    size += len(whole)
                    if size >= window:
                        yield from rows()
                at += len(bounds) - 1
        if held:
            yield from rows()

    schema = f"sequence_id long, n_tokens long, segment_ids array<{kind}>, segment_starts array<long>, cu_seqlens array<int>, id_bytes int, input_ids binary, position_ids binary"
    return docs.select(id_col, text_col, F.spark_partition_id().alias("part")).mapInArrow(fill, schema)
