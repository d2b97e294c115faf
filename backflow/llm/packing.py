"""Packing along a space-filling curve: like documents share sequences.

A document becomes ids, the ids a signed hashed vector, the vector a point of few dimensions by a fixed random
projection, and the point a place on a Hilbert curve. Documents are range-sorted by that place and laid end to end, so
neighbours on the curve fill the same sequences.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from backflow.llm.common import partitions_for, stored, texts_of
from backflow.llm.tokens import word_tokenizer

BUCKETS = 128
DIMENSIONS = 4
BITS = 12
PARTITION_BYTES = 48 << 20


def projection(seed: int = 11) -> np.ndarray:
    """A fixed orthonormal map from hashed vectors to points, so that a unit vector stays within -1 and 1."""
    return np.linalg.qr(np.random.Generator(np.random.PCG64(seed)).normal(size=(BUCKETS, DIMENSIONS)))[0]


def hashed_vectors(ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A signed count of hashed ids for each document, of length 1 (0 for one without ids)."""
    n = len(bounds) - 1
    mixed = (ids.astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(24)
    owner = np.repeat(np.arange(n), np.diff(bounds))
    counts = np.bincount(owner * (2 * BUCKETS) + mixed, minlength=n * 2 * BUCKETS).reshape(n, 2, BUCKETS)
    vectors = (counts[:, 0] - counts[:, 1]).astype(np.float64)
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)


def hilbert_keys(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places on the Hilbert curve of points whose coordinates are whole numbers below ``2 ** bits``, one row each."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the rotations and reflections of the coarser cells
        for i in range(dims):
            flip = (x[i] & q) != 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] ^= np.where(flip, q - 1, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):  # Gray code
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[-1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros(x.shape[1], dtype=np.int64)
    for bit in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> bit) & 1)
    return key


def curve_places(vectors: np.ndarray) -> np.ndarray:
    points = (vectors @ projection() + 1) / 2 * (1 << BITS)
    return hilbert_keys(np.clip(points, 0, (1 << BITS) - 1).astype(np.int64))


def tokenized(docs: DataFrame, id_col: str, text_col: str, end_id: int, path: str | None) -> DataFrame:
    """(id, place, n_tokens, tokens): every whole text's ids, the end id last, as little-endian bytes."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = word_tokenizer(path)
        for batch in batches:
            at = 0
            for ids, bounds in tokenizer.encode(texts_of(batch.column(1))):
                n = len(bounds) - 1
                end = np.array([end_id], dtype=tokenizer.dtype).tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, n), pa.array(curve_places(hashed_vectors(ids, bounds)), pa.int64()), pa.array(np.diff(bounds) + 1, pa.int64()),
                        pa.array([ids[bounds[k] : bounds[k + 1]].tobytes() + end for k in range(n)], pa.binary()),
                    ],
                    names=["id", "place", "n_tokens", "tokens"],
                )
                at += n

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(encode, f"id {kind}, place long, n_tokens long, tokens binary")


def powers_of_two(n: int) -> list[int]:
    """Descending powers of two that add up to ``n``."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def pack_along_curve(
    docs: DataFrame, length: int = 2048, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, path: str | None = None, with_ids: bool = True
) -> DataFrame:
    """Cuts documents into pieces that fill sequences of ``length`` ids, neighbours on the curve side by side.

    One row per piece: id, start (ids of the document before it), length, ids_crc32 (of the ids as little-endian
    32-bit numbers), doc_tokens (with the end id), sequence_id, offset, and ``ids`` (little-endian bytes) if asked for.
    Every id lies in exactly one piece and offsets have no gaps. Each range partition fills its own sequences; what
    is left at its end is cut into sequences whose lengths are powers of two, so nothing is padded.

    A null or empty text is a document of the end id alone; a null id is kept. Ties on the curve, as among copies, are ordered
    by id, so a group of copies of any size is dealt over partitions by the range sort. Repeated rows are packed
    each. Other columns are not read. An empty table gives an empty result.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    table = stored(tokenized(docs, id_col, text_col, end_id, path))
    total = table.agg(F.sum("n_tokens")).first()[0] or 0

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dtype = np.dtype(word_tokenizer(path).dtype)
        sequence = None
        names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
        rows: list[tuple] = []
        open_pieces: list[tuple] = []  # (id, start, ids, doc_tokens) of the sequence at hand
        used = 0

        def close(pieces: list[tuple]) -> None:
            nonlocal sequence
            offset = 0
            for doc, start, ids, n in pieces:
                row = (doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), n, sequence, offset)
                rows.append(row + (ids.tobytes(),) if with_ids else row)
                offset += len(ids)
            sequence += 1

        def batch_of() -> pa.RecordBatch:
            columns = list(zip(*rows)) if rows else [()] * len(names)
            arrays = [pa.array(columns[0], id_type), *(pa.array(c, pa.int64()) for c in columns[1:7]), *(pa.array(c, pa.binary()) for c in columns[7:])]
            rows.clear()
            return pa.RecordBatch.from_arrays(arrays, names=names)

        id_type = None
        for batch in batches:
            id_type = batch.schema.field(0).type
            if sequence is None and len(batch):
                sequence = batch.column(3)[0].as_py() << 40
            for doc, n, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                ids = np.frombuffer(blob.as_py(), dtype=dtype)
                start = 0
                while start < n:
                    piece = ids[start : start + length - used]
                    open_pieces.append((doc, start, piece, n))
                    used += len(piece)
                    start += len(piece)
                    if used == length:
                        close(open_pieces)
                        open_pieces, used = [], 0
            yield batch_of()
        for size in powers_of_two(used):
            pieces, left = [], size
            while left:
                doc, start, ids, n = open_pieces.pop(0)
                pieces.append((doc, start, ids[:left], n))
                if len(ids) > left:
                    open_pieces.insert(0, (doc, start + left, ids[left:], n))
                left -= len(pieces[-1][2])
            close(pieces)
        if rows:
            yield batch_of()

    parts = partitions_for(total * 2, PARTITION_BYTES, docs.sparkSession)
    ordered = table.repartitionByRange(parts, "place", "id", "n_tokens").sortWithinPartitions("place", "id", "n_tokens", "tokens")
    packed = ordered.select("id", "n_tokens", "tokens", F.spark_partition_id().alias("part")).mapInArrow(
        fill, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_ids
    )
    return packed.withColumnRenamed("id", id_col)
