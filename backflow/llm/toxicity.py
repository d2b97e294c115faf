"""Toxicity by a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

An n-gram's ratio is the log of its share of toxic labelled documents over its share of clean ones. N-grams whose
ratio stands out from chance are kept; a document's features are the ratios of the kept n-grams that it holds, and a
logistic regression is fitted on them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from backflow.llm.common import fewer, slices, texts_of

SIZES = (3, 4, 5)
BINS = 1 << 20
#: Most labelled rows that are learned from, and most n-grams that are kept (their numbers take two bytes).
SAMPLE_ROWS = 20_000
KEPT = 8_000
# Standard errors by which a kept n-gram's log ratio differs from 0.
STANDS_OUT = 2.5
CHUNK = 400_000

_FACTORS = np.random.Generator(np.random.PCG64(909)).integers(1, 1 << 63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _gram_chunks(texts: list[str]) -> Iterator[tuple[int, int, list[tuple[np.ndarray, np.ndarray]]]]:
    """(first text, number of texts, [(text of each n-gram, bin of each n-gram)] by size) for runs of texts.

    Texts are lower-cased with a space at both ends; n-grams never join two texts.
    """
    begin = 0
    while begin < len(texts):
        parts, size, end = [], 0, begin
        while end < len(texts) and (not parts or size < CHUNK):
            parts.append(f" {texts[end].lower()} ")
            size += len(parts[-1])
            end += 1
        codes = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        codes = np.where(codes <= 32, np.uint32(32), codes).astype(np.uint64)
        owner = np.repeat(np.arange(len(parts), dtype=np.int32), [len(p) for p in parts])
        grams, sums = [], codes * _FACTORS[0]
        for n in range(2, max(SIZES) + 1):
            if len(codes) < n:
                break
            sums = sums[: len(codes) - n + 1] + codes[n - 1 :] * _FACTORS[n - 1]
            if n in SIZES:
                bins = ((sums * _FACTORS[7]) >> np.uint64(64 - 20)).astype(np.int32)
                inside = owner[: len(bins)] == owner[n - 1 :]
                grams.append((owner[: len(bins)][inside], bins[inside]))
        yield begin, len(parts), grams
        begin = end


def held_bins(texts: list[str], wanted: np.ndarray) -> Iterator[np.ndarray]:
    """Per text, the distinct n-gram bins that ``wanted`` marks."""
    for _, n, grams in _gram_chunks(texts):
        owners, bins = [], []
        for owner, found in grams:
            keep = wanted[found]
            owners.append(owner[keep])
            bins.append(found[keep])
        pairs = np.unique(np.concatenate([np.zeros(0, np.int64), *(o.astype(np.int64) * BINS + b for o, b in zip(owners, bins))]))
        cuts = np.searchsorted(pairs, np.arange(n + 1, dtype=np.int64) * BINS)
        for k in range(n):
            yield pairs[cuts[k] : cuts[k + 1]] % BINS


@dataclass
class Model:
    """``weights``: per n-gram bin its ratio times its fitted weight, 0 where not kept."""

    bins: np.ndarray
    weights: np.ndarray
    bias: float

    def scores(self, texts: list[str]) -> np.ndarray:
        wanted = np.zeros(BINS, dtype=bool)
        wanted[self.bins] = True
        table = np.zeros(BINS)
        table[self.bins] = self.weights
        sums = np.array([table[b].sum() for b in held_bins(texts, wanted)])
        return 1 / (1 + np.exp(-np.clip(sums + self.bias, -500, 500)))


def fit_logistic(starts: np.ndarray, columns: np.ndarray, ratios: np.ndarray, labels: np.ndarray, penalty: float = 3e-4, rounds: int = 300, block: int = 1000) -> tuple[np.ndarray, float]:
    """(weights of the scaled features, bias) of a logistic regression by accelerated gradient steps.

    Row ``k`` has the features ``columns[starts[k]:starts[k + 1]]``. Rows are worked off in blocks, so that only the
    column numbers are held whole.
    """
    n, m = len(labels), len(ratios)
    cuts = [*range(0, n, block), n]
    blocks = [(np.repeat(np.arange(e - b, dtype=np.int16), np.diff(starts[b : e + 1])), columns[starts[b] : starts[e]], slice(b, e)) for b, e in zip(cuts, cuts[1:])]
    # A step per feature that is safe: the sum of a row's sizes bounds what the other features add to the curvature.
    curve, far = np.zeros(m), 0.0
    for rows, found, at in blocks:
        sizes = np.abs(ratios[found])
        reach = np.bincount(rows, sizes, minlength=at.stop - at.start) + 1
        curve += np.bincount(found, sizes * reach[rows], minlength=m)
        far += reach.sum()
    steps, bias_step = 1 / (curve / (4 * n) + penalty), 4 * n / far
    share = np.clip(labels.mean(), 1e-6, 1 - 1e-6)
    w, bias = np.zeros(m), float(np.log(share / (1 - share)))
    ahead, ahead_bias, t = w.copy(), bias, 1.0
    for _ in range(rounds):
        scaled, slope, slope_bias = ahead * ratios, np.zeros(m), 0.0
        for rows, found, at in blocks:
            scores = np.bincount(rows, scaled[found], minlength=at.stop - at.start) + ahead_bias
            wrong = 1 / (1 + np.exp(-np.clip(scores, -500, 500))) - labels[at]
            slope += np.bincount(found, wrong[rows], minlength=m)
            slope_bias += wrong.sum()
        new = ahead - steps * (slope * ratios / n + penalty * ahead)
        new_bias = ahead_bias - bias_step * slope_bias / n
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, ahead_bias = new + (t - 1) / t_next * (new - w), new_bias + (t - 1) / t_next * (new_bias - bias)
        w, bias, t = new, new_bias, t_next
    return w, float(bias)


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, limit: int) -> DataFrame:
    """(label, text) of at most ``limit`` labelled documents that are open to learning, chosen by a hash of the id."""
    open_to = F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 != 1
    chosen = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & open_to).groupBy(id_col).agg(F.max(label_col).alias("label"))
    chosen = chosen.orderBy(F.xxhash64(id_col), id_col).limit(limit)
    # At most ``limit`` rows of two numbers: a bound that makes the broadcast safe.
    return docs.select(id_col, text_col).join(F.broadcast(chosen), id_col).select(F.col("label").cast("int"), F.col(text_col).alias("text"))


def _telling_grams(rows: DataFrame, kept: int) -> tuple[int, int, np.ndarray, np.ndarray]:
    """Clean and toxic documents, and the bins and log ratios of the ``kept`` n-grams that stand out most, by bin.

    Counts of all bins are added up and judged in tasks, a slice of the bins each; the driver gets the kept ones only.
    """
    width = 1 << 14

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, BINS), dtype=np.int64)
        seen = np.zeros((2, 1), dtype=np.int64)
        everything = np.ones(BINS, dtype=bool)
        for batch in slices(batches):
            for label, bins in zip(batch.column(0).to_pylist(), held_bins(texts_of(batch.column(1)), everything)):
                total[label, bins] += 1
                seen[label] += 1
        if seen.sum():
            # Each slice takes the numbers of documents along, as its last column.
            blobs = [np.hstack([total[:, at : at + width], seen]).astype("<i8").tobytes() for at in range(0, BINS, width)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(blobs)), pa.int32()), pa.array(blobs, pa.binary())], names=["part", "counts"])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts = np.frombuffer(blob, dtype="<i8")
                sums[part] = sums[part] + counts if part in sums else counts
        for part, counts in sums.items():
            counts = counts.reshape(2, -1)
            clean, toxic = counts[:, width].tolist()
            if part == 0:
                yield pa.RecordBatch.from_pydict({"bin": [None], "ratio": [None], "certain": [None], "clean": [clean], "toxic": [toxic]}, schema)
            if clean and toxic:
                p, q = counts[1, :width] + 0.5, counts[0, :width] + 0.5
                ratio = np.log(p / (toxic + 1)) - np.log(q / (clean + 1))
                # The variance of a log ratio of two counts.
                certain = np.abs(ratio) / np.sqrt(1 / p + 1 / q)
                at = np.flatnonzero(certain >= STANDS_OUT)
                none = pa.nulls(len(at), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(at + part * width, pa.int32()), pa.array(ratio[at]), pa.array(certain[at]), none, none], schema=schema)

    schema = pa.schema([("bin", pa.int32()), ("ratio", pa.float64()), ("certain", pa.float64()), ("clean", pa.int64()), ("toxic", pa.int64())])
    judged = rows.mapInArrow(count, "part int, counts binary").repartition("part").mapInArrow(judge, "bin int, ratio double, certain double, clean long, toxic long")
    # The row with the numbers of documents has no bin and comes first. An iterator leaves the choice to a task.
    best = list(judged.orderBy(F.desc_nulls_first("certain"), "bin").limit(kept + 1).toLocalIterator())
    if not best:
        return 0, 0, np.zeros(0, np.int64), np.zeros(0)
    grams = sorted((row.bin, row.ratio) for row in best[1:])
    return best[0].clean, best[0].toxic, np.array([g[0] for g in grams], dtype=np.int64), np.array([g[1] for g in grams], dtype=np.float64)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", limit: int = SAMPLE_ROWS, kept: int = KEPT) -> Model:
    """A model from at most ``limit`` labelled rows. Rows whose crc32(id as text) mod 3 is 1 are never learned from.

    Labels other than 0 and 1, null ids and labels without a document are left out. Without rows of both labels, the model scores
    every text with the share of label 1 (one half without any row).
    """
    # Fewer partitions: each counting task sends all bins, and the iterator below runs a job for each partition.
    rows = fewer(training_rows(docs, labels, id_col, text_col, label_col, limit))
    clean, toxic, bins, ratios = _telling_grams(rows, kept)
    if not clean or not toxic:
        share = (toxic + 0.5) / (clean + toxic + 1)
        return Model(np.zeros(0, np.int64), np.zeros(0), float(np.log(share / (1 - share))))
    place = np.full(BINS, -1, dtype=np.int16)
    place[bins] = np.arange(len(bins))
    place_of = rows.sparkSession.sparkContext.broadcast(place)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            held = [place_of.value[b].astype("<i2").tobytes() for b in held_bins(texts_of(batch.column(1)), place_of.value >= 0)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held, pa.binary())], names=["label", "columns"])

    targets, columns, starts = [], bytearray(), [0]
    for row in rows.mapInArrow(features, "label int, columns binary").toLocalIterator():
        targets.append(row.label)
        columns += row.columns
        starts.append(len(columns) // 2)
    weights, bias = fit_logistic(np.array(starts), np.frombuffer(columns, dtype="<i2"), ratios, np.array(targets, dtype=np.float64))
    return Model(bins, ratios * weights, bias)


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """(id, held_out, score, predicted) of every row, from its whole text alone.

    A null or empty text gets the score of a text without any kept n-gram; a null id is not held out. Repeated rows are scored
    each; other columns are not read; an empty table gives an empty result. Scores equal to the threshold are predicted 1.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shipped.value.scores(texts_of(batch.column(1))), pa.float64())], names=["id", "score"])

    rows = docs.select(id_col, text_col).mapInArrow(score, f"id {kind}, score double")
    held_out = F.coalesce(F.crc32(F.col("id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return rows.select(F.col("id").alias(id_col), held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, with all columns."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield batch.filter(pa.array(shipped.value.scores(texts_of(batch.column(at))) < threshold))

    return docs.mapInArrow(keep, docs.schema)
