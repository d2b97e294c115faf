"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from backflow.session import checkpoint

__all__ = ["checkpoint", "fewer", "read", "stored", "grouped_rows", "slices", "texts_of", "partitions_for"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints; a local session without one gets a temporary folder."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        checkpoint(spark.range(0))
    return context.getCheckpointDir()


# Tasks per core beyond which small partitions are put together: more tasks balance no better and leave more files.
TASKS_A_CORE = 8


def fewer(df: DataFrame) -> DataFrame:
    """``df`` in at most ``TASKS_A_CORE`` partitions for each core of the cluster, without a shuffle."""
    return df.coalesce(TASKS_A_CORE * df.sparkSession.sparkContext.defaultParallelism)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once as a table in the shared folder and read back: wide rows, read by several later steps."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    fewer(df).write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions_for(total: int, each: int, spark: SparkSession) -> int:
    """Partitions so that each holds about ``each`` of ``total``, and no fewer than the session's shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(total) // each))


def grouped_rows(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[tuple[object, dict[str, list]]]:
    """Consecutive rows with one key, from batches sorted by that key, as (key, columns).

    Batches cut a group anywhere; only the group at hand is held.
    """
    held, current, started = None, None, False
    for batch in batches:
        columns = batch.to_pydict()
        keys = columns[key]
        begin = 0
        while begin < len(keys):
            end = begin + 1
            while end < len(keys) and keys[end] == keys[begin]:
                end += 1
            part = {name: values[begin:end] for name, values in columns.items()}
            if started and keys[begin] == current:
                held = {name: held[name] + values for name, values in part.items()}
            else:
                if started:
                    yield current, held
                held, current, started = part, keys[begin], True
            begin = end
    if started:
        yield current, held


def slices(batches: Iterable[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most ``rows`` rows, so that what Python makes of them stays small."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)


def texts_of(column: pa.Array) -> list[str]:
    """The texts of a batch; null counts as empty."""
    return [x or "" for x in column.to_pylist()]

