"""Session settings and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings the plans were written for. A cluster sets its own values for
# partition counts; AQE then coalesces or splits at run time.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Checkpoint files go when nothing refers to them any more.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(app: str = "backflow", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder of its own; a
    cluster without it is refused, since a machine-local folder would lose data
    with the executor.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a shared folder")
            folder = tempfile.mkdtemp(prefix="backflow-checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


#: Spark's setting by which the shuffle files of a query go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def swept(spark: SparkSession):
    """Shuffle files of the queries that run inside go when they end. Otherwise they stay until the driver's memory is cleaned, and add up over the jobs of a plan."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with a reliable checkpoint in :func:`shared_folder`."""
    shared_folder(df.sparkSession)
    with swept(df.sparkSession):
        # A plan of its own: shuffles of ``df`` that an earlier action left stay as they are.
        return df.select("*").checkpoint(eager=True)


def stored(df: DataFrame, name: str = "lines") -> DataFrame:
    """``df`` written once as a compressed table in :func:`shared_folder` and read back, for rows that several jobs read some columns of.

    Columns keep small there and unused ones are not read; unlike a checkpoint the table stays until the folder is cleaned.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    with swept(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
