"""Incremental ingest of order-line files, driven by Structured Streaming.

New files are picked up once (file-source checkpoint), cleaned by the same
operators as the batch load and appended to a staging folder with an exactly-once
file sink. The keyed merge into bronze stays a batch job over the staged rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from backflow.functions.expressions import ID
from backflow.operators import clean
from backflow.operators.joins import append_ignore
from backflow.schemas import BRONZE


def stage_new_files(spark: SparkSession, source: str, staging: str, checkpoint: str, header: list[str]) -> None:
    """Process all files not seen yet, then stop (trigger: available now)."""
    text = T.StructType([T.StructField(c, T.StringType()) for c in header])
    raw = clean.lower_columns(spark.readStream.schema(text).option("header", True).csv(source))
    typed = clean.coerce_types(clean.map_columns_ci(raw, BRONZE)).withColumn(ID, clean.clean_email(F.col(ID)))
    keyed = clean.with_primary_key(typed, ["sales_order_no", "sku", ID])
    query = (
        clean.fix_return_dates(keyed)
        .writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(staging)
    )
    query.awaitTermination()


def merge_staged(bronze: DataFrame, staged: DataFrame) -> DataFrame:
    """Rows to add to bronze; existing keys win."""
    return append_ignore(bronze, staged.select(*bronze.columns), ["primary_key"], ["order_date", "return_date"])
