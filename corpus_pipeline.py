"""A training-data pipeline over ``documents``: five stages, each written as Parquet and read again by the next.

All stages but the last keep the columns of ``documents``. Toxic documents, all but one document of each near-duplicate
group, and documents that hold a benchmark passage go; secrets are replaced in the text; what is left is packed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from backflow.llm import decontam, neardup, packing, secrets, toxicity
from backflow.llm.common import fewer, read, stored


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labelled ones among them, does not reject."""
    return toxicity.accepted(fewer(docs), toxicity.fit(docs, read(spark, sf_dir, "labels")))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate group.

    Rows that share this id are repeats if their texts are equal too: of those, the row whose other columns are smallest, in their order, stays.
    Different texts under one id all stay. A null text counts as empty, so rows without id and text are repeats of each other.

    Documents without an id get one from their text for the time being, above all others, so that they give way to
    those with an id and stay where they have no copy.
    """
    named = docs.withColumn("_near_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(1 << 62) + F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(1 << 61))))
    kept = neardup.near_duplicates(named, id_col="_near_id").filter("kept").select("_near_id")
    others = [F.col(f"`{c}`") for c in docs.columns]
    once = named.join(kept, "_near_id", "left_semi").groupBy("_near_id", F.coalesce("text", F.lit("")).alias("_text")).agg(F.min(F.struct(*others)).alias("_row"))
    return fewer(once).select("_row.*")


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return decontam.clean(fewer(docs), read(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark; n_chars is that of the new text."""
    changed = secrets.redacted(docs.withColumn("_before", F.char_length("text")))
    length = F.char_length("text").cast(docs.schema["n_chars"].dataType)
    return fewer(changed).withColumn("n_chars", F.when(length != F.col("_before"), length).otherwise(F.col("n_chars"))).select(*[F.col(f"`{c}`") for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of full sequences, like documents side by side."""
    return fewer(packing.pack_along_curve(docs, with_ids=False))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", without_toxic), ("near_duplicates", without_copies), ("decontamination", without_benchmark), ("secrets", without_secrets), ("packing", packed),
]

#: SQL has no classifier and no public vocabulary; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs)
    return docs
