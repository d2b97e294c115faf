"""Batched scoring of free text with a pluggable scorer."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

COMMENT_COLUMNS = {"return_comment", "comment", "comments"}

# A small default lexicon for runs without a model.
POSITIVE = ["good", "great", "love", "loved", "nice", "perfect", "happy", "excellent", "beautiful", "thanks", "comfortable"]
NEGATIVE = ["bad", "poor", "broken", "damaged", "wrong", "late", "small", "large", "tight", "loose", "defective", "disappointed", "hate", "cheap", "torn", "return"]

Scorer = Callable[[list[str]], list[tuple[str, float]]]


def lexicon_columns(text: Column) -> tuple[Column, Column]:
    """Label by the balance of listed words, and the margin's share as confidence, as column expressions."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+")
    hits = lambda listed: F.size(F.filter(words, lambda w: w.isin(listed)))
    good, bad = hits(POSITIVE), hits(NEGATIVE)
    label = F.when(good > bad, "POSITIVE").when(bad > good, "NEGATIVE").otherwise("NEUTRAL")
    return label, F.lit(0.5) + F.coalesce(F.try_divide(F.lit(0.5) * F.abs(good - bad), good + bad), F.lit(0.0))


def comment_column(df: DataFrame) -> str:
    found = [c for c in df.columns if c.lower() in COMMENT_COLUMNS]
    if not found:
        raise ValueError("no comment column found")
    return found[0]


def score_text(df: DataFrame, col: str | None = None, factory: Callable[[], Scorer] | None = None, batch: int = 32) -> DataFrame:
    """Adds ``model_sentiment`` and ``model_confidence``; NULL text counts as ''.

    Without ``factory`` the word list decides, as column expressions. With it, a
    model is built once per task and whole texts go through it ``batch`` at a time.
    """
    name = col or comment_column(df)
    if factory is None:
        label, confidence = lexicon_columns(F.col(name))
        return df.withColumns({"model_sentiment": label, "model_confidence": confidence})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = factory()
        for frame in frames:
            texts = frame[name].fillna("").astype(str).tolist()
            scored = [pair for lo in range(0, len(texts), batch) for pair in scorer(texts[lo:lo + batch])]
            yield frame.assign(model_sentiment=[s for s, _ in scored], model_confidence=[c for _, c in scored])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInPandas(run, f"{fields}, model_sentiment string, model_confidence double")


def sentiment_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("model_sentiment").agg(F.count(F.lit(1)).alias("n"), F.avg("model_confidence").alias("avg_confidence"))
