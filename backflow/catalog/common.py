"""Frames and CTEs that several registered queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from backflow.catalog.twins import cte
from backflow.features.current import core_table
from backflow.functions.expressions import ID
from backflow.session import checkpoint
from backflow.sources.order_lines import order_lines, table


def customer_base(spark: SparkSession, sf: str) -> DataFrame:
    """Customer grain with volume, behaviour, timing and recency columns; checkpointed, since most jobs go over it more than once."""
    return checkpoint(core_table(order_lines(spark, sf), money=False))


cte("base", """
SELECT f01.*, f02.* EXCLUDE (customer_emailid), f04.* EXCLUDE (customer_emailid), recent_orders, recent_returns, recent_vs_avg_ratio,
 CAST(behavior_stability_score AS DOUBLE) AS behavior_stability_score, total_sales_qty, total_return_qty
FROM f01 JOIN f02 USING (customer_emailid) JOIN f04 USING (customer_emailid) JOIN f05 USING (customer_emailid)
 JOIN (SELECT customer_emailid, total_sales_qty, total_return_qty FROM f21) t USING (customer_emailid)""")

# Feature columns used by the preparation and segment queries below.
NUMERIC = [
    "sales_order_no_nunique", "sku_nunique", "items_returned_count", "sales_qty_mean", "avg_order_size", "return_rate",
    "return_product_variety", "avg_returns_per_order", "return_frequency_ratio", "return_intensity", "customer_lifetime_days",
    "avg_days_to_return", "return_timing_spread", "recent_orders", "recent_returns", "recent_vs_avg_ratio", "behavior_stability_score",
]


def labelled(df: DataFrame) -> DataFrame:
    """A rule-made segment label for the report queries: few orders are noise (-1),
    the rest split by the order count and by long lifetimes."""
    n = F.col("sales_order_no_nunique")
    return df.withColumn("cluster", F.when(n <= 5, -1).otherwise(n % 4 + F.when(F.col("customer_lifetime_days") > 1900, 4).otherwise(0)).cast("int"))


cte("labelled", """
SELECT *, CAST(CASE WHEN sales_order_no_nunique <= 5 THEN -1 ELSE sales_order_no_nunique % 4 + CASE WHEN customer_lifetime_days > 1900 THEN 4 ELSE 0 END END AS INT) AS cluster
FROM base""")


def gold_like(df: DataFrame, features: list[str] = NUMERIC) -> DataFrame:
    """Adds completeness and a rule-made outlier score to a customer frame."""
    filled = sum((F.when(F.col(c) != 0, 1).otherwise(0) for c in features), F.lit(0))
    return df.withColumns({
        "feature_completeness_score": filled / F.lit(float(len(features))),
        "outlier_score": -F.least(F.lit(1.0), F.col("return_intensity") / 50.0),
    })


cte("goldish", f"""
SELECT *, ({' + '.join(f'CASE WHEN {c} <> 0 THEN 1 ELSE 0 END' for c in NUMERIC)}) / {float(len(NUMERIC))}e0 AS feature_completeness_score,
 -least(1e0, return_intensity / 50e0) AS outlier_score FROM labelled""")


def segments(spark: SparkSession, sf: str) -> DataFrame:
    return gold_like(labelled(customer_base(spark, sf)))


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """(id, v array<double>, label) from the embeddings table."""
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"), F.col("label").cast("int").alias("label")
    )
