"""Variant: features from order, item and return-timing summaries.

The wider join of orders and items on the customer alone multiplies sums; here
each summary is reduced to the customer grain before they meet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from backflow.features.current import recent_cutoff
from backflow.functions.expressions import ID, banded, calendar_days, first_match, flag, or_zero, ratio, whole_days
from backflow.operators.ordered import with_running
from backflow.session import checkpoint, stored


# What the summaries read of a line.
SUMMARY_COLUMNS = [ID, "sales_order_no", "order_date", "sku", "q_cls_id", "line_no", "sales_qty", "return_qty", "units_returned_flag", "return_date"]


def is_flagged():
    return F.upper("units_returned_flag") == "YES"


def order_summary(lines: DataFrame) -> DataFrame:
    back = flag(is_flagged())
    return lines.groupBy(ID, "sales_order_no", "order_date").agg(
        F.count(F.lit(1)).alias("items_in_order"),
        F.sum("sales_qty").alias("total_qty_ordered"),
        F.countDistinct("sku").alias("unique_skus_in_order"),
        F.countDistinct("q_cls_id").alias("unique_categories_in_order"),
        F.sum(back).alias("items_returned_in_order"),
        F.sum(F.when(is_flagged(), F.col("return_qty")).otherwise(0)).alias("qty_returned_in_order"),
    )


def item_summary(lines: DataFrame) -> DataFrame:
    gap = F.when(is_flagged() & F.col("return_date").isNotNull(), whole_days(F.col("order_date"), F.col("return_date")))
    return lines.groupBy(ID, "sku", "q_cls_id").agg(
        F.count(F.lit(1)).alias("purchase_frequency"),
        F.sum("sales_qty").alias("total_qty_purchased"),
        F.sum(F.when(is_flagged(), F.col("return_qty")).otherwise(0)).alias("total_qty_returned"),
        F.sum(flag(is_flagged())).alias("return_frequency"),
        F.min("order_date").alias("first_purchase_date"),
        F.max("order_date").alias("last_purchase_date"),
        F.avg(gap).alias("avg_days_to_return"),
    )


def return_timing(lines: DataFrame) -> DataFrame:
    return lines.where(is_flagged() & F.col("return_date").isNotNull()).select(
        ID, "sales_order_no", "sku", "order_date", "return_date",
        whole_days(F.col("order_date"), F.col("return_date")).alias("days_to_return"),
        F.month("order_date").cast("bigint").alias("order_month"),
        F.month("return_date").cast("bigint").alias("return_month"),
    )


def item_streaks(lines: DataFrame) -> DataFrame:
    """Runs of returned lines: the running count of kept lines names the run."""
    # Only what the order and the runs need is sorted and kept.
    ties = ["sales_order_no", "sku", "line_no", "return_qty"]
    work = lines.select(ID, "order_date", *ties, flag(is_flagged()).alias("is_return"), flag(~is_flagged()).alias("is_kept"))
    runs = with_running(work, ID, "order_date", ties, sums={"run": "is_kept"})
    lengths = runs.where("is_return = 1").groupBy(ID, "run").agg(F.count(F.lit(1)).alias("len"))
    return lengths.groupBy(ID).agg(
        F.count(F.lit(1)).alias("consecutive_returns"), F.avg("len").alias("avg_consecutive_returns")
    )


def summary_features(lines: DataFrame, style: str = "table") -> DataFrame:
    """Feature table from the summaries.

    ``style="table"`` gives the tenure bands <90/<180/Mature; ``"notebook"``
    adds the recent-to-overall ratio and stability and the band 'Established'. The columns that the summaries use are stored once, and
    each summary's customer rows are checkpointed before the next one begins, so that its shuffles are gone by then.
    """
    lines = stored(lines.select(*SUMMARY_COLUMNS))
    cutoff = recent_cutoff(lines)
    recent = F.col("order_date") >= F.col("_cutoff")
    orders = checkpoint(order_summary(lines).withColumn("_cutoff", cutoff).groupBy(ID).agg(
        F.countDistinct("sales_order_no").alias("orders"),
        F.avg("items_in_order").alias("avg_order_size"),
        F.sum("items_returned_in_order").alias("back"),
        F.sum(flag(F.col("items_returned_in_order") > 0)).alias("orders_back"),
        F.countDistinct(F.when(recent, F.col("sales_order_no"))).alias("recent_orders"),
        F.sum(F.when(recent, F.col("items_returned_in_order"))).alias("recent_returns"),
        F.min("order_date").alias("first_order_date"),
        F.max("order_date").alias("last_order_date"),
        calendar_days(F.min("order_date"), F.max("order_date")).alias("calendar_life"),
        whole_days(F.min("order_date"), F.max("order_date")).alias("whole_life"),
    ))
    bought = F.col("total_qty_purchased")
    items = checkpoint(item_summary(lines).groupBy(ID).agg(
        F.countDistinct("sku").alias("sku_nunique"),
        F.sum("return_frequency").alias("items_returned_count"),
        F.avg("total_qty_purchased").alias("sales_qty_mean"),
        F.count("sku").alias("sku_rows"),
        F.sum("total_qty_returned").alias("qty_back"),
        F.sum("total_qty_purchased").alias("qty_bought"),
        F.countDistinct(F.when(F.col("return_frequency") > 0, F.col("sku"))).alias("return_product_variety"),
        F.avg(F.when(bought > 0, ratio(F.col("total_qty_returned"), bought))).alias("return_intensity"),
    ))
    timing = checkpoint(return_timing(lines).groupBy(ID).agg(
        F.avg("days_to_return").alias("avg_days_to_return"), F.stddev_samp("days_to_return").alias("return_timing_spread")
    ))
    joined = orders.join(items, ID, "left").join(timing, ID, "left").join(checkpoint(item_streaks(lines)), ID, "left")
    per_order = ratio(F.col("back"), F.col("orders"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    shared = [
        F.col(ID), F.col("orders").alias("sales_order_no_nunique"),
        or_zero(F.col("sku_nunique")).alias("sku_nunique"), or_zero(F.col("items_returned_count")).alias("items_returned_count"),
        zero(F.col("sales_qty_mean")).alias("sales_qty_mean"), zero(F.col("avg_order_size")).alias("avg_order_size"),
        zero(ratio(F.col("items_returned_count"), F.col("sku_rows"))).alias("return_rate"),
        zero(ratio(F.col("qty_back"), F.col("qty_bought"))).alias("return_ratio"),
        or_zero(F.col("return_product_variety")).alias("return_product_variety"),
        zero(per_order).alias("avg_returns_per_order"),
        zero(ratio(F.col("orders_back"), F.col("orders"))).alias("return_frequency_ratio"),
        zero(F.col("return_intensity")).alias("return_intensity"),
        or_zero(F.col("consecutive_returns")).alias("consecutive_returns"),
        zero(F.col("avg_consecutive_returns")).alias("avg_consecutive_returns"),
        F.col("recent_orders"),
    ]
    if style == "table":
        life = F.col("calendar_life")
        return joined.select(
            *shared, life.alias("customer_lifetime_days"),
            first_match([(life < 90, "New"), (life < 180, "Growing")], "Mature").alias("customer_tenure_stage"),
            "first_order_date", "last_order_date", "avg_days_to_return", "return_timing_spread", "recent_returns",
        )
    life = F.col("whole_life")
    recent_rate = ratio(or_zero(F.col("recent_returns")), F.col("recent_orders"))
    vs = F.when(F.col("recent_orders") > 0, F.try_divide(recent_rate, per_order)).otherwise(1.0)
    # Divided by the overall rate; NULLIF(.., 1) leaves a rate of exactly one undefined.
    base = F.when(per_order != 1, per_order)
    stability = F.when(F.col("orders") >= 3, 1.0 - F.try_divide(F.abs(recent_rate - per_order), base)).otherwise(0.5)
    return joined.select(
        *shared, or_zero(life).alias("customer_lifetime_days"),
        zero(F.col("avg_days_to_return")).alias("avg_days_to_return"), zero(F.col("return_timing_spread")).alias("return_timing_spread"),
        banded(life, [(90, "New"), (180, "Growing"), (365, "Mature")], "Established").alias("customer_tenure_stage"),
        or_zero(F.col("recent_returns")).alias("recent_returns"), vs.alias("recent_vs_avg_ratio"), stability.alias("behavior_stability_score"),
    )
