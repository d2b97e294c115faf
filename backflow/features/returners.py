"""Variant: features of customers with at least one return."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from backflow.features.current import is_returned, recent_cutoff
from backflow.functions.expressions import ID, first_match, flag, or_zero, ratio, round_to, whole_days, with_row
from backflow.operators.ordered import with_running
from backflow.session import checkpoint

# Columns used for segmenting in this variant.
CLUSTER_FEATURES = [
    "sales_order_no_nunique", "sku_nunique", "return_rate", "return_ratio", "items_returned_count",
    "return_product_variety", "customer_lifetime_days", "recent_orders", "recent_returns", "sales_qty_mean",
    "avg_days_to_return", "return_timing_spread", "avg_returns_per_order", "return_frequency_ratio",
    "avg_return_intensity", "recent_vs_avg_ratio", "return_trend_increasing",
]


def only_returners(lines: DataFrame) -> DataFrame:
    return lines.join(lines.where(is_returned()).select(ID).distinct(), ID, "left_semi")


def _by_order(lines: DataFrame) -> DataFrame:
    """Sums per (customer, order, instant): what this variant reads of a line beside its SKU."""
    gap = F.when(is_returned() & F.col("return_date").isNotNull(), whole_days(F.col("order_date"), F.col("return_date")))
    share = F.when(is_returned(), ratio(F.col("return_qty"), F.col("sales_qty")))
    return lines.groupBy(ID, "sales_order_no", "order_date").agg(
        F.count(F.lit(1)).alias("items"), F.sum(flag(is_returned())).alias("ret_items"),
        F.sum("sales_qty").alias("sold"), F.count("sales_qty").alias("sold_rows"), F.sum("return_qty").alias("back"), F.count("return_qty").alias("back_rows"),
        F.sum(gap).alias("gap_sum"), F.count(gap).alias("gaps"), F.min(gap).alias("gap_low"), F.max(gap).alias("gap_high"),
        F.sum(share).alias("share_sum"), F.count(share).alias("shares"),
    )


def _returning(orders: DataFrame) -> DataFrame:
    return orders.join(orders.where("ret_items > 0").select(ID).distinct(), ID, "left_semi")


def _volume(mine: DataFrame, lines: DataFrame) -> DataFrame:
    """One row per returner from the rows of :func:`_by_order`; no row is copied for a distinct count."""
    total = lambda c: F.sum(c).alias(c)
    recent = F.col("order_date") >= F.col("_cutoff")
    per_order = mine.withColumn("_cutoff", recent_cutoff(mine)).groupBy(ID, "sales_order_no").agg(
        *[total(c) for c in ("items", "ret_items", "sold", "sold_rows", "back", "back_rows", "gap_sum", "gaps", "share_sum", "shares")],
        F.min("gap_low").alias("gap_low"), F.max("gap_high").alias("gap_high"), F.min("order_date").alias("first"), F.max("order_date").alias("last"),
        F.max(flag(recent)).alias("recent"), F.sum(F.when(recent, F.col("ret_items")).otherwise(0)).alias("recent_returns"),
    )
    named = flag(F.col("sales_order_no").isNotNull())
    sums = per_order.groupBy(ID).agg(
        F.sum(named).alias("sales_order_no_nunique"), F.sum(F.col("recent") * named).alias("recent_orders"), F.avg(F.when(F.col("ret_items") > 0, F.col("ret_items"))).alias("avg_returns_per_order"),
        *[total(c) for c in ("items", "ret_items", "sold", "sold_rows", "back", "back_rows", "gap_sum", "gaps", "share_sum", "shares", "recent_returns")],
        (F.max("gap_high") - F.min("gap_low")).alias("return_timing_spread"), whole_days(F.min("first"), F.max("last")).alias("customer_lifetime_days"),
    )
    skus = lines.where(F.col("sku").isNotNull()).groupBy(ID, "sku").agg(F.max(flag(is_returned())).alias("ret"))
    variety = skus.groupBy(ID).agg(F.count(F.lit(1)).alias("skus"), F.sum("ret").alias("variety"))
    return sums.join(variety, ID, "left").select(
        ID,
        "sales_order_no_nunique",
        or_zero(F.col("skus")).alias("sku_nunique"),
        F.col("sold").alias("sales_qty_sum"),
        round_to(ratio(F.col("sold"), F.col("sold_rows")), 2).alias("sales_qty_mean"),
        F.col("back").alias("return_qty_sum"),
        round_to(ratio(F.col("back"), F.col("back_rows")), 2).alias("return_qty_mean"),
        round_to(ratio(F.col("back"), F.col("sold")), 3).alias("return_ratio"),
        F.col("ret_items").alias("items_returned_count"),
        round_to(ratio(F.col("ret_items"), F.col("items")), 3).alias("return_rate"),
        or_zero(F.col("variety")).alias("return_product_variety"),
        "customer_lifetime_days",
        "recent_orders",
        "recent_returns",
        ratio(F.col("gap_sum"), F.col("gaps")).alias("avg_days_to_return"),
        "return_timing_spread",
        "avg_returns_per_order",
        F.coalesce(ratio(F.col("share_sum"), F.col("shares")), F.lit(0.0)).alias("avg_return_intensity"),
        ratio(F.col("ret_items"), F.col("sales_order_no_nunique")).alias("return_frequency_ratio"),
    )


VOLUME_COLUMNS = [
    "sales_order_no_nunique", "sku_nunique", "sales_qty_sum", "sales_qty_mean", "return_qty_sum", "return_qty_mean", "return_ratio",
    "items_returned_count", "return_rate", "return_product_variety", "customer_lifetime_days", "recent_orders", "recent_returns",
]


def returner_features(lines: DataFrame) -> DataFrame:
    """Volume, rates, lifetime and recent activity of returners."""
    return _volume(_returning(_by_order(lines)), lines).select(ID, *VOLUME_COLUMNS)


def recent_vs_avg(lines: DataFrame, min_orders: int = 10) -> DataFrame:
    """Return rate of the last quarter of the orders (three at least) over all orders.

    Orders rank by their first line. Ranks come per customer over order rows;
    beyond the order grain nothing is sorted.
    """
    return _recent_vs_avg(_returning(_by_order(lines)), min_orders)


def _recent_vs_avg(mine: DataFrame, min_orders: int = 10) -> DataFrame:
    orders = mine.groupBy(ID, "sales_order_no").agg(F.min("order_date").alias("seen"), F.sum("items").alias("items"), F.sum("ret_items").alias("back"))
    per_day = _last_orders(orders)
    recent = F.col("newest") <= F.greatest(F.lit(3), F.floor(F.col("orders") * 0.25))
    sums = per_day.groupBy(ID).agg(
        F.max("orders").alias("orders"),
        F.sum("items").alias("items"), F.sum("back").alias("back"),
        F.sum(F.when(recent, F.col("items"))).alias("recent_items"), F.sum(F.when(recent, F.col("back"))).alias("recent_back"),
    )
    overall, latest = ratio(F.col("back"), F.col("items")), F.coalesce(ratio(F.col("recent_back"), F.col("recent_items")), F.lit(0.0))
    seasoned = F.col("orders") >= min_orders
    value = F.when(overall > 0, F.try_divide(latest, overall)).otherwise(F.when(latest == 0, 1.0).otherwise(5.0))
    vs = F.when(seasoned, value).otherwise(1.0)
    return sums.select(
        ID,
        F.when(seasoned, latest).otherwise(0.0).alias("recent_return_rate"),
        vs.alias("recent_vs_avg_ratio"),
        F.when(seasoned, F.greatest(F.lit(3), F.floor(F.col("orders") * 0.25))).otherwise(0).cast("bigint").alias("recent_order_count"),
        flag(vs > 1.5).alias("return_trend_increasing"),
        flag(vs < 0.5).alias("return_trend_decreasing"),
    )


def _last_orders(orders: DataFrame) -> DataFrame:
    """Rank from the newest order, by blocks of bounded size however many orders a customer has."""
    ranked = with_running(orders, ID, "seen", ["sales_order_no"], row_number="_oldest", size="orders")
    return ranked.withColumn("newest", F.col("orders") - F.col("_oldest") + 1).drop("_oldest")


def return_timing_stats(lines: DataFrame) -> DataFrame:
    gap = whole_days(F.col("order_date"), F.col("return_date"))
    timed = lines.where(is_returned() & F.col("return_date").isNotNull()).select(ID, gap.alias("gap"))
    return timed.groupBy(ID).agg(
        F.avg("gap").alias("avg_days_to_return"),
        F.coalesce(F.stddev_samp("gap"), F.lit(0.0)).alias("return_timing_consistency"),
        F.min("gap").alias("days_to_first_return"),
        (F.max("gap") - F.min("gap")).alias("return_timing_spread"),
    )


def returns_per_order(lines: DataFrame) -> DataFrame:
    per_order = lines.where(is_returned()).groupBy(ID, "sales_order_no").agg(F.count(F.lit(1)).alias("n"))
    return per_order.groupBy(ID).agg(F.avg("n").alias("avg_returns_per_order"))


def return_intensity(lines: DataFrame) -> DataFrame:
    back = F.when(is_returned(), ratio(F.col("return_qty"), F.col("sales_qty")))
    return only_returners(lines).groupBy(ID).agg(
        F.coalesce(F.avg(back), F.lit(0.0)).alias("avg_return_intensity"),
        ratio(F.sum(flag(is_returned())), F.countDistinct("sales_order_no")).alias("return_frequency_ratio"),
    )


# What the segmenting columns read of a line.
LINE_COLUMNS = [ID, "sales_order_no", "order_date", "sku", "sales_qty", "return_qty", "return_date"]


def clustering_frame(lines: DataFrame) -> DataFrame:
    """The seventeen columns this variant segments on, rounded to 3 digits.

    The lines are joined once and folded to orders once; both are checkpointed, and all columns start from them.
    """
    fixed = checkpoint(lines.select(*LINE_COLUMNS))
    mine = checkpoint(_returning(checkpoint(_by_order(fixed))))
    out = _volume(mine, fixed).join(_recent_vs_avg(mine), ID, "left")
    return out.select(ID, *[round_to(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), 3).alias(c) for c in CLUSTER_FEATURES])


def interpret(summary: DataFrame, limits: DataFrame) -> DataFrame:
    """Segment type and action per cluster from population quantiles.

    ``limits`` is the one-row frame of :func:`segment_limits`. The two early
    alert rules are always overridden by the later chain, so they are left out.
    """
    c, q = F.col, lambda n: F.col(f"_row.{n}")
    high_rate, low_recent = c("avg_return_rate") >= q("rate_75"), c("avg_recent_orders") <= q("recent_25")
    full = c("avg_return_intensity") >= q("intensity_75")
    rules = [
        (high_rate & (c("avg_return_ratio") >= q("ratio_75")), "HIGH RISK - Heavy Returners", "Immediate retention intervention needed"),
        ((c("avg_returns_per_order") >= q("per_order_75")) & full, "BULK RETURNERS - High Volume Per Order", "Order size limits + return policy review"),
        (full & (c("avg_days_to_return") <= 7), "FAST FULL RETURNERS - Quick Complete Returns", "Product education + sizing guides"),
        (high_rate & low_recent, "CHURN RISK - High Returns + Low Engagement", "Re-engagement campaign with better recommendations"),
        ((c("avg_orders") >= q("orders_75")) & (c("avg_return_rate") <= q("rate_25")), "VIP - High Volume Low Returns", "Premium loyalty rewards program"),
        ((c("avg_orders") >= q("orders_75")) & high_rate, "COMPLEX - High Volume High Returns", "Personalized service + product quality review"),
        (c("avg_product_variety") >= q("variety_75"), "EXPLORERS - High Product Variety", "Product discovery campaigns"),
        (low_recent, "AT RISK - Low Recent Activity", "Win-back campaign"),
    ]
    out = with_row(summary, limits)
    return out.select(
        *summary.columns,
        first_match([(r[0], r[1]) for r in rules], "STANDARD - Balanced Customers").alias("cluster_type"),
        first_match([(r[0], r[2]) for r in rules], "Standard marketing engagement").alias("action"),
    )
