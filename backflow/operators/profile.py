"""Exploratory profiles of lines and customers."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from backflow.features.current import is_returned, order_returns, return_streak_starts
from backflow.functions.expressions import ID, banded, calendar_days, guarded_corr, ratio, round_to, season, with_row
from backflow.operators.ordered import with_running
from backflow.operators.pivots import stacked
from backflow.operators.quantiles import column_quantiles, quantile_row
from backflow.session import checkpoint

N = lambda: F.count(F.lit(1))


def join_rows(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two one-row frames side by side."""
    return with_row(left, right).select(*left.columns, *[F.col(f"_row.{c}").alias(c) for c in right.columns])


#: Figures of the overview: name, aggregate, column.
OVERVIEW = [
    *((f"unique_{name}", "count_distinct", col) for name, col in (("customers", ID), ("orders", "sales_order_no"), ("skus", "q_sku_id"), ("classes", "q_cls_id"))),
    ("earliest_order", "min", "order_date"), ("latest_order", "max", "order_date"),
    *((f"{kind}_{col}" if kind == "avg" else f"total_{col}", kind, col) for kind in ("sum", "avg") for col in ("sales_qty", "return_qty")),
]


def overview(lines: DataFrame) -> DataFrame:
    return lines.agg(N().alias("total_records"), *[getattr(F, kind)(col).alias(name) for name, kind, col in OVERVIEW])


def activity_averages(lines: DataFrame) -> DataFrame:
    """Mean distinct orders and returns per customer."""
    per = lines.groupBy(ID).agg(F.countDistinct("sales_order_no").alias("o"), F.countDistinct("return_no").alias("r"))
    return per.agg(F.avg("o").alias("avg_unique_orders_per_customer"), F.avg("r").alias("avg_unique_returns_per_customer"))


def customer_totals(lines: DataFrame) -> DataFrame:
    """Customer grain used by the distribution profiles."""
    return lines.groupBy(ID).agg(
        F.countDistinct("sales_order_no").alias("order_count"), N().alias("item_count"),
        F.countDistinct("q_sku_id").alias("product_variety"), F.countDistinct("q_cls_id").alias("category_variety"),
        F.sum("sales_qty").alias("total_sales_qty"), F.avg("sales_qty").alias("sales_qty_mean"),
        ratio(F.sum("return_qty"), F.sum("sales_qty")).alias("return_rate"),
        ratio(N(), F.countDistinct("sales_order_no")).alias("avg_order_size"),
        calendar_days(F.min("order_date"), F.max("order_date")).alias("lifetime_days"),
    )


def customer_distribution(lines: DataFrame) -> DataFrame:
    c = customer_totals(lines)
    plain = c.agg(
        N().alias("customer_count"), F.avg("order_count").alias("avg_orders_per_customer"), F.avg("total_sales_qty").alias("avg_total_qty_purchased"),
        F.avg("return_rate").alias("avg_return_rate"), F.avg("lifetime_days").alias("avg_customer_lifetime_days"), F.avg("avg_order_size").alias("avg_order_size"),
        F.max("order_count").alias("max_orders"), F.max("total_sales_qty").alias("max_qty_purchased"), F.max("return_rate").alias("max_return_rate"),
        F.max("avg_order_size").alias("max_order_size"),
    )
    return join_rows(plain, quantile_row(c, {"median_orders": ("order_count", 0.5), "median_return_rate": ("return_rate", 0.5)}))


def metric_distributions(lines: DataFrame) -> DataFrame:
    """mean, std, min, quartiles, p95, p99 and max of four customer metrics."""
    metrics = ["sales_qty_mean", "avg_order_size", "return_rate", "product_variety"]
    # Cut once: the plain figures and the quantiles start from the customer rows, not from the lines.
    c = checkpoint(customer_totals(lines).select(ID, *metrics))
    probs = {"q25": 0.25, "median": 0.5, "q75": 0.75, "p95": 0.95, "p99": 0.99}
    long = c.select(ID, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(ID, metrics, "feature", "value")
    plain = long.groupBy("feature").agg(
        F.avg("value").alias("mean_val"), F.stddev_samp("value").alias("std_val"), F.min("value").alias("min_val"), F.max("value").alias("max_val")
    )
    return plain.join(column_quantiles(c, metrics, probs), "feature").withColumnRenamed("feature", "metric")


def return_timing_profile(lines: DataFrame) -> DataFrame:
    gap = calendar_days(F.col("order_date"), F.col("return_date"))
    per = (
        lines.where(is_returned() & F.col("return_date").isNotNull()).groupBy(ID)
        .agg(F.avg(gap).alias("avg_days"), F.stddev_samp(gap).alias("spread"))
    )
    plain = per.agg(
        N().alias("customers_with_returns"), F.avg("avg_days").alias("overall_avg_days_to_return"), F.max("avg_days").alias("max_avg_days_to_return"),
        F.avg("spread").alias("avg_timing_spread"), F.count_if(F.col("avg_days") > 60).alias("customers_over_60_days"),
        F.count_if(F.col("avg_days") < 0).alias("customers_negative_days"),
    )
    marks = {"median_avg_days_to_return": ("avg_days", 0.5), "p95_avg_days_to_return": ("avg_days", 0.95), "p95_timing_spread": ("spread", 0.95)}
    return join_rows(plain, quantile_row(per, marks))


TENURE_STAGES = [(90, "New (≤90 days)"), (180, "Growing (91-180 days)"), (365, "Mature (181-365 days)"), (730, "Established (1-2 years)")]


def tenure_profile(lines: DataFrame) -> DataFrame:
    c = customer_totals(lines).withColumn("tenure_stage", banded(F.col("lifetime_days"), TENURE_STAGES, "Veteran (>2 years)"))
    stages = c.groupBy("tenure_stage").agg(N().alias("customer_count"), F.avg("lifetime_days").alias("avg_lifetime_days"), F.avg("order_count").alias("avg_orders"))
    total = lines.select(F.countDistinct(ID)).scalar()
    return stages.withColumn("percentage", round_to(100.0 * F.col("customer_count") / total, 2)).orderBy("avg_lifetime_days")


def consecutive_profile(lines: DataFrame) -> DataFrame:
    """Streak lengths per customer; orders of one instant share a running count.

    Returned orders fold to one row per instant, the running number of starts up
    to and including the instant names the streak, and lengths add up.
    """
    starts = return_streak_starts(order_returns(lines)).where("has_returns = 1")
    instants = starts.groupBy(ID, "order_date").agg(F.sum("starts").alias("starts"), N().alias("orders"))
    named = with_running(instants, ID, "order_date", [], sums={"streak": "starts"})
    lengths = named.groupBy(ID, "streak").agg(F.sum("orders").alias("len"))
    per = lengths.groupBy(ID).agg(N().alias("events"), F.max("len").alias("longest"), F.avg("len").alias("mean_len"))
    plain = per.agg(
        N().alias("customers_with_consecutive_returns"), F.avg("longest").alias("avg_max_consecutive"), F.max("longest").alias("overall_max_consecutive"),
        F.avg("mean_len").alias("avg_avg_consecutive"), F.count_if(F.col("longest") > 10).alias("customers_over_10_consecutive"),
    )
    return join_rows(plain, quantile_row(per, {"p95_max_consecutive": ("longest", 0.95)}))


def category_profile(lines: DataFrame) -> DataFrame:
    c = customer_totals(lines).select("category_variety", "product_variety")
    plain = c.agg(
        F.avg("category_variety").alias("avg_categories_per_customer"), F.max("category_variety").alias("max_categories"),
        F.avg("product_variety").alias("avg_products_per_customer"), F.max("product_variety").alias("max_products"),
        F.count_if(F.col("category_variety") > 50).alias("customers_over_50_categories"), F.count_if(F.col("product_variety") > 50).alias("customers_over_50_products"),
    )
    return join_rows(plain, quantile_row(c, {"p95_categories": ("category_variety", 0.95), "p95_products": ("product_variety", 0.95)}))


SEASON_NAMES = {"Fall": "Fall (Oct-Dec)", "Winter": "Winter (Jan-Mar)", "Spring": "Spring (Apr-Jun)", "Summer": "Summer (Jul-Sep)"}


def season_profile(lines: DataFrame) -> DataFrame:
    """Active customers, items ordered, units returned and their ratio per season."""
    folded = lines.groupBy(season(F.col("order_date")).alias("s"), ID).agg(N().alias("n"), F.sum("return_qty").alias("back"))
    stats = folded.groupBy("s").agg(
        N().alias("active_customers"), F.sum("n").alias("total_items_ordered"), F.sum("back").alias("total_items_returned")
    )
    names = F.create_map(*[F.lit(x) for pair in SEASON_NAMES.items() for x in pair])
    rank = F.array_position(F.array(*[F.lit(s) for s in SEASON_NAMES]), F.col("s"))
    return stats.orderBy(rank).select(
        names[F.col("s")].alias("season"), "active_customers", "total_items_ordered", "total_items_returned",
        round_to(100.0 * F.col("total_items_returned") / F.col("total_items_ordered"), 2).alias("return_rate_pct"),
    )


def eligibility(lines: DataFrame, min_orders: int = 50, min_days: int = 730, gate_orders: int = 1) -> DataFrame:
    c = customer_totals(lines)
    pct = lambda n: round_to(100.0 * n / N(), 2)
    long_lived, busy = F.count_if(F.col("lifetime_days") > min_days), F.count_if(F.col("order_count") >= min_orders)
    return c.agg(
        N().alias("total_customers"), long_lived.alias("customers_over_2_years"), pct(long_lived).alias("pct_over_2_years"),
        busy.alias(f"customers_{min_orders}plus_orders"), pct(busy).alias(f"pct_{min_orders}plus_orders"), F.count_if(F.col("order_count") >= gate_orders).alias("customers_with_sufficient_orders"),
    )


def silver_summary(silver: DataFrame) -> DataFrame:
    """(metric, value): averages, shares, zero fills and completeness per group."""
    pct = lambda cond: 100.0 * F.count_if(cond) / N()
    aggs: dict[str, Column] = {
        "customer_count": N(), "avg_return_rate": F.avg("return_rate"), "avg_orders": F.avg("sales_order_no_nunique"),
        "avg_lifetime_days": F.avg("customer_lifetime_days"), "veteran_customers": F.count_if(F.col("customer_tenure_stage") == "Veteran"),
        "high_return_customers": F.count_if(F.col("return_rate") > 0.5), "zero_return_customers": F.count_if(F.col("return_rate") == 0),
        "zero_return_rate_pct": pct(F.col("return_rate") == 0), "zero_return_variety_pct": pct(F.col("return_product_variety") == 0),
        "completeness_basic_volume": pct(F.col("sales_order_no_nunique") > 0), "completeness_temporal": pct(F.col("customer_lifetime_days") > 0),
        "completeness_returns": pct(F.col("return_rate") > 0),
    }
    if "sku_adjacency_orders" in silver.columns:
        aggs["completeness_adjacency"] = pct(F.col("sku_adjacency_orders") > 0)
    for c in ("category_diversity_score", "avg_order_value"):
        if c in silver.columns:
            aggs[f"avg_{c}"] = F.avg(c)
    return stacked(silver.agg(*[e.cast("double").alias(n) for n, e in aggs.items()]))


def business_insights(df: DataFrame, value: str = "avg_order_value") -> DataFrame:
    """P90 limits of return rate and order value and the customers at or above them."""
    limits = quantile_row(df, {"high_return_rate_threshold": ("return_rate", 0.9), "high_value_threshold": (value, 0.9)})
    rate, worth = F.col("return_rate") >= F.col("_row.high_return_rate_threshold"), F.col(value) >= F.col("_row.high_value_threshold")
    return with_row(df, limits).agg(
        N().alias("total_customers"), F.count_if(rate).alias("high_return_customers"), F.count_if(worth).alias("high_value_customers"),
        F.count_if(rate & worth).alias("high_return_high_value"), F.avg("customer_lifetime_days").alias("avg_customer_lifetime_days"),
        F.avg("return_rate").alias("avg_return_rate"), F.avg(value).alias("avg_order_value"),
        F.max("_row.high_return_rate_threshold").alias("high_return_rate_threshold"), F.max("_row.high_value_threshold").alias("high_value_threshold"),
    )


def correlations(df: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """(feature_group, feature_a, feature_b, correlation): every pair of a group in one aggregate."""
    pairs = [(g, a, b) for g, cols in groups.items() for a, b in combinations([c for c in cols if c in df.columns], 2)]
    row = df.agg(*[guarded_corr(F.col(a), F.col(b)).alias(f"c{i}") for i, (_, a, b) in enumerate(pairs)])
    structs = [
        F.struct(F.lit(g).alias("feature_group"), F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"), F.col(f"c{i}").alias("correlation"))
        for i, (g, a, b) in enumerate(pairs)
    ]
    return row.select(F.explode(F.array(*structs)).alias("r")).select("r.*")


def high_correlations(df: DataFrame, cols: list[str], limit: float = 0.8) -> DataFrame:
    return correlations(df, {"all": cols}).where(F.abs("correlation") > limit).drop("feature_group")


def tenure_return_rate(silver: DataFrame) -> DataFrame:
    stages = F.array(*[F.lit(s) for s in ("New", "Growing", "Mature", "Veteran")])
    rates = silver.where(F.col("return_rate") <= 1.0).groupBy("customer_tenure_stage").agg(F.avg("return_rate").alias("mean_return_rate"), N().alias("customers"))
    return rates.withColumn("stage_order", F.array_position(stages, F.col("customer_tenure_stage"))).orderBy("stage_order")


def comment_stats(lines: DataFrame, comment: str = "return_comment", key: str = ID) -> DataFrame:
    """Distinct comments on returns per customer with their number: one row per customer and comment."""
    said = lines.where(is_returned() & F.col(comment).isNotNull() & (F.col(comment) != ""))
    return said.groupBy(key, F.col(comment).alias("comment")).agg(N().alias("returns_with_comment"))


def category_by_cluster(lines_with_cluster: DataFrame) -> DataFrame:
    return lines_with_cluster.where(F.col("cluster").isNotNull()).groupBy("cluster", "q_cls_id").agg(
        F.sum("return_qty").alias("return_qty"), F.countDistinct(ID).alias("customers")
    )


def date_parse_profile(lines: DataFrame, text: str, fmt: str) -> DataFrame:
    """How return-date text parses under one format, and the day gaps it gives."""
    parsed = F.try_to_timestamp(F.col(text), F.lit(fmt)).cast("timestamp_ntz")
    gap = F.when(is_returned() & parsed.isNotNull(), calendar_days(F.col("order_date"), parsed))
    return lines.agg(
        N().alias("total_records"), F.count_if(is_returned()).alias("returned_records"), F.count_if(F.col(text) != "-").alias("non_dash_dates"),
        F.count(parsed).alias("parsed_dates"), F.min(gap).alias("min_days"), F.max(gap).alias("max_days"), F.avg(gap).alias("avg_days"),
    )


def gold_summary(gold: DataFrame) -> DataFrame:
    clean = F.coalesce("data_quality_flags", F.lit("")) == ""
    return gold.agg(
        N().alias("total_customers"), F.avg("feature_completeness_score").alias("avg_completeness"),
        F.count_if(F.col("outlier_score") < -0.5).alias("extreme_outliers"),
        F.count_if(F.col("data_quality_flags").like("%LOW_COMPLETENESS%")).alias("low_completeness_customers"),
        F.count_if(clean).alias("clean_customers"), (100.0 * F.count_if(clean) / N()).alias("ready_pct"),
        F.count_if(~clean).alias("flagged_customers"), F.count_if(F.col("outlier_score") < 0).alias("negative_scores"),
    )
