"""Segment profiles, priorities and report tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from backflow.features.returners import interpret
from backflow.functions.expressions import ID, first_match, round_to, unpivot, with_row
from backflow.operators.pivots import stacked, top_per_group
from backflow.operators.prepare import CLUSTER_GROUPS
from backflow.operators.quantiles import column_quantiles, quantile_row

N = lambda: F.count(F.lit(1))
METHOD = "DBSCAN_KMEANS_SUBDBSCAN"


def report_base(results: DataFrame, silver: DataFrame, gold: DataFrame) -> DataFrame:
    """Results with their silver and gold columns."""
    return results.join(silver, ID, "left").join(gold, ID, "left")


# --- profiles -------------------------------------------------------------------------------------


def cluster_profile(df: DataFrame, cols: list[str], label: str = "cluster") -> DataFrame:
    """Size, share and feature means per cluster, noise left out."""
    clean = df.where(F.col(label) != -1)
    total = clean.select(N()).scalar()
    return clean.groupBy(label).agg(
        N().alias("size"), *[F.avg(c).alias(f"avg_{c}") for c in cols],
        F.avg("outlier_score").alias("outlier_score_mean"), F.avg("feature_completeness_score").alias("completeness_score_mean"),
    ).withColumn("percentage", 100.0 * F.col("size") / total)


def cluster_summary_table(df: DataFrame, label: str = "cluster", method: str = METHOD) -> DataFrame:
    """Rows of the ``cluster_summary`` table."""
    p = cluster_profile(df, ["return_rate", "sales_order_no_nunique", "customer_lifetime_days"], label)
    return p.select(
        F.col(label).alias("cluster_id"), F.lit(method).alias("clustering_method"), F.col("size").cast("int").alias("customer_count"),
        F.col("percentage").alias("percentage_of_total"), F.col("avg_return_rate"), F.col("avg_sales_order_no_nunique").alias("avg_order_count"),
        F.col("avg_customer_lifetime_days").alias("avg_lifetime_days"), F.col("completeness_score_mean").alias("avg_completeness_score"),
    )


def result_rows(df: DataFrame, label: str = "cluster", method: str = METHOD) -> DataFrame:
    """Rows of the ``clustering_results`` table."""
    return df.select(
        ID, F.col(label).cast("int").alias("final_cluster_id"), F.lit(method).alias("clustering_method"),
        F.current_timestamp().cast("timestamp_ntz").alias("clustering_timestamp"), F.col("feature_completeness_score").alias("cluster_quality_score"),
    )


def _archetype_rules(rate: str, orders: str, days: str) -> list[tuple[Column, str, str]]:
    # Archetype names and strategies in rule order.
    r, o, d = F.col(rate), F.col(orders), F.col(days)
    return [
        (r > 0.4, "High Returners", "Focus on return reason analysis and quality improvement"),
        ((r < 0.1) & (o > 20), "Loyal Customers", "Retention programs and premium service offerings"),
        ((d > 730) & (o > 15), "Veteran Shoppers", "Loyalty rewards and exclusive experiences"),
        (d < 180, "New Customers", "Onboarding optimization and early engagement"),
        (o > 30, "Frequent Buyers", "Volume incentives and personalized recommendations"),
    ]


def archetype(profile: DataFrame, rate: str = "avg_return_rate", orders: str = "avg_order_count", days: str = "avg_lifetime_days") -> DataFrame:
    rules = _archetype_rules(rate, orders, days)
    return profile.withColumns({
        "business_archetype": first_match([(c, name) for c, name, _ in rules], "Regular Customers"),
        "recommended_strategy": first_match([(c, s) for c, _, s in rules], "Balanced engagement and satisfaction monitoring"),
    })


SHEET = {
    "avg_return_rate": "return_rate", "avg_order_count": "sales_order_no_nunique", "avg_lifetime_days": "customer_lifetime_days",
    "avg_order_size": "avg_order_size", "avg_product_variety": "sku_nunique", "avg_return_variety": "return_product_variety",
    "avg_days_to_return": "avg_days_to_return", "avg_behavior_stability": "behavior_stability_score",
    "avg_completeness_score": "feature_completeness_score",
}
OPTIONAL_SHEET = {"avg_category_diversity": "category_diversity_score", "avg_quality_score": "cluster_quality_score"}


def cluster_profiles_sheet(df: DataFrame, label: str = "cluster") -> DataFrame:
    """Means, the median rate, outliers, archetype and strategy per cluster (noise left out)."""
    clean = df.where(F.col(label) != -1)
    sheet = SHEET | {k: v for k, v in OPTIONAL_SHEET.items() if v in df.columns}
    medians = column_quantiles(clean, ["return_rate"], {"median_return_rate": 0.5}, [label]).drop("feature")
    total = clean.select(N()).scalar()
    rows = clean.groupBy(label).agg(
        N().alias("customer_count"), *[F.avg(c).alias(name) for name, c in sheet.items()],
        F.count_if(F.col("outlier_score") < -0.5).alias("outlier_customers"),
    )
    return archetype(rows.join(medians, label).withColumn("percentage_of_total", 100.0 * F.col("customer_count") / total))


def assignments(df: DataFrame, label: str = "cluster") -> DataFrame:
    """Customer to cluster with archetype, outlier mark and key metrics."""
    names = cluster_profiles_sheet(df, label).select(label, "business_archetype")
    # One row per cluster.
    return df.join(F.broadcast(names), label, "left").select(
        ID, label, "business_archetype", (F.col(label) == -1).alias("is_outlier"), "return_rate", "sales_order_no_nunique",
        "customer_lifetime_days", "avg_order_size", "items_returned_count", "outlier_score", "feature_completeness_score",
    )


def executive_summary(df: DataFrame, label: str = "cluster") -> DataFrame:
    """(metric, value): totals, shares, averages, then one row per cluster size."""
    noise = F.col(label) == -1
    row = df.agg(
        N().alias("total_customers"), F.count_if(~noise).alias("clustered_customers"), F.count_if(noise).alias("noise_customers"),
        F.countDistinct(F.when(~noise, F.col(label))).alias("clusters"), (100.0 * F.count_if(~noise) / N()).alias("clustered_pct"),
        (100.0 * F.count_if(noise) / N()).alias("noise_pct"), F.avg("return_rate").alias("avg_return_rate"),
        F.avg("customer_lifetime_days").alias("avg_lifetime_days"), F.avg("sales_order_no_nunique").alias("avg_order_count"),
    )
    sizes = df.where(~noise).groupBy(label).agg(N().cast("double").alias("value"))
    return stacked(row).unionByName(sizes.select(F.concat(F.lit("cluster_"), F.col(label).cast("string")).alias("metric"), "value"))


def quality_rating(score: Column) -> Column:
    return first_match([(score > 0.7, "Excellent"), (score > 0.5, "Good"), (score > 0.3, "Fair")], "Poor")


def final_report(summary: DataFrame, totals: DataFrame, silhouette: float | None = None) -> dict[str, DataFrame]:
    """The report as tables: totals with rating, profiles by size, recommendations.

    ``summary`` holds one row per cluster, ``totals`` one row with
    ``total_customers``, ``clustered_customers`` and ``noise_customers``.
    """
    head = totals.withColumns({
        "clustered_pct": F.try_divide(100.0 * F.col("clustered_customers"), F.col("total_customers")),
        "noise_pct": F.try_divide(100.0 * F.col("noise_customers"), F.col("total_customers")),
        "quality_rating": quality_rating(F.lit(silhouette)) if silhouette is not None else F.lit(None).cast("string"),
    })
    profiles = archetype(summary).orderBy(F.desc("customer_count"), "cluster_id")
    return {"summary": head, "profiles": profiles, "recommendations": recommendations(summary, totals)}


def recommendations(summary: DataFrame, totals: DataFrame) -> DataFrame:
    """(topic, clusters, customers) for the rules that apply."""
    n, size = F.col("customer_count"), F.col("_totals.clustered_customers")
    high, large, small = F.col("avg_return_rate") > 0.3, n > size * 0.15, n < size * 0.05
    counts = with_row(summary, totals, "_totals").agg(*[
        x for name, cond in (("high_return_rate", high), ("major_segments", large), ("niche_segments", small))
        for x in (F.count_if(cond).alias(f"{name}_c"), F.coalesce(F.sum(F.when(cond, n)), F.lit(0)).alias(f"{name}_n"))
    ])
    item = lambda topic, c, k: F.struct(F.lit(topic).alias("topic"), c.cast("bigint").alias("clusters"), k.cast("bigint").alias("customers"))
    rows = [item(t, F.col(f"{t}_c"), F.col(f"{t}_n")) for t in ("high_return_rate", "major_segments", "niche_segments")]
    rows.append(item("outliers", F.lit(0), F.col("_totals.noise_customers")))
    return with_row(counts, totals, "_totals").select(F.explode(F.array(*rows)).alias("r")).select("r.*").where("clusters > 0 OR (topic = 'outliers' AND customers > 0)")


def quality_metrics(scores: DataFrame, df: DataFrame, silhouette: float | None = None, label: str = "cluster") -> DataFrame:
    """(metric_category, metric_name, value): layer scores, coverage and averages."""
    named = lambda cat, name, val: F.struct(F.lit(cat).alias("metric_category"), F.lit(name).alias("metric_name"), val.alias("value"))
    row = df.agg(
        (100.0 * F.count_if(F.col(label) != -1) / N()).alias("coverage"), F.avg("feature_completeness_score").alias("complete"),
    )
    items = [named("Coverage", "Customer Coverage Rate", F.col("coverage")), named("Completeness", "Average Feature Completeness", F.col("complete"))]
    if silhouette is not None:
        items.append(named("Clustering Quality", "Silhouette Score", F.lit(float(silhouette))))
    layers = scores.select(
        F.lit("Data Quality").alias("metric_category"), F.concat("layer", F.lit(" Quality Score")).alias("metric_name"), F.col("data_quality_score").alias("value")
    )
    return layers.unionByName(row.select(F.explode(F.array(*items)).alias("m")).select("m.*"))


def technical_details(df: DataFrame, config: dict) -> DataFrame:
    """(section, parameter, value): feature counts per group and run parameters."""
    rows = [("features", g, str(len([c for c in cols if c in df.columns]))) for g, cols in CLUSTER_GROUPS.items()]
    rows += [("configuration", k, str(v)) for k, v in sorted(config.items())]
    return df.sparkSession.createDataFrame(rows, "section string, parameter string, value string")


def distinctive_features(df: DataFrame, cols: list[str], top: int = 5, label: str = "cluster") -> DataFrame:
    """Per cluster the features furthest above and below the overall mean (percent)."""
    long = unpivot(df.where(F.col(label) != -1), [label], cols)
    overall = long.groupBy("feature").agg(F.avg("value").alias("base"))
    means = long.groupBy(label, "feature").agg(F.avg("value").alias("m"))
    gap = F.try_divide(100.0 * (F.col("m") - F.col("base")), F.abs("base"))
    gaps = means.join(overall, "feature").select(label, "feature", gap.alias("deviation_pct")).where("deviation_pct IS NOT NULL")
    # clusters x features rows: small whatever the number of customers.
    high = top_per_group(gaps.where("deviation_pct > 0"), label, [F.desc("deviation_pct"), F.col("feature")], top).withColumn("direction", F.lit("high"))
    low = top_per_group(gaps.where("deviation_pct < 0"), label, [F.asc("deviation_pct"), F.col("feature")], top).withColumn("direction", F.lit("low"))
    return high.unionByName(low)


# --- variant: segments of returners ------------------------------------------------------------------

SUMMARY_NAMES = {
    "avg_orders": "sales_order_no_nunique", "avg_return_rate": "return_rate", "avg_return_ratio": "return_ratio",
    "avg_items_returned": "items_returned_count", "avg_lifetime_days": "customer_lifetime_days", "avg_recent_orders": "recent_orders",
    "avg_recent_returns": "recent_returns", "avg_product_variety": "sku_nunique", "avg_order_size": "sales_qty_mean",
    "avg_days_to_return": "avg_days_to_return", "avg_return_timing_spread": "return_timing_spread",
    "avg_returns_per_order": "avg_returns_per_order", "avg_return_frequency_ratio": "return_frequency_ratio",
    "avg_return_intensity": "avg_return_intensity", "avg_recent_vs_avg_ratio": "recent_vs_avg_ratio",
    "avg_return_trend_increasing": "return_trend_increasing",
}


def returner_summary(df: DataFrame, label: str = "cluster") -> DataFrame:
    """Rounded means and the customer count per cluster."""
    return df.groupBy(label).agg(N().alias("customer_count"), *[round_to(F.avg(c), 3).alias(n) for n, c in SUMMARY_NAMES.items()])


def segment_limits(df: DataFrame) -> DataFrame:
    """Population quantiles behind the segment rules, one row."""
    return quantile_row(df, {
        "rate_75": ("return_rate", 0.75), "rate_25": ("return_rate", 0.25), "ratio_75": ("return_ratio", 0.75),
        "orders_75": ("sales_order_no_nunique", 0.75), "recent_25": ("recent_orders", 0.25), "intensity_75": ("avg_return_intensity", 0.75),
        "per_order_75": ("avg_returns_per_order", 0.75), "variety_75": ("sku_nunique", 0.75), "orders_90": ("sales_order_no_nunique", 0.9),
    })


def segment_types(df: DataFrame, label: str = "cluster") -> DataFrame:
    """Cluster summary with segment type and action."""
    return interpret(returner_summary(df, label), segment_limits(df))


def level_profile(df: DataFrame, cols: list[str], label: str = "cluster") -> DataFrame:
    """HIGH / LOW / MODERATE of each cluster mean against the population quartiles."""
    means = unpivot(df, [label], cols).groupBy(label, "feature").agg(round_to(F.avg("value"), 3).alias("value"))
    limits = column_quantiles(df, cols, {"p25": 0.25, "p75": 0.75})
    level = first_match([(F.col("value") >= F.col("p75"), "HIGH"), (F.col("value") <= F.col("p25"), "LOW")], "MODERATE")
    return means.join(F.broadcast(limits), "feature").select(label, "feature", "value", level.alias("level"))


def distinguishing_features(levels: DataFrame, label: str = "cluster") -> DataFrame:
    """Features that are HIGH or LOW per cluster, as one text."""
    marked = levels.where(F.col("level") != "MODERATE")
    return marked.groupBy(label).agg(F.array_join(F.array_sort(F.collect_list("feature")), ", ").alias("distinguishing_features"))


def priority_matrix(types: DataFrame, limits: DataFrame) -> DataFrame:
    """Business value, risk and opportunity (0 to 10), their mean and the focus."""
    out = with_row(types, limits)
    total = types.select(F.sum("customer_count")).scalar()
    c, q = F.col, lambda n: F.col(f"_row.{n}")
    pts = lambda cond, n: F.when(cond, n).otherwise(0)
    share = 100.0 * c("customer_count") / c("_total")
    names = lambda *parts: F.coalesce(sum((c("cluster_type").contains(p).cast("int") for p in parts), F.lit(0)) > 0, F.lit(False))
    value = (
        first_match([(c("avg_orders") >= q("orders_90"), 4), (c("avg_orders") >= q("orders_75"), 2)], 0)
        + pts(c("avg_lifetime_days") >= 500, 2) + pts(share >= 15, 2) + pts(c("avg_recent_orders") >= 3, 2)
    )
    risk = pts(c("avg_return_rate") >= q("rate_75"), 3) + pts(c("avg_recent_orders") <= q("recent_25"), 3) + pts(names("CHURN", "HIGH RISK"), 4)
    chance = (
        first_match([(names("VIP", "CHAMPION"), 4), (names("EXPLORER"), 3), (names("STANDARD"), 2)], 0)
        + pts(c("avg_recent_orders") >= 2, 2) + pts(c("_value") >= 6, 2)
    )
    scored = out.withColumn("_total", total).withColumn("_value", value).withColumn("_risk", risk).withColumn("_chance", chance)
    ten = F.lit(10)
    return scored.select(
        "cluster", "cluster_type", "customer_count", share.alias("percentage"), F.least("_value", ten).alias("business_value_score"),
        F.least("_risk", ten).alias("risk_score"), F.least("_chance", ten).alias("opportunity_score"),
        round_to((c("_value") + c("_risk") + c("_chance")) / 3.0, 1).alias("overall_priority"),
        first_match([(c("_risk") >= 6, "Retention"), (c("_chance") >= 6, "Growth")], "Maintenance").alias("primary_focus"),
    ).orderBy(F.desc("overall_priority"), "cluster")


def segment_match(types: DataFrame) -> DataFrame:
    """Suggested segment per cluster from its means and how well the rule type agrees."""
    c = F.col
    has = lambda *parts: sum((c("cluster_type").contains(p).cast("int") for p in parts), F.lit(0)) > 0
    cases = [
        ((c("avg_orders") > 50) & (c("avg_return_rate") < 0.3), "VIP CHAMPIONS", has("VIP")),
        ((c("avg_return_rate") > 0.6) & (c("avg_return_ratio") > 0.5), "HEAVY RETURNERS", has("HEAVY", "HIGH RISK")),
        ((c("avg_recent_orders") < 2) & (c("avg_orders") > 10), "CHURN RISK", has("CHURN", "AT RISK")),
        (c("avg_product_variety") > 100, "EXPLORERS", has("EXPLORER")),
    ]
    verdict = lambda good, otherwise="MISMATCH": F.when(good, "STRONG MATCH").otherwise(otherwise)
    return types.select(
        "cluster", "cluster_type", "customer_count",
        first_match([(cond, name) for cond, name, _ in cases], "STANDARD/BALANCED").alias("expected_segment"),
        first_match([(cond, verdict(good)) for cond, _, good in cases], verdict(has("STANDARD"), "ACCEPTABLE")).alias("match_quality"),
    )


def match_overview(types: DataFrame) -> DataFrame:
    """Clusters with a known rule type, and the largest and smallest share."""
    known = sum((F.col("cluster_type").contains(p).cast("int") for p in ("VIP", "HEAVY", "HIGH RISK", "CHURN", "AT RISK", "EXPLORER", "STANDARD")), F.lit(0)) > 0
    total = types.select(F.sum("customer_count")).scalar()
    shares = types.withColumn("pct", round_to(100.0 * F.col("customer_count") / total, 1))
    return shares.agg(F.count_if(known).alias("strong_matches"), N().alias("clusters"), F.max("pct").alias("largest_pct"), F.min("pct").alias("smallest_pct"))


def campaign_lists(labels: DataFrame, types: DataFrame) -> DataFrame:
    """(campaign, customer) for the risk and loyalty clusters."""
    has = lambda *parts: sum((F.col("cluster_type").contains(p).cast("int") for p in parts), F.lit(0)) > 0
    # One row per cluster.
    picked = types.select("cluster", first_match([(has("HIGH RISK", "CHURN RISK"), "high_risk"), (has("LOYAL"), "loyal")], F.lit(None).cast("string")).alias("campaign"))
    return labels.join(F.broadcast(picked.where("campaign IS NOT NULL")), "cluster").select("campaign", "cluster", ID)


def labelled_export(df: DataFrame, types: DataFrame) -> DataFrame:
    return df.join(F.broadcast(types.select("cluster", "cluster_type")), "cluster", "left")


def sample_lists(labels: DataFrame, k: int = 100) -> DataFrame:
    """First ``k`` ids per cluster."""
    return top_per_group(labels.select("cluster", ID), "cluster", [F.col(ID)], k)
