"""Data-quality checks and validation reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from backflow.functions.expressions import ID, any_of, joined_flags, with_row
from backflow.operators.pivots import stacked

N = lambda: F.count(F.lit(1))

# Warning rules (column, low, high, warn above) per feature group.
RANGE_RULES = [
    ("sales_qty_mean", None, None, 15.0), ("avg_order_size", None, None, 10.0),
    ("return_rate", 0.0, 1.0, None), ("return_ratio", 0.0, 1.0, None), ("return_frequency_ratio", 0.0, 1.0, None),
    ("return_intensity", 0.0, 1.0, None), ("return_product_variety", None, None, 25.0), ("avg_returns_per_order", None, None, 8.0),
    ("consecutive_returns", None, None, 6.0), ("avg_consecutive_returns", None, None, 3.0),
    ("avg_days_to_return", 0.0, None, 60.0), ("return_timing_spread", None, None, 45.0), ("behavior_stability_score", 0.0, 1.0, None),
    ("category_diversity_score", None, None, 1.5), ("category_loyalty_score", 0.0, 1.0, None), ("high_return_category_affinity", 0.0, 1.0, None),
    ("sku_adjacency_timing", None, None, 14.0), ("sku_adjacency_return_timing", None, None, 14.0),
    ("trend_product_category_order_rate", -1.0, 1.0, None), ("trend_product_category_return_rate", -1.0, 1.0, None),
    ("avg_order_value", 0.0, 100.0, None), ("avg_return_value", 0.0, 100.0, None), ("high_value_return_affinity", 0.0, 100.0, None),
]


def check_ranges(df: DataFrame, rules: list[tuple] = RANGE_RULES) -> DataFrame:
    """Per rule: values outside the range, above the warning level and NULL; one pass."""
    present = [r for r in rules if r[0] in df.columns]
    structs = []
    aggs = []
    for i, (c, lo, hi, warn) in enumerate(present):
        bounds = [F.col(c) < lo] if lo is not None else []
        bounds += [F.col(c) > hi] if hi is not None else []
        aggs += [
            F.count_if(any_of(bounds) if bounds else F.lit(False)).alias(f"o{i}"),
            F.count_if(F.col(c) > warn if warn is not None else F.lit(False)).alias(f"w{i}"),
            F.count_if(F.col(c).isNull()).alias(f"n{i}"),
        ]
        structs.append(F.struct(
            F.lit(c).alias("feature"), F.col(f"o{i}").alias("out_of_range"), F.col(f"w{i}").alias("above_warning"), F.col(f"n{i}").alias("nulls"),
        ))
    return df.agg(*aggs).select(F.explode(F.array(*structs)).alias("r")).select("r.*")


def feature_tests() -> dict[str, list[tuple[str, Column]]]:
    """Assertions per feature group; a test passes when the condition holds on every row."""
    c = F.col
    nonneg = lambda col: (f"{col}_non_negative", c(col) >= 0)
    positive = lambda col: (f"{col}_positive", c(col) > 0)
    within = lambda col, lo, hi: (f"{col}_in_range", c(col).between(lo, hi))
    return {
        "basic_volume": [
            positive("sales_order_no_nunique"), positive("sku_nunique"), nonneg("items_returned_count"), positive("sales_qty_mean"),
            positive("avg_order_size"), ("reasonable_order_sizes", c("avg_order_size") <= 50), ("reasonable_qty_mean", c("sales_qty_mean") <= 100),
        ],
        "return_behavior": [
            within("return_rate", 0, 1), within("return_ratio", 0, 1), within("return_frequency_ratio", 0, 1),
            # Returned units per returned line are at least one, so only the sign can be tested.
            nonneg("return_intensity"), nonneg("return_product_variety"), nonneg("avg_returns_per_order"),
        ],
        "temporal": [
            nonneg("customer_lifetime_days"), nonneg("avg_days_to_return"), nonneg("return_timing_spread"),
            ("valid_tenure_stages", c("customer_tenure_stage").isin("New", "Growing", "Mature", "Veteran")),
        ],
        "category": [within("category_loyalty_score", 0, 1), within("high_return_category_affinity", 0, 1), nonneg("category_diversity_score")],
        "adjacency": [nonneg("sku_adjacency_orders"), nonneg("sku_adjacency_returns"), nonneg("sku_adjacency_timing"), nonneg("sku_adjacency_return_timing")],
        "seasonal": [nonneg("seasonal_susceptibility_orders"), nonneg("seasonal_susceptibility_returns")],
        "trend": [within("trend_product_category_order_rate", -1, 1), within("trend_product_category_return_rate", -1, 1)],
        "monetary": [
            within("avg_order_value", 0, 100), within("avg_return_value", 0, 100), within("high_value_return_affinity", 0, 100),
            ("no_nulls", c("avg_order_value").isNotNull() & c("avg_return_value").isNotNull() & c("high_value_return_affinity").isNotNull()),
        ],
    }


def feature_group_tests(groups: dict[str, DataFrame]) -> DataFrame:
    """Rows (feature_group, test, passed) for every group present."""
    out = None
    for group, tests in feature_tests().items():
        if group not in groups:
            continue
        aggs = [F.coalesce(F.every(F.coalesce(cond, F.lit(False))), F.lit(True)).alias(name) for name, cond in tests]
        if group == "monetary":
            aggs.append((F.coalesce(F.avg("high_value_return_affinity"), F.lit(0)) <= 50).alias("reasonable_high_value_returns"))
        row = groups[group].agg(*aggs)
        part = row.unpivot([], row.columns, "test", "passed").select(F.lit(group).alias("feature_group"), "test", "passed")
        out = part if out is None else out.unionByName(part)
    return out


CORE = ["sales_order_no_nunique", "customer_lifetime_days", "sku_nunique", "first_order_date", "last_order_date"]
ZERO_CHECKED = ["return_rate", "return_ratio", "avg_returns_per_order", "return_frequency_ratio", "items_returned_count"]


def validate_silver(df: DataFrame) -> DataFrame:
    """Rows (check, value, passed); ``passed`` is NULL for plain figures.

    A failing row blocks the silver write.
    """
    # Ids fold to one row each first, so the duplicate count is a plain sum.
    per_id = df.groupBy(ID).agg(N().alias("n")).agg(F.sum(F.col("n") - 1).alias("d")).select(F.coalesce("d", F.lit(0)))
    share = lambda cond: 100.0 * F.count_if(cond) / N()
    figures: dict[str, tuple[Column, str | None]] = {
        "total_customers": (N(), None),
        "missing_ids": (F.count_if(F.col(ID).isNull()), "zero"),
    }
    for c in df.columns:
        if c != ID:
            figures[f"nulls_{c}"] = (F.count_if(F.col(c).isNull()), "zero" if c in CORE else None)
    for c in ZERO_CHECKED:
        if c in df.columns:
            figures[f"zero_pct_{c}"] = (share(F.col(c) == 0), "at_most_95")
    figures |= {
        "return_rate_out_of_range": (F.count_if((F.col("return_rate") < 0) | (F.col("return_rate") > 1)), "zero"),
        "negative_lifetime": (F.count_if(F.col("customer_lifetime_days") < 0), "zero"),
        "first_date_after_last_date": (F.count_if(F.col("first_order_date") > F.col("last_order_date")), "zero"),
        "avg_return_rate": (F.avg("return_rate"), None),
        "avg_order_count": (F.avg("sales_order_no_nunique"), None),
        "avg_lifetime_days": (F.avg("customer_lifetime_days"), None),
        "zero_return_rate_pct": (share(F.col("return_rate") == 0), None),
    }
    rules = {name: rule for name, (_, rule) in figures.items()} | {"duplicate_ids": "zero"}
    row = df.agg(*[expr.cast("double").alias(name) for name, (expr, _) in figures.items()]).withColumn("duplicate_ids", per_id.scalar().cast("double"))
    zero = [n for n, r in rules.items() if r == "zero"]
    warn = [n for n, r in rules.items() if r == "at_most_95"]
    verdict = F.when(F.col("check").isin(zero), F.col("value") == 0).when(F.col("check").isin(warn), F.col("value") <= 95)
    return stacked(row, "check").withColumn("passed", verdict).withColumn("blocking", F.col("check").isin(zero))


def silver_passes(report: DataFrame) -> bool:
    return report.where(F.col("blocking") & ~F.col("passed")).limit(1).count() == 0


def quality_flag_column() -> Column:
    return joined_flags([
        (F.col("return_rate") > 0.95, "HIGH_RETURN_RATE"),
        (F.col("avg_days_to_return") > 60, "LATE_RETURNS"),
        (F.col("consecutive_returns") > 10, "HIGH_CONSECUTIVE_RETURNS"),
    ])


def with_quality_flags(df: DataFrame) -> DataFrame:
    """Flags of each row. (The flags of the whole data set: :func:`dataset_flags`.)"""
    return df.withColumn("data_quality_flags", quality_flag_column())


def dataset_flags(df: DataFrame) -> DataFrame:
    """One string naming every flag that any customer carries."""
    any_row = df.agg(
        F.max("return_rate").alias("return_rate"), F.max("avg_days_to_return").alias("avg_days_to_return"),
        F.max("consecutive_returns").alias("consecutive_returns"),
    )
    return any_row.select(quality_flag_column().alias("data_quality_flags"))


def issue_summary(issues: DataFrame) -> DataFrame:
    """Unresolved issues per type, most frequent first."""
    return issues.where(~F.col("resolved")).groupBy("issue_type").agg(N().alias("issue_count")).orderBy(F.desc("issue_count"), "issue_type")


def layer_counts(bronze: DataFrame, silver: DataFrame, gold: DataFrame) -> DataFrame:
    """(layer, metric, value): rows, customers, orders, returns, classes, totals and day span."""
    sizes = bronze.agg(
        N().alias("total_records"), F.countDistinct(ID).alias("unique_customers"), F.countDistinct("sales_order_no").alias("unique_orders"),
        F.countDistinct("q_sku_id").alias("unique_skus"), F.countDistinct("class_").alias("unique_classes"),
        F.sum("sales_qty").alias("total_sales_qty"), F.sum("return_qty").alias("total_return_qty"),
        F.count_if(F.col("return_qty") > 0).alias("records_with_returns"),
        F.datediff(F.max("order_date"), F.min("order_date")).alias("span_days"),
    )
    parts = [
        stacked(sizes).withColumn("layer", F.lit("bronze")),
        stacked(silver.agg(N().alias("customer_features_count"))).withColumn("layer", F.lit("silver")),
        stacked(gold.agg(N().alias("processed_customers_count"))).withColumn("layer", F.lit("gold")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def quality_report(lines: DataFrame, raw_id: str = "customer_emailid_raw") -> DataFrame:
    """Labelled counts with their share (percent), from one pass over the lines."""
    back = F.col("return_qty") > 0
    no_comment = F.col("return_comment").isNull() | (F.trim("return_comment") == "")
    row = lines.agg(
        N().alias("n"), F.count_if(back).alias("back"), F.count_if(back & no_comment).alias("silent"),
        F.count_if(F.col("data_quality_flags").like("%RETURN_DATE%")).alias("fixed"),
        (F.countDistinct(raw_id) - F.countDistinct(F.lower(raw_id))).alias("cased"),
    )
    line = lambda name, n, share: F.struct(F.lit(name).alias("check_type"), F.col(n).alias("count"), share.alias("percentage"))
    pct = lambda n, d: F.round(F.try_divide(100.0 * F.col(n), F.col(d)), 2)
    none = F.lit(None).cast("double")
    return row.select(F.explode(F.array(
        line("Total records", "n", none), line("Records with returns", "back", pct("back", "n")),
        line("Missing return comments", "silent", pct("silent", "back")), line("Return date issues fixed", "fixed", pct("fixed", "n")),
        line("Duplicate emails (case)", "cased", none),
    )).alias("r")).select("r.*")


def layer_quality_scores(bronze: DataFrame, silver: DataFrame, gold: DataFrame) -> DataFrame:
    """Score (percent) per layer: unflagged lines, valid customers, clean gold rows."""
    pct = lambda good, n: F.coalesce(F.try_divide(100.0 * good, n), F.lit(0.0))
    b = bronze.agg(pct(F.count_if(F.col("data_quality_flags") == ""), N()).alias("s"), N().alias("n"), F.count_if(F.col("data_quality_flags") != "").alias("bad"))
    wrong = (F.col("return_rate") > 1) | (F.col("return_rate") < 0) | (F.col("customer_lifetime_days") < 0)
    s = silver.agg((F.coalesce(F.avg("feature_completeness_score"), F.lit(0.0)) * 100).alias("s"), N().alias("n"), F.count_if(wrong).alias("bad"))
    g = gold.agg(
        pct(F.count_if(F.coalesce("data_quality_flags", F.lit("")) == ""), N()).alias("s"), N().alias("n"), F.count_if(F.col("outlier_score") < -0.5).alias("bad")
    )
    shape = lambda f, layer: f.select(F.lit(layer).alias("layer"), F.col("n").alias("records"), F.col("bad").alias("problem_records"), F.col("s").alias("data_quality_score"))
    return shape(b, "Bronze Layer").unionByName(shape(s, "Silver Layer")).unionByName(shape(g, "Gold Layer"))


def source_consistency(lines: DataFrame) -> DataFrame:
    """(test, passed): flag agrees with quantity, dates parse, rates per customer in [0, 1]."""
    yes = F.col("units_returned_flag") == "Yes"
    row = lines.agg(
        F.every(~yes | (F.col("return_qty") > 0)).alias("returned_has_quantity"),
        F.every((F.col("units_returned_flag") != "No") | (F.col("return_qty") == 0)).alias("kept_has_no_quantity"),
        F.every(F.col("order_date").isNotNull()).alias("order_date_parses"),
    )
    rate = F.try_divide(F.sum("return_qty").cast("double"), F.sum("sales_qty").cast("double"))
    rates = lines.groupBy(ID).agg(rate.alias("r")).agg(F.every(F.coalesce(F.col("r").between(0, 1), F.lit(True))).alias("rate_in_range"))
    whole = row.withColumn("rate_in_range", rates.scalar())
    return whole.unpivot([], whole.columns, "test", "passed")


def null_summary(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """(column, null_count) from one aggregate."""
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols or df.columns])
    return row.unpivot([], row.columns, "column", "null_count")


def variant_summary(df: DataFrame) -> DataFrame:
    return df.agg(
        N().alias("total_customers"), F.avg("sales_order_no_nunique").alias("avg_orders_per_customer"), F.avg("sku_nunique").alias("avg_skus_per_customer"),
        F.avg("return_rate").alias("avg_return_rate"), F.count_if(F.col("items_returned_count") > 0).alias("customers_with_returns"),
        F.count_if(F.col("recent_orders") > 0).alias("recent_active_customers"),
    )


def score_statistics(df: DataFrame, col: str) -> DataFrame:
    return df.agg(F.min(col).alias("min_score"), F.max(col).alias("max_score"), F.avg(col).alias("avg_score"), F.stddev_samp(col).alias("std_score"))


def score_histogram(df: DataFrame, col: str, bins: int = 50) -> DataFrame:
    """Counts in equal-width bins, left-closed; the maximum falls in the last bin."""
    ends = df.agg(F.min(col).alias("lo"), F.max(col).alias("hi"))
    pos = F.try_divide((F.col(col) - F.col("_row.lo")) * bins, F.col("_row.hi") - F.col("_row.lo"))
    bin_no = F.least(F.floor(F.coalesce(pos, F.lit(0.0))) + 1, F.lit(bins)).cast("bigint")
    return with_row(df.where(F.col(col).isNotNull()), ends).groupBy(bin_no.alias("bin")).agg(N().alias("n"))
