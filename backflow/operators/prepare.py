"""Imputation, scaling and feature selection on customer-grain frames."""

from __future__ import annotations

from itertools import combinations_with_replacement

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from backflow.functions.expressions import ID, joined_flags, unpivot, with_row
from backflow.operators import forest
from backflow.operators.pivots import equal_width_bins
from backflow.operators.profile import correlations
from backflow.operators.quantiles import column_quantiles, quantile_row

N = lambda: F.count(F.lit(1))

# Columns whose absence drops a customer, and columns filled with zero.
CORE_COLUMNS = ["sales_order_no_nunique", "sku_nunique", "sales_qty_mean", "customer_lifetime_days", "first_order_date", "last_order_date"]
ZERO_FILLED = [
    "items_returned_count", "return_rate", "return_ratio", "return_product_variety", "avg_returns_per_order", "return_frequency_ratio",
    "return_intensity", "consecutive_returns", "avg_consecutive_returns", "avg_days_to_return", "return_timing_spread", "recent_returns",
    "recent_vs_avg_ratio", "high_return_category_affinity", "sku_adjacency_returns", "sku_adjacency_return_timing",
    "seasonal_susceptibility_returns", "trend_product_category_return_rate",
]
# Feature groups offered to clustering.
CLUSTER_GROUPS = {
    "volume_metrics": ["sales_order_no_nunique", "sku_nunique", "items_returned_count", "sales_qty_mean", "avg_order_size"],
    "return_behavior": ["return_rate", "return_ratio", "return_product_variety", "avg_returns_per_order", "return_frequency_ratio", "return_intensity"],
    "temporal_patterns": ["customer_lifetime_days", "avg_days_to_return", "return_timing_spread"],
    "recency_trends": ["recent_orders", "recent_returns", "recent_vs_avg_ratio", "behavior_stability_score"],
    "category_intelligence": ["category_diversity_score", "category_loyalty_score", "high_return_category_affinity"],
    "adjacency_patterns": ["sku_adjacency_orders", "sku_adjacency_returns", "sku_adjacency_timing", "sku_adjacency_return_timing"],
    "seasonal_trends": ["seasonal_susceptibility_orders", "seasonal_susceptibility_returns"],
    "trend_susceptibility": ["trend_product_category_order_rate", "trend_product_category_return_rate"],
}
# Non-zero share an advanced group's feature must exceed; the other groups are always kept.
MIN_SHARE = {"category_intelligence": 0.1, "adjacency_patterns": 0.05, "seasonal_trends": 0.05, "trend_susceptibility": 0.1}


# --- imputation -------------------------------------------------------------------------------


def drop_missing_core(df: DataFrame) -> DataFrame:
    return df.dropna(subset=[c for c in CORE_COLUMNS if c in df.columns])


def zero_fill(df: DataFrame) -> DataFrame:
    filled = df.na.fill(0, [c for c in ZERO_FILLED if c in df.columns])
    return filled.na.fill("New", ["customer_tenure_stage"]) if "customer_tenure_stage" in df.columns else filled


def _numeric(df: DataFrame) -> list[str]:
    kinds = {"double", "float", "integer", "long", "short", "byte"}
    return [f.name for f in df.schema.fields if f.dataType.typeName() in kinds]


def mean_fill(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """NULLs of the remaining numeric columns become the column mean (one aggregate)."""
    cols = cols or [c for c in _numeric(df) if c not in ZERO_FILLED and c not in CORE_COLUMNS]
    if not cols:
        return df
    means = df.agg(*[F.avg(c).alias(c) for c in cols])
    out = with_row(df, means, "_means")
    return out.withColumns({c: F.coalesce(F.col(c).cast("double"), F.col(f"_means.{c}")) for c in cols}).drop("_means")


def fill_rule(name: str) -> str:
    """How a column is filled, by its name; the first matching rule wins."""
    n = name.lower()
    if "rate" in n or "ratio" in n or "count" in n or "nunique" in n:
        return "zero"
    return "median" if "days" in n or "score" in n else "zero"


def fill_by_name(df: DataFrame, cols: list[str]) -> DataFrame:
    medians = [c for c in cols if fill_rule(c) == "median"]
    out = with_row(df, quantile_row(df, {c: (c, 0.5) for c in medians}), "_medians") if medians else df
    values = {c: F.coalesce(F.col(c).cast("double"), F.col(f"_medians.{c}") if c in medians else F.lit(0.0)) for c in cols}
    return out.withColumns(values).drop("_medians")


def imputation_flags(df: DataFrame, cols: list[str]) -> DataFrame:
    """Names of the columns that will be imputed per row, and their number."""
    missing = [(F.col(c).isNull(), c) for c in cols]
    return df.withColumns({
        "imputed_columns": joined_flags(missing, ","),
        "imputed_count": sum((F.when(cond, 1).otherwise(0) for cond, _ in missing), F.lit(0)),
    })


# --- scaling -----------------------------------------------------------------------------------


def scaling_stats(df: DataFrame, cols: list[str], method: str = "robust") -> DataFrame:
    """One row of centre and width per column (width 1 where it would be 0)."""
    if method == "robust":
        wanted = {}
        for c in cols:
            wanted |= {f"{c}_center": (c, 0.5), f"{c}_q25": (c, 0.25), f"{c}_q75": (c, 0.75)}
        q = quantile_row(df, wanted)
        width = lambda c: F.col(f"{c}_q75") - F.col(f"{c}_q25")
        return q.select(*[x for c in cols for x in (F.col(f"{c}_center"), F.when(width(c) == 0, 1.0).otherwise(width(c)).alias(f"{c}_width"))])
    if method == "standard":
        row = df.agg(*[x for c in cols for x in (F.avg(c).alias(f"{c}_center"), F.stddev_pop(c).alias(f"{c}_width"))])
        return row.withColumns({f"{c}_width": F.when(F.col(f"{c}_width") == 0, 1.0).otherwise(F.col(f"{c}_width")) for c in cols})
    raise ValueError(f"unsupported scaling method: {method}")


def apply_scaling(df: DataFrame, stats: DataFrame, cols: list[str]) -> DataFrame:
    out = with_row(df, stats, "_stats")
    scaled = {f"{c}_scaled": (F.col(c).cast("double") - F.col(f"_stats.{c}_center")) / F.col(f"_stats.{c}_width") for c in cols}
    return out.withColumns(scaled).drop("_stats")


def scale(df: DataFrame, cols: list[str], method: str = "robust") -> DataFrame:
    return apply_scaling(df, scaling_stats(df, cols, method), cols)


def minmax_rescale(df: DataFrame, silver: DataFrame, col: str, out: str) -> DataFrame:
    """(x - min) / (max - min) with both ends over the positive silver values."""
    ends = silver.where(F.col(col) > 0).agg(F.min(col).alias("lo"), F.max(col).alias("hi"))
    x = F.col(col)
    value = F.try_divide(x - F.col("_ends.lo"), F.col("_ends.hi") - F.col("_ends.lo"))
    return with_row(df, ends, "_ends").withColumn(out, value).drop("_ends")


def inverse_scale_centers(centers: DataFrame, stats: DataFrame, cols: list[str]) -> DataFrame:
    out = with_row(centers, stats, "_stats")
    return out.withColumns({c: F.col(c) * F.col(f"_stats.{c}_width") + F.col(f"_stats.{c}_center") for c in cols}).drop("_stats")


def completeness(df: DataFrame, cols: list[str]) -> DataFrame:
    """Share of unscaled features that are present and not zero."""
    filled = sum((F.when(F.col(c) != 0, 1).otherwise(0) for c in cols), F.lit(0))
    return df.withColumn("feature_completeness_score", filled / F.lit(float(len(cols))))


def gold_flags(df: DataFrame) -> DataFrame:
    """LOW_COMPLETENESS below 0.3, EXTREME_OUTLIER below the first percentile of the score."""
    low = F.when(F.col("feature_completeness_score") < 0.3, "LOW_COMPLETENESS;").otherwise("")
    cut = quantile_row(df, {"p01": ("outlier_score", 0.01)})
    extreme = F.when(F.col("outlier_score") < F.col("_cut.p01"), "EXTREME_OUTLIER;").otherwise("")
    return with_row(df, cut, "_cut").withColumn("data_quality_flags", F.concat(low, extreme)).drop("_cut")


# --- selection -----------------------------------------------------------------------------------
# Selection works on statistics per column (or pair of columns): a handful of
# numbers reach the driver, never rows.


def select_features(df: DataFrame) -> list[str]:
    """Core groups always; an advanced feature by its non-zero share (NULL counts as non-zero)."""
    advanced = [(c, limit) for g, limit in MIN_SHARE.items() for c in CLUSTER_GROUPS[g] if c in df.columns]
    keep = [c for g, cols in CLUSTER_GROUPS.items() if g not in MIN_SHARE for c in cols if c in df.columns]
    if advanced:
        shares = nonzero_shares(df, [c for c, _ in advanced]).first()
        keep += [c for c, limit in advanced if (shares[c] or 0.0) > limit]
    return keep


def nonzero_shares(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.agg(*[F.avg(F.when(F.col(c) == 0, 0.0).otherwise(1.0)).alias(c) for c in cols])


def drop_null_features(df: DataFrame, cols: list[str]) -> list[str]:
    present = df.agg(*[F.count(c).alias(c) for c in cols]).first()
    return [c for c in cols if present[c] > 0]


def variances(df: DataFrame, cols: list[str], population: bool = False) -> DataFrame:
    """(feature, variance) rows."""
    f = F.var_pop if population else F.var_samp
    row = df.agg(*[f(c).alias(c) for c in cols])
    return unpivot(row, [], cols, "feature", "variance")


def drop_low_variance(df: DataFrame, cols: list[str], threshold: float = 0.01) -> list[str]:
    kept = {r["feature"] for r in variances(df, cols).where(F.col("variance") >= threshold).collect()}
    return [c for c in cols if c in kept]


def correlated_to_drop(pairs: list[tuple[str, str]]) -> list[str]:
    """From high pairs in column order: of two features still in, the one in more pairs leaves."""
    seen: dict[str, int] = {}
    for pair in pairs:
        for name in pair:
            seen[name] = seen.get(name, 0) + 1
    out: list[str] = []
    for a, b in pairs:
        if a not in out and b not in out:
            out.append(a if seen[a] > seen[b] else b)
    return out


def drop_correlated(df: DataFrame, cols: list[str], threshold: float = 0.8) -> list[str]:
    rows = correlations(df, {"all": cols}).where(F.abs("correlation") > threshold).collect()
    high = {(r["feature_a"], r["feature_b"]) for r in rows}
    ordered = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:] if (a, b) in high]
    gone = set(correlated_to_drop(ordered))
    return [c for c in cols if c not in gone]


def vif(df: DataFrame, cols: list[str]) -> DataFrame:
    """Variance inflation without intercept: diagonal of G times diagonal of its inverse.

    The Gram matrix is one aggregate of p(p+1)/2 sums; only that matrix reaches the driver.
    """
    pairs = list(combinations_with_replacement(range(len(cols)), 2))
    x = lambda i: F.col(cols[i]).cast("double")
    sums = df.agg(*[F.sum(x(i) * x(j)).alias(f"g{i}_{j}") for i, j in pairs]).first()
    gram = np.zeros((len(cols), len(cols)))
    for i, j in pairs:
        gram[i, j] = gram[j, i] = sums[f"g{i}_{j}"] or 0.0
    # Scaling to a unit diagonal keeps the inverse stable for columns of very different size.
    size = np.sqrt(np.diag(gram))
    size[size == 0] = 1.0
    values = np.diag(np.linalg.pinv(gram / np.outer(size, size), hermitian=True))
    return df.sparkSession.createDataFrame([(c, float(v)) for c, v in zip(cols, values)], "feature string, vif double")


def _target(df: DataFrame, cols: list[str]) -> DataFrame:
    if "feature_completeness_score" in df.columns:
        return df.withColumn("_y", F.col("feature_completeness_score"))
    return completeness(df, cols).withColumnRenamed("feature_completeness_score", "_y")


#: The deepest that trees grow.
DEPTH = 30


def rf_importance(df: DataFrame, cols: list[str], trees: int = 100, seed: int = 42, depth: int = DEPTH) -> DataFrame:
    """(feature, importance) of a random forest on completeness. NULL counts as 0; ``depth`` is the most that trees may grow to."""
    data = _target(df, cols).fillna(0.0, cols).withColumn("_fold", F.lit(0))
    values = forest.importances(data, cols, [(None, seed)], trees, depth)[0]
    return df.sparkSession.createDataFrame([(c, float(v)) for c, v in zip(cols, values)], "feature string, importance double")


def importance_stability(df: DataFrame, cols: list[str], folds: int = 5, trees: int = 50, seed: int = 42, depth: int = DEPTH) -> DataFrame:
    """Mean, spread and coefficient of variation of importances over folds (split by id hash)."""
    data = _target(df, cols).fillna(0.0, cols).withColumn("_fold", F.pmod(F.xxhash64(ID), F.lit(folds)))
    runs = forest.importances(data, cols, [(k, seed + k) for k in range(folds)], trees, depth)
    mean, std = np.mean(runs, axis=0), np.std(runs, axis=0)
    rows = [(c, float(m), float(s), float(s / (m + 1e-10))) for c, m, s in zip(cols, mean, std)]
    return df.sparkSession.createDataFrame(rows, "feature string, mean_importance double, std_importance double, stability double")


def binned_long(df: DataFrame, keys: list[str], cols: list[str], n: int = 5) -> DataFrame:
    """(keys, feature, value, bin): right-closed quantile bins, repeated edges dropped."""
    probs = {f"q{i}": i / n for i in range(n)}
    edges = column_quantiles(df, cols, probs).select(
        "feature", F.col("q0").alias("lo"), F.array_distinct(F.array(*[F.col(f"q{i}") for i in range(1, n)])).alias("edges")
    )
    long = unpivot(df, keys, cols).where(F.col("value").isNotNull())
    # One row of edges per column: bounded by the column list.
    below = F.filter("edges", lambda e: (e > F.col("lo")) & (e < F.col("value")))
    return long.join(F.broadcast(edges), "feature").select(*keys, "feature", "value", (F.size(below) + 1).alias("bin"))


def information_value(df: DataFrame, cols: list[str], event: Column, bins: int = 5) -> DataFrame:
    """(feature, iv): quantile bins against a 0/1 event."""
    floor = F.lit(1e-10)
    flagged = df.withColumn("_event", F.when(event, 1.0).otherwise(0.0))
    per_bin = binned_long(flagged, ["_event"], cols, bins).groupBy("feature", "bin").agg(
        F.sum("_event").alias("e"), F.sum(1.0 - F.col("_event")).alias("n")
    )
    totals = per_bin.groupBy("feature").agg(F.sum("e").alias("te"), F.sum("n").alias("tn"))
    pe, pn = F.try_divide(F.col("e"), F.col("te")), F.try_divide(F.col("n"), F.col("tn"))
    weight = F.ln(F.greatest(pe, floor) / F.greatest(pn, floor))
    return per_bin.join(totals, "feature").groupBy("feature").agg(F.sum((pe - pn) * weight).alias("iv"))


def consolidate(spark: SparkSession, cols: list[str], flagged: dict[str, list[str]], min_flags: int = 2) -> DataFrame:
    """(feature, flags, methods, removed) over the methods' flag lists."""
    rows = [(c, sorted(m for m, names in flagged.items() if c in names)) for c in cols]
    data = [(c, len(m), ",".join(m), len(m) >= min_flags) for c, m in rows]
    return spark.createDataFrame(data, "feature string, flags int, methods string, removed boolean")


def advanced_selection(
    df: DataFrame, cols: list[str], event: Column, min_importance: float = 0.01, min_variance: float = 0.01,
    max_vif: float = 10.0, max_stability: float = 0.5, min_iv: float = 0.02,
) -> tuple[list[str], dict]:
    """Run the five methods, drop what two or more flag; metadata for the run log."""
    names = lambda frame, cond: [r["feature"] for r in frame.where(cond).collect()]
    flagged = {
        "high_vif": names(vif(df, cols), F.col("vif") > max_vif),
        "low_variance": names(variances(df, cols, population=True), F.col("variance") < min_variance),
        "low_importance": names(rf_importance(df, cols), F.col("importance") < min_importance),
        "unstable": names(importance_stability(df, cols), F.col("stability") > max_stability),
        "low_iv": names(information_value(df, cols, event), F.col("iv") < min_iv),
    }
    summary = consolidate(df.sparkSession, cols, flagged)
    removed = names(summary, F.col("removed"))
    kept = [c for c in cols if c not in removed]
    meta = {
        "original_features": cols, "optimized_features": kept, "removed_features": removed, "flagged_features": flagged,
        "parameters": {"min_importance": min_importance, "min_variance": min_variance, "max_vif": max_vif, "max_stability": max_stability, "min_iv": min_iv},
    }
    return kept, meta


def mutual_information(df: DataFrame, cols: list[str], target: str, bins: int = 5) -> DataFrame:
    """(feature, mi): mutual information of quantile-binned features with a class column."""
    joint = binned_long(df.where(F.col(target).isNotNull()), [target], cols, bins).groupBy("feature", "bin", target).agg(N().alias("n"))
    by_bin = joint.groupBy("feature", "bin").agg(F.sum("n").alias("nb"))
    by_class = joint.groupBy("feature", target).agg(F.sum("n").alias("nc"))
    total = joint.groupBy("feature").agg(F.sum("n").alias("t"))
    p = F.col("n") / F.col("t")
    term = p * F.ln(F.col("n") * F.col("t") / (F.col("nb") * F.col("nc")))
    return (
        joint.join(by_bin, ["feature", "bin"]).join(by_class, ["feature", target]).join(total, "feature")
        .groupBy("feature").agg(F.greatest(F.sum(term), F.lit(0.0)).alias("mi"))
    )


def pseudo_targets(df: DataFrame) -> DataFrame:
    """Class columns for feature ranking: streak level, order-return level and tenure."""
    out = df.withColumn("_rental", F.col("sales_order_no_nunique") * F.col("return_rate"))
    out = equal_width_bins(out, "consecutive_returns", 3).withColumnRenamed("bin", "churn_risk")
    out = equal_width_bins(out, "_rental", 3).withColumnRenamed("bin", "rental_candidate")
    return out.withColumn("marketing_segment", F.col("customer_tenure_stage")).drop("_rental")


def select_k_best(df: DataFrame, cols: list[str], target: str, k: int = 8) -> DataFrame:
    return mutual_information(df, cols, target).orderBy(F.desc("mi"), "feature").limit(k)


def anova_f(df: DataFrame, cols: list[str], target: str) -> DataFrame:
    """(feature, f_value): between-class over within-class mean squares."""
    long = unpivot(df, [target], cols).where(F.col("value").isNotNull())
    per = long.groupBy("feature", target).agg(N().alias("n"), F.avg("value").alias("m"), F.var_pop("value").alias("v"))
    all_ = per.groupBy("feature").agg(
        F.sum("n").alias("t"), N().alias("k"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("gm"), F.sum(F.col("n") * F.col("v")).alias("ssw")
    )
    between = per.join(all_.select("feature", "gm"), "feature").groupBy("feature").agg(F.sum(F.col("n") * F.pow(F.col("m") - F.col("gm"), F.lit(2))).alias("ssb"))
    f = F.try_divide(F.col("ssb") / (F.col("k") - 1), F.col("ssw") / (F.col("t") - F.col("k")))
    return all_.join(between, "feature").where("k > 1 AND t > k").select("feature", f.alias("f_value"))


def cluster_means_long(df: DataFrame, cols: list[str], label: str = "cluster") -> DataFrame:
    return unpivot(df, [label], cols).groupBy(label, "feature").agg(F.avg("value").alias("mean"))


def discriminative_features(df: DataFrame, cols: list[str], top: int = 15, label: str = "cluster") -> DataFrame:
    """Features by the variance of their cluster means (noise left out), largest first."""
    means = cluster_means_long(df.where(F.col(label) != -1), cols, label)
    return means.groupBy("feature").agg(F.var_pop("mean").alias("variance")).orderBy(F.desc("variance"), "feature").limit(top)


def cluster_feature_matrix(df: DataFrame, cols: list[str], clusters: list[int], top: int = 15, label: str = "cluster") -> DataFrame:
    best = discriminative_features(df, cols, top, label).select("feature")
    means = cluster_means_long(df.where(F.col(label) != -1), cols, label).join(best, "feature", "left_semi")
    return means.groupBy("feature").pivot(label, clusters).agg(F.first("mean")).select("feature", *[F.col(str(c)).alias(f"cluster_{c}") for c in clusters])


def between_within_ratio(df: DataFrame, cols: list[str], label: str = "cluster") -> DataFrame:
    """Mean squared gap of cluster means to the overall mean, over the sample variance."""
    long = unpivot(df, [label], cols)
    overall = long.groupBy("feature").agg(F.avg("value").alias("overall_mean"), F.var_samp("value").alias("within"), F.stddev_samp("value").alias("overall_std"))
    means = long.groupBy("feature", label).agg(F.avg("value").alias("m"))
    between = means.join(overall, "feature").groupBy("feature").agg(
        F.avg(F.pow(F.col("m") - F.col("overall_mean"), F.lit(2))).alias("between"),
    )
    score = F.when(F.col("within") > 0, F.col("between") / F.col("within")).otherwise(0.0)
    return overall.join(between, "feature").select(
        "feature", score.alias("importance_score"), F.col("between").alias("between_cluster_variance"),
        F.col("within").alias("within_cluster_variance"), "overall_mean", "overall_std",
    )
