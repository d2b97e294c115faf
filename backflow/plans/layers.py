"""Silver, gold and segment builds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from backflow.features import current as now
from backflow.functions.expressions import ID
from backflow.operators.quantiles import quantile_scalar
from backflow.operators import dbscan as db, joins, kmeans as km, outliers, prepare as pre, quality
from backflow.operators.clean import complete_to_schema
from backflow.plans import report
from backflow.schemas import GOLD, SILVER
from backflow.session import checkpoint, stored
from backflow.sources.readers import scan_gold, scan_silver

TOTALS = ("total_sales_qty", "total_return_qty")


# What the feature groups read of a line.
LINE_COLUMNS = [
    ID, "sales_order_no", "order_date", "q_sku_id", "sales_qty", "gross", "return_qty", "return_date", "q_cls_id", "class_",
]


def merged_features(bronze: DataFrame) -> DataFrame:
    """Every feature group side by side; all joins are on the customer key.

    The lines are read once: the columns that the groups use are stored, and every group reads its own of them from that table.
    Each group's customer rows are checkpointed before the next group begins, so that no more than one group's shuffles lie on disk; so are the
    finished rows.
    """
    bronze = stored(bronze.select(*LINE_COLUMNS))
    groups = {
        "core": now.core_table(bronze),
        "category": checkpoint(now.category_intelligence(bronze)),
        "consecutive": checkpoint(now.consecutive_returns(bronze)),
        "adjacency": checkpoint(now.adjacency(bronze)),
        "seasonal": checkpoint(now.seasonal(bronze)),
        "trend": checkpoint(now.trend(bronze)),
    }
    return checkpoint(joins.merge_feature_groups(groups, "core"))


def build_silver(bronze: DataFrame) -> DataFrame:
    """Features, imputation, metadata and per-row flags in the silver schema.

    The merged frame is a checkpoint: the column means would otherwise run
    every feature job a second time.
    """
    merged = merged_features(bronze.where(F.col(ID).isNotNull()))
    filled = pre.zero_fill(pre.drop_missing_core(merged))
    rest = [c for c in filled.columns if c not in pre.ZERO_FILLED and c not in pre.CORE_COLUMNS and c not in TOTALS]
    numeric = [c for c, t in filled.dtypes if c in rest and t in ("double", "bigint", "int")]
    whole = pre.mean_fill(filled, numeric).withColumns({
        "customer_emailid_cleaned": F.lower(F.trim(ID)),
        "product_category_loyalty": F.col("category_loyalty_score"),
        "feature_calculation_date": F.current_timestamp().cast("timestamp_ntz"),
    })
    return complete_to_schema(quality.with_quality_flags(whole), SILVER)


def build_gold(
    silver: DataFrame, method: str = "robust", contamination: float = 0.05, variance_threshold: float = 0.01,
    correlation_threshold: float | None = None, advanced: bool = False,
) -> tuple[DataFrame, dict]:
    """Selected, filled and scaled features with outlier score, completeness and flags."""
    rows = scan_silver(silver)
    chosen = pre.drop_null_features(rows, pre.select_features(rows))
    offered = list(chosen)
    if correlation_threshold is not None:
        chosen = pre.drop_correlated(rows, chosen, correlation_threshold)
    filled = pre.fill_by_name(rows.select(ID, *chosen), chosen)
    chosen = pre.drop_low_variance(filled, chosen, variance_threshold)
    meta: dict = {"offered": offered, "scaling_method": method, "contamination": contamination}
    if advanced:
        # The event is an outlier flag where the frame has one, else completeness above its median.
        judged = filled if "outlier_flag" in filled.columns else pre.completeness(filled, chosen)
        event = F.col("outlier_flag") if "outlier_flag" in filled.columns else F.col("feature_completeness_score") > quantile_scalar(judged, "feature_completeness_score", 0.5)
        chosen, meta["advanced"] = pre.advanced_selection(checkpoint(judged.withColumn("_event", event)), chosen, F.col("_event").cast("boolean"))
    meta["selected"] = chosen
    scored = checkpoint(outliers.isolation_forest(filled.select(ID, *chosen), chosen, contamination))
    scaled = pre.gold_flags(pre.completeness(pre.scale(scored, chosen, method), chosen))
    stamped = scaled.withColumns({
        "processing_timestamp": F.current_timestamp().cast("timestamp_ntz"),
        "scaling_method": F.lit("RobustScaler" if method == "robust" else "StandardScaler"),
    })
    return complete_to_schema(stamped, GOLD), meta


# Default clustering parameters.
CONFIG = {
    "dbscan_eps": 0.5, "dbscan_min_samples": 5, "k_values": list(range(3, 15)), "n_init": 20, "sub_eps": 0.3, "sub_min_samples": 3,
    "min_silhouette": 0.3, "max_noise_ratio": 0.15, "pca_components": None,
}


def run_clustering(gold: DataFrame, config: dict | None = None) -> tuple[DataFrame, dict]:
    """(customer, cluster) labels: density pass, centroid pass on the rest, density inside clusters."""
    cfg = CONFIG | (config or {})
    rows, features, _ = scan_gold(gold)
    used = pre.drop_null_features(rows, features)
    vectors = km.to_vectors(rows, used, ID)
    if cfg["pca_components"]:
        vectors = km.pca(vectors, cfg["pca_components"])[0].select("id", F.col("pca").alias("v"))
    vectors = checkpoint(vectors)
    first = checkpoint(db.dbscan(vectors, cfg["dbscan_eps"], cfg["dbscan_min_samples"]))
    noise = first.where("cluster = -1").select("id")
    shares = db.dbscan_summary(first, cfg["max_noise_ratio"]).first().asDict()
    if shares["n_clusters"] == 0:
        # Nothing dense at this radius: segment all customers rather than none.
        noise = noise.limit(0)
    clean = vectors.join(noise, "id", "left_anti")
    n_clean = clean.count()
    ks = [k for k in cfg["k_values"] if k < n_clean]
    search = km.kmeans_search(clean, ks, cfg["n_init"])
    k, candidates = km.choose_k(search, cfg["min_silhouette"])
    main, figures = km.kmeans_final(vectors, k, noise, cfg["n_init"])
    refined, info = db.sub_dbscan(vectors, checkpoint(main), cfg["sub_eps"], cfg["sub_min_samples"])
    labels = refined.select(F.col("id").alias(ID), F.col("final_id").alias("cluster"))
    meta = {"config": cfg, "dbscan": shares, "k": k, "candidates": candidates, "kmeans": figures, "sub_clusters": [r.asDict() for r in info.collect()]}
    return labels, meta


def report_tables(labels: DataFrame, silver: DataFrame, gold: DataFrame, meta: dict) -> dict[str, DataFrame]:
    """The named report tables of one clustering run."""
    base = report.report_base(labels, silver.drop("data_quality_flags"), gold.select(ID, "outlier_score", "feature_completeness_score"))
    # The quality of a customer's assignment is the completeness of the features behind it.
    base = checkpoint(base.withColumn("cluster_quality_score", F.col("feature_completeness_score")))
    noise = F.col("cluster") == -1
    totals = base.agg(F.count(F.lit(1)).alias("total_customers"), F.count_if(~noise).alias("clustered_customers"), F.count_if(noise).alias("noise_customers"))
    score = meta["kmeans"]["silhouette_score"]
    summary = report.cluster_summary_table(base)
    parts = report.final_report(summary, totals, score)
    return {
        "executive_summary": report.executive_summary(base),
        "cluster_profiles": report.cluster_profiles_sheet(base),
        "customer_assignments": report.assignments(base),
        "cluster_summary": summary,
        "report_summary": parts["summary"],
        "recommendations": parts["recommendations"],
        "feature_importance": pre.between_within_ratio(base, ["return_rate", "sales_order_no_nunique", "customer_lifetime_days", "avg_order_size"]),
        "technical_details": report.technical_details(base, {k: v for k, v in meta["config"].items()}),
    }
