"""Fixed table schemas (layers, results, helpers)."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(spec: str) -> T.StructType:
    kinds = {
        "s": T.StringType(), "i": T.IntegerType(), "d": T.DoubleType(), "t": T.TimestampNTZType(), "b": T.BooleanType(), "l": T.LongType(),
    }
    return T.StructType([T.StructField(n, kinds[k]) for n, k in (item.split(":") for item in spec.split())])


# Column names and types of the layer, result and helper tables.
BRONZE = _struct(
    "primary_key:s sales_order_no:s customer_emailid:s order_date:t sku:s sales_qty:i gross:d return_qty:i "
    "units_returned_flag:s return_date:t return_no:s return_comment:s orderlink:s q_cls_id:s q_sku_desc:s "
    "q_gmm_id:s q_sku_id:s class_:s division_:s brand_:s q_clr_dnum:s q_clr_desc:s vendor_style:s size_:s "
    "data_quality_flags:s"
)
SILVER = _struct(
    "customer_emailid:s sales_order_no_nunique:i sku_nunique:i items_returned_count:i sales_qty_mean:d avg_order_size:d "
    "return_rate:d return_ratio:d return_product_variety:i avg_returns_per_order:d return_frequency_ratio:d return_intensity:d "
    "consecutive_returns:i avg_consecutive_returns:d customer_lifetime_days:i avg_days_to_return:d return_timing_spread:d "
    "customer_tenure_stage:s recent_orders:i recent_returns:i recent_vs_avg_ratio:d behavior_stability_score:d "
    "avg_order_value:d avg_return_value:d high_value_return_affinity:d product_category_loyalty:d category_diversity_score:d "
    "category_loyalty_score:d high_return_category_affinity:d sku_adjacency_orders:i sku_adjacency_returns:i "
    "sku_adjacency_timing:d sku_adjacency_return_timing:d seasonal_susceptibility_returns:d seasonal_susceptibility_orders:d "
    "trend_product_category_return_rate:d trend_product_category_order_rate:d customer_emailid_cleaned:s "
    "total_sales_qty:i total_return_qty:i first_order_date:t last_order_date:t feature_calculation_date:t data_quality_flags:s"
)
_NOT_SCALED = {
    "customer_emailid", "customer_emailid_cleaned", "customer_tenure_stage", "total_sales_qty", "total_return_qty",
    "first_order_date", "last_order_date", "feature_calculation_date", "data_quality_flags",
}
SCALABLE = [f.name for f in SILVER.fields if f.name not in _NOT_SCALED]
GOLD = T.StructType(
    [T.StructField("customer_emailid", T.StringType())]
    + [T.StructField(f"{n}_scaled", T.DoubleType()) for n in SCALABLE]
    + _struct("outlier_score:d feature_completeness_score:d processing_timestamp:t scaling_method:s data_quality_flags:s").fields
)
CLUSTERING_RESULTS = _struct(
    "customer_emailid:s final_cluster_id:i clustering_method:s clustering_timestamp:t cluster_quality_score:d"
)
CLUSTER_SUMMARY = _struct(
    "cluster_id:i clustering_method:s customer_count:i percentage_of_total:d avg_return_rate:d avg_order_count:d "
    "avg_lifetime_days:d avg_completeness_score:d creation_timestamp:t"
)
EMAIL_CANDIDATES = _struct(
    "email_group_id:l customer_emailid:s customer_emailid_cleaned:s similarity_score:d consolidation_suggested:b review_timestamp:t"
)
QUALITY_ISSUES = _struct(
    "issue_id:l issue_type:s issue_description:s affected_records:l severity:s detection_timestamp:t resolved:b"
)
FEATURE_LOG = _struct(
    "log_id:l feature_name:s calculation_start:t calculation_end:t execution_time_seconds:d records_processed:l "
    "warnings_count:l errors_count:l status:s"
)
# Defaults applied on write where the value is NULL.
DEFAULTS = {
    "data_quality_flags": "", "resolved": False, "consolidation_suggested": False, "status": "PENDING",
    "scaling_method": "RobustScaler",
}

TABLES = {
    "bronze_return_order_data": BRONZE,
    "silver_customer_features": SILVER,
    "gold_cluster_processed": GOLD,
    "clustering_results": CLUSTERING_RESULTS,
    "cluster_summary": CLUSTER_SUMMARY,
    "email_consolidation_candidates": EMAIL_CANDIDATES,
    "data_quality_issues": QUALITY_ISSUES,
    "feature_calculation_log": FEATURE_LOG,
}
