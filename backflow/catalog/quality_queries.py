"""Registered queries: data quality and profiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from backflow.catalog import common, relational_queries as rel  # noqa: F401
from backflow.catalog.feature_queries import rounding
from backflow.catalog.twins import cte, twin
from backflow.features import current as now
from backflow.functions.expressions import ID, rounded
from backflow.operators import clean, joins, profile, quality
from backflow.operators.pivots import monthly_by_cluster
from backflow.operators.prepare import CLUSTER_GROUPS
from backflow.plans.layers import LINE_COLUMNS
from backflow.session import checkpoint, stored
from backflow.sources.order_lines import order_lines, table

QUERIES: dict = {}
TWINS: dict[str, str] = {}


def register(name, job, sql=None):
    QUERIES[name] = lambda spark, sf: rounded(job(spark, sf))
    if sql:
        TWINS[name] = twin(sql)


def on_lines(name, job, sql=None):
    register(name, lambda spark, sf: job(order_lines(spark, sf)), sql)


def on_base(name, job, sql=None):
    register(name, lambda spark, sf: job(common.customer_base(spark, sf)), sql)


def on_segments(name, job, sql=None):
    register(name, lambda spark, sf: job(common.segments(spark, sf)), sql)


U = " UNION ALL "

# --- data quality ---------------------------------------------------------------------------

BASE_RULES = [r for r in quality.RANGE_RULES if r[0] in set(common.NUMERIC) | {"return_ratio"}]


def _rule_sql(rule) -> str:
    c, lo, hi, warn = rule
    outside = " OR ".join(([f"{c} < {lo}"] if lo is not None else []) + ([f"{c} > {hi}"] if hi is not None else [])) or "false"
    return f"SELECT '{c}' AS feature, count(*) FILTER (WHERE {outside}) AS out_of_range, count(*) FILTER (WHERE {f'{c} > {warn}' if warn is not None else 'false'}) AS above_warning, count(*) FILTER (WHERE {c} IS NULL) AS nulls FROM base"


on_base("dq_01_check_ranges", quality.check_ranges, U.join(_rule_sql(r) for r in BASE_RULES))
TESTS_SQL = {
    "basic_volume": {"sales_order_no_nunique_positive": "sales_order_no_nunique > 0", "sku_nunique_positive": "sku_nunique > 0", "items_returned_count_non_negative": "items_returned_count >= 0",
                     "sales_qty_mean_positive": "sales_qty_mean > 0", "avg_order_size_positive": "avg_order_size > 0", "reasonable_order_sizes": "avg_order_size <= 50", "reasonable_qty_mean": "sales_qty_mean <= 100"},
    "return_behavior": {"return_rate_in_range": "return_rate BETWEEN 0 AND 1", "return_ratio_in_range": "return_ratio BETWEEN 0 AND 1", "return_frequency_ratio_in_range": "return_frequency_ratio BETWEEN 0 AND 1",
                        "return_intensity_non_negative": "return_intensity >= 0", "return_product_variety_non_negative": "return_product_variety >= 0", "avg_returns_per_order_non_negative": "avg_returns_per_order >= 0"},
    "temporal": {"customer_lifetime_days_non_negative": "customer_lifetime_days >= 0", "avg_days_to_return_non_negative": "avg_days_to_return >= 0", "return_timing_spread_non_negative": "return_timing_spread >= 0",
                 "valid_tenure_stages": "customer_tenure_stage IN ('New', 'Growing', 'Mature', 'Veteran')"},
}
for _group, _cols, _lo, _hi in [
    ("category", ["category_loyalty_score", "high_return_category_affinity"], 0, 1), ("category", ["category_diversity_score"], 0, None),
    ("adjacency", ["sku_adjacency_orders", "sku_adjacency_returns", "sku_adjacency_timing", "sku_adjacency_return_timing"], 0, None),
    ("seasonal", ["seasonal_susceptibility_orders", "seasonal_susceptibility_returns"], 0, None),
    ("trend", ["trend_product_category_order_rate", "trend_product_category_return_rate"], -1, 1), ("monetary", ["avg_order_value", "avg_return_value", "high_value_return_affinity"], 0, 100),
]:
    for _col in _cols:
        _name, _test = (f"{_col}_non_negative", f"{_col} >= 0") if _hi is None else (f"{_col}_in_range", f"{_col} BETWEEN {_lo} AND {_hi}")
        TESTS_SQL.setdefault(_group, {})[_name] = _test
TESTS_SQL["monetary"]["no_nulls"] = "avg_order_value IS NOT NULL AND avg_return_value IS NOT NULL AND high_value_return_affinity IS NOT NULL"
# Every group with the lines' own figures; each test is one pass over its group.
_SOURCES = {"category": ("f06", now.category_intelligence), "adjacency": ("f07", now.adjacency), "seasonal": ("f08", now.seasonal), "trend": ("f09", now.trend), "monetary": ("f10", now.monetary)}


def _group_tests(spark, sf):
    # The rows of a group are checkpointed before the next one begins, so that its shuffles are gone by then.
    lines = stored(order_lines(spark, sf).select(*LINE_COLUMNS))
    base = checkpoint(now.core_table(lines, money=False))
    return quality.feature_group_tests({g: checkpoint(_SOURCES[g][1](lines)) if g in _SOURCES else base for g in TESTS_SQL})


register("dq_02_feature_group_tests", _group_tests, U.join(
    f"SELECT '{g}' AS feature_group, '{t}' AS test, coalesce(bool_and(coalesce({cond}, false)), true) AS passed FROM {_SOURCES[g][0] if g in _SOURCES else 'base'}" for g, ts in TESTS_SQL.items() for t, cond in ts.items())
    + " UNION ALL SELECT 'monetary', 'reasonable_high_value_returns', coalesce(avg(high_value_return_affinity), 0) <= 50 FROM f10")


def _validate_sql() -> str:
    cols = ["sales_order_no_nunique", "return_rate", "return_ratio", "avg_returns_per_order", "return_frequency_ratio", "items_returned_count", "customer_lifetime_days", "sku_nunique", "first_order_date", "last_order_date"]
    rows = [("total_customers", "count(*)", None), ("missing_ids", "count(*) FILTER (WHERE customer_emailid IS NULL)", 0),
            ("duplicate_ids", "count(*) - count(DISTINCT customer_emailid)", 0)]
    rows += [(f"nulls_{c}", f"count(*) FILTER (WHERE {c} IS NULL)", 0 if c in quality.CORE else None) for c in cols]
    rows += [(f"zero_pct_{c}", f"100e0 * count(*) FILTER (WHERE {c} = 0) / count(*)", 95) for c in quality.ZERO_CHECKED]
    rows += [("return_rate_out_of_range", "count(*) FILTER (WHERE return_rate < 0 OR return_rate > 1)", 0), ("negative_lifetime", "count(*) FILTER (WHERE customer_lifetime_days < 0)", 0),
             ("first_date_after_last_date", "count(*) FILTER (WHERE first_order_date > last_order_date)", 0), ("avg_return_rate", "avg(return_rate)", None),
             ("avg_order_count", "avg(sales_order_no_nunique)", None), ("avg_lifetime_days", "avg(customer_lifetime_days)", None), ("zero_return_rate_pct", "100e0 * count(*) FILTER (WHERE return_rate = 0) / count(*)", None)]
    verdict = lambda e, lim: "CAST(NULL AS BOOLEAN)" if lim is None else f"{e} <= {lim}"
    return U.join(f"SELECT '{n}' AS \"check\", round(CAST({e} AS DOUBLE), 6) AS value, {verdict(e, lim)} AS passed, {'true' if lim == 0 else 'false'} AS blocking FROM base" for n, e, lim in rows)


on_base("dq_03_validate_silver", lambda s: quality.validate_silver(s.select(ID, "sales_order_no_nunique", "return_rate", "return_ratio", "avg_returns_per_order", "return_frequency_ratio", "items_returned_count", "customer_lifetime_days", "sku_nunique", "first_order_date", "last_order_date")), _validate_sql())
cte("flagged", """SELECT b.*, consecutive_returns, concat_ws(';', CASE WHEN return_rate > 0.95 THEN 'HIGH_RETURN_RATE' END, CASE WHEN avg_days_to_return > 60 THEN 'LATE_RETURNS' END,
 CASE WHEN consecutive_returns > 10 THEN 'HIGH_CONSECUTIVE_RETURNS' END) AS data_quality_flags FROM base b JOIN f03 ON b.customer_emailid = f03.customer_emailid""")
_with_streaks = lambda spark, sf: common.customer_base(spark, sf).join(now.consecutive_returns(order_lines(spark, sf)), ID, "left")
register("dq_04_quality_flags", lambda spark, sf: quality.with_quality_flags(_with_streaks(spark, sf)).select(ID, "data_quality_flags"), "SELECT customer_emailid, data_quality_flags FROM flagged")
register("dq_04_dataset_flags", lambda spark, sf: quality.dataset_flags(_with_streaks(spark, sf)), """
SELECT concat_ws(';', CASE WHEN max(return_rate) > 0.95 THEN 'HIGH_RETURN_RATE' END, CASE WHEN max(avg_days_to_return) > 60 THEN 'LATE_RETURNS' END, CASE WHEN max(consecutive_returns) > 10 THEN 'HIGH_CONSECUTIVE_RETURNS' END) AS data_quality_flags FROM flagged""")
on_lines("dq_05_issue_summary", lambda b: quality.issue_summary(clean.fix_return_dates(b).where("data_quality_flags <> ''").select(
    F.col("data_quality_flags").alias("issue_type"), (F.col("line_no") == 7).alias("resolved"))), """
SELECT data_quality_flags AS issue_type, count(*) AS issue_count FROM fixed WHERE data_quality_flags <> '' AND line_no <> 7 GROUP BY 1""")
register("dq_06_check_duplicates", lambda spark, sf: clean.check_duplicates(rel.keyed(order_lines(spark, sf)), "pk", "bronze").unionByName(
    clean.check_duplicates(common.customer_base(spark, sf), ID, "silver")).unionByName(clean.check_duplicates(common.segments(spark, sf), ID, "gold")), """
SELECT 'bronze' AS layer, count(*) AS total_rows, count(DISTINCT pk) AS distinct_keys, count(*) - count(DISTINCT pk) AS duplicates FROM keyed
UNION ALL SELECT 'silver', count(*), count(DISTINCT customer_emailid), count(*) - count(DISTINCT customer_emailid) FROM base
UNION ALL SELECT 'gold', count(*), count(DISTINCT customer_emailid), count(*) - count(DISTINCT customer_emailid) FROM goldish""")
on_lines("dq_06_top_duplicates", lambda b: clean.top_duplicates(rel.keyed(b), "pk", 10), "SELECT pk, count(*) AS n FROM keyed GROUP BY pk HAVING count(*) > 1 ORDER BY n DESC, pk LIMIT 10")
register("dq_07_layer_counts", lambda spark, sf: quality.layer_counts(order_lines(spark, sf), common.customer_base(spark, sf), common.segments(spark, sf)), U.join(
    f"SELECT '{layer}' AS layer, '{m}' AS metric, CAST({e} AS DOUBLE) AS value FROM {dict(bronze='order_lines', silver='base', gold='goldish')[layer]}" for layer, m, e in [
        ("bronze", "total_records", "count(*)"), ("bronze", "unique_customers", "count(DISTINCT customer_emailid)"), ("bronze", "unique_orders", "count(DISTINCT sales_order_no)"),
        ("bronze", "unique_skus", "count(DISTINCT q_sku_id)"), ("bronze", "unique_classes", "count(DISTINCT class_)"), ("bronze", "total_sales_qty", "sum(sales_qty)"),
        ("bronze", "total_return_qty", "sum(return_qty)"), ("bronze", "records_with_returns", "count(*) FILTER (WHERE return_qty > 0)"), ("bronze", "span_days", "date_diff('day', min(order_date), max(order_date))"),
        ("silver", "customer_features_count", "count(*)"), ("gold", "processed_customers_count", "count(*)")]))
_commented = lambda b: clean.fix_return_dates(b).withColumn("return_comment", F.when(F.col("line_no") % 3 == 0, F.col("q_sku_desc")).when(F.col("line_no") % 3 == 1, F.lit("  ")))
cte("commented", "SELECT *, CASE WHEN line_no % 3 = 0 THEN q_sku_desc WHEN line_no % 3 = 1 THEN '  ' END AS return_comment FROM fixed")
on_lines("dq_08_quality_report", lambda b: quality.quality_report(_commented(b)), """
SELECT 'Total records' AS check_type, count(*) AS count, CAST(NULL AS DOUBLE) AS percentage FROM commented
UNION ALL SELECT 'Records with returns', count(*) FILTER (WHERE return_qty > 0), round(100e0 * count(*) FILTER (WHERE return_qty > 0) / count(*), 2) FROM commented
UNION ALL SELECT 'Missing return comments', count(*), round(100e0 * count(*) / (SELECT count(*) FROM commented WHERE return_qty > 0), 2) FROM commented WHERE return_qty > 0 AND (return_comment IS NULL OR trim(return_comment) = '')
UNION ALL SELECT 'Return date issues fixed', count(*), round(100e0 * count(*) / (SELECT count(*) FROM commented), 2) FROM commented WHERE data_quality_flags LIKE '%RETURN_DATE%'
UNION ALL SELECT 'Duplicate emails (case)', count(DISTINCT customer_emailid_raw) - count(DISTINCT lower(customer_emailid_raw)), NULL FROM commented""")
_gold_flags = lambda s: s.withColumn("data_quality_flags", F.when(F.col("feature_completeness_score") < 0.9, "LOW_COMPLETENESS;").otherwise(""))
cte("gold_flags", "SELECT *, CASE WHEN feature_completeness_score < 0.9 THEN 'LOW_COMPLETENESS;' ELSE '' END AS data_quality_flags FROM goldish")
register("dq_09_layer_quality_scores", lambda spark, sf: (lambda s: quality.layer_quality_scores(clean.fix_return_dates(order_lines(spark, sf)), s, _gold_flags(s)))(common.segments(spark, sf)), """
SELECT 'Bronze Layer' AS layer, count(*) AS records, count(*) FILTER (WHERE data_quality_flags <> '') AS problem_records, round(100e0 * count(*) FILTER (WHERE data_quality_flags = '') / count(*), 6) AS data_quality_score FROM fixed
UNION ALL SELECT 'Silver Layer', count(*), count(*) FILTER (WHERE return_rate > 1 OR return_rate < 0 OR customer_lifetime_days < 0), round(avg(feature_completeness_score) * 100, 6) FROM goldish
UNION ALL SELECT 'Gold Layer', count(*), count(*) FILTER (WHERE outlier_score < -0.5), round(100e0 * count(*) FILTER (WHERE data_quality_flags = '') / count(*), 6) FROM gold_flags""")
on_lines("dq_10_email_case_groups", joins.case_groups, """
SELECT * FROM (SELECT lower(customer_emailid_raw) AS email_standardized, customer_emailid_raw AS email_variant, count(*) AS variant_records, count(*) OVER (PARTITION BY lower(customer_emailid_raw)) AS variant_count,
 CAST(sum(count(*)) OVER (PARTITION BY lower(customer_emailid_raw)) AS BIGINT) AS total_records FROM order_lines GROUP BY customer_emailid_raw) WHERE variant_count > 1""")
on_lines("dq_11_source_consistency", quality.source_consistency, """
SELECT 'returned_has_quantity' AS test, bool_and(units_returned_flag <> 'Yes' OR return_qty > 0) AS passed FROM order_lines UNION ALL SELECT 'kept_has_no_quantity', bool_and(units_returned_flag <> 'No' OR return_qty = 0) FROM order_lines
UNION ALL SELECT 'order_date_parses', bool_and(order_date IS NOT NULL) FROM order_lines UNION ALL SELECT 'rate_in_range', bool_and(r BETWEEN 0 AND 1) FROM (SELECT sum(return_qty) / CAST(sum(sales_qty) AS DOUBLE) AS r FROM order_lines GROUP BY customer_emailid)""")
_COLS = ["sales_order_no", "customer_emailid_raw", "customer_emailid", "order_date", "sku", "sales_qty", "gross", "return_qty", "units_returned_flag", "return_date", "return_no", "q_cls_id", "q_sku_id", "q_sku_desc", "class_", "division_", "brand_", "size_", "line_no"]
on_lines("dq_12_null_summary", lambda b: quality.null_summary(b), U.join(f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} IS NULL) AS null_count FROM order_lines" for c in _COLS))
on_base("dq_12_variant_summary", quality.variant_summary, """SELECT count(*) AS total_customers, round(avg(sales_order_no_nunique), 6) AS avg_orders_per_customer, round(avg(sku_nunique), 6) AS avg_skus_per_customer, round(avg(return_rate), 6) AS avg_return_rate,
 count(*) FILTER (WHERE items_returned_count > 0) AS customers_with_returns, count(*) FILTER (WHERE recent_orders > 0) AS recent_active_customers FROM base""")
cte("f23", "SELECT customer_emailid, CAST(count(DISTINCT class_) AS DOUBLE) / (SELECT n FROM class_total) AS category_diversity_score FROM order_lines GROUP BY customer_emailid")
on_lines("dq_13_score_statistics", lambda b: quality.score_statistics(now.category_diversity(b), "category_diversity_score"), """
SELECT round(min(category_diversity_score), 6) AS min_score, round(max(category_diversity_score), 6) AS max_score, round(avg(category_diversity_score), 6) AS avg_score, round(stddev_samp(category_diversity_score), 6) AS std_score FROM f23""")
on_lines("dq_13_score_histogram", lambda b: quality.score_histogram(now.category_diversity(b), "category_diversity_score", 50), """
SELECT CAST(least(floor((category_diversity_score - lo) * 50 / (hi - lo)) + 1, 50) AS BIGINT) AS bin, count(*) AS n FROM f23, (SELECT min(category_diversity_score) AS lo, max(category_diversity_score) AS hi FROM f23) GROUP BY 1""")

# --- profiles ---------------------------------------------------------------------------------

_SQL_OF = {"count_distinct": "count(DISTINCT {})", "sum": "CAST(sum({}) AS BIGINT)", "avg": "round(avg({}), 6)", "min": "min({})", "max": "max({})"}
on_lines("pf_01_overview", profile.overview, "SELECT count(*) AS total_records, " + ", ".join(f"{_SQL_OF[kind].format(col)} AS {name}" for name, kind, col in profile.OVERVIEW) + " FROM order_lines")
on_lines("pf_01_activity_averages", profile.activity_averages, """SELECT round(avg(o), 6) AS avg_unique_orders_per_customer, round(avg(r), 6) AS avg_unique_returns_per_customer
 FROM (SELECT count(DISTINCT sales_order_no) AS o, count(DISTINCT return_no) AS r FROM order_lines GROUP BY customer_emailid)""")
cte("cust_totals", """
SELECT customer_emailid, count(DISTINCT sales_order_no) AS order_count, count(DISTINCT q_sku_id) AS product_variety, count(DISTINCT q_cls_id) AS category_variety, CAST(sum(sales_qty) AS BIGINT) AS total_sales_qty,
 avg(CAST(sales_qty AS DOUBLE)) AS sales_qty_mean, CAST(sum(return_qty) AS DOUBLE) / nullif(sum(sales_qty), 0) AS return_rate, CAST(count(*) AS DOUBLE) / count(DISTINCT sales_order_no) AS avg_order_size,
 date_diff('day', min(order_date), max(order_date)) AS lifetime_days FROM order_lines GROUP BY customer_emailid""")
on_lines("pf_02_customer_distribution", profile.customer_distribution, """
SELECT count(*) AS customer_count, round(avg(order_count), 6) AS avg_orders_per_customer, round(avg(total_sales_qty), 6) AS avg_total_qty_purchased, round(avg(return_rate), 6) AS avg_return_rate, round(avg(lifetime_days), 6) AS avg_customer_lifetime_days,
 round(avg(avg_order_size), 6) AS avg_order_size, max(order_count) AS max_orders, max(total_sales_qty) AS max_qty_purchased, round(max(return_rate), 6) AS max_return_rate, round(max(avg_order_size), 6) AS max_order_size,
 round(quantile_cont(CAST(order_count AS DOUBLE), 0.5), 6) AS median_orders, round(quantile_cont(return_rate, 0.5), 6) AS median_return_rate FROM cust_totals""")
_Q5 = {"q25": 0.25, "median": 0.5, "q75": 0.75, "p95": 0.95, "p99": 0.99}
on_lines("pf_03_metric_distributions", profile.metric_distributions, U.join(
    f"SELECT '{m}' AS metric, round(avg({m}), 6) AS mean_val, round(stddev_samp({m}), 6) AS std_val, round(CAST(min({m}) AS DOUBLE), 6) AS min_val, round(CAST(max({m}) AS DOUBLE), 6) AS max_val, "
    + ", ".join(f"round(quantile_cont(CAST({m} AS DOUBLE), {p}), 6) AS {n}" for n, p in _Q5.items()) + " FROM cust_totals" for m in ["sales_qty_mean", "avg_order_size", "return_rate", "product_variety"]))
on_lines("pf_04_return_timing_profile", profile.return_timing_profile, """
SELECT count(*) AS customers_with_returns, round(avg(a), 6) AS overall_avg_days_to_return, round(max(a), 6) AS max_avg_days_to_return, round(avg(s), 6) AS avg_timing_spread, count(*) FILTER (WHERE a > 60) AS customers_over_60_days,
 count(*) FILTER (WHERE a < 0) AS customers_negative_days, round(quantile_cont(a, 0.5), 6) AS median_avg_days_to_return, round(quantile_cont(a, 0.95), 6) AS p95_avg_days_to_return, round(quantile_cont(s, 0.95), 6) AS p95_timing_spread
FROM (SELECT customer_emailid, avg(CAST(date_diff('day', order_date, return_date) AS DOUBLE)) AS a, stddev_samp(CAST(date_diff('day', order_date, return_date) AS DOUBLE)) AS s FROM order_lines WHERE return_qty > 0 AND return_date IS NOT NULL GROUP BY 1)""")
_STAGE = "CASE " + " ".join(f"WHEN lifetime_days <= {top} THEN '{name}'" for top, name in profile.TENURE_STAGES) + " ELSE 'Veteran (>2 years)' END"
on_lines("pf_05_tenure_profile", profile.tenure_profile, f"""
SELECT {_STAGE} AS tenure_stage, count(*) AS customer_count, round(avg(lifetime_days), 6) AS avg_lifetime_days, round(avg(order_count), 6) AS avg_orders, round(100e0 * count(*) / (SELECT count(*) FROM cust_totals), 2) AS percentage FROM cust_totals GROUP BY 1""")
on_lines("pf_06_consecutive_profile", profile.consecutive_profile, """
SELECT count(*) AS customers_with_consecutive_returns, round(avg(longest), 6) AS avg_max_consecutive, CAST(max(longest) AS BIGINT) AS overall_max_consecutive, round(avg(m), 6) AS avg_avg_consecutive,
 count(*) FILTER (WHERE longest > 10) AS customers_over_10_consecutive, round(quantile_cont(CAST(longest AS DOUBLE), 0.95), 6) AS p95_max_consecutive
FROM (SELECT customer_emailid, max(len) AS longest, avg(len) AS m FROM (SELECT customer_emailid, g, count(*) AS len FROM (
 SELECT customer_emailid, sum(starts) OVER (PARTITION BY customer_emailid ORDER BY order_date) AS g FROM order_marks WHERE has_returns = 1) GROUP BY ALL) GROUP BY 1)""")
on_lines("pf_07_category_profile", profile.category_profile, """
SELECT round(avg(category_variety), 6) AS avg_categories_per_customer, max(category_variety) AS max_categories, round(avg(product_variety), 6) AS avg_products_per_customer, max(product_variety) AS max_products,
 count(*) FILTER (WHERE category_variety > 50) AS customers_over_50_categories, count(*) FILTER (WHERE product_variety > 50) AS customers_over_50_products,
 round(quantile_cont(CAST(category_variety AS DOUBLE), 0.95), 6) AS p95_categories, round(quantile_cont(CAST(product_variety AS DOUBLE), 0.95), 6) AS p95_products FROM cust_totals""")
on_lines("pf_08_season_profile", profile.season_profile, """
SELECT CASE season WHEN 'Fall' THEN 'Fall (Oct-Dec)' WHEN 'Winter' THEN 'Winter (Jan-Mar)' WHEN 'Spring' THEN 'Spring (Apr-Jun)' ELSE 'Summer (Jul-Sep)' END AS season, count(DISTINCT customer_emailid) AS active_customers,
 count(*) AS total_items_ordered, CAST(sum(return_qty) AS BIGINT) AS total_items_returned, round(100e0 * sum(return_qty) / count(*), 2) AS return_rate_pct FROM season_rows GROUP BY season_rows.season""")
on_lines("pf_09_eligibility", lambda b: profile.eligibility(b, min_orders=12, gate_orders=5), """
SELECT count(*) AS total_customers, count(*) FILTER (WHERE lifetime_days > 730) AS customers_over_2_years, round(100e0 * count(*) FILTER (WHERE lifetime_days > 730) / count(*), 2) AS pct_over_2_years,
 count(*) FILTER (WHERE order_count >= 12) AS customers_12plus_orders, round(100e0 * count(*) FILTER (WHERE order_count >= 12) / count(*), 2) AS pct_12plus_orders, count(*) FILTER (WHERE order_count >= 5) AS customers_with_sufficient_orders FROM cust_totals""")
_SUM = {"customer_count": "count(*)", "avg_return_rate": "avg(return_rate)", "avg_orders": "avg(sales_order_no_nunique)", "avg_lifetime_days": "avg(customer_lifetime_days)",
        "veteran_customers": "count(*) FILTER (WHERE customer_tenure_stage = 'Veteran')", "high_return_customers": "count(*) FILTER (WHERE return_rate > 0.5)", "zero_return_customers": "count(*) FILTER (WHERE return_rate = 0)",
        "zero_return_rate_pct": "100e0 * count(*) FILTER (WHERE return_rate = 0) / count(*)", "zero_return_variety_pct": "100e0 * count(*) FILTER (WHERE return_product_variety = 0) / count(*)",
        "completeness_basic_volume": "100e0 * count(*) FILTER (WHERE sales_order_no_nunique > 0) / count(*)", "completeness_temporal": "100e0 * count(*) FILTER (WHERE customer_lifetime_days > 0) / count(*)",
        "completeness_returns": "100e0 * count(*) FILTER (WHERE return_rate > 0) / count(*)"}
on_base("pf_10_silver_summary", profile.silver_summary, U.join(f"SELECT '{n}' AS metric, round(CAST({e} AS DOUBLE), 6) AS value FROM base" for n, e in _SUM.items()))
on_lines("pf_11_business_insights", lambda b: profile.business_insights(now.core_table(b)), """
SELECT count(*) AS total_customers, count(*) FILTER (WHERE return_rate >= r) AS high_return_customers, count(*) FILTER (WHERE avg_order_value >= v) AS high_value_customers, count(*) FILTER (WHERE return_rate >= r AND avg_order_value >= v) AS high_return_high_value,
 round(avg(customer_lifetime_days), 6) AS avg_customer_lifetime_days, round(avg(return_rate), 6) AS avg_return_rate, round(avg(avg_order_value), 6) AS avg_order_value, round(max(r), 6) AS high_return_rate_threshold, round(max(v), 6) AS high_value_threshold
FROM base JOIN f10 USING (customer_emailid), (SELECT quantile_cont(return_rate, 0.9) AS r FROM base), (SELECT quantile_cont(avg_order_value, 0.9) AS v FROM f10)""")
_GROUPS = {
    "Volume Metrics": ["sales_order_no_nunique", "sku_nunique", "items_returned_count", "sales_qty_mean", "avg_order_size"], "Temporal Patterns": ["customer_lifetime_days", "avg_days_to_return", "return_timing_spread"],
    "Return Behavior": ["return_rate", "return_ratio", "return_product_variety", "avg_returns_per_order", "return_frequency_ratio", "return_intensity"], "Recency": ["recent_orders", "recent_returns", "recent_vs_avg_ratio", "behavior_stability_score"],
}
_pair_rows = lambda cols: [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
on_base("pf_12_group_correlations", lambda s: profile.correlations(s, _GROUPS), U.join(
    f"SELECT '{g}' AS feature_group, '{a}' AS feature_a, '{b}' AS feature_b, round(corr({a}, {b}), 6) AS correlation FROM base" for g, cols in _GROUPS.items() for a, b in _pair_rows(cols)))
# The groups that come from the lines, each with its function and the CTE of its columns.
_LINE_GROUPS = {
    "Category Intelligence": ("category_intelligence", now.category_intelligence, "f06"), "Adjacency Patterns": ("adjacency_patterns", now.adjacency, "f07"),
    "Seasonal Trends": ("seasonal_trends", now.seasonal, "f08"), "Trend Susceptibility": ("trend_susceptibility", now.trend, "f09"),
}


def _line_group_correlations(b):
    # Lines are joined once; the rows of a group are checkpointed before the next one begins, so that its shuffles are gone by then.
    lines = stored(b.select(*LINE_COLUMNS))
    parts = [profile.correlations(checkpoint(job(lines)), {g: CLUSTER_GROUPS[key]}) for g, (key, job, _) in _LINE_GROUPS.items()]
    return reduce(lambda x, y: x.unionByName(y), parts)


on_lines("pf_12_line_group_correlations", _line_group_correlations, U.join(
    f"SELECT '{g}' AS feature_group, '{a}' AS feature_a, '{b}' AS feature_b, round(coalesce(corr({a}, {b}), 0e0), 6) AS correlation FROM {t}"
    for g, (key, _, t) in _LINE_GROUPS.items() for a, b in _pair_rows(CLUSTER_GROUPS[key])))
on_base("pf_12_high_correlations", lambda s: profile.high_correlations(s, common.NUMERIC), "SELECT * FROM (" + U.join(
    f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, round(corr({a}, {b}), 6) AS correlation FROM base" for a, b in _pair_rows(common.NUMERIC)) + ") WHERE abs(correlation) > 0.8")
on_base("pf_13_tenure_return_rate", lambda s: profile.tenure_return_rate(s), """
SELECT customer_tenure_stage, round(avg(return_rate), 6) AS mean_return_rate, count(*) AS customers, CAST(CASE customer_tenure_stage WHEN 'New' THEN 1 WHEN 'Growing' THEN 2 WHEN 'Mature' THEN 3 ELSE 4 END AS BIGINT) AS stage_order
FROM base WHERE return_rate <= 1 GROUP BY customer_tenure_stage""")
on_lines("pf_14_comment_stats", lambda b: profile.comment_stats(_commented(b).withColumn("return_comment", F.trim("return_comment"))), """
SELECT customer_emailid, trim(return_comment) AS comment, count(*) AS returns_with_comment FROM commented WHERE return_qty > 0 AND return_comment IS NOT NULL AND trim(return_comment) <> '' GROUP BY ALL""")
_clustered = lambda spark, sf: joins.attach_clusters(order_lines(spark, sf), common.labelled(common.customer_base(spark, sf)))
register("pf_15_category_by_cluster", lambda spark, sf: profile.category_by_cluster(_clustered(spark, sf)), """
SELECT cluster, q_cls_id, CAST(sum(return_qty) AS BIGINT) AS return_qty, count(DISTINCT customer_emailid) AS customers FROM order_lines JOIN labelled USING (customer_emailid) GROUP BY cluster, q_cls_id""")
on_lines("pf_16_date_parse_profile", lambda b: profile.date_parse_profile(
    b.withColumn("t", F.coalesce(F.when(F.col("line_no") == 3, F.date_format("return_date", "yyyy-MM-dd")).otherwise(F.date_format("return_date", "MM/dd/yyyy")), F.lit("-"))), "t", "MM/dd/yyyy"), """
SELECT count(*) AS total_records, count(*) FILTER (WHERE return_qty > 0) AS returned_records, count(return_date) AS non_dash_dates, count(p) AS parsed_dates,
 min(date_diff('day', order_date, p)) FILTER (WHERE return_qty > 0) AS min_days, max(date_diff('day', order_date, p)) FILTER (WHERE return_qty > 0) AS max_days, round(avg(date_diff('day', order_date, p)) FILTER (WHERE return_qty > 0), 6) AS avg_days
FROM (SELECT *, CASE WHEN line_no <> 3 THEN return_date END AS p FROM order_lines)""")
on_segments("pf_17_gold_summary", lambda s: profile.gold_summary(_gold_flags(s)), """
SELECT count(*) AS total_customers, round(avg(feature_completeness_score), 6) AS avg_completeness, count(*) FILTER (WHERE outlier_score < -0.5) AS extreme_outliers, count(*) FILTER (WHERE data_quality_flags <> '') AS low_completeness_customers,
 count(*) FILTER (WHERE data_quality_flags = '') AS clean_customers, round(100e0 * count(*) FILTER (WHERE data_quality_flags = '') / count(*), 6) AS ready_pct, count(*) FILTER (WHERE data_quality_flags <> '') AS flagged_customers, count(*) FILTER (WHERE outlier_score < 0) AS negative_scores FROM gold_flags""")
