"""Registered queries of the two feature variants."""

from __future__ import annotations

from pyspark.sql import functions as F

from backflow.catalog.feature_queries import rounding
from backflow.catalog.twins import cte, twin
from backflow.features import order_item as oi, returners as rt
from backflow.functions.expressions import rounded
from backflow.sources.order_lines import order_lines

QUERIES: dict = {}
TWINS: dict[str, str] = {}


def on_lines(name: str, job, sql: str) -> None:
    QUERIES[name] = lambda spark, sf: rounded(job(order_lines(spark, sf)))
    TWINS[name] = twin(sql)


def longs(df, *cols):
    return df.withColumns({c: F.col(c).cast("bigint") for c in cols})


FLAG = "upper(units_returned_flag) = 'YES'"
# Whole 24-hour periods, towards zero.
GAP = "CAST(trunc(date_diff('second', order_date, return_date) / 86400.0) AS BIGINT)"

cte("orders_sum", f"""
SELECT customer_emailid, sales_order_no, order_date, count(*) AS items_in_order, CAST(sum(sales_qty) AS BIGINT) AS total_qty_ordered,
 count(DISTINCT sku) AS unique_skus_in_order, count(DISTINCT q_cls_id) AS unique_categories_in_order,
 CAST(count(*) FILTER (WHERE {FLAG}) AS BIGINT) AS items_returned_in_order,
 CAST(sum(CASE WHEN {FLAG} THEN return_qty ELSE 0 END) AS BIGINT) AS qty_returned_in_order
FROM order_lines GROUP BY customer_emailid, sales_order_no, order_date""")
on_lines("f_11_order_summary", lambda b: longs(oi.order_summary(b), "items_returned_in_order"), "SELECT * FROM orders_sum")

cte("items_sum", f"""
SELECT customer_emailid, sku, q_cls_id, count(*) AS purchase_frequency, CAST(sum(sales_qty) AS BIGINT) AS total_qty_purchased,
 CAST(sum(CASE WHEN {FLAG} THEN return_qty ELSE 0 END) AS BIGINT) AS total_qty_returned,
 CAST(count(*) FILTER (WHERE {FLAG}) AS BIGINT) AS return_frequency, min(order_date) AS first_purchase_date, max(order_date) AS last_purchase_date,
 avg(CASE WHEN {FLAG} AND return_date IS NOT NULL THEN CAST({GAP} AS DOUBLE) END) AS avg_days_to_return
FROM order_lines GROUP BY customer_emailid, sku, q_cls_id""")
on_lines("f_12_item_summary", lambda b: longs(oi.item_summary(b), "return_frequency"), """
SELECT customer_emailid, sku, q_cls_id, purchase_frequency, total_qty_purchased, total_qty_returned, return_frequency,
 first_purchase_date, last_purchase_date, round(avg_days_to_return, 6) + 0.0 AS avg_days_to_return FROM items_sum""")

cte("timed", f"""
SELECT customer_emailid, sales_order_no, sku, order_date, return_date, {GAP} AS days_to_return,
 CAST(month(order_date) AS BIGINT) AS order_month, CAST(month(return_date) AS BIGINT) AS return_month
FROM order_lines WHERE {FLAG} AND return_date IS NOT NULL""")
on_lines("f_13_return_timing", oi.return_timing, "SELECT * FROM timed")

cte("line_runs", f"""
SELECT customer_emailid, {FLAG} AS ret, sum(CASE WHEN {FLAG} THEN 0 ELSE 1 END) OVER (PARTITION BY customer_emailid
 ORDER BY order_date, sales_order_no, sku, line_no, return_qty ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM order_lines""")
cte("streaks", """
SELECT customer_emailid, count(*) AS consecutive_returns, avg(len) AS avg_consecutive_returns FROM (
 SELECT customer_emailid, run, count(*) AS len FROM line_runs WHERE ret GROUP BY customer_emailid, run) GROUP BY customer_emailid""")
on_lines("wn_06_item_streaks", oi.item_streaks, "SELECT customer_emailid, consecutive_returns, round(avg_consecutive_returns, 6) AS avg_consecutive_returns FROM streaks")
cte("g2", """
SELECT o.*, i.* EXCLUDE (customer_emailid), t.avg_days_to_return, t.return_timing_spread, s.consecutive_returns, s.avg_consecutive_returns FROM (
 SELECT customer_emailid, count(DISTINCT sales_order_no) AS orders, avg(items_in_order) AS avg_order_size, sum(items_returned_in_order) AS back,
  count(*) FILTER (WHERE items_returned_in_order > 0) AS orders_back,
  count(DISTINCT sales_order_no) FILTER (WHERE order_date >= (SELECT cut_at FROM cutoff)) AS recent_orders,
  CAST(sum(items_returned_in_order) FILTER (WHERE order_date >= (SELECT cut_at FROM cutoff)) AS BIGINT) AS recent_returns,
  min(order_date) AS first_order_date, max(order_date) AS last_order_date
 FROM orders_sum GROUP BY customer_emailid) o
LEFT JOIN (SELECT customer_emailid, count(DISTINCT sku) AS sku_nunique, CAST(sum(return_frequency) AS BIGINT) AS items_returned_count,
  avg(total_qty_purchased) AS sales_qty_mean, count(sku) AS sku_rows, sum(total_qty_returned) AS qty_back, sum(total_qty_purchased) AS qty_bought,
  count(DISTINCT sku) FILTER (WHERE return_frequency > 0) AS return_product_variety,
  avg(CAST(total_qty_returned AS DOUBLE) / total_qty_purchased) FILTER (WHERE total_qty_purchased > 0) AS return_intensity
 FROM items_sum GROUP BY customer_emailid) i ON o.customer_emailid = i.customer_emailid
LEFT JOIN (SELECT customer_emailid, avg(CAST(days_to_return AS DOUBLE)) AS avg_days_to_return, stddev_samp(CAST(days_to_return AS DOUBLE)) AS return_timing_spread
 FROM timed GROUP BY customer_emailid) t ON o.customer_emailid = t.customer_emailid
LEFT JOIN streaks s ON o.customer_emailid = s.customer_emailid""")
SHARED = """customer_emailid, orders AS sales_order_no_nunique, sku_nunique, items_returned_count, round(sales_qty_mean, 6) AS sales_qty_mean,
 round(avg_order_size, 6) AS avg_order_size, round(CAST(items_returned_count AS DOUBLE) / sku_rows, 6) AS return_rate,
 round(coalesce(CAST(qty_back AS DOUBLE) / nullif(qty_bought, 0), 0), 6) AS return_ratio, return_product_variety,
 round(CAST(back AS DOUBLE) / orders, 6) AS avg_returns_per_order, round(CAST(orders_back AS DOUBLE) / orders, 6) AS return_frequency_ratio,
 round(coalesce(return_intensity, 0), 6) AS return_intensity, coalesce(consecutive_returns, 0) AS consecutive_returns,
 round(coalesce(avg_consecutive_returns, 0), 6) AS avg_consecutive_returns, recent_orders"""
on_lines("f_14_summary_features", lambda b: longs(oi.summary_features(b), "recent_returns"), f"""
SELECT {SHARED}, CAST(date_diff('day', first_order_date, last_order_date) AS BIGINT) AS customer_lifetime_days,
 CASE WHEN date_diff('day', first_order_date, last_order_date) < 90 THEN 'New' WHEN date_diff('day', first_order_date, last_order_date) < 180 THEN 'Growing' ELSE 'Mature' END AS customer_tenure_stage,
 first_order_date, last_order_date, round(avg_days_to_return, 6) + 0.0 AS avg_days_to_return, round(return_timing_spread, 6) AS return_timing_spread, recent_returns
FROM g2""")
on_lines("f_14_summary_features_notebook", lambda b: longs(oi.summary_features(b, "notebook"), "recent_returns"), f"""
SELECT {SHARED}, life AS customer_lifetime_days,
 CASE WHEN life <= 90 THEN 'New' WHEN life <= 180 THEN 'Growing' WHEN life <= 365 THEN 'Mature' ELSE 'Established' END AS customer_tenure_stage,
 round(coalesce(avg_days_to_return, 0), 6) + 0.0 AS avg_days_to_return, round(coalesce(return_timing_spread, 0), 6) AS return_timing_spread,
 coalesce(recent_returns, 0) AS recent_returns,
 round(CASE WHEN recent_orders > 0 THEN (coalesce(recent_returns, 0) / CAST(recent_orders AS DOUBLE)) / nullif(back / CAST(orders AS DOUBLE), 0) ELSE 1e0 END, 6) AS recent_vs_avg_ratio,
 round(CASE WHEN orders >= 3 THEN 1e0 - abs(coalesce(recent_returns, 0) / nullif(CAST(recent_orders AS DOUBLE), 0) - back / CAST(orders AS DOUBLE)) / nullif(nullif(back / CAST(orders AS DOUBLE), 1e0), 0e0) ELSE 0.5e0 END, 6) + 0.0 AS behavior_stability_score
FROM (SELECT *, CAST(trunc(date_diff('second', first_order_date, last_order_date) / 86400.0) AS BIGINT) AS life FROM g2)""")
on_lines("jn_14_order_item_join", lambda b: oi.summary_features(b).select("customer_emailid", "sales_order_no_nunique", "sku_nunique", "avg_order_size", "sales_qty_mean"), """
SELECT customer_emailid, orders AS sales_order_no_nunique, sku_nunique, round(avg_order_size, 6) AS avg_order_size, round(sales_qty_mean, 6) AS sales_qty_mean FROM g2""")

cte("returners", "SELECT * FROM order_lines WHERE customer_emailid IN (SELECT customer_emailid FROM order_lines WHERE return_qty > 0)")
on_lines("prj_11_only_returners", lambda b: rt.only_returners(b).select("customer_emailid", "sales_order_no", "sku", "line_no", "return_qty"),
         "SELECT customer_emailid, sales_order_no, sku, line_no, return_qty FROM returners")
LIFE = "CAST(trunc(date_diff('second', min(order_date), max(order_date)) / 86400.0) AS BIGINT)"
cte("g1", f"""
SELECT customer_emailid, count(DISTINCT sales_order_no) AS sales_order_no_nunique, count(DISTINCT sku) AS sku_nunique,
 CAST(sum(sales_qty) AS BIGINT) AS sales_qty_sum, round(avg(sales_qty), 2) AS sales_qty_mean, CAST(sum(return_qty) AS BIGINT) AS return_qty_sum,
 round(avg(return_qty), 2) AS return_qty_mean, round(CAST(sum(return_qty) AS DOUBLE) / nullif(sum(sales_qty), 0), 3) AS return_ratio,
 CAST(count(*) FILTER (WHERE return_qty > 0) AS BIGINT) AS items_returned_count,
 round(CAST(count(*) FILTER (WHERE return_qty > 0) AS DOUBLE) / count(*), 3) AS return_rate,
 count(DISTINCT sku) FILTER (WHERE return_qty > 0) AS return_product_variety, {LIFE} AS customer_lifetime_days,
 count(DISTINCT sales_order_no) FILTER (WHERE order_date >= (SELECT max(order_date) FROM returners) - INTERVAL '90' DAY) AS recent_orders,
 CAST(count(*) FILTER (WHERE return_qty > 0 AND order_date >= (SELECT max(order_date) FROM returners) - INTERVAL '90' DAY) AS BIGINT) AS recent_returns
FROM returners GROUP BY customer_emailid""")
on_lines("f_15_returner_features", lambda b: longs(rt.returner_features(b), "items_returned_count", "recent_returns"), "SELECT * FROM g1")

cte("ranked_orders", """
SELECT *, row_number() OVER (PARTITION BY customer_emailid ORDER BY seen DESC, sales_order_no DESC) AS newest,
 count(*) OVER (PARTITION BY customer_emailid) AS orders FROM (
 SELECT customer_emailid, sales_order_no, min(order_date) AS seen, count(*) AS items, count(*) FILTER (WHERE return_qty > 0) AS back
 FROM returners GROUP BY customer_emailid, sales_order_no)""")
cte("recent_vs", """
SELECT customer_emailid, CASE WHEN orders >= 10 THEN latest ELSE 0e0 END AS recent_return_rate,
 CASE WHEN orders < 10 THEN 1e0 WHEN overall > 0 THEN latest / overall WHEN latest = 0 THEN 1e0 ELSE 5e0 END AS recent_vs_avg_ratio,
 CAST(CASE WHEN orders >= 10 THEN greatest(3, floor(orders * 0.25)) ELSE 0 END AS BIGINT) AS recent_order_count
FROM (SELECT customer_emailid, max(orders) AS orders, CAST(sum(back) AS DOUBLE) / sum(items) AS overall,
  coalesce(CAST(sum(back) FILTER (WHERE newest <= greatest(3, floor(orders * 0.25))) AS DOUBLE) / sum(items) FILTER (WHERE newest <= greatest(3, floor(orders * 0.25))), 0e0) AS latest
 FROM ranked_orders GROUP BY customer_emailid)""")
on_lines("f_16_recent_vs_avg", rt.recent_vs_avg, """
SELECT customer_emailid, round(recent_return_rate, 6) AS recent_return_rate, round(recent_vs_avg_ratio, 6) AS recent_vs_avg_ratio, recent_order_count,
 CASE WHEN recent_vs_avg_ratio > 1.5 THEN 1 ELSE 0 END AS return_trend_increasing, CASE WHEN recent_vs_avg_ratio < 0.5 THEN 1 ELSE 0 END AS return_trend_decreasing FROM recent_vs""")
on_lines("wn_08_last_orders", lambda b: rt._last_orders(rt.only_returners(b).groupBy("customer_emailid", "sales_order_no").agg(F.min("order_date").alias("seen")))
         .where(F.col("newest") <= F.greatest(F.lit(3), F.floor(F.col("orders") * 0.25))).select("customer_emailid", "sales_order_no", F.col("newest").cast("bigint").alias("newest")), """
SELECT customer_emailid, sales_order_no, newest FROM ranked_orders WHERE newest <= greatest(3, floor(orders * 0.25))""")
cte("g1_timing", f"""
SELECT customer_emailid, avg(CAST(g AS DOUBLE)) AS avg_days_to_return, coalesce(stddev_samp(CAST(g AS DOUBLE)), 0) AS return_timing_consistency, min(g) AS days_to_first_return, max(g) - min(g) AS return_timing_spread
FROM (SELECT customer_emailid, {GAP} AS g FROM order_lines WHERE return_qty > 0 AND return_date IS NOT NULL) GROUP BY customer_emailid""")
on_lines("f_17_return_timing_stats", rt.return_timing_stats, f"""
SELECT customer_emailid, days_to_first_return, return_timing_spread, {rounding(['avg_days_to_return', 'return_timing_consistency'])} FROM g1_timing""")
cte("g1_per_order", """SELECT customer_emailid, avg(n) AS avg_returns_per_order FROM (
 SELECT customer_emailid, sales_order_no, count(*) AS n FROM order_lines WHERE return_qty > 0 GROUP BY customer_emailid, sales_order_no) GROUP BY customer_emailid""")
on_lines("f_18_returns_per_order", rt.returns_per_order, "SELECT customer_emailid, round(avg_returns_per_order, 6) AS avg_returns_per_order FROM g1_per_order")
cte("g1_intensity", """
SELECT customer_emailid, coalesce(avg(CAST(return_qty AS DOUBLE) / nullif(sales_qty, 0)) FILTER (WHERE return_qty > 0), 0) AS avg_return_intensity,
 CAST(count(*) FILTER (WHERE return_qty > 0) AS DOUBLE) / count(DISTINCT sales_order_no) AS return_frequency_ratio FROM returners GROUP BY customer_emailid""")
on_lines("f_19_return_intensity", rt.return_intensity, f"SELECT customer_emailid, {rounding(['avg_return_intensity', 'return_frequency_ratio'])} FROM g1_intensity")
