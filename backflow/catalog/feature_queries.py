"""Registered feature queries with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from backflow.catalog.twins import cte, twin
from backflow.features import current as now
from backflow.functions.expressions import ID, rounded
from backflow.session import stored
from backflow.sources.order_lines import order_lines

QUERIES: dict = {}
TWINS: dict[str, str] = {}


def on_lines(name: str, job, sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, sf: rounded(job(order_lines(spark, sf)))
    if sql:
        TWINS[name] = twin(sql)


def rounding(cols: list[str], digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) + 0.0 AS {c}" for c in cols)


K = "customer_emailid"

cte("f01", """
SELECT customer_emailid, count(DISTINCT sales_order_no) AS sales_order_no_nunique,
 count(DISTINCT q_sku_id) AS sku_nunique, CAST(count(*) FILTER (WHERE return_qty > 0) AS BIGINT) AS items_returned_count,
 avg(CAST(sales_qty AS DOUBLE)) AS sales_qty_mean,
 CAST(count(*) AS DOUBLE) / count(DISTINCT sales_order_no) AS avg_order_size
FROM order_lines GROUP BY customer_emailid""")
on_lines("f_01_basic_volume", now.basic_volume, f"""
SELECT {K}, sales_order_no_nunique, sku_nunique, items_returned_count, {rounding(['sales_qty_mean', 'avg_order_size'])} FROM f01""")

cte("f02", """
SELECT customer_emailid, coalesce(rate, 0.0) AS return_rate, coalesce(rate, 0.0) AS return_ratio, return_product_variety,
 coalesce(ret / nullif(orders, 0), 0.0) AS avg_returns_per_order, coalesce(ret / nullif(items, 0), 0.0) AS return_frequency_ratio,
 coalesce(back / nullif(ret, 0), 0.0) AS return_intensity
FROM (SELECT customer_emailid, CAST(sum(return_qty) AS DOUBLE) / nullif(CAST(sum(sales_qty) AS DOUBLE), 0) AS rate,
  count(DISTINCT q_sku_id) FILTER (WHERE return_qty > 0) AS return_product_variety,
  CAST(count(*) FILTER (WHERE return_qty > 0) AS DOUBLE) AS ret, CAST(count(*) AS DOUBLE) AS items,
  CAST(count(DISTINCT sales_order_no) AS DOUBLE) AS orders, CAST(sum(return_qty) AS DOUBLE) AS back
 FROM order_lines GROUP BY customer_emailid)""")
on_lines("f_02_return_behavior", now.return_behavior, f"""
SELECT {K}, return_product_variety, {rounding(['return_rate', 'return_ratio', 'avg_returns_per_order', 'return_frequency_ratio', 'return_intensity'])} FROM f02""")

cte("order_flags", """
SELECT customer_emailid, sales_order_no, order_date, CASE WHEN sum(return_qty) > 0 THEN 1 ELSE 0 END AS has_returns
FROM order_lines GROUP BY customer_emailid, sales_order_no, order_date""")
cte("order_marks", """
SELECT *, CASE WHEN has_returns = 1 AND coalesce(lag(has_returns) OVER (PARTITION BY customer_emailid ORDER BY order_date, sales_order_no), 0) = 0
 THEN 1 ELSE 0 END AS starts FROM order_flags""")
cte("f03", """
SELECT c.customer_emailid, coalesce(n, 0) AS consecutive_returns, coalesce(m, 0.0) AS avg_consecutive_returns
FROM (SELECT DISTINCT customer_emailid FROM order_lines) c LEFT JOIN (
 SELECT customer_emailid, count(*) AS n, avg(len) AS m FROM (
  SELECT customer_emailid, island, count(*) AS len FROM (
   SELECT customer_emailid, sum(starts) OVER (PARTITION BY customer_emailid ORDER BY order_date, sales_order_no ROWS UNBOUNDED PRECEDING) AS island
   FROM order_marks WHERE has_returns = 1) GROUP BY customer_emailid, island) GROUP BY customer_emailid) s
ON c.customer_emailid = s.customer_emailid""")
on_lines("f_03_consecutive_returns", now.consecutive_returns, f"""
SELECT {K}, CAST(consecutive_returns AS BIGINT) AS consecutive_returns, {rounding(['avg_consecutive_returns'])} FROM f03""")

cte("f04", """
SELECT customer_emailid, CAST(date_diff('day', min(order_date), max(order_date)) AS BIGINT) AS customer_lifetime_days,
 coalesce(avg(CAST(gap AS DOUBLE)), 0.0) AS avg_days_to_return, coalesce(stddev_samp(CAST(gap AS DOUBLE)), 0.0) AS return_timing_spread,
 CASE WHEN date_diff('day', min(order_date), max(order_date)) <= 90 THEN 'New' WHEN date_diff('day', min(order_date), max(order_date)) <= 180 THEN 'Growing'
  WHEN date_diff('day', min(order_date), max(order_date)) <= 365 THEN 'Mature' ELSE 'Veteran' END AS customer_tenure_stage,
 min(order_date) AS first_order_date, max(order_date) AS last_order_date
FROM (SELECT *, CASE WHEN return_qty > 0 AND return_date IS NOT NULL THEN date_diff('day', order_date, return_date) END AS gap FROM order_lines)
GROUP BY customer_emailid""")
on_lines("f_04_temporal", now.temporal, f"""
SELECT {K}, customer_lifetime_days, customer_tenure_stage, first_order_date, last_order_date, {rounding(['avg_days_to_return', 'return_timing_spread'])} FROM f04""")

cte("cutoff", "SELECT max(order_date) - INTERVAL '90' DAY AS cut_at FROM order_lines")
cte("f05", """
SELECT customer_emailid, recent_orders, recent_returns, vs AS recent_vs_avg_ratio,
 CASE WHEN vs BETWEEN 0.8 AND 1.2 THEN 1.0 WHEN vs BETWEEN 0.5 AND 1.5 THEN 0.7 WHEN vs BETWEEN 0.2 AND 2.0 THEN 0.4 ELSE 0.1 END AS behavior_stability_score
FROM (SELECT *, CASE WHEN rets > 0 AND life > 90 THEN (recent_returns / 90e0) / (CAST(rets AS DOUBLE) / life) ELSE 0e0 END AS vs FROM (
 SELECT customer_emailid, count(DISTINCT sales_order_no) FILTER (WHERE order_date >= (SELECT cut_at FROM cutoff)) AS recent_orders,
  count(*) FILTER (WHERE order_date >= (SELECT cut_at FROM cutoff) AND return_qty > 0) AS recent_returns,
  count(*) FILTER (WHERE return_qty > 0) AS rets, date_diff('day', min(order_date), max(order_date)) AS life
 FROM order_lines GROUP BY customer_emailid))""")
on_lines("f_05_recency", now.recency, f"""
SELECT {K}, recent_orders, recent_returns, round(recent_vs_avg_ratio, 6) AS recent_vs_avg_ratio, CAST(behavior_stability_score AS DOUBLE) AS behavior_stability_score FROM f05""")

cte("class_total", "SELECT CASE WHEN count(DISTINCT class_) > 0 THEN count(DISTINCT class_) ELSE 20 END AS n FROM order_lines")
cte("f06", """
SELECT customer_emailid, CAST(count(*) AS DOUBLE) / (SELECT n FROM class_total) AS category_diversity_score,
 sum(pow(n / total, 2)) AS category_loyalty_score,
 CASE WHEN avg(rate) > 0.3 THEN 1e0 WHEN avg(rate) > 0.15 THEN 0.7e0 WHEN avg(rate) > 0.05 THEN 0.4e0 ELSE 0.1e0 END AS high_return_category_affinity
FROM (SELECT *, sum(n) OVER (PARTITION BY customer_emailid) AS total FROM (
 SELECT customer_emailid, q_cls_id, CAST(count(*) AS DOUBLE) AS n,
  CASE WHEN sum(sales_qty) > 0 THEN CAST(sum(return_qty) AS DOUBLE) / sum(sales_qty) ELSE 0e0 END AS rate
 FROM order_lines WHERE q_cls_id IS NOT NULL GROUP BY customer_emailid, q_cls_id))
GROUP BY customer_emailid""")
on_lines("f_06_category_intelligence", now.category_intelligence, f"""
SELECT {K}, {rounding(['category_diversity_score', 'category_loyalty_score'])}, high_return_category_affinity FROM f06""")

cte("near_pairs", """
SELECT a.customer_emailid, a.q_sku_id AS sku_a, b.q_sku_id AS sku_b, a.order_date AS at_a, b.order_date AS at_b,
 CAST(abs(date_diff('day', a.order_date, b.order_date)) AS BIGINT) AS days_between,
 CASE WHEN a.return_qty > 0 THEN 1 ELSE 0 END AS returned_a, CASE WHEN b.return_qty > 0 THEN 1 ELSE 0 END AS returned_b
FROM order_lines a JOIN order_lines b ON a.customer_emailid = b.customer_emailid
WHERE a.q_sku_id <> b.q_sku_id AND a.order_date <> b.order_date AND abs(date_diff('day', a.order_date, b.order_date)) <= 14""")
on_lines("jn_03_adjacent_pairs", now.adjacent_pairs, "SELECT * FROM near_pairs")
cte("f07", """
SELECT c.customer_emailid, coalesce(o, 0) AS sku_adjacency_orders, coalesce(r, 0) AS sku_adjacency_returns,
 coalesce(t, 0.0) AS sku_adjacency_timing, coalesce(rt, 0.0) AS sku_adjacency_return_timing
FROM (SELECT DISTINCT customer_emailid FROM order_lines) c LEFT JOIN (
 SELECT customer_emailid, count(DISTINCT (sku_a, sku_b)) AS o, count(*) FILTER (WHERE returned_a = 1 AND returned_b = 1) AS r,
  avg(CAST(days_between AS DOUBLE)) AS t, avg(CAST(days_between AS DOUBLE)) FILTER (WHERE returned_a = 1 AND returned_b = 1) AS rt
 FROM near_pairs GROUP BY customer_emailid) p ON c.customer_emailid = p.customer_emailid""")
# The joins' shuffles are gone before those of the pairs begin.
on_lines("f_07_adjacency", lambda b: now.adjacency(stored(b.select(ID, "q_sku_id", "order_date", "return_qty"))), f"""
SELECT {K}, sku_adjacency_orders, sku_adjacency_returns, {rounding(['sku_adjacency_timing', 'sku_adjacency_return_timing'])} FROM f07""")

cte("season_rows", """
SELECT *, CASE WHEN month(order_date) IN (10, 11, 12) THEN 'Fall' WHEN month(order_date) IN (1, 2, 3) THEN 'Winter'
 WHEN month(order_date) IN (4, 5, 6) THEN 'Spring' ELSE 'Summer' END AS season FROM order_lines""")
cte("f08", """
SELECT c.customer_emailid, coalesce(o, 0.0) AS seasonal_susceptibility_orders, coalesce(r, 0.0) AS seasonal_susceptibility_returns
FROM (SELECT DISTINCT customer_emailid FROM order_lines) c LEFT JOIN (
 SELECT customer_emailid, stddev_samp(n) / nullif(avg(n), 0) AS o, stddev_samp(back) / nullif(avg(back), 0) AS r FROM (
  SELECT customer_emailid, season, CAST(count(*) AS DOUBLE) AS n, CAST(sum(return_qty) AS DOUBLE) AS back FROM season_rows
  WHERE customer_emailid IN (SELECT customer_emailid FROM f04 WHERE customer_lifetime_days > 730)
  GROUP BY customer_emailid, season) GROUP BY customer_emailid HAVING count(*) >= 3) s
ON c.customer_emailid = s.customer_emailid""")
on_lines("f_08_seasonal", now.seasonal, f"""
SELECT {K}, {rounding(['seasonal_susceptibility_orders', 'seasonal_susceptibility_returns'])} FROM f08""")

cte("category_months", """
SELECT customer_emailid, q_cls_id, date_trunc('month', order_date) AS m, CAST(count(*) AS DOUBLE) AS n, CAST(sum(return_qty) AS DOUBLE) AS back
FROM order_lines WHERE q_cls_id IS NOT NULL GROUP BY ALL""")
cte("market_months", """
SELECT q_cls_id, date_trunc('month', order_date) AS m, CAST(count(*) AS DOUBLE) AS all_n, CAST(sum(return_qty) AS DOUBLE) AS all_back
FROM order_lines WHERE q_cls_id IS NOT NULL GROUP BY ALL""")
cte("f09", """
SELECT c.customer_emailid, CASE WHEN o IS NULL OR isnan(o) THEN 0e0 ELSE o END AS trend_product_category_order_rate,
 CASE WHEN r IS NULL OR isnan(r) THEN 0e0 ELSE r END AS trend_product_category_return_rate
FROM (SELECT DISTINCT customer_emailid FROM order_lines) c LEFT JOIN (
 SELECT customer_emailid, corr(n, all_n) AS o, corr(back, all_back) AS r FROM category_months JOIN market_months USING (q_cls_id, m)
 GROUP BY customer_emailid HAVING count(*) >= 6) t ON c.customer_emailid = t.customer_emailid""")
on_lines("f_09_trend", now.trend, f"""
SELECT {K}, {rounding(['trend_product_category_order_rate', 'trend_product_category_return_rate'])} FROM f09""")

cte("gross_limit", "SELECT percentile_disc(0.75) WITHIN GROUP (ORDER BY gross) AS g FROM order_lines")
cte("f10_raw", """
SELECT customer_emailid, value / nullif(orders, 0) AS avg_order_value,
 CASE WHEN back = 0 THEN 0.0 ELSE back_value / nullif(back, 0) END AS avg_return_value,
 coalesce(CAST(high_back AS DOUBLE) / nullif(high, 0), 0.0) * 100 AS high_value_return_affinity
FROM (SELECT customer_emailid, count(DISTINCT sales_order_no) AS orders, sum(gross) AS value, CAST(sum(return_qty) AS DOUBLE) AS back,
  sum(CASE WHEN return_qty > 0 THEN gross / nullif(sales_qty, 0) * return_qty ELSE 0 END) AS back_value,
  count(DISTINCT sales_order_no) FILTER (WHERE gross > (SELECT g FROM gross_limit)) AS high,
  count(DISTINCT sales_order_no) FILTER (WHERE gross > (SELECT g FROM gross_limit) AND return_qty > 0) AS high_back
 FROM order_lines WHERE gross IS NOT NULL GROUP BY customer_emailid)""")


def _clipped(c: str) -> str:
    return f"""CASE WHEN max({c}) OVER () > min({c}) OVER () THEN 100 * (least({c}, (SELECT quantile_cont({c}, 0.99) FROM f10_raw)) - min({c}) OVER ())
 / nullif((SELECT quantile_cont({c}, 0.99) FROM f10_raw) - min({c}) OVER (), 0) ELSE {c} END AS {c}"""


cte("f10", f"""SELECT customer_emailid, {_clipped('avg_order_value')}, {_clipped('avg_return_value')}, high_value_return_affinity FROM f10_raw""")
on_lines("f_10_monetary", now.monetary, f"""
SELECT {K}, {rounding(['avg_order_value', 'avg_return_value', 'high_value_return_affinity'])} FROM f10""")

cte("f21", """
SELECT customer_emailid, lower(trim(customer_emailid)) AS customer_emailid_cleaned, CAST(sum(sales_qty) AS BIGINT) AS total_sales_qty,
 CAST(sum(return_qty) AS BIGINT) AS total_return_qty, min(order_date) AS first_order_date, max(order_date) AS last_order_date
FROM order_lines GROUP BY customer_emailid""")
on_lines("f_21_customer_metadata", now.customer_metadata, "SELECT * FROM f21")


def _new_customers(bronze):
    known = bronze.where(F.col("order_date") < F.lit("1996-01-01").cast("timestamp_ntz"))
    return now.new_customer_features(bronze, known.select(ID).distinct())


on_lines("f_22_new_customer_features", _new_customers, """
SELECT customer_emailid, round(CAST(count(DISTINCT class_) AS DOUBLE) / (SELECT n FROM class_total), 6) AS category_diversity_score,
 count(DISTINCT sales_order_no) AS sales_order_no_nunique, count(DISTINCT class_) AS sku_nunique,
 count(DISTINCT return_no) AS items_returned_count, CAST(count(*) FILTER (WHERE return_qty > 0) AS BIGINT) AS return_qty_sum,
 count(*) AS sales_qty_sum, round(CAST(count(*) AS DOUBLE) / count(DISTINCT sales_order_no), 6) AS sales_qty_mean,
 round(CAST(count(*) FILTER (WHERE return_qty > 0) AS DOUBLE) / count(*), 6) AS return_rate,
 round(CAST(count(DISTINCT return_no) AS DOUBLE) / count(DISTINCT sales_order_no), 6) AS avg_returns_per_order,
 round(CAST(count(DISTINCT sales_order_no) FILTER (WHERE return_qty > 0) AS DOUBLE) / count(DISTINCT sales_order_no), 6) AS return_frequency_ratio,
 CAST(date_diff('day', min(order_date), max(order_date)) AS BIGINT) AS customer_lifetime_days
FROM order_lines WHERE customer_emailid NOT IN (SELECT customer_emailid FROM order_lines WHERE order_date < TIMESTAMP '1996-01-01')
GROUP BY customer_emailid""")
on_lines("f_23_category_diversity", now.category_diversity, """
SELECT customer_emailid, round(CAST(count(DISTINCT class_) AS DOUBLE) / (SELECT n FROM class_total), 6) AS category_diversity_score
FROM order_lines GROUP BY customer_emailid""")
