"""Registered queries: sources, mapping, joins, aggregates, windows, sorts, scalars."""

from __future__ import annotations

from pyspark.sql import Window, functions as F, types as T

from backflow.catalog import common, feature_queries, variant_queries  # noqa: F401  (their CTEs)
from backflow.catalog.twins import cte, twin
from backflow.features.current import order_returns, return_streak_starts
from backflow.functions import expressions as X
from backflow.functions.expressions import ID, rounded
from backflow.operators import clean, joins, pivots
from backflow.operators.ordered import with_running
from backflow.operators.quantiles import exact_quantiles
from backflow.schemas import BRONZE
from backflow.sources import readers
from backflow.sources.order_lines import order_lines, table

QUERIES: dict = {}
TWINS: dict[str, str] = {}


def register(name: str, job, sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, sf: rounded(job(spark, sf))
    if sql:
        TWINS[name] = twin(sql)


def on_lines(name: str, job, sql: str | None = None) -> None:
    register(name, lambda spark, sf: job(order_lines(spark, sf)), sql)


def on_base(name: str, job, sql: str | None = None) -> None:
    register(name, lambda spark, sf: job(common.customer_base(spark, sf)), sql)


def long(c: str):
    return F.col(c).cast("bigint").alias(c)


# --- sources ----------------------------------------------------------------------------

on_lines("src_05_from_frame", lambda b: readers.from_frame(b, "backflow_lines").groupBy("brand_").agg(F.count(F.lit(1)).alias("n")),
         "SELECT brand_, count(*) AS n FROM order_lines GROUP BY brand_")
on_base("src_06_scan_silver", lambda s: readers.scan_silver(s).select(ID, "sales_order_no_nunique"),
        "SELECT customer_emailid, sales_order_no_nunique FROM base WHERE customer_emailid IS NOT NULL AND sales_order_no_nunique > 0")


def _scan_gold(spark, sf):
    gold = common.segments(spark, sf).select(ID, F.col("return_rate").alias("return_rate_scaled"), "outlier_score")
    rows, features, metadata = readers.scan_gold(gold)
    return rows.select(*features, *metadata)


register("src_07_scan_gold", _scan_gold, """
SELECT customer_emailid, round(return_rate, 6) AS return_rate_scaled, round(outlier_score, 6) + 0.0 AS outlier_score FROM goldish WHERE customer_emailid IS NOT NULL""")
on_lines("src_08_validate_source", lambda b: readers.validate_source(b, ["CUSTOMER_EMAILID", "SKU", "RETURN_DATE", "SENTIMENT"]), """
SELECT 'required_columns' AS gate, false AS passed, 'SENTIMENT' AS detail
UNION ALL SELECT 'row_count', count(*) > 0, CAST(count(*) AS STRING) FROM order_lines
UNION ALL SELECT 'missing_customer_emailid', avg(CASE WHEN customer_emailid IS NULL THEN 1e0 ELSE 0e0 END) <= 0.1, printf('%.4f', avg(CASE WHEN customer_emailid IS NULL THEN 1e0 ELSE 0e0 END)) FROM order_lines
UNION ALL SELECT 'missing_sku', avg(CASE WHEN sku IS NULL THEN 1e0 ELSE 0e0 END) <= 0.1, printf('%.4f', avg(CASE WHEN sku IS NULL THEN 1e0 ELSE 0e0 END)) FROM order_lines
UNION ALL SELECT 'missing_return_date', avg(CASE WHEN return_date IS NULL THEN 1e0 ELSE 0e0 END) <= 0.1, printf('%.4f', avg(CASE WHEN return_date IS NULL THEN 1e0 ELSE 0e0 END)) FROM order_lines""")
_PROFILED = {"customer": 5, "orders": 6, "lineitem": 11, "part": 6}
register("src_09_table_profile", lambda spark, sf: readers.table_profile({n: table(spark, sf, n) for n in _PROFILED}).drop("columns"),
         " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS row_count, CAST({k} AS BIGINT) AS column_count FROM {n}" for n, k in _PROFILED.items()))
on_lines("src_09_distinct_values", lambda b: readers.distinct_values(b, ["brand_", "q_cls_id", "size_", "return_no"]),
         " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS distinct_values FROM order_lines" for c in ["brand_", "q_cls_id", "size_", "return_no"]))

# --- mapping and cleaning -------------------------------------------------------------


def _as_source_text(b):
    """The lines as an upper-case text file would give them."""
    names = ["sales_order_no", "customer_emailid_raw", "order_date", "sku", "sales_qty", "gross", "return_qty", "units_returned_flag", "return_date", "return_no", "q_cls_id", "q_sku_id", "class_"]
    heads = {"customer_emailid_raw": "CUSTOMER_EMAILID"}
    return b.select(*[F.col(n).cast("string").alias(heads.get(n, n.upper())) for n in names])


TARGET = T.StructType([f for f in BRONZE.fields if f.name in ("customer_emailid", "sku", "order_date", "sales_qty", "return_no", "vendor_style")])
on_lines("prj_01_map_columns_ci", lambda b: clean.coerce_types(clean.map_columns_ci(_as_source_text(b), TARGET)), """
SELECT customer_emailid_raw AS customer_emailid, order_date, sku, sales_qty, return_no, CAST(NULL AS STRING) AS vendor_style FROM order_lines""")
FUZZY = T.StructType([T.StructField(n, T.StringType()) for n in ("orderno", "returnno", "class", "vendor_style")])
on_lines("prj_02_map_columns_fuzzy", lambda b: clean.map_columns_fuzzy(_as_source_text(b), FUZZY), """
SELECT sales_order_no AS orderno, return_no AS returnno, class_ AS class, CAST(NULL AS STRING) AS vendor_style FROM order_lines""")
on_lines("prj_03_lower_columns", lambda b: clean.lower_columns(_as_source_text(b)).groupBy("units_returned_flag").agg(F.count(F.lit(1)).alias("n")),
         "SELECT units_returned_flag, count(*) AS n FROM order_lines GROUP BY units_returned_flag")
on_lines("prj_04_primary_key", lambda b: clean.with_primary_key(b, ["sales_order_no", "sku", "return_no", ID]).select("primary_key"), """
SELECT concat(sales_order_no, '-', sku, '-', coalesce(return_no, ''), '-', customer_emailid) AS primary_key FROM order_lines""")


def _dirty_text(b):
    return b.select(
        "line_no", "sku",
        F.when(F.col("line_no") == 1, "not a date").otherwise(F.col("order_date").cast("string")).alias("order_date"),
        F.when(F.col("line_no") == 2, "").otherwise(F.concat(F.col("sales_qty").cast("string"), F.lit(".0000"))).alias("sales_qty"),
        F.when(F.col("line_no") == 3, "n/a").otherwise(F.col("gross").cast("string")).alias("gross"),
    )


on_lines("prj_05_coerce_types", lambda b: clean.coerce_types(_dirty_text(b), ("order_date",)), """
SELECT line_no, sku, CASE WHEN line_no <> 1 THEN order_date END AS order_date, CASE WHEN line_no <> 2 THEN sales_qty END AS sales_qty,
 CASE WHEN line_no <> 3 THEN round(gross, 6) END AS gross FROM order_lines""")
on_lines("prj_06_clean_email", lambda b: b.select(clean.clean_email(F.concat(F.lit("  "), "customer_emailid_raw", F.lit(" "))).alias("email")).groupBy("email").agg(F.count(F.lit(1)).alias("n")), """
SELECT lower(trim(customer_emailid_raw)) AS email, count(*) AS n FROM order_lines GROUP BY 1""")
cte("fixed", """
SELECT * REPLACE (CASE WHEN return_date < order_date OR (return_qty > 0 AND return_date IS NULL) THEN order_date + INTERVAL '1' DAY ELSE return_date END AS return_date),
 CASE WHEN return_date < order_date THEN 'RETURN_DATE_FIXED' WHEN return_qty > 0 AND return_date IS NULL THEN 'RETURN_DATE_IMPUTED' ELSE '' END AS data_quality_flags
FROM order_lines""")
on_lines("prj_07_fix_return_dates", lambda b: clean.fix_return_dates(b).select("sales_order_no", "sku", "line_no", "return_date", "data_quality_flags"),
         "SELECT sales_order_no, sku, line_no, return_date, data_quality_flags FROM fixed")
on_lines("prj_07_return_date_issues", clean.return_date_issues, """
SELECT * FROM (SELECT 'INVALID_RETURN_DATES' AS issue_type, concat('Return dates before order dates: ', count(*), ' records') AS issue_description, count(*) AS affected_records, 'HIGH' AS severity
 FROM order_lines WHERE return_date < order_date
UNION ALL SELECT 'MISSING_RETURN_DATES', concat('Missing return dates with return qty > 0: ', count(*), ' records'), count(*), 'MEDIUM'
 FROM order_lines WHERE return_qty > 0 AND return_date IS NULL) WHERE affected_records > 0""")
on_lines("prj_08_standardize_flag", lambda b: b.select(
    clean.flag_is_yes(F.col("units_returned_flag")).alias("yes"),
    clean.flag_or_unknown(F.when(F.col("line_no") != 4, F.col("units_returned_flag"))).alias("flag")).groupBy("yes", "flag").agg(F.count(F.lit(1)).alias("n")), """
SELECT upper(units_returned_flag) = 'YES' AS yes, coalesce(CASE WHEN line_no <> 4 THEN units_returned_flag END, 'Unknown') AS flag, count(*) AS n FROM order_lines GROUP BY 1, 2""")
on_lines("prj_09_coerce_qty", lambda b: b.select("sku", "line_no", clean.to_quantity(F.when(F.col("line_no") == 2, F.lit("x")).otherwise(F.col("sales_qty").cast("string"))).alias("qty")), """
SELECT sku, line_no, CASE WHEN line_no = 2 THEN 0e0 ELSE CAST(sales_qty AS DOUBLE) END AS qty FROM order_lines""")
on_lines("prj_10_excel_serial_to_ts", lambda b: b.select(
    "sku", "line_no", clean.excel_serial_to_ts(F.coalesce(
        (F.timestamp_diff("SECOND", F.lit("1899-12-30 00:00:00").cast("timestamp_ntz"), F.col("order_date")) / 86400.0).cast("string"), F.lit("-"))).alias("ts")),
    "SELECT sku, line_no, order_date AS ts FROM order_lines")
on_lines("prj_12_predicates", lambda b: b.where(
    F.col("return_date").isNotNull() & F.col("sales_qty").between(5, 20) & F.col("brand_").isin("Brand#1", "Brand#2", "Brand#3")
    & F.col("q_sku_desc").like("%ring%") & (F.trim("return_no") != "")).select("sales_order_no", "sku", "sales_qty", "brand_"), """
SELECT sales_order_no, sku, sales_qty, brand_ FROM order_lines WHERE return_date IS NOT NULL AND sales_qty BETWEEN 5 AND 20
 AND brand_ IN ('Brand#1', 'Brand#2', 'Brand#3') AND q_sku_desc LIKE '%ring%' AND trim(return_no) <> ''""")
on_base("prj_13_drop_noise", lambda s: clean.drop_noise(common.labelled(s)).select(ID, "cluster"), "SELECT customer_emailid, cluster FROM labelled WHERE cluster <> -1")
NEW_SCHEMA = T.StructType([T.StructField("customer_emailid", T.StringType()), T.StructField("return_rate", T.DoubleType()), T.StructField("sku_adjacency_orders", T.LongType()), T.StructField("customer_tenure_stage", T.StringType())])
on_base("prj_14_complete_new_customers", lambda s: clean.complete_to_schema(s.select(ID, "return_rate"), NEW_SCHEMA), """
SELECT customer_emailid, round(return_rate, 6) AS return_rate, CAST(NULL AS BIGINT) AS sku_adjacency_orders, CAST(NULL AS STRING) AS customer_tenure_stage FROM base""")
on_lines("prj_15_lookup_customers", lambda b: clean.lookup_customers(b.select(ID, "sales_order_no", "sku"), b.where(F.col("return_qty") >= 45)), """
SELECT customer_emailid, sales_order_no, sku FROM order_lines WHERE customer_emailid IN (SELECT customer_emailid FROM order_lines WHERE return_qty >= 45)""")
on_base("prj_15_cluster_members", lambda s: clean.cluster_members(common.labelled(s), 2), "SELECT customer_emailid FROM labelled WHERE cluster = 2")

# --- joins --------------------------------------------------------------------------------

CUT = "TIMESTAMP '1999-01-01'"
before = lambda b: b.where(F.col("order_date") < F.lit("1999-01-01").cast("timestamp_ntz"))
after = lambda b: b.where(F.col("order_date") >= F.lit("1999-01-01").cast("timestamp_ntz"))


def _merged(b):
    from backflow.features import current as now

    groups = {"basic_volume": now.basic_volume(b), "consecutive": now.consecutive_returns(b), "seasonal": now.seasonal(b)}
    return joins.merge_feature_groups(groups).select(ID, "sales_order_no_nunique", "consecutive_returns", "seasonal_susceptibility_orders")


on_lines("jn_01_merge_feature_groups", _merged, """
SELECT customer_emailid, sales_order_no_nunique, CAST(consecutive_returns AS BIGINT) AS consecutive_returns, round(seasonal_susceptibility_orders, 6) AS seasonal_susceptibility_orders
FROM f01 LEFT JOIN f03 USING (customer_emailid) LEFT JOIN f08 USING (customer_emailid)""")
on_lines("jn_02_inner_join", lambda b: (
    b.groupBy(ID, "q_cls_id").agg(F.count(F.lit(1)).alias("n")).join(b.groupBy(ID).agg(F.count(F.lit(1)).alias("total")), ID)), """
SELECT customer_emailid, q_cls_id, n, total FROM (SELECT customer_emailid, q_cls_id, count(*) AS n FROM order_lines GROUP BY ALL)
 JOIN (SELECT customer_emailid, count(*) AS total FROM order_lines GROUP BY ALL) USING (customer_emailid)""")


def _mail_ids(spark, sf):
    """Mail-like ids from customers, with misspelt twins for every fifth customer."""
    c = table(spark, sf, "customer")
    clean_id = F.concat(F.substring(F.md5("c_name"), 1, 16), F.lit("@"), F.lower("c_mktsegment"), F.lit(".example"))
    return c.select(clean_id.alias("id")).unionByName(
        c.where("c_custkey % 5 = 0").select(F.concat(F.substring(clean_id, 1, 7), F.lit("x"), F.expr(f"substring(concat(substring(md5(c_name), 1, 16), '@', lower(c_mktsegment), '.example'), 9, 100)")).alias("id"))
    ).unionByName(c.where("c_custkey % 7 = 0").select(F.concat(F.lit("z"), clean_id).alias("id")))


cte("mail_ids", """
SELECT m AS id FROM mails UNION ALL SELECT concat(substr(m, 1, 7), 'x', substr(m, 9)) FROM mails WHERE c_custkey % 5 = 0
UNION ALL SELECT concat('z', m) FROM mails WHERE c_custkey % 7 = 0""")
cte("mails", "SELECT c_custkey, concat(substr(md5(c_name), 1, 16), '@', lower(c_mktsegment), '.example') AS m FROM customer")
register("jn_04_similar_emails", lambda spark, sf: joins.similar_ids(_mail_ids(spark, sf), "id", 0.85), """
SELECT a.id AS email1, b.id AS email2, round(1e0 - levenshtein(a.id, b.id) / CAST(greatest(length(a.id), length(b.id)) AS DOUBLE), 6) AS similarity
FROM (SELECT DISTINCT id FROM mail_ids) a JOIN (SELECT DISTINCT id FROM mail_ids) b ON a.id < b.id AND abs(length(a.id) - length(b.id)) <= 6
WHERE 1e0 - levenshtein(a.id, b.id) / CAST(greatest(length(a.id), length(b.id)) AS DOUBLE) >= 0.85""")
on_lines("jn_05_multi_key_join", lambda b: (lambda m: b.withColumn("m", F.date_trunc("month", "order_date")).groupBy(ID, "q_cls_id", "m").agg(F.count(F.lit(1)).alias("n")).join(m, ["q_cls_id", "m"]))(
    b.groupBy("q_cls_id", F.date_trunc("month", "order_date").alias("m")).agg(F.count(F.lit(1)).alias("all_n"))).withColumn("m", F.col("m").cast("date")), """
SELECT customer_emailid, q_cls_id, CAST(m AS DATE) AS m, CAST(n AS BIGINT) AS n, CAST(all_n AS BIGINT) AS all_n FROM category_months JOIN market_months USING (q_cls_id, m)""")
on_lines("jn_06_anti_join", lambda b: joins.missing_keys(b, before(b)), f"SELECT DISTINCT customer_emailid FROM order_lines a WHERE NOT EXISTS (SELECT 1 FROM order_lines b WHERE a.customer_emailid = b.customer_emailid AND order_date < {CUT})")
on_lines("jn_06_not_in", lambda b: joins.not_in(b.select(ID).distinct(), b.where("return_qty > 40").select(ID)).unionByName(
    joins.not_in(b.select(ID).distinct(), b.select(F.nullif(F.col(ID), F.lit("customer#000000001")).alias(ID)))), """
SELECT DISTINCT customer_emailid FROM order_lines WHERE customer_emailid NOT IN (SELECT customer_emailid FROM order_lines WHERE return_qty > 40)
UNION ALL SELECT DISTINCT customer_emailid FROM order_lines WHERE customer_emailid NOT IN (SELECT nullif(customer_emailid, 'customer#000000001') FROM order_lines)""")
on_lines("jn_07_semi_join", lambda b: b.join(before(b).where("return_qty > 0").select(ID).distinct(), ID, "left_semi").groupBy(ID).agg(F.count(F.lit(1)).alias("n")), f"""
SELECT customer_emailid, count(*) AS n FROM order_lines WHERE customer_emailid IN (SELECT customer_emailid FROM order_lines WHERE return_qty > 0 AND order_date < {CUT}) GROUP BY 1""")
on_lines("jn_09_one_row_reference", lambda b: b.withColumn("cut", b.select(F.max("order_date")).scalar() - F.expr("INTERVAL 90 DAYS")).where("order_date >= cut").select(ID, "sales_order_no", "sku", "cut"), """
SELECT customer_emailid, sales_order_no, sku, cut_at AS cut FROM order_lines, cutoff WHERE order_date >= cut_at""")


def _report_base(spark, sf):
    seg = common.segments(spark, sf)
    from backflow.plans.report import report_base

    results = seg.where("cluster <> 3").select(ID, F.col("cluster").alias("final_cluster_id"))
    return report_base(results, seg.where("return_rate > 0.1").select(ID, "return_rate"), seg.select(ID, "outlier_score"))


register("jn_10_report_base", _report_base, """
SELECT customer_emailid, cluster AS final_cluster_id, round(CASE WHEN return_rate > 0.1 THEN return_rate END, 6) AS return_rate, round(outlier_score, 6) + 0.0 AS outlier_score
FROM goldish WHERE cluster <> 3""")
on_lines("jn_11_attach_sentiment", lambda b: joins.attach_sentiment(
    b.select("sku", "line_no", F.col("size_").alias("return_reason")),
    b.select(F.col("size_").alias("return_reason"), (F.length("brand_") / 10.0).alias("sentiment_score")).distinct()), """
SELECT sku, line_no, size_ AS return_reason, round(s, 6) AS sentiment_score FROM order_lines LEFT JOIN (
 SELECT size_, avg(x) AS s FROM (SELECT DISTINCT size_, length(brand_) / 10e0 AS x FROM order_lines) GROUP BY size_) r USING (size_)""")
register("jn_12_attach_clusters", lambda spark, sf: joins.attach_clusters(
    order_lines(spark, sf).select(ID, "sales_order_no", "sku"), common.labelled(common.customer_base(spark, sf)).where("cluster <> -1")), """
SELECT o.customer_emailid, sales_order_no, sku, cluster FROM order_lines o LEFT JOIN (SELECT * FROM labelled WHERE cluster <> -1) l ON o.customer_emailid = l.customer_emailid""")
on_lines("jn_13_key_overlap", lambda b: joins.key_overlap(after(b), before(b)), f"""
SELECT count(DISTINCT customer_emailid) AS unique_customers, count(DISTINCT customer_emailid) FILTER (WHERE k) AS in_both, count(DISTINCT customer_emailid) FILTER (WHERE NOT k) AS only_in_batch,
 min(order_date) AS earliest_order, max(order_date) AS latest_order
FROM (SELECT *, customer_emailid IN (SELECT customer_emailid FROM order_lines WHERE order_date < {CUT}) AS k FROM order_lines WHERE order_date >= {CUT})""")

# --- upserts over tables (the write side is tested with files) ------------------------------

KEYED = "SELECT *, concat(sales_order_no, '-', sku, '-', customer_emailid) AS pk FROM order_lines"
cte("keyed", KEYED)
keyed = lambda b: clean.with_primary_key(b, ["sales_order_no", "sku", ID], name="pk")
ORDER = ["order_date", "line_no", "sales_qty", "return_qty", "gross"]
LAST = "row_number() OVER (PARTITION BY pk ORDER BY order_date DESC, line_no DESC, sales_qty DESC, return_qty DESC, gross DESC, return_no DESC NULLS LAST)"
slim = lambda b: keyed(b).select("pk", *ORDER, "return_no")
on_lines("so_03_dedupe_keep_last", lambda b: clean.dedupe_keep_last(slim(b), ["pk"], ORDER), f"SELECT pk, order_date, line_no, sales_qty, return_qty, gross, return_no FROM keyed QUALIFY {LAST} = 1")
old_rows = lambda b: clean.dedupe_keep_last(slim(b).where("line_no <= 4"), ["pk"], ORDER)
new_rows = lambda b: slim(b).where("line_no >= 4").withColumn("gross", F.col("gross") + 1)
cte("old_rows", f"SELECT pk, order_date, line_no, sales_qty, return_qty, gross, return_no FROM keyed WHERE line_no <= 4 QUALIFY {LAST} = 1")
cte("new_rows", f"SELECT pk, order_date, line_no, sales_qty, return_qty, gross + 1 AS gross, return_no FROM keyed WHERE line_no >= 4 QUALIFY {LAST} = 1")
on_lines("snk_02_upsert_keep_new", lambda b: joins.upsert_keep_new(old_rows(b), new_rows(b), ["pk"], ORDER), """
SELECT * FROM new_rows UNION ALL SELECT * FROM old_rows WHERE pk NOT IN (SELECT pk FROM new_rows)""")
on_lines("snk_03_append_ignore", lambda b: joins.append_ignore(old_rows(b), new_rows(b), ["pk"], ORDER), "SELECT * FROM new_rows WHERE pk NOT IN (SELECT pk FROM old_rows)")
on_lines("snk_04_append_new", lambda b: joins.append_new(old_rows(b), new_rows(b), ["pk"], ORDER)[1], "SELECT count(*) AS rows_added FROM new_rows WHERE pk NOT IN (SELECT pk FROM old_rows)")
on_lines("snk_07_update_from", lambda b: joins.update_from(
    b.select(ID, "sales_order_no", "sku", "line_no", "gross"), b.where("return_qty > 30").groupBy("sales_order_no", ID, "sku").agg(F.max("return_qty").cast("double").alias("gross")),
    ["sales_order_no", ID, "sku"], ["gross"]), """
SELECT o.customer_emailid, o.sales_order_no, o.sku, line_no, CASE WHEN u.sku IS NOT NULL THEN u.g ELSE o.gross END AS gross FROM order_lines o LEFT JOIN (
 SELECT sales_order_no, customer_emailid, sku, CAST(max(return_qty) AS DOUBLE) AS g FROM order_lines WHERE return_qty > 30 GROUP BY ALL) u
 ON o.sales_order_no = u.sales_order_no AND o.customer_emailid = u.customer_emailid AND o.sku = u.sku""")

# --- aggregates -------------------------------------------------------------------------

on_lines("ag_01_group_aggregate", lambda b: b.groupBy("brand_").agg(
    F.count(F.lit(1)).alias("n"), F.countDistinct(ID).alias("customers"), F.sum("sales_qty").alias("qty"), F.avg("gross").alias("avg_gross"), F.min("order_date").alias("first"), F.max("order_date").alias("last")), """
SELECT brand_, count(*) AS n, count(DISTINCT customer_emailid) AS customers, CAST(sum(sales_qty) AS BIGINT) AS qty, round(avg(gross), 6) AS avg_gross, min(order_date) AS first, max(order_date) AS last FROM order_lines GROUP BY brand_""")
on_lines("ag_02_filtered_aggregate", lambda b: b.groupBy("brand_").agg(
    F.count_if(F.col("return_qty") > 0).alias("returned"), F.sum(F.when(F.col("return_qty") > 0, F.col("gross"))).alias("returned_gross"),
    F.sum(F.when(F.col("sales_qty") > 1000, F.col("sales_qty"))).alias("none_qualify")), """
SELECT brand_, count(*) FILTER (WHERE return_qty > 0) AS returned, round(sum(gross) FILTER (WHERE return_qty > 0), 6) AS returned_gross, CAST(sum(sales_qty) FILTER (WHERE sales_qty > 1000) AS BIGINT) AS none_qualify FROM order_lines GROUP BY brand_""")
on_lines("ag_03_conditional_distinct", lambda b: b.groupBy("q_cls_id").agg(
    F.countDistinct(F.when(F.col("return_qty") > 0, F.col(ID))).alias("returners"), F.countDistinct(F.when(F.col("gross") > 80000, F.col("sales_order_no"))).alias("high_orders")), """
SELECT q_cls_id, count(DISTINCT CASE WHEN return_qty > 0 THEN customer_emailid END) AS returners, count(DISTINCT CASE WHEN gross > 80000 THEN sales_order_no END) AS high_orders FROM order_lines GROUP BY 1""")
on_lines("ag_04_composite_distinct", lambda b: b.groupBy("brand_").agg(F.countDistinct(F.struct(ID, "sku")).alias("pairs")), "SELECT brand_, count(DISTINCT (customer_emailid, sku)) AS pairs FROM order_lines GROUP BY 1")
on_lines("ag_05_having", lambda b: b.groupBy(ID).agg(F.countDistinct("sales_order_no").alias("orders"), F.sum("return_qty").alias("back")).where("orders >= 12 AND back > 250"), """
SELECT customer_emailid, count(DISTINCT sales_order_no) AS orders, CAST(sum(return_qty) AS BIGINT) AS back FROM order_lines GROUP BY 1 HAVING count(DISTINCT sales_order_no) >= 12 AND sum(return_qty) > 250""")
on_lines("ag_06_two_level", lambda b: b.groupBy(ID, "q_cls_id").agg(F.count(F.lit(1)).alias("n")).groupBy(ID).agg(F.max("n").alias("largest"), F.avg("n").alias("mean")), """
SELECT customer_emailid, max(n) AS largest, round(avg(n), 6) AS mean FROM (SELECT customer_emailid, q_cls_id, count(*) AS n FROM order_lines GROUP BY ALL) GROUP BY 1""")
on_lines("ag_07_global", lambda b: b.agg(F.count(F.lit(1)).alias("n"), F.countDistinct(ID).alias("customers"), F.sum("return_qty").alias("back"), F.avg("sales_qty").alias("qty")), """
SELECT count(*) AS n, count(DISTINCT customer_emailid) AS customers, CAST(sum(return_qty) AS BIGINT) AS back, round(avg(sales_qty), 6) AS qty FROM order_lines""")
on_lines("ag_08_statistics", lambda b: b.groupBy("brand_").agg(
    F.stddev_samp("gross").alias("sd"), F.var_samp("sales_qty").alias("var_s"), F.var_pop("sales_qty").alias("var_p"), X.guarded_corr(F.col("sales_qty"), F.col("return_qty")).alias("r")), """
SELECT brand_, round(stddev_samp(gross), 6) AS sd, round(var_samp(sales_qty), 6) AS var_s, round(var_pop(sales_qty), 6) AS var_p, round(corr(sales_qty, return_qty), 6) AS r FROM order_lines GROUP BY 1""")
PROBS = {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}
on_lines("ag_09_percentiles", lambda b: exact_quantiles(b, ["brand_"], "gross", PROBS).join(exact_quantiles(b, ["brand_"], "gross", {"d75": 0.75}, True), "brand_"), f"""
SELECT brand_, {', '.join(f'round(quantile_cont(gross, {p}), 6) AS {n}' for n, p in PROBS.items())}, quantile_disc(gross, 0.75) AS d75 FROM order_lines GROUP BY brand_""")
on_lines("ag_10_collections", lambda b: b.select("q_cls_id", "brand_").distinct().groupBy("q_cls_id").agg(
    F.array_join(F.array_sort(F.collect_list("brand_")), ",").alias("brands"), F.count(F.lit(1)).alias("n")), """
SELECT q_cls_id, string_agg(DISTINCT brand_, ',' ORDER BY brand_) AS brands, count(DISTINCT brand_) AS n FROM order_lines GROUP BY 1""")
register("ag_11_pivot", lambda spark, sf: pivots.monthly_by_cluster(joins.attach_clusters(order_lines(spark, sf), common.labelled(common.customer_base(spark, sf)))), f"""
SELECT cluster, {', '.join(f'coalesce(CAST(sum(return_qty) FILTER (WHERE month(order_date) = {m}) AS BIGINT), 0) AS m{m}' for m in range(1, 13))}
FROM order_lines JOIN labelled USING (customer_emailid) GROUP BY cluster""")
STAT_COLS = ["return_rate", "avg_order_size", "customer_lifetime_days"]
on_base("ag_12_segment_statistics", lambda s: pivots.segment_statistics(s, "customer_tenure_stage", STAT_COLS), "SELECT customer_tenure_stage, " + ", ".join(
    f"round(avg({c}), 6) AS {c}_mean, round(median(CAST({c} AS DOUBLE)), 6) AS {c}_median, round(stddev_samp({c}), 6) AS {c}_std, round(CAST(min({c}) AS DOUBLE), 6) AS {c}_min, round(CAST(max({c}) AS DOUBLE), 6) AS {c}_max" for c in STAT_COLS) + " FROM base GROUP BY 1")
STAT_PROBS = {"p01": 0.01, "p10": 0.1, "p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99}


def _feature_stats_sql(c: str) -> str:
    qs = ", ".join(f"round(quantile_cont(CAST({c} AS DOUBLE), {p}), 6) + 0.0 AS {n}" for n, p in STAT_PROBS.items())
    return f"""SELECT '{c}' AS feature, count({c}) AS count, count(*) - count({c}) AS null_count, round(100e0 * (count(*) - count({c})) / count(*), 6) AS null_percent,
 round(CAST(min({c}) AS DOUBLE), 6) + 0.0 AS min, round(CAST(max({c}) AS DOUBLE), 6) AS max, round(avg({c}), 6) + 0.0 AS mean, round(stddev_samp({c}), 6) AS std, {qs},
 count(*) FILTER (WHERE {c} < (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.01) FROM base) OR {c} > (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.99) FROM base)) AS outliers_count FROM base"""


on_base("ag_13_feature_stats", lambda s: pivots.feature_stats(s, common.NUMERIC), " UNION ALL ".join(_feature_stats_sql(c) for c in common.NUMERIC))

# --- windows ----------------------------------------------------------------------------

TIES = ["sales_order_no", "sku", "line_no", "return_qty", "sales_qty", "gross"]
OVER = "PARTITION BY customer_emailid ORDER BY order_date, sales_order_no, sku, line_no, return_qty, sales_qty, gross"
on_lines("wn_01_row_number", lambda b: with_running(b.select(ID, "order_date", *TIES), ID, "order_date", TIES, row_number="seq").select(ID, "sales_order_no", "sku", "line_no", "seq"),
         f"SELECT customer_emailid, sales_order_no, sku, line_no, row_number() OVER ({OVER}) AS seq FROM order_lines")
on_lines("wn_02_lag_flag", lambda b: with_running(order_returns(b), ID, "order_date", ["sales_order_no"], lags={"prev_returned": "has_returns"}),
         "SELECT *, lag(has_returns) OVER (PARTITION BY customer_emailid ORDER BY order_date, sales_order_no) AS prev_returned FROM order_flags")
on_lines("wn_03_running_sum_rows", lambda b: with_running(return_streak_starts(order_returns(b)).where("has_returns = 1"), ID, "order_date", ["sales_order_no"], sums={"island": "starts"})
         .select(ID, "sales_order_no", "order_date", long("island")), """
SELECT customer_emailid, sales_order_no, order_date, CAST(sum(starts) OVER (PARTITION BY customer_emailid ORDER BY order_date, sales_order_no ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM order_marks WHERE has_returns = 1""")
on_lines("wn_04_running_sum_range", lambda b: pivots.running_sum_with_peers(b, ID, "order_date", "return_qty"), """
SELECT DISTINCT customer_emailid, order_date, CAST(sum(return_qty) OVER (PARTITION BY customer_emailid ORDER BY order_date) AS BIGINT) AS running FROM order_lines""")
on_lines("wn_05_share_of_total", lambda b: pivots.share_of_total(b, "brand_"), "SELECT brand_, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS percentage FROM order_lines GROUP BY brand_")
on_lines("wn_07_batches", lambda b: pivots.numbered_batches(b, 100), """
SELECT customer_emailid, CAST(floor((row_number() OVER (ORDER BY customer_emailid) - 1) / 100) AS BIGINT) AS batch_id FROM (SELECT DISTINCT customer_emailid FROM order_lines)""")

# --- sorts, limits, distinct ---------------------------------------------------------------

on_base("so_01_order_by", lambda s: s.groupBy("customer_tenure_stage").agg(F.avg("return_rate").alias("rate")).orderBy(
    F.when(F.col("customer_tenure_stage") == "New", 1).when(F.col("customer_tenure_stage") == "Growing", 2).when(F.col("customer_tenure_stage") == "Mature", 3).otherwise(4)),
    "SELECT customer_tenure_stage, round(avg(return_rate), 6) AS rate FROM base GROUP BY 1")
on_base("so_02_top_k", lambda s: s.orderBy(F.desc("return_rate"), ID).limit(10).select(ID, "return_rate"), "SELECT customer_emailid, round(return_rate, 6) AS return_rate FROM base ORDER BY base.return_rate DESC, customer_emailid LIMIT 10")
on_base("so_02_top_k_per_group", lambda s: pivots.top_per_group(common.labelled(s), "cluster", [F.col(ID)], 100).select("cluster", ID), """
SELECT cluster, customer_emailid FROM labelled QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY customer_emailid) <= 100""")
on_lines("so_04_dedupe_exact", lambda b: clean.dedupe_exact(b.select("brand_", "q_cls_id", "size_", "line_no")), "SELECT DISTINCT brand_, q_cls_id, size_, line_no FROM order_lines")
on_lines("so_05_distinct_projection", lambda b: b.select(ID).distinct(), "SELECT DISTINCT customer_emailid FROM order_lines")
on_lines("so_06_labelled_metrics", lambda b: pivots.stacked(b.agg(F.count(F.lit(1)).cast("double").alias("rows"), F.count_if(F.col("return_qty") > 0).cast("double").alias("returns"), F.avg("sales_qty").alias("avg_qty"))), """
SELECT 'rows' AS metric, CAST(count(*) AS DOUBLE) AS value FROM order_lines UNION ALL SELECT 'returns', CAST(count(*) FILTER (WHERE return_qty > 0) AS DOUBLE) FROM order_lines
UNION ALL SELECT 'avg_qty', round(avg(sales_qty), 6) FROM order_lines""")

# --- scalar functions -----------------------------------------------------------------------

on_lines("sc_01_strings", lambda b: b.select("sku", "line_no", F.upper("q_sku_desc").alias("u"), F.length("class_").cast("bigint").alias("n"), F.concat("brand_", F.lit("|"), "size_").alias("c"),
         F.replace("class_", F.lit(":"), F.lit("/")).alias("r"), F.col("q_sku_desc").endswith("ring").alias("e"), F.col("class_").like("%Brand#1%").alias("l")), """
SELECT sku, line_no, upper(q_sku_desc) AS u, length(class_) AS n, brand_ || '|' || size_ AS c, replace(class_, ':', '/') AS r, suffix(q_sku_desc, 'ring') AS e, class_ LIKE '%Brand#1%' AS l FROM order_lines""")
register("sc_02_levenshtein", lambda spark, sf: table(spark, sf, "part").select("p_partkey", F.levenshtein("p_name", "p_type").cast("bigint").alias("d")), "SELECT p_partkey, levenshtein(p_name, p_type) AS d FROM part")
on_lines("sc_03_math", lambda b: b.select("sku", "line_no", F.abs(F.col("return_qty") - F.col("sales_qty")).cast("bigint").alias("a"), F.pow(F.col("sales_qty") / 50.0, F.lit(2)).alias("p"), F.greatest("sales_qty", "return_qty").alias("g"),
         F.ln("gross").alias("ln"), F.floor(F.col("sales_qty") * 0.25).alias("f"), F.least("sales_qty", F.lit(20)).alias("clip")), """
SELECT sku, line_no, CAST(abs(return_qty - sales_qty) AS BIGINT) AS a, round(pow(sales_qty / 50e0, 2), 6) AS p, greatest(sales_qty, return_qty) AS g, round(ln(gross), 6) AS ln, CAST(floor(sales_qty * 0.25) AS BIGINT) AS f, least(sales_qty, 20) AS clip FROM order_lines""")
on_lines("sc_04_nulls", lambda b: b.select("sku", "line_no", F.coalesce("return_no", F.lit("none")).alias("c"), F.nullif(F.col("return_qty"), F.lit(0)).alias("n"), "return_date").na.fill({"n": -1}), """
SELECT sku, line_no, coalesce(return_no, 'none') AS c, coalesce(nullif(return_qty, 0), -1) AS n, return_date FROM order_lines""")
on_lines("sc_05_casts", lambda b: b.select("sku", "line_no", F.col("size_").try_cast("int").alias("i"), F.col("brand_").try_cast("int").alias("bad"), F.col("gross").cast("string").try_cast("double").alias("g"), (F.col("return_qty").cast("float") / F.col("sales_qty").cast("float")).cast("float").cast("double").alias("r32")), """
SELECT sku, line_no, TRY_CAST(size_ AS INT) AS i, TRY_CAST(brand_ AS INT) AS bad, CAST(CAST(gross AS VARCHAR) AS DOUBLE) AS g, round(CAST(CAST(return_qty AS FLOAT) / CAST(sales_qty AS FLOAT) AS DOUBLE), 6) AS r32 FROM order_lines""")
on_lines("sc_06_dates", lambda b: b.select("sku", "line_no", X.calendar_days(F.col("order_date"), F.col("return_date")).alias("d"), X.whole_days(F.col("order_date"), F.col("return_date")).alias("w"),
         F.date_trunc("month", "order_date").cast("timestamp_ntz").alias("m"), F.month("order_date").cast("bigint").alias("mo"), F.dayofmonth("order_date").cast("bigint").alias("dd"), (F.col("order_date") - F.expr("INTERVAL 90 DAYS")).alias("b")), """
SELECT sku, line_no, date_diff('day', order_date, return_date) AS d, CAST(trunc(date_diff('second', order_date, return_date) / 86400.0) AS BIGINT) AS w, CAST(date_trunc('month', order_date) AS TIMESTAMP) AS m,
 month(order_date) AS mo, day(order_date) AS dd, order_date - INTERVAL '90' DAY AS b FROM order_lines""")
on_base("sc_07_banding", lambda s: s.select(ID, X.banded(F.col("customer_lifetime_days"), [(90, "New"), (180, "Growing"), (365, "Mature"), (730, "Established")], "Veteran").alias("band")), """
SELECT customer_emailid, CASE WHEN customer_lifetime_days <= 90 THEN 'New' WHEN customer_lifetime_days <= 180 THEN 'Growing' WHEN customer_lifetime_days <= 365 THEN 'Mature' WHEN customer_lifetime_days <= 730 THEN 'Established' ELSE 'Veteran' END AS band FROM base""")
on_lines("sc_08_season", lambda b: b.groupBy(X.season(F.col("order_date")).alias("season")).agg(F.count(F.lit(1)).alias("n")), "SELECT season, count(*) AS n FROM season_rows GROUP BY season")
on_base("sc_09_equal_width_bin", lambda s: pivots.equal_width_bins(s, "avg_returns_per_order", 3).groupBy("bin").agg(F.count(F.lit(1)).alias("n")), """
SELECT CAST(greatest(1, least(3, ceil((avg_returns_per_order - lo) / ((hi - lo) / 3)))) AS BIGINT) AS bin, count(*) AS n
FROM base, (SELECT min(avg_returns_per_order) AS lo, max(avg_returns_per_order) AS hi FROM base) GROUP BY 1""")
on_base("sc_09_quantile_bin", lambda s: pivots.quantile_bins(s, "recent_returns", 5).groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.max("recent_returns").alias("top")), """
SELECT CAST(len(list_filter(list_distinct([q1, q2, q3, q4]), lambda e: e > q0 AND e < recent_returns)) + 1 AS BIGINT) AS bin, count(*) AS n, max(recent_returns) AS top FROM base, (
 SELECT quantile_cont(CAST(recent_returns AS DOUBLE), 0.2) AS q1, quantile_cont(CAST(recent_returns AS DOUBLE), 0.4) AS q2, quantile_cont(CAST(recent_returns AS DOUBLE), 0.6) AS q3,
 quantile_cont(CAST(recent_returns AS DOUBLE), 0.8) AS q4, min(recent_returns) AS q0 FROM base) GROUP BY 1""")
