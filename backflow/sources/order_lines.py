"""Order lines with returns, derived from the given star-schema tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

# One text for both engines: the same SELECT feeds the Spark plans and, as a
# CTE, the SQL twins.
ORDER_LINES_SQL = """
SELECT CAST(o.o_orderkey AS STRING) AS sales_order_no,
 CASE WHEN l.l_linenumber % 7 = 0 THEN upper(c.c_name) ELSE lower(c.c_name) END AS customer_emailid_raw,
 lower(c.c_name) AS customer_emailid,
 o.o_orderdate + CAST(o.o_orderkey % 86400 AS INT) * INTERVAL '1' SECOND AS order_date,
 CAST(l.l_partkey AS STRING) AS sku,
 CAST(l.l_quantity AS INT) AS sales_qty,
 l.l_extendedprice AS gross,
 CASE WHEN l.l_returnflag='R' THEN CAST(ceil(l.l_quantity*(l.l_linenumber % 4 + 1)/4.0) AS INT) ELSE 0 END AS return_qty,
 CASE WHEN l.l_returnflag='R' THEN 'Yes' ELSE 'No' END AS units_returned_flag,
 CASE WHEN l.l_returnflag<>'R' OR l.l_orderkey % 20 = 0 THEN NULL
      WHEN l.l_orderkey % 20 = 1 THEN o.o_orderdate - INTERVAL '3' DAY
      ELSE o.o_orderdate + CAST(1 + (l.l_partkey*7 + l.l_linenumber*13) % 70 AS INT) * INTERVAL '1' DAY END AS return_date,
 CASE WHEN l.l_returnflag='R' THEN concat('N', CAST(l.l_orderkey*10 + l.l_linenumber AS STRING)) END AS return_no,
 p.p_type AS q_cls_id, CAST(l.l_partkey AS STRING) AS q_sku_id, p.p_name AS q_sku_desc,
 concat(p.p_type,':',p.p_brand) AS class_, p.p_type AS division_, p.p_brand AS brand_,
 CAST(p.p_size AS STRING) AS size_, l.l_linenumber AS line_no
FROM {lineitem} l JOIN {orders} o ON l.l_orderkey=o.o_orderkey
 JOIN {customer} c ON o.o_custkey=c.c_custkey JOIN {part} p ON l.l_partkey=p.p_partkey
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Lines that one task should join and fold, and lines that are worth a task of their own while cores are idle.
LINES_A_TASK = 500_000
LEAST_LINES = 25_000


def parts_of_lines(spark: SparkSession, lines: int) -> int:
    """Tasks for so many lines: their number grows with the lines, and small tables use the cores that there are."""
    return max(1, -(-lines // LINES_A_TASK), min(spark.sparkContext.defaultParallelism, -(-lines // LEAST_LINES)))


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line-grain bronze rows; how tables are joined is left to Catalyst and AQE.

    The joins are those of the text in another order, by which fewer bytes are moved: lines meet the parts while they are narrow, orders
    meet their customers before they meet the lines. So lines are shuffled by part and by order, not by customer as well, and what follows
    finds the lines of an order next to each other: sums by order are complete before their shuffle. Lines are dealt by order key before the
    last join, which the join with large orders needs anyway; where orders are small enough to be
    sent out, it spreads a table of few files or row groups before the string work and the aggregates. The number of parts goes by
    the lines (counted from the files' footers): without it AQE puts the narrow rows together to one part a core, whatever their number.
    """
    lines, orders, customers, parts = (table(spark, sf_dir, n) for n in ("lineitem", "orders", "customer", "part"))
    number = parts_of_lines(spark, lines.count())
    sold = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).repartition(number, "l_orderkey")
    owned = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    joined = sold.join(owned, F.col("l_orderkey") == F.col("o_orderkey"))
    # Column names begin with their table's letter, so they need no table.
    columns = re.sub(r"\b[locp]\.(?=[locp]_)", "", ORDER_LINES_SQL[:ORDER_LINES_SQL.index("FROM {lineitem}")])
    return spark.sql(f"{columns} FROM {{joined}}", joined=joined)


def order_lines_twin() -> str:
    """The same SELECT with plain table names, for the SQL side."""
    return ORDER_LINES_SQL.format(lineitem="lineitem", orders="orders", customer="customer", part="part")
