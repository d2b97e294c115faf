"""Scans of order-line files and layer tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from backflow.functions.expressions import ID

# Text header of an order-line file (upper case in the files) and its types.
SOURCE_TYPES = {
    "sales_qty": "double", "return_qty": "double", "gross": "double", "order_date": "timestamp_ntz", "return_date": "timestamp_ntz",
}
# The twelve columns of the narrow extract.
PROJECTED = [
    "customer_emailid", "sales_order_no", "q_gmm_id", "q_cls_id", "sku", "q_sku_desc", "sales_qty",
    "units_returned_flag", "return_no", "return_qty", "order_date", "return_date",
]
METADATA_COLUMNS = [
    ID, "outlier_score", "feature_completeness_score", "data_quality_flags", "processing_timestamp", "scaling_method",
]


def read_all_string(spark: SparkSession, path: str) -> DataFrame:
    """Header CSV with every column as text; types are set later with try_cast."""
    return spark.read.options(header=True, inferSchema=False, multiLine=False, escape='"').csv(path)


def load_bronze(spark: SparkSession, path: str) -> DataFrame:
    """CSV scan, cleaned, keyed and deduplicated; file splits replace chunks."""
    from backflow.operators import clean
    from backflow.schemas import BRONZE

    raw = clean.lower_columns(read_all_string(spark, path))
    typed = clean.coerce_types(clean.map_columns_ci(raw, BRONZE))
    keyed = clean.with_primary_key(typed.withColumn(ID, clean.clean_email(F.col(ID))), ["q_sku_id", "sales_order_no", ID], "_")
    return clean.dedupe_keep_last(clean.fix_return_dates(keyed), ["primary_key"], ["order_date", "return_date"])


def read_projected_csv(spark: SparkSession, path: str) -> DataFrame:
    """Twelve columns; a return date of '-' means none."""
    from backflow.operators import clean

    raw = clean.lower_columns(read_all_string(spark, path)).select(*PROJECTED)
    return clean.coerce_types(raw.withColumn("return_date", F.nullif(F.col("return_date"), F.lit("-"))))


_FORMATS = {".csv": "csv", ".parquet": "parquet", ".json": "json", ".orc": "orc"}


def load_table(spark: SparkSession, path: str, name: str, force: bool = False) -> DataFrame:
    """Save a file as table ``name`` by suffix; keep an existing table unless forced."""
    if spark.catalog.tableExists(name) and not force:
        return spark.table(name)
    suffix = next((s for s in _FORMATS if path.rstrip("/").endswith(s)), None)
    if suffix is None:
        raise ValueError(f"unsupported file type: {path}")
    df = read_all_string(spark, path) if suffix == ".csv" else spark.read.format(_FORMATS[suffix]).load(path)
    df.write.mode("overwrite").saveAsTable(name)
    return spark.table(name)


def from_frame(df: DataFrame, name: str) -> DataFrame:
    df.createOrReplaceTempView(name)
    return df.sparkSession.table(name)


def scan_silver(silver: DataFrame) -> DataFrame:
    return silver.where(F.col(ID).isNotNull() & (F.col("sales_order_no_nunique") > 0))


def scan_gold(gold: DataFrame) -> tuple[DataFrame, list[str], list[str]]:
    """Gold rows with an id, the scaled feature columns and the metadata columns."""
    features = [c for c in gold.columns if c.endswith("_scaled")]
    return gold.where(F.col(ID).isNotNull()), features, [c for c in METADATA_COLUMNS if c in gold.columns]


def validate_source(df: DataFrame, required: list[str], max_missing: float = 0.1) -> DataFrame:
    """Gate rows (gate, passed, detail): required columns, any rows, missing share per column."""
    present = {c.lower(): c for c in df.columns}
    missing = [c for c in required if c.lower() not in present]
    checked = [present[c.lower()] for c in required if c.lower() in present]
    n = F.count(F.lit(1))
    stats = df.agg(n.alias("n"), *[F.coalesce(F.try_divide(F.sum(F.col(c).isNull().cast("double")), n), F.lit(0.0)).alias(c) for c in checked])
    gate = lambda name, passed, detail: F.struct(F.lit(name).alias("gate"), passed.alias("passed"), detail.alias("detail"))
    gates = [
        gate("required_columns", F.lit(not missing), F.lit(",".join(missing))),
        gate("row_count", F.col("n") > 0, F.col("n").cast("string")),
        *[gate(f"missing_{c.lower()}", F.col(c) <= max_missing, F.format_number(F.col(c), 4)) for c in checked],
    ]
    return stats.select(F.explode(F.array(*gates)).alias("g")).select("g.*")


def table_profile(frames: dict[str, DataFrame]) -> DataFrame:
    """One row per table: row count, column count and schema text."""
    parts = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(name).alias("table_name"), "row_count", F.lit(len(df.columns)).cast("bigint").alias("column_count"),
            F.lit(",".join(sorted(df.columns))).alias("columns"),
        )
        for name, df in frames.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def distinct_values(df: DataFrame, cols: list[str]) -> DataFrame:
    """Distinct non-null values per column: one pass over the long form."""
    texts = df.select(*[F.col(c).cast("string").alias(c) for c in cols])
    long = texts.unpivot([], cols, "column_name", "value").where("value IS NOT NULL")
    return long.groupBy("column_name").agg(F.countDistinct("value").alias("distinct_values"))
