"""Column mapping, typing, cleaning and deduplication of order lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from backflow.functions.expressions import ID, clean_email, flag, joined_flags, long_sum

__all__ = ["clean_email"]


def lower_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower() for c in df.columns])


def _mapped(df: DataFrame, target: T.StructType, find) -> DataFrame:
    cols = []
    for field in target.fields:
        source = find(field.name)
        cols.append((F.col(f"`{source}`") if source else F.lit(None).cast(field.dataType)).alias(field.name))
    return df.select(*cols)


def map_columns_ci(df: DataFrame, target: T.StructType) -> DataFrame:
    """Target columns by case-insensitive name, NULL for absent ones."""
    by_name = {c.lower(): c for c in reversed(df.columns)}
    return _mapped(df, target, lambda n: by_name.get(n.lower()))


def map_columns_fuzzy(df: DataFrame, target: T.StructType) -> DataFrame:
    """Exact name first, else the first column holding the name when underscores are ignored."""
    squash = lambda n: n.lower().replace("_", "")

    def find(name: str) -> str | None:
        if name in df.columns:
            return name
        return next((c for c in df.columns if squash(name) in squash(c)), None)

    return _mapped(df, target, find)


def with_primary_key(df: DataFrame, cols: list[str], sep: str = "-", name: str = "primary_key") -> DataFrame:
    """Key of ``cols`` joined by ``sep``; NULL counts as ''."""
    return df.withColumn(name, F.concat_ws(sep, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols]))


def to_quantity(col: Column) -> Column:
    """Number or 0."""
    return F.coalesce(col.try_cast("double"), F.lit(0.0))


def coerce_types(df: DataFrame, stamps: tuple[str, ...] = ("order_date", "return_date")) -> DataFrame:
    """Bad dates and numbers become NULL; quantities such as '1.0000' become integers."""
    changes = {}
    for c in stamps:
        if c in df.columns:
            changes[c] = F.col(c).try_cast("timestamp_ntz")
    for c in ("sales_qty", "return_qty"):
        if c in df.columns:
            changes[c] = F.col(c).try_cast("double").try_cast("int")
    if "gross" in df.columns:
        changes["gross"] = F.col("gross").try_cast("double")
    return df.withColumns(changes)


def fix_return_dates(df: DataFrame) -> DataFrame:
    """Return before order, or returned without a date: the day after the order.

    Both repairs are named in ``data_quality_flags``.
    """
    before = F.col("return_date") < F.col("order_date")
    absent = (F.col("return_qty") > 0) & F.col("return_date").isNull()
    next_day = F.col("order_date") + F.expr("INTERVAL 1 DAY")
    return df.withColumn("data_quality_flags", joined_flags([(before, "RETURN_DATE_FIXED"), (absent, "RETURN_DATE_IMPUTED")])).withColumn(
        "return_date", F.when(before | absent, next_day).otherwise(F.col("return_date"))
    )


def return_date_issues(raw: DataFrame) -> DataFrame:
    """Issue rows (type, description, affected, severity) of one load, zero counts left out."""
    counts = raw.agg(
        long_sum(flag(F.col("return_date") < F.col("order_date"))).alias("a"),
        long_sum(flag((F.col("return_qty") > 0) & F.col("return_date").isNull())).alias("b"),
    )
    issue = lambda kind, text, n, level: F.struct(
        F.lit(kind).alias("issue_type"), F.concat(F.lit(text + ": "), F.col(n).cast("string"), F.lit(" records")).alias("issue_description"),
        F.col(n).alias("affected_records"), F.lit(level).alias("severity"),
    )
    rows = F.array(
        issue("INVALID_RETURN_DATES", "Return dates before order dates", "a", "HIGH"),
        issue("MISSING_RETURN_DATES", "Missing return dates with return qty > 0", "b", "MEDIUM"),
    )
    return counts.select(F.explode(rows).alias("i")).select("i.*").where("affected_records > 0")


def flag_is_yes(col: Column) -> Column:
    return F.upper(col) == "YES"


def flag_or_unknown(col: Column) -> Column:
    return F.coalesce(col, F.lit("Unknown"))


def excel_serial_to_ts(col: Column) -> Column:
    """Spreadsheet day number (text) to a timestamp; '-' and bad text give NULL."""
    seconds = F.round(col.try_cast("double") * 86400).cast("bigint")
    return F.timestamp_add("SECOND", seconds, F.lit("1899-12-30 00:00:00").cast("timestamp_ntz"))


def dedupe_keep_last(df: DataFrame, key: list[str], order: list[str], known: DataFrame | None = None) -> DataFrame:
    """The last row per key in ``order``, ties decided by all other columns; none for the keys of ``known``.

    A max over a struct combines on the map side, so a key shared by a third of
    all rows reaches the reducer as one row per input partition. Keys meet those of ``known`` where they were combined: rows are not dealt again.
    """
    rest = [c for c in df.columns if c not in order]
    names = [f"_k_{i}" for i in range(len(key))]
    named = [F.col(c).alias(n) for c, n in zip(key, names)]
    picked = df.groupBy(*named).agg(F.max(F.struct(*order, *rest)).alias("_row"))
    if known is not None:
        picked = picked.join(known.select(*named), names, "left_anti")
    return picked.select(*[F.col(f"_row.{c}").alias(c) for c in df.columns])


def dedupe_exact(df: DataFrame) -> DataFrame:
    return df.distinct()


def drop_noise(df: DataFrame, label: str = "cluster") -> DataFrame:
    return df.where(F.col(label) != -1)


def complete_to_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Schema columns in order; those not computed are NULL of their type.

    Copying another customer's row as a template would leak values, so only the
    NULL form exists.
    """
    return _mapped(df, schema, lambda n: n if n in df.columns else None).select(
        *[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields]
    )


def lookup_customers(df: DataFrame, ids: DataFrame) -> DataFrame:
    return df.join(ids.select(ID).distinct(), ID, "left_semi")


def cluster_members(labels: DataFrame, cluster: int, label: str = "cluster") -> DataFrame:
    return labels.where(F.col(label) == cluster).select(ID)


def check_duplicates(df: DataFrame, key: str, layer: str) -> DataFrame:
    """One row: total, distinct keys, surplus rows."""
    per_key = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(F.sum("n").alias("total_rows"), F.count(key).alias("distinct_keys")).select(
        F.lit(layer).alias("layer"), F.coalesce("total_rows", F.lit(0)).alias("total_rows"), "distinct_keys",
        (F.coalesce("total_rows", F.lit(0)) - F.col("distinct_keys")).alias("duplicates"),
    )


def top_duplicates(df: DataFrame, key: str, k: int = 10) -> DataFrame:
    per_key = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return per_key.orderBy(F.desc("n"), key).limit(k)
