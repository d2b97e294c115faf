"""Drivers: incremental refresh, full build, short chains and the variant build."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from backflow.features import current as now, order_item
from backflow.functions.expressions import ID
from backflow.operators import clean, joins, prepare as pre, profile, quality
from backflow.operators.clean import complete_to_schema
from backflow.plans import layers
from backflow.schemas import BRONZE
from backflow.sinks import tables as sinks
from backflow.sources import readers

KEY = ["primary_key"]
ORDER = ["order_date", "return_date"]


@dataclass
class Run:
    """Step log of one run; a failing step stops the run."""

    spark: SparkSession
    only: set[str] | None = None
    rows: list[tuple] = field(default_factory=list)

    def step(self, name: str, job: Callable[[], object]) -> object:
        if self.only is not None and name not in self.only:
            self.rows.append((name, "SKIPPED", 0.0, ""))
            return None
        start = time.time()
        try:
            result = job()
        except Exception as exc:
            self.rows.append((name, "FAILED", time.time() - start, f"{type(exc).__name__}: {exc}"))
            raise
        detail = str(result) if isinstance(result, (int, str, bool)) else ""
        self.rows.append((name, "SUCCESS", time.time() - start, detail))
        return result

    def log(self) -> DataFrame:
        return self.spark.createDataFrame(self.rows, "step string, status string, seconds double, detail string")


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def typed_source(spark: SparkSession, csv: str) -> DataFrame:
    """A new-data file mapped, typed, keyed and cleaned to the bronze schema."""
    raw = clean.coerce_types(clean.map_columns_ci(readers.read_all_string(spark, csv), BRONZE))
    tidy = raw.withColumn(ID, clean.clean_email(F.col(ID)))
    return complete_to_schema(clean.fix_return_dates(clean.with_primary_key(tidy, ["sales_order_no", "sku", ID])), BRONZE)


def import_new(bronze: DataFrame, incoming: DataFrame, target: str) -> int:
    """Bronze plus the rows with absent keys in a new location; the number added (zero is fine)."""
    spark = bronze.sparkSession
    sinks.write_checked(joins.append_ignore(bronze, incoming, KEY, ORDER), f"{target}_added")
    added = read(spark, f"{target}_added")
    sinks.write_checked(bronze.unionByName(added), target)
    return sinks.row_count(added)


def refresh_silver(bronze: DataFrame, silver: DataFrame, target: str) -> int:
    """Refreshed diversity for known customers, full features for new ones."""
    updated = joins.update_from(silver, now.category_diversity(bronze), [ID], ["category_diversity_score"])
    fresh = joins.missing_keys(bronze, silver)
    # Global figures (cut-off, limits, category totals) still come from all lines,
    # so features are built on everything and only the new customers kept.
    if fresh.limit(1).count():
        updated = updated.unionByName(layers.build_silver(bronze).join(fresh, ID, "left_semi").select(*updated.columns))
    return sinks.write_checked(updated, target)


def rescale_gold(gold: DataFrame, silver: DataFrame, target: str) -> int:
    """Diversity of gold rows rescaled by the silver range."""
    score = silver.select(ID, "category_diversity_score")
    scaled = pre.minmax_rescale(score, silver, "category_diversity_score", "category_diversity_score_scaled")
    return sinks.write_checked(joins.update_from(gold, scaled.select(ID, "category_diversity_score_scaled"), [ID], ["category_diversity_score_scaled"]), target)


def duplicate_report(frames: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    parts = [clean.check_duplicates(df, key, name) for name, (df, key) in frames.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def run_incremental(spark: SparkSession, csv: str, bronze: str, silver: str, gold: str, out: str, only: set[str] | None = None) -> DataFrame:
    """Duplicates, import, silver, gold, duplicates again, export; new versions under ``out``."""
    run = Run(spark, only)

    def duplicates(b: str, s: str, g: str, name: str) -> int:
        frame = duplicate_report({"bronze": (read(spark, b), "primary_key"), "silver": (read(spark, s), ID), "gold": (read(spark, g), ID)})
        return sinks.write_checked(frame, f"{out}/{name}")

    run.step("duplicates_before", lambda: duplicates(bronze, silver, gold, "duplicates_before"))
    run.step("import", lambda: import_new(read(spark, bronze), typed_source(spark, csv), f"{out}/bronze"))
    done = lambda step, new, old: new if any(r[0] == step and r[1] == "SUCCESS" for r in run.rows) else old
    b = done("import", f"{out}/bronze", bronze)
    run.step("silver", lambda: refresh_silver(read(spark, b), read(spark, silver), f"{out}/silver"))
    s = done("silver", f"{out}/silver", silver)
    run.step("gold", lambda: rescale_gold(read(spark, gold), read(spark, s), f"{out}/gold"))
    g = done("gold", f"{out}/gold", gold)
    run.step("duplicates_after", lambda: duplicates(b, s, g, "duplicates_after"))
    run.step("export", lambda: sinks.export_layer(read(spark, s), f"{out}/export", "silver")[1] + sinks.export_layer(read(spark, g), f"{out}/export", "gold")[1])
    return run.log()


def run_refresh(spark: SparkSession, csv: str, bronze: str, silver: str, gold: str, out: str, chain: str = "diversity") -> DataFrame:
    """Short chains: ``import`` (import, silver, export), ``diversity`` (silver, export), ``gold`` (gold, export)."""
    steps = {"import": {"import", "silver", "export"}, "diversity": {"silver", "export"}, "gold": {"gold", "export"}}[chain]
    return run_incremental(spark, csv, bronze, silver, gold, out, steps)


def run_full(spark: SparkSession, csv: str, out: str, only: set[str] | None = None, gold_options: dict | None = None, cluster_options: dict | None = None) -> DataFrame:
    """Load, profile, features, analytics, preprocessing and clustering with a step log."""
    run = Run(spark, only)
    where = lambda name: f"{out}/{name}"
    run.step("load", lambda: sinks.write_checked(complete_to_schema(readers.load_bronze(spark, csv), BRONZE), where("bronze")))
    run.step("profile", lambda: sinks.write_checked(profile.overview(read(spark, where("bronze"))), where("overview")))

    def features() -> int:
        silver = layers.build_silver(read(spark, where("bronze")))
        rows = sinks.write_checked(silver, where("silver_candidate"))
        stored = read(spark, where("silver_candidate"))
        checks = quality.validate_silver(stored)
        sinks.write_checked(checks, where("silver_validation"))
        if not quality.silver_passes(read(spark, where("silver_validation"))):
            raise ValueError("silver validation failed")
        sinks.write_checked(stored, where("silver"))
        return rows

    run.step("features", features)
    run.step("analytics", lambda: sinks.write_checked(profile.silver_summary(read(spark, where("silver"))), where("silver_summary")))

    def preprocess() -> int:
        gold, meta = layers.build_gold(read(spark, where("silver")), **(gold_options or {}))
        sinks.write_metadata(spark, meta, where("gold_metadata"))
        return sinks.write_checked(gold, where("gold"))

    run.step("preprocess", preprocess)

    def cluster() -> int:
        gold, silver = read(spark, where("gold")), read(spark, where("silver"))
        labels, meta = layers.run_clustering(gold, cluster_options)
        sinks.write_checked(labels, where("labels"))
        stored = read(spark, where("labels"))
        sinks.write_metadata(spark, meta, where("clustering_metadata"))
        sinks.write_report_tables(layers.report_tables(stored, silver, gold, meta), where("report"))
        return sinks.row_count(stored)

    run.step("cluster", cluster)
    log = run.log()
    sinks.write_checked(log, where("step_log"))
    return log


def run_variant(spark: SparkSession, path: str, table: str = "customer_features", style: str = "table", force: bool = False) -> DataFrame:
    """Summary-based features from a file, kept under ``table`` unless forced."""
    if spark.catalog.tableExists(table) and not force:
        return spark.table(table)
    lines = readers.read_projected_csv(spark, path) if path.endswith(".csv") else read(spark, path)
    if "line_no" not in lines.columns:
        # Total order for equal instants; content decides, so it is repeatable.
        lines = lines.withColumn("line_no", F.xxhash64(*lines.columns))
    sinks.overwrite_table(order_item.summary_features(lines, style), table)
    return spark.table(table)
