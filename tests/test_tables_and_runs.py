"""Write-then-read tests of sinks, streaming ingest and the drivers."""

from datetime import datetime

import pytest
from conftest import SMALL, rows
from pyspark.sql import functions as F

from backflow.operators import clean, joins, profile
from backflow.plans import pipeline
from backflow.schemas import CLUSTERING_RESULTS, FEATURE_LOG, GOLD, QUALITY_ISSUES, SILVER, TABLES
from backflow.sinks import tables as sinks
from backflow.sources import order_lines as order_line_source, readers
from backflow.sources.order_lines import order_lines
from backflow.streaming.ingest import merge_staged, stage_new_files


def source_text(spark, where="true"):
    """Order lines in the upper-case text form of a source file."""
    lines = order_lines(spark, SMALL).where(where)
    names = ["sales_order_no", "order_date", "sku", "gross", "units_returned_flag", "return_date", "return_no", "q_cls_id", "q_sku_desc", "q_sku_id", "class_", "division_", "brand_", "size_"]
    return lines.select(
        F.col("customer_emailid_raw").alias("CUSTOMER_EMAILID"), F.concat(F.col("sales_qty").cast("string"), F.lit(".0000")).alias("SALES_QTY"),
        F.concat(F.col("return_qty").cast("string"), F.lit(".0000")).alias("RETURN_QTY"), *[F.col(n).cast("string").alias(n.upper()) for n in names],
    )


def write_csv(df, path):
    df.write.option("header", True).csv(str(path))
    return str(path)


def test_create_layers_and_overwrite(spark):
    made = sinks.create_layers(spark, "t_")
    assert len(made) == len(TABLES) and sinks.create_layers(spark, "t_") == []
    df = spark.createDataFrame([("a", 0.5)], "customer_emailid string, return_rate double")
    assert sinks.overwrite_table(df, "t_silver_customer_features", SILVER) == 1
    row = spark.table("t_silver_customer_features").first()
    assert row["return_rate"] == 0.5 and row["data_quality_flags"] == "" and row["sku_nunique"] is None


def test_align_reports_and_refuses(spark):
    df = spark.createDataFrame([(1, "a")], "extra int, customer_emailid string")
    out, report = sinks.align_to_schema(df, CLUSTERING_RESULTS)
    assert out.columns == CLUSTERING_RESULTS.fieldNames() and report["extra"] == ["extra"] and "final_cluster_id" in report["missing"]
    with pytest.raises(ValueError):
        sinks.align_to_schema(df.drop("customer_emailid"), CLUSTERING_RESULTS)


def test_replace_method_touches_only_its_rows(spark, tmp_path):
    path = str(tmp_path / "results")
    make = lambda m, n: spark.createDataFrame([(f"c{i}", i, m) for i in range(n)], "customer_emailid string, final_cluster_id int, clustering_method string")
    sinks.replace_method(make("A", 3).unionByName(make("B", 2)), path)
    sinks.replace_method(make("A", 1), path)
    got = spark.read.parquet(path).groupBy("clustering_method").count()
    assert rows(got, "clustering_method") == [("A", 1), ("B", 2)]


def test_exports_metadata_and_reports(spark, tmp_path):
    df = spark.range(10).withColumn("x", F.col("id") * 2)
    path, n = sinks.export_layer(df, str(tmp_path), "silver")
    assert n == 10 and spark.read.option("header", True).csv(path).count() == 10
    sinks.export_table(df.repartition(4), str(tmp_path / "many"), one_file=True)
    assert len(list((tmp_path / "many").glob("part-*"))) == 4 and len(list((tmp_path / "many-one").glob("part-*"))) == 1
    assert spark.read.option("header", True).csv(str(tmp_path / "many-one")).count() == 10
    assert spark.read.option("header", True).csv(str(tmp_path / "many")).count() == 10
    sinks.write_metadata(spark, {"k": 3, "names": ["a"]}, str(tmp_path / "meta"))
    assert sinks.read_metadata(spark, str(tmp_path / "meta")) == {"k": 3, "names": ["a"]}
    assert sinks.write_report_tables({"a": df, "b": df.limit(2)}, str(tmp_path / "report")) == {"a": 10, "b": 2}


def test_logs_continue_their_ids(spark):
    empty = spark.createDataFrame([], FEATURE_LOG)
    first = sinks.log_run(empty, "basic_volume", datetime(2024, 1, 1), datetime(2024, 1, 1, 0, 0, 2), 5)
    second = sinks.log_run(empty.unionByName(first), "trend", datetime(2024, 1, 1), datetime(2024, 1, 1), 1)
    assert first.first()["log_id"] == 1 and first.first()["execution_time_seconds"] == 2.0 and second.first()["log_id"] == 2
    found = spark.createDataFrame([("B", "x", 2, "HIGH"), ("A", "y", 1, "LOW")], "issue_type string, issue_description string, affected_records long, severity string")
    issues = sinks.log_issues(spark.createDataFrame([], QUALITY_ISSUES), found)
    assert [(r["issue_id"], r["issue_type"], r["resolved"]) for r in issues.orderBy("issue_id").collect()] == [(1, "A", False), (2, "B", False)]


def test_retype_and_backfill(spark, tmp_path):
    src, dst = str(tmp_path / "a"), str(tmp_path / "b")
    spark.createDataFrame([("1", "x"), ("oops", "y")], "n string, k string").write.parquet(src)
    out = sinks.retype_column(spark, src, dst, "n", "int")
    assert rows(out, "k") == [(1, "x"), (None, "y")] and spark.read.parquet(src).dtypes[0] == ("n", "string")
    base = spark.createDataFrame([("o1",), ("o2",)], "k string")
    prices = spark.createDataFrame([("o1", 5.0), ("o1", 4.0)], "k string, gross double")
    filled, changed = sinks.add_column_backfill(base, prices, ["k"])
    assert changed and rows(filled, "k") == [("o1", 5.0), ("o2", 0.0)]
    same, changed = sinks.add_column_backfill(filled, prices.withColumn("gross", F.lit(9.0)), ["k"])
    assert not changed and same is filled
    forced, changed = sinks.add_column_backfill(filled, prices.withColumn("gross", F.lit(9.0)), ["k"], force=True)
    assert changed and rows(forced, "k") == [("o1", 9.0), ("o2", 0.0)]
    assert sinks.column_stats(forced).first().asDict()["rows_with_gross"] == 1


def test_readers(spark, tmp_path):
    path = write_csv(source_text(spark, "line_no <= 2"), tmp_path / "lines.csv")
    bronze = readers.load_bronze(spark, path)
    n, keys = bronze.count(), bronze.select("primary_key").distinct().count()
    assert n == keys > 0 and dict(bronze.dtypes)["sales_qty"] == "int"
    assert bronze.where("return_date < order_date").count() == 0
    assert bronze.where(F.col("customer_emailid") != F.lower("customer_emailid")).count() == 0
    assert all(t == "string" for _, t in readers.read_all_string(spark, path).dtypes)
    narrow = spark.createDataFrame([("a", "o", "g", "c", "s", "d", "1.0", "Yes", "n", "1", "2024-01-01", "-")], ", ".join(f"{c.upper()} string" for c in readers.PROJECTED))
    got = readers.read_projected_csv(spark, write_csv(narrow, tmp_path / "narrow.csv")).first()
    assert got["return_date"] is None and got["sales_qty"] == 1
    loaded = readers.load_table(spark, path, "loaded_lines", force=True)
    assert loaded.count() == readers.load_table(spark, "/does/not/exist.csv", "loaded_lines").count()
    with pytest.raises(ValueError):
        readers.load_table(spark, str(tmp_path / "x.docx"), "other_lines")


def test_streaming_ingest_takes_each_file_once(spark, tmp_path):
    source, staging, state = tmp_path / "in", str(tmp_path / "staged"), str(tmp_path / "state")
    first = source_text(spark, "line_no = 1").coalesce(1)
    header = first.columns
    first.write.mode("append").option("header", True).csv(str(source))
    stage_new_files(spark, str(source), staging, state, header)
    stage_new_files(spark, str(source), staging, state, header)
    staged = spark.read.parquet(staging)
    assert staged.count() == first.count()
    bronze = staged.limit(0)
    grown = bronze.unionByName(merge_staged(bronze, staged))
    source_text(spark, "line_no <= 2").coalesce(1).write.mode("append").option("header", True).csv(str(source))
    stage_new_files(spark, str(source), staging, state, header)
    again = merge_staged(grown, spark.read.parquet(staging))
    assert 0 < again.count() < spark.read.parquet(staging).count()
    assert again.join(grown.select("primary_key"), "primary_key").count() == 0


def test_full_build_then_incremental(spark, tmp_path):
    csv = write_csv(source_text(spark, "CAST(sales_order_no AS INT) % 10 <> 0"), tmp_path / "a.csv")
    out = str(tmp_path / "full")
    log = pipeline.run_full(
        spark, csv, out, gold_options={"correlation_threshold": 0.95},
        cluster_options={"dbscan_eps": 3.0, "dbscan_min_samples": 3, "k_values": [2, 3], "n_init": 1, "sub_eps": 1.0},
    )
    assert {r["status"] for r in log.collect()} == {"SUCCESS"}
    read = spark.read.parquet
    silver, gold, labels = read(f"{out}/silver"), read(f"{out}/gold"), read(f"{out}/labels")
    customers = read(f"{out}/bronze").select("customer_emailid").distinct().count()
    assert silver.count() == gold.count() == labels.count() == customers
    assert silver.columns == SILVER.fieldNames() and gold.columns == GOLD.fieldNames()
    assert read(f"{out}/report/customer_assignments").count() == customers
    assert sinks.read_metadata(spark, f"{out}/clustering_metadata")["k"] in (2, 3)

    new = write_csv(source_text(spark), tmp_path / "b.csv")
    inc = str(tmp_path / "inc")
    # The incremental key has its own spelling, so the base is rekeyed once.
    base = clean.with_primary_key(read(f"{out}/bronze"), ["sales_order_no", "sku", "customer_emailid"])
    sinks.write_checked(clean.dedupe_keep_last(base, ["primary_key"], ["order_date"]), f"{inc}_base")
    log = pipeline.run_incremental(spark, new, f"{inc}_base", f"{out}/silver", f"{out}/gold", inc)
    assert [r["status"] for r in log.collect()] == ["SUCCESS"] * 6
    added = read(f"{inc}/bronze").count() - read(f"{inc}_base").count()
    assert added == int(log.where("step = 'import'").first()["detail"]) > 0
    assert read(f"{inc}/silver").count() == read(f"{inc}/bronze").select("customer_emailid").distinct().count()
    assert joins.missing_keys(read(f"{inc}/bronze"), read(f"{inc}/silver")).count() == 0

    again = pipeline.run_refresh(spark, new, f"{inc}/bronze", f"{inc}/silver", f"{inc}/gold", str(tmp_path / "again"), "import")
    status = {r["step"]: (r["status"], r["detail"]) for r in again.collect()}
    assert status["import"] == ("SUCCESS", "0") and status["gold"][0] == "SKIPPED"


def test_failing_step_stops_the_run(spark, tmp_path):
    with pytest.raises(Exception):
        pipeline.run_full(spark, str(tmp_path / "missing.csv"), str(tmp_path / "out"))
    assert not (tmp_path / "out" / "silver").exists()


def test_variant_build_is_kept_unless_forced(spark, tmp_path):
    path = str(tmp_path / "lines.parquet")
    order_lines(spark, SMALL).write.parquet(path)
    first = pipeline.run_variant(spark, path, "variant_features", force=True).count()
    assert first == pipeline.run_variant(spark, "/does/not/exist", "variant_features").count() > 0


def test_parts_of_the_lines_grow_with_the_lines(spark, monkeypatch):
    monkeypatch.setattr(order_line_source, "LINES_A_TASK", 200)
    lines = order_lines(spark, SMALL)
    sizes = [r["count"] for r in lines.groupBy(F.spark_partition_id()).count().collect()]
    # Few rows make no single part: AQE must not put the dealt ones together.
    assert len(sizes) > 10 and max(sizes) < 4 * 200 and sum(sizes) == spark.read.parquet(f"{SMALL}/lineitem.parquet").count()
    assert order_line_source.parts_of_lines(spark, 0) == 1


def test_metric_distributions_start_from_customer_rows(spark):
    # Both halves read a checkpoint, so the result names no file of the lines any more.
    assert profile.metric_distributions(order_lines(spark, SMALL)).inputFiles() == []
