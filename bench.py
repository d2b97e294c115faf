"""Headline timings: one JSON line. BENCH_SF_DIR and BENCH_CPUS select data and cores."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from backflow.catalog import registry
from backflow.session import build_session

HEADLINE = [
    "f_01_basic_volume", "f_02_return_behavior", "f_03_consecutive_returns", "f_04_temporal", "f_05_recency", "f_06_category_intelligence",
    "f_07_adjacency", "f_08_seasonal", "f_09_trend", "f_10_monetary", "f_20_create_all_features", "f_23_category_diversity",
    "jn_03_adjacent_pairs", "so_03_dedupe_keep_last", "snk_03_append_ignore", "scl_03_minmax_rescale", "dq_06_check_duplicates",
    "pf_02_customer_distribution", "pf_03_metric_distributions", "scl_01_robust_scale", "c_15_cluster_profiles_sheet",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("OFF")
    queries = registry.queries()
    only = sys.argv[1:]
    names = [n for n in HEADLINE if not only or any(p in n for p in only)]
    # One untimed run of two shapes so that class loading is not measured.
    for name in ("f_01_basic_volume", "f_10_monetary"):
        queries[name](spark, sf).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        start = time.time()
        queries[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": Path(sf).name}))
    spark.stop()


if __name__ == "__main__":
    main()
