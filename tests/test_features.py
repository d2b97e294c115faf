"""Edge frames with hand-made expectations, and brute force on random frames."""

import random
from datetime import datetime, timedelta

import pytest
from conftest import SMALL, rows
from pyspark.sql import functions as F

from backflow.features import current as now, returners as rt
from backflow.sources.order_lines import order_lines


def one(df):
    return df.first().asDict()


def test_zero_quantity_and_no_returns_give_zero_rates(make_lines):
    got = one(now.return_behavior(make_lines([{"qty": 0}, {"qty": 0, "o": "o2"}])))
    assert got["return_rate"] == 0.0 and got["return_intensity"] == 0.0 and got["avg_returns_per_order"] == 0.0


def test_everything_returned(make_lines):
    got = one(now.return_behavior(make_lines([{"qty": 2, "back": 2}, {"qty": 3, "back": 3, "sku": "s2"}])))
    assert got["return_rate"] == 1.0 and got["return_product_variety"] == 2 and got["return_intensity"] == 2.5


def test_single_order_has_zero_spread_and_lifetime(make_lines):
    got = one(now.temporal(make_lines([{"back": 1, "ret": "2024-01-05"}])))
    assert got["customer_lifetime_days"] == 0 and got["avg_days_to_return"] == 4.0
    assert got["return_timing_spread"] == 0.0 and got["customer_tenure_stage"] == "New"


@pytest.mark.parametrize("flags, expected", [("0", (0, 0.0)), ("1", (1, 1.0)), ("110111", (2, 2.5)), ("10101", (3, 1.0)), ("0110", (1, 2.0))])
def test_return_streaks(make_lines, flags, expected):
    lines = make_lines([{"o": f"o{i}", "at": str(datetime(2024, 1, 1) + timedelta(days=40 * i)), "back": int(f)} for i, f in enumerate(flags)])
    got = one(now.consecutive_returns(lines))
    assert (got["consecutive_returns"], got["avg_consecutive_returns"]) == expected


def test_streaks_across_orders_of_one_instant_follow_the_order_number(make_lines):
    same = "2024-01-01 10:00:00"
    got = one(now.consecutive_returns(make_lines([{"o": "1", "at": same, "back": 1}, {"o": "2", "at": same}, {"o": "3", "at": same, "back": 1}])))
    assert got["consecutive_returns"] == 2


def test_null_category_is_left_out_of_category_features(make_lines):
    got = one(now.category_intelligence(make_lines([{"cat": None}, {"cat": "x"}, {"cat": "x", "cls": "y"}])))
    assert got["category_loyalty_score"] == 1.0 and got["category_diversity_score"] == 0.5


def test_null_gross_customers_have_no_monetary_row(make_lines):
    got = rows(now.monetary_raw(make_lines([{"gross": None}, {"c": "b", "gross": 5.0}])), "customer_emailid")
    assert [r[0] for r in got] == ["b"]


def test_three_seasons_are_needed(make_lines):
    dates = ["2020-01-05", "2020-04-05", "2024-04-06"]
    two = one(now.seasonal(make_lines([{"at": d, "o": d} for d in dates])))
    assert two["seasonal_susceptibility_orders"] == 0.0
    three = one(now.seasonal(make_lines([{"at": d, "o": d} for d in dates + ["2022-08-01"]])))
    assert three["seasonal_susceptibility_orders"] > 0


def test_constant_category_series_has_zero_trend(make_lines):
    lines = make_lines([{"at": f"2024-0{m}-01", "o": str(m), "cat": "k"} for m in range(1, 8)])
    assert one(now.trend(lines))["trend_product_category_order_rate"] == 0.0


def test_adjacency_window_is_inclusive_at_14_days(make_lines):
    base = {"at": "2024-01-01", "sku": "x", "o": "1"}
    inside = one(now.adjacency(make_lines([base, {"at": "2024-01-15", "sku": "y", "o": "2"}])))
    outside = one(now.adjacency(make_lines([base, {"at": "2024-01-16", "sku": "y", "o": "2"}])))
    instant = one(now.adjacency(make_lines([base, {"at": "2024-01-01", "sku": "y", "o": "2"}])))
    assert (inside["sku_adjacency_orders"], inside["sku_adjacency_timing"]) == (2, 14.0)
    assert outside["sku_adjacency_orders"] == 0 and instant["sku_adjacency_orders"] == 0


def brute_adjacency(lines, days=14):
    out = {}
    for a in lines:
        for b in lines:
            gap = abs((a["at"].date() - b["at"].date()).days)
            if a["c"] == b["c"] and a["sku"] != b["sku"] and a["at"] != b["at"] and gap <= days:
                s = out.setdefault(a["c"], [set(), 0, [], []])
                s[0].add((a["sku"], b["sku"]))
                s[2].append(gap)
                if a["back"] > 0 and b["back"] > 0:
                    s[1] += 1
                    s[3].append(gap)
    mean = lambda v: sum(v) / len(v) if v else 0.0
    return {c: (len(s[0]), s[1], mean(s[2]), mean(s[3])) for c, s in out.items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_adjacency_equals_brute_force_with_a_hot_customer(make_lines, seed):
    rng = random.Random(seed)
    items = []
    for i in range(220):
        at = datetime(2024, 1, 1) + timedelta(days=rng.randrange(60), hours=rng.choice([0, 12]))
        items.append({"c": "hot" if rng.random() < 0.5 else rng.choice("xyz"), "sku": f"s{rng.randrange(9)}", "at": at, "back": rng.randrange(2), "o": str(i)})
    expected = brute_adjacency(items)
    got = now.adjacency(make_lines([{**x, "at": str(x["at"])} for x in items])).collect()
    for r in got:
        want = expected.get(r["customer_emailid"], (0, 0, 0.0, 0.0))
        assert (r["sku_adjacency_orders"], r["sku_adjacency_returns"]) == want[:2]
        assert r["sku_adjacency_timing"] == pytest.approx(want[2]) and r["sku_adjacency_return_timing"] == pytest.approx(want[3])


def compare_single_features(lines):
    wide = now.core_features(lines)
    single = {
        "basic_volume": now.basic_volume(lines), "return_behavior": now.return_behavior(lines), "temporal": now.temporal(lines),
        "recency": now.recency(lines), "monetary": now.monetary(lines),
    }
    for name, df in single.items():
        a = {r["customer_emailid"]: r.asDict() for r in df.collect()}
        b = {r["customer_emailid"]: r.asDict() for r in wide[name].collect()}
        assert a.keys() == b.keys()
        for k in a:
            for c, v in a[k].items():
                assert b[k][c] == (pytest.approx(v, abs=1e-9) if isinstance(v, float) else v), (name, c)


def test_wide_core_table_equals_the_single_features(spark):
    lines = order_lines(spark, SMALL).cache()
    try:
        compare_single_features(lines)
    finally:
        lines.unpersist(blocking=True)  # later tests of the session look at plans over the same tables


def test_new_customers_only(make_lines, spark):
    lines = make_lines([{"c": "old"}, {"c": "new", "back": 1}])
    known = spark.createDataFrame([("old",)], "customer_emailid string")
    got = now.new_customer_features(lines, known).collect()
    assert [r["customer_emailid"] for r in got] == ["new"] and got[0]["return_rate"] == 1.0


def test_recent_vs_average_needs_ten_orders(make_lines):
    items = [{"o": f"{i:02d}", "at": f"2024-{1 + i // 28:02d}-{1 + i % 28:02d}", "back": int(i >= 9)} for i in range(12)]
    got = one(rt.recent_vs_avg(make_lines(items)))
    assert got["recent_order_count"] == 3 and got["recent_return_rate"] == 1.0 and got["recent_vs_avg_ratio"] == pytest.approx(4.0)
    few = one(rt.recent_vs_avg(make_lines(items[:5] + [{"o": "zz", "back": 1}])))
    assert few["recent_vs_avg_ratio"] == 1.0


def test_empty_input_gives_empty_features(make_lines):
    lines = make_lines([{}]).where(F.lit(False))
    for job in (now.basic_volume, now.consecutive_returns, now.adjacency, now.category_intelligence, now.monetary, now.trend):
        assert job(lines).count() == 0


def test_returner_segments_start_from_rows_worked_out_once(spark, make_lines):
    from backflow.catalog import segment_queries
    from conftest import SMALL

    plan = segment_queries.returner_segments(spark, SMALL)._jdf.queryExecution().toString()
    assert "parquet" not in plan.lower()
    # An order over two days, one line without an order and one without a SKU; a customer without returns is left out.
    items = [{"o": "1", "at": "2024-01-01", "sku": "a", "back": 1, "qty": 2, "ret": "2024-01-04"}, {"o": "1", "at": "2024-06-01", "sku": "b", "qty": 4},
             {"o": None, "at": "2024-05-01", "sku": "a", "back": 3, "qty": 3}, {"o": "2", "at": "2024-02-01", "sku": None, "qty": 5}, {"c": "z", "o": "9", "at": "2025-01-01"}]
    (row,) = rt.clustering_frame(make_lines(items)).collect()
    want = {"sales_order_no_nunique": 2, "sku_nunique": 2, "return_rate": 0.5, "return_ratio": round(4 / 14, 3), "items_returned_count": 2, "return_product_variety": 1, "customer_lifetime_days": 152,
            "recent_orders": 1, "recent_returns": 1, "sales_qty_mean": 3.5, "avg_days_to_return": 3, "return_timing_spread": 0, "avg_returns_per_order": 1, "return_frequency_ratio": 1, "avg_return_intensity": 0.75}
    assert {c: row[c] for c in want} == want


def test_customer_base_is_worked_out_once(spark):
    from backflow.catalog import common
    from conftest import SMALL

    assert "parquet" not in common.customer_base(spark, SMALL)._jdf.queryExecution().toString().lower()
