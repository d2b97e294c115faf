"""Quantiles, ordered columns, dedupe, upserts, similarity join, cleaning."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from conftest import rows
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F, types as T

from backflow.functions import text as tx
from backflow.operators import clean, joins, pivots, quality
from backflow.operators.ordered import with_running
from backflow.operators.quantiles import exact_quantiles, quantile_row
from backflow.schemas import BRONZE, GOLD, SILVER
from backflow.sources import readers

NUMBERS = st.lists(st.one_of(st.floats(-1e6, 1e6, allow_nan=False), st.sampled_from([0.0, 1.0, 2.0, 0.5, -3.0, 1e-12, 1e15])), min_size=1, max_size=60)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(NUMBERS)
def test_quantiles_match_numpy(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    got = exact_quantiles(df, [], "x", {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.99, "e": 1.0}).first()
    assert list(got) == pytest.approx(list(np.quantile(values, [0, 0.25, 0.5, 0.99, 1])), rel=1e-9, abs=1e-9)
    disc = exact_quantiles(df, [], "x", {"q": 0.75}, discrete=True).first()[0]
    assert disc == sorted(values)[max(int(np.ceil(len(values) * 0.75)) - 1, 0)]


def test_quantiles_with_a_hot_value_and_nulls(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7.0).when(F.col("id") % 3 == 1, F.col("id").cast("double")).alias("x"))
    values = [7.0] * 1000 + [float(i) for i in range(3000) if i % 3 == 1]
    got = quantile_row(df, {"m": ("x", 0.5), "p": ("x", 0.9)}).first()
    assert tuple(got) == pytest.approx(tuple(np.quantile(values, [0.5, 0.9])))


def test_running_columns_match_a_plain_loop(spark):
    rng = random.Random(3)
    data = [(rng.choice(["hot"] * 4 + ["x"]), datetime(2024, 1, 1) + timedelta(hours=7 * rng.randrange(40)), i, rng.randrange(5)) for i in range(200)]
    df = spark.createDataFrame(data, "k string, t timestamp_ntz, i int, v int")
    got = {r["i"]: (r["total"], r["prev"], r["n"]) for r in with_running(df, "k", "t", ["i"], {"total": "v"}, {"prev": "v"}, "n").collect()}
    for key in ("hot", "x"):
        total, prev = 0, None
        for n, row in enumerate(sorted((r for r in data if r[0] == key), key=lambda r: (r[1], r[2])), 1):
            total += row[3]
            assert got[row[2]] == (total, prev, n)
            prev = row[3]


def test_dedupe_keeps_the_last_row_whatever_the_input_order(spark):
    data = [("k", 1, "a"), ("k", 3, None), ("k", 3, "b"), ("j", 2, "z")]
    for order in (data, data[::-1]):
        got = rows(clean.dedupe_keep_last(spark.createDataFrame(order, "key string, n int, v string"), ["key"], ["n"]), "key")
        assert got == [("j", 2, "z"), ("k", 3, "b")]


def test_upserts_with_repeated_keys_in_the_batch(spark):
    base = spark.createDataFrame([("a", 1), ("b", 1)], "key string, n int")
    batch = spark.createDataFrame([("b", 2), ("b", 3), ("c", 2), ("c", 5)], "key string, n int")
    assert rows(joins.upsert_keep_new(base, batch, ["key"], ["n"]), "key") == [("a", 1), ("b", 3), ("c", 5)]
    assert rows(joins.append_ignore(base, batch, ["key"], ["n"])) == [("c", 5)]
    grown, added = joins.append_new(base, batch, ["key"], ["n"])
    assert added.first()[0] == 1 and rows(grown, "key") == [("a", 1), ("b", 1), ("c", 5)]
    updated = joins.update_from(base, spark.createDataFrame([("b", None), ("z", 9)], "key string, n int"), ["key"], ["n"])
    assert rows(updated, "key") == [("a", 1), ("b", None)]


def test_not_in_with_a_null_leaves_nothing(spark):
    df = spark.createDataFrame([("a",), ("b",)], "customer_emailid string")
    assert joins.not_in(df, spark.createDataFrame([("a",), (None,)], "customer_emailid string")).count() == 0
    assert rows(joins.not_in(df, spark.createDataFrame([("a",)], "customer_emailid string"))) == [("b",)]


def edit_distance(a, b):
    line = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, line[j] + 1, line[j - 1] + (x != y)))
        line = new
    return line[-1]


@pytest.mark.parametrize("threshold", [0.8, 0.6])
def test_similar_ids_equal_all_pairs(spark, threshold):
    rng = random.Random(11)
    ids = ["", "a", "ab", "@", "a@b", "x@mail.com", "x@mail.org", "xy@mail.com", "mail.com", "x.mail.com"]
    for _ in range(60):
        word = list("".join(rng.choice("abc") for _ in range(rng.randrange(1, 12))) + rng.choice(["@mail.com", "@mail.org", "@mai.com", ""]))
        ids.append("".join(word))
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(word))
            word[at] = rng.choice(["", "a", "q", "ab"])
        ids.append("".join(word))
    ids = sorted(set(ids))
    expected = {}
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            score = 1.0 - edit_distance(a, b) / max(len(a), len(b))
            if score >= threshold:
                expected[(a, b)] = score
    got = {(r[0], r[1]): r[2] for r in joins.similar_ids(spark.createDataFrame([(x,) for x in ids], "customer_emailid string"), threshold=threshold).collect()}
    assert got.keys() == expected.keys()
    assert all(got[k] == pytest.approx(v) for k, v in expected.items())


def test_case_groups(spark):
    df = spark.createDataFrame([("A@x",), ("a@x",), ("a@x",), ("b@x",)], "customer_emailid_raw string")
    assert sorted((r[0], r[1], r[3], r[4]) for r in joins.case_groups(df).collect()) == [("a@x", "A@x", 2, 3), ("a@x", "a@x", 2, 3)]


def test_return_dates_are_repaired_and_named(spark):
    d = datetime
    df = spark.createDataFrame([(1, d(2024, 1, 5), d(2024, 1, 2)), (2, d(2024, 1, 5), None), (0, d(2024, 1, 5), None), (1, d(2024, 1, 5), d(2024, 1, 9))],
                               "return_qty int, order_date timestamp_ntz, return_date timestamp_ntz")
    got = [(r["return_date"], r["data_quality_flags"]) for r in clean.fix_return_dates(df).collect()]
    assert got == [(d(2024, 1, 6), "RETURN_DATE_FIXED"), (d(2024, 1, 6), "RETURN_DATE_IMPUTED"), (None, ""), (d(2024, 1, 9), "")]
    assert {r["issue_type"]: r["affected_records"] for r in clean.return_date_issues(df).collect()} == {"INVALID_RETURN_DATES": 1, "MISSING_RETURN_DATES": 1}


def test_column_mapping_and_keys(spark):
    df = spark.createDataFrame([("1", "x", None)], "SALES_ORDER_NO string, Sku string, extra string")
    target = T.StructType([T.StructField(n, T.StringType()) for n in ("sku", "sales_order_no", "gross")])
    assert rows(clean.map_columns_ci(df, target)) == [("x", "1", None)]
    assert rows(clean.map_columns_fuzzy(spark.createDataFrame([("7",)], "the_SalesOrderNo_ string"), T.StructType([T.StructField("sales_order_no", T.StringType())]))) == [("7",)]
    assert clean.with_primary_key(df, ["SALES_ORDER_NO", "extra", "Sku"], "_").first()["primary_key"] == "1__x"


def test_excel_serials_and_bad_text(spark):
    df = spark.createDataFrame([("45205.5",), ("-",), ("x",), (None,)], "t string")
    got = [r[0] for r in df.select(clean.excel_serial_to_ts(F.col("t"))).collect()]
    assert got == [datetime(2023, 10, 6, 12), None, None, None]


def test_bins_are_right_closed(spark):
    df = spark.createDataFrame([(float(x),) for x in (0, 1, 2, 3)], "x double")
    assert [r["bin"] for r in pivots.equal_width_bins(df, "x", 3).orderBy("x").collect()] == [1, 1, 2, 3]
    same = spark.createDataFrame([(5.0,)] * 4, "x double")
    assert {r["bin"] for r in pivots.equal_width_bins(same, "x", 3).collect()} == {1}
    assert {r["bin"] for r in pivots.quantile_bins(same, "x", 5).collect()} == {1}


def test_silver_validation_blocks_bad_rows(spark):
    good = spark.createDataFrame([("a", 1, 1, 5, datetime(2024, 1, 1), datetime(2024, 1, 2), 0.5)],
                                 "customer_emailid string, sales_order_no_nunique int, sku_nunique int, customer_lifetime_days int, first_order_date timestamp_ntz, last_order_date timestamp_ntz, return_rate double")
    assert quality.silver_passes(quality.validate_silver(good))
    for broken in (good.unionByName(good), good.withColumn("return_rate", F.lit(1.2)), good.withColumn("sku_nunique", F.lit(None).cast("int")),
                   good.withColumn("first_order_date", F.lit("2025-01-01").cast("timestamp_ntz"))):
        assert not quality.silver_passes(quality.validate_silver(broken))


def test_text_scoring_handles_nulls_and_batches(spark):
    df = spark.createDataFrame([("great fit love it",), (None,), ("broken",), ("good but late",)], "Return_Comment string")
    got = [(r["model_sentiment"], r["model_confidence"]) for r in tx.score_text(df, batch=2).collect()]
    assert got == [("POSITIVE", 1.0), ("NEUTRAL", 0.5), ("NEGATIVE", 1.0), ("NEUTRAL", 0.5)]
    with pytest.raises(ValueError):
        tx.comment_column(spark.range(1))


def test_schema_sizes():
    assert len(SILVER) == 44 and len(GOLD) == 41 and len(BRONZE) == 25


def test_source_gates(spark):
    df = spark.createDataFrame([("a", None), ("b", "x")], "sku string, note string")
    got = {r["gate"]: r["passed"] for r in readers.validate_source(df, ["SKU", "note", "gone"]).collect()}
    assert got == {"required_columns": False, "row_count": True, "missing_sku": True, "missing_note": False}


# --- hot keys: no task above a stated bound -----------------------------------------------


def test_pairs_of_a_hot_customer_meet_by_bounded_blocks(spark):
    from backflow.operators.blocks import BLOCK, in_blocks, near_pairs

    rng = random.Random(21)
    data = {(("hot" if i % 3 else f"c{rng.randrange(30)}"), rng.choice([5, 5, 5, rng.randrange(60)]), i) for i in range(600)}
    df = spark.createDataFrame(sorted(data), "k string, day int, i int").repartition(3)
    held = in_blocks(df, ["k", "day", "i"], 4)
    assert held.groupBy("k", BLOCK).count().agg(F.max("count")).first()[0] <= 16
    assert held.groupBy("k").agg(F.countDistinct(BLOCK).alias("n")).where("k = 'hot'").first()["n"] >= 400 // 16
    for reach in (0, 3, 14):
        got = sorted((r["k"], r["i_a"], r["i_b"]) for r in near_pairs(df, "k", "day", reach, ["i"], bits=4).collect())
        by_key = {}
        for k, day, i in data:
            by_key.setdefault(k, []).append((day, i))
        expected = sorted((k, a[1], b[1]) for k, v in by_key.items() for n, a in enumerate(sorted(v)) for b in sorted(v)[n + 1 :] if b[0] - a[0] <= reach)
        assert got == expected


def test_adjacent_pairs_and_their_counts_with_a_hot_customer(spark, make_lines, monkeypatch):
    from backflow.features import current
    from backflow.operators import blocks

    monkeypatch.setattr(current, "near_pairs", lambda *a: blocks.near_pairs(*a, bits=3))
    rng = random.Random(22)
    items = [{"c": rng.choice(["hot", "hot", "x", "y"]), "sku": f"s{rng.randrange(6)}", "at": f"2024-0{rng.randrange(1, 3)}-{rng.randrange(1, 28):02d}", "back": rng.randrange(2)} for _ in range(90)]
    items += [dict(items[0])] * 5
    lines = make_lines(items)
    kept = [(r["customer_emailid"], r["q_sku_id"], r["order_date"], r["return_qty"] > 0) for r in lines.collect()]
    near = [(a, b) for a in kept for b in kept if a[0] == b[0] and a[1] != b[1] and a[2] != b[2] and abs((a[2] - b[2]).days) <= 14]
    got = sorted(map(str, current.adjacent_pairs(lines).collect()))
    assert len(got) == len(near)
    assert sorted((r["sku_a"], r["sku_b"], r["at_a"], r["at_b"], r["days_between"], r["returned_a"], r["returned_b"]) for r in current.adjacent_pairs(lines).collect()) == sorted(
        (a[1], b[1], a[2], b[2], abs((a[2] - b[2]).days), int(a[3]), int(b[3])) for a, b in near
    )
    skus = {r["customer_emailid"]: r["sku_adjacency_orders"] for r in current.adjacency(lines).collect()}
    assert skus == {c: len({(a[1], b[1]) for a, b in near if a[0] == c}) for c in {k[0] for k in kept}}


def test_ordered_columns_with_all_rows_at_one_instant(spark):
    rng = random.Random(23)
    data = [(None if i % 50 == 0 else "hot" if i % 3 else f"k{i % 7}", datetime(2024, 1, 1), i, rng.randrange(5)) for i in range(900)]
    df = spark.createDataFrame(data, "k string, t timestamp_ntz, i int, v int").repartition(4)
    out = with_running(df, "k", "t", ["i"], {"total": "v"}, {"prev": "v"}, "n", "size", bits=5)
    got = {r["i"]: (r["total"], r["prev"], r["n"], r["size"]) for r in out.collect()}
    for key in {r[0] for r in data}:
        rows_of, total, prev = [r for r in data if r[0] == key], 0, None
        for n, row in enumerate(rows_of, 1):
            total += row[3]
            assert got[row[2]] == (total, prev, n, len(rows_of))
            prev = row[3]


@pytest.mark.parametrize("spread", [0.0005, 1e-13, 0.0])
def test_quantiles_of_values_next_to_each_other_cut_their_bucket(spark, spread):
    rng = np.random.default_rng(24)
    values = 1.5 + spread * rng.random(4000)
    df = spark.createDataFrame([("g", float(v)) for v in values] + [("h", float(v)) for v in (1, 2, float("inf"))], "g string, x double")
    probs = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.995, "e": 1.0}
    got = {r["g"]: [r[p] for p in probs] for r in exact_quantiles(df, ["g"], "x", probs, bound=40).collect()}
    assert got["g"] == pytest.approx(np.quantile(values, list(probs.values())).tolist(), rel=1e-15)
    assert got["h"][2] == 2 and exact_quantiles(df, ["g"], "x", {"q": 1.0}, discrete=True).where("g = 'h'").first()["q"] == float("inf")
    exact = exact_quantiles(df, ["g"], "x", {"q": 0.37}, discrete=True, bound=3).where("g = 'g'").first()["q"]
    assert exact == sorted(values)[int(np.ceil(4000 * 0.37)) - 1]


def test_a_stem_of_a_third_of_the_ids_names_no_segment(spark):
    rng = random.Random(25)
    letters = "abcdefghijklmnopqrstuvwxyz"
    ids = ["customer.number." + "".join(rng.choice(letters) for _ in range(14)) + "@mail.com" for _ in range(400)]
    ids += ["".join(rng.choice(letters) for _ in range(rng.randrange(8, 30))) + rng.choice(["@mail.com", "@web.org"]) for _ in range(700)]
    ids += [i[:20] + "q" + i[21:] for i in ids[:40]] + [i[1:] for i in ids[500:540]]
    words = spark.createDataFrame([(i,) for i in sorted(set(ids))], "w string").withColumn("len", F.length("w"))
    cut = joins.rare_segments(words.withColumn("e", F.floor(F.col("len") * 0.15).cast("int"))).cache()
    assert cut.groupBy("w").agg(F.count("*").alias("n"), F.first("e").alias("e"), F.min(F.length("seg")).alias("s")).where("n <> e + 1 OR s < 1").count() == 0
    assert cut.where(F.expr("substring(w, pos + 1, length(seg))") != F.col("seg")).count() == 0
    largest = cut.groupBy("e", "seg").count().agg(F.max("count")).first()[0]
    assert largest < 40  # of 400 ids with one stem
    got = {(r[0], r[1]) for r in joins.similar_ids(words, "w", 0.85).collect()}
    ids = sorted(set(ids))
    expected = {(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if abs(len(a) - len(b)) <= 0.15 * max(len(a), len(b)) and 1.0 - edit_distance(a, b) / max(len(a), len(b)) >= 0.85}
    assert got == expected and len(got) > 70
    with pytest.raises(ValueError):
        joins.similar_ids(words, "w", 0.5)
