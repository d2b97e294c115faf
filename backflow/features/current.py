"""Customer features, one row per ``customer_emailid`` (current formulas).

Each function is a pure DataFrame -> DataFrame job over order lines.
:func:`core_metrics` computes the groups that share the customer grain in two
passes (order grain and SKU grain) for the full build.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from backflow.functions.expressions import (
    ID, banded, calendar_days, day_number, first_match, flag, guarded_corr, long_sum, or_zero, ratio, season, with_row,
)
from backflow.operators.blocks import near_pairs
from backflow.operators.ordered import with_running
from backflow.operators.quantiles import quantile_row, quantile_scalar
from backflow.session import checkpoint, stored

RECENT_DAYS = 90


def is_returned() -> Column:
    return F.col("return_qty") > 0


def customers(bronze: DataFrame) -> DataFrame:
    return bronze.select(ID).distinct()


def on_every_customer(bronze: DataFrame, feats: DataFrame) -> DataFrame:
    """Left-join feature rows onto all customers, 0 for customers without a row."""
    cols = [c for c in feats.columns if c != ID]
    return customers(bronze).join(feats, ID, "left").select(ID, *[or_zero(F.col(c)).alias(c) for c in cols])


def basic_volume(bronze: DataFrame) -> DataFrame:
    items, orders = F.count(F.lit(1)), F.countDistinct("sales_order_no")
    return bronze.groupBy(ID).agg(
        orders.alias("sales_order_no_nunique"),
        F.countDistinct("q_sku_id").alias("sku_nunique"),
        long_sum(flag(is_returned())).alias("items_returned_count"),
        F.avg("sales_qty").alias("sales_qty_mean"),
        ratio(items, orders).alias("avg_order_size"),
    )


def return_behavior(bronze: DataFrame) -> DataFrame:
    sums = bronze.groupBy(ID).agg(
        F.sum("sales_qty").alias("sold"),
        F.sum("return_qty").alias("back"),
        F.count(F.lit(1)).alias("items"),
        F.countDistinct("sales_order_no").alias("orders"),
        F.countDistinct(F.when(is_returned(), F.col("q_sku_id"))).alias("variety"),
        F.sum(flag(is_returned())).alias("ret_items"),
    )
    return sums.select(ID, *_behavior_columns())


def _behavior_columns() -> list[Column]:
    rate = F.coalesce(ratio(F.col("back"), F.col("sold")), F.lit(0.0))
    return [
        rate.alias("return_rate"),
        rate.alias("return_ratio"),
        or_zero(F.col("variety")).alias("return_product_variety"),
        F.coalesce(ratio(F.col("ret_items"), F.col("orders")), F.lit(0.0)).alias("avg_returns_per_order"),
        F.coalesce(ratio(F.col("ret_items"), F.col("items")), F.lit(0.0)).alias("return_frequency_ratio"),
        F.coalesce(ratio(F.col("back"), F.col("ret_items")), F.lit(0.0)).alias("return_intensity"),
    ]


def order_returns(bronze: DataFrame) -> DataFrame:
    """One row per (customer, order, order date) with a returned-something flag."""
    return bronze.groupBy(ID, "sales_order_no", "order_date").agg(flag(F.sum("return_qty") > 0).alias("has_returns"))


def return_streak_starts(orders: DataFrame) -> DataFrame:
    """Orders with the flag of the previous order and a streak-start marker."""
    prior = with_running(orders, ID, "order_date", ["sales_order_no"], lags={"prev_returned": "has_returns"})
    starts = (F.col("has_returns") == 1) & F.coalesce(F.col("prev_returned") == 0, F.lit(True))
    return prior.withColumn("starts", flag(starts))


def consecutive_returns(bronze: DataFrame) -> DataFrame:
    """Number of return streaks and their mean length.

    The streak count is the number of starts, the lengths sum to the returned
    orders, so no streak ever has to be rebuilt as a group of rows.
    """
    streaks = (
        return_streak_starts(order_returns(bronze))
        .groupBy(ID)
        .agg(F.sum("starts").alias("n"), F.sum("has_returns").alias("returned"))
    )
    return streaks.select(
        ID,
        F.col("n").alias("consecutive_returns"),
        F.coalesce(ratio(F.col("returned"), F.col("n")), F.lit(0.0)).alias("avg_consecutive_returns"),
    )


TENURE_BANDS = [(90, "New"), (180, "Growing"), (365, "Mature")]


def temporal(bronze: DataFrame) -> DataFrame:
    gap = F.when(is_returned() & F.col("return_date").isNotNull(), calendar_days(F.col("order_date"), F.col("return_date")))
    life = calendar_days(F.min("order_date"), F.max("order_date"))
    return (
        bronze.groupBy(ID)
        .agg(
            life.alias("customer_lifetime_days"),
            F.coalesce(F.avg(gap), F.lit(0.0)).alias("avg_days_to_return"),
            F.coalesce(F.stddev_samp(gap), F.lit(0.0)).alias("return_timing_spread"),
            F.min("order_date").alias("first_order_date"),
            F.max("order_date").alias("last_order_date"),
        )
        .withColumn("customer_tenure_stage", banded(F.col("customer_lifetime_days"), TENURE_BANDS, "Veteran"))
    )


def recent_cutoff(bronze: DataFrame, days: int = RECENT_DAYS) -> Column:
    """Latest order date minus ``days``, as a scalar subquery (one-column scan)."""
    return bronze.select(F.max("order_date")).scalar() - F.expr(f"INTERVAL {int(days)} DAYS")


def _recency_columns(days: int) -> list[Column]:
    recent_rate = ratio(F.col("recent_returns"), F.lit(float(days)))
    usual_rate = ratio(F.col("ret_items"), F.col("life"))
    vs = F.when((F.col("ret_items") > 0) & (F.col("life") > days), F.coalesce(F.try_divide(recent_rate, usual_rate), F.lit(0.0))).otherwise(0.0)
    stable = first_match([(vs.between(0.8, 1.2), 1.0), (vs.between(0.5, 1.5), 0.7), (vs.between(0.2, 2.0), 0.4)], 0.1)
    return [
        F.col("recent_orders"),
        F.col("recent_returns"),
        vs.alias("recent_vs_avg_ratio"),
        stable.alias("behavior_stability_score"),
    ]


def recency(bronze: DataFrame, days: int = RECENT_DAYS) -> DataFrame:
    recent = F.col("order_date") >= F.col("_cutoff")
    sums = (
        bronze.withColumn("_cutoff", recent_cutoff(bronze, days))
        .groupBy(ID)
        .agg(
            F.countDistinct(F.when(recent, F.col("sales_order_no"))).alias("recent_orders"),
            long_sum(flag(recent & is_returned())).alias("recent_returns"),
            long_sum(flag(is_returned())).alias("ret_items"),
            calendar_days(F.min("order_date"), F.max("order_date")).alias("life"),
        )
    )
    return sums.select(ID, *_recency_columns(days))


def class_count(bronze: DataFrame) -> Column:
    """Distinct ``class_`` over all lines (20 when there is none)."""
    n = bronze.select(F.countDistinct("class_").alias("n"))
    return n.select(F.when(F.col("n") > 0, F.col("n")).otherwise(20)).scalar()


def category_intelligence(bronze: DataFrame) -> DataFrame:
    per_category = (
        bronze.where(F.col("q_cls_id").isNotNull())
        .groupBy(ID, "q_cls_id")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("return_qty").alias("back"), F.sum("sales_qty").alias("sold"))
    )
    return category_scores(per_category, class_count(bronze))


def category_scores(per_category: DataFrame, classes: Column) -> DataFrame:
    """Category scores from one row per (customer, category) with lines ``n``, ``back`` and ``sold``."""
    # sum((n_i / N)^2) needs only sum(n^2) and N, so no join back to totals.
    square = F.col("n").cast("double") * F.col("n")
    category_rate = F.when(F.col("sold") > 0, F.col("back").cast("double") / F.col("sold")).otherwise(0.0)
    sums = per_category.groupBy(ID).agg(
        F.count(F.lit(1)).alias("categories"),
        F.sum(square).alias("squares"),
        F.sum("n").alias("total"),
        F.avg(category_rate).alias("rate"),
    )
    rate = F.col("rate")
    return sums.withColumn("classes", classes).select(
        ID,
        ratio(F.col("categories"), F.col("classes")).alias("category_diversity_score"),
        ratio(F.col("squares"), F.col("total").cast("double") * F.col("total")).alias("category_loyalty_score"),
        first_match([(rate > 0.3, 1.0), (rate > 0.15, 0.7), (rate > 0.05, 0.4)], 0.1).alias("high_return_category_affinity"),
    )


# --- near-in-time product pairs -------------------------------------------------


def adjacent_pairs(bronze: DataFrame, days: int = 14) -> DataFrame:
    """Ordered pairs of lines of one customer: other SKU, other instant, within ``days``.

    Equal lines fold to one row with their number; rows then meet by blocks of bounded size (:func:`near_pairs`), and each
    pair comes out once for each direction and each pair of the lines behind it.
    """
    rows = bronze.where(F.col("q_sku_id").isNotNull()).groupBy(
        ID,
        F.col("q_sku_id").alias("sku"),
        F.col("order_date").alias("at"),
        day_number(F.col("order_date")).alias("day"),
        flag(is_returned()).alias("returned"),
    ).agg(F.count(F.lit(1)).alias("n"))
    pairs = near_pairs(rows, ID, "day", days, ["at", "sku", "returned"]).where((F.col("sku_a") != F.col("sku_b")) & (F.col("at_a") != F.col("at_b")))
    gap = (F.col("day_b") - F.col("day_a")).cast("bigint").alias("days_between")
    seen = lambda x, y: F.struct(*[F.col(f"{c}_{s}").alias(f"{c}_{o}") for c in ("sku", "at", "returned") for s, o in ((x, "a"), (y, "b"))])
    both = F.flatten(F.array_repeat(F.array(seen("a", "b"), seen("b", "a")), (F.col("n_a") * F.col("n_b")).cast("int")))
    out = pairs.select(ID, gap, F.explode(both).alias("pair"))
    return out.select(ID, "pair.sku_a", "pair.sku_b", "pair.at_a", "pair.at_b", "days_between", "pair.returned_a", "pair.returned_b")


def _near_sums(counts: DataFrame, keys: list[str], days: int) -> DataFrame:
    """Ordered pairs within ``days`` and their summed distance, from daily counts.

    With n rows on a day and the rows of the ``days`` days before it, the pairs
    are n*n plus twice n*earlier, so one range window over daily counts replaces
    the pair join. The window length is bounded by the calendar.
    """
    by_day = counts.groupBy(*keys, "day").agg(F.sum("n").cast("double").alias("n"), F.sum("r").cast("double").alias("r"))
    before = Window.partitionBy(*keys).orderBy("day").rangeBetween(-days, -1)
    aggs = []
    for c in ("n", "r"):
        by_day = by_day.withColumns({
            f"{c}_near": or_zero(F.sum(c).over(before)),
            f"{c}_near_days": or_zero(F.sum(F.col(c) * F.col("day")).over(before)),
        })
        near, near_days = F.col(f"{c}_near"), F.col(f"{c}_near_days")
        aggs += [
            F.sum(F.col(c) * F.col(c) + 2 * F.col(c) * near).alias(f"{c}_pairs"),
            F.sum(2 * F.col(c) * (F.col("day") * near - near_days)).alias(f"{c}_days"),
        ]
    return by_day.groupBy(*keys).agg(*aggs)


def _distinct_sku_pairs(rows: DataFrame, days: int) -> DataFrame:
    """Distinct ordered SKU pairs per customer within ``days``.

    Lines fold to (customer, bucket, SKU) with first and last instant. In one
    bucket any two SKUs are near (unless both only have the same instant); in
    neighbouring buckets the closest days decide. The relation is symmetric, so
    unordered pairs are counted and doubled. Folded rows meet by blocks.
    """
    folded = (
        rows.withColumn("bucket", F.floor(F.col("day") / F.lit(days)).cast("int"))
        .groupBy(ID, "bucket", "sku")
        .agg(F.min("day").alias("d0"), F.max("day").alias("d1"), F.min("at").alias("t0"), F.max("at").alias("t1"))
    )
    same_instant = (F.col("t0_a") == F.col("t1_a")) & (F.col("t0_b") == F.col("t1_b")) & (F.col("t0_a") == F.col("t0_b"))
    near = ((F.col("bucket_a") == F.col("bucket_b")) & ~same_instant) | ((F.col("bucket_a") < F.col("bucket_b")) & (F.col("d0_b") - F.col("d1_a") <= days))
    pairs = near_pairs(folded, ID, "bucket", 1, ["sku"]).where((F.col("sku_a") != F.col("sku_b")) & near)
    unordered = pairs.select(ID, F.least("sku_a", "sku_b").alias("sku_a"), F.greatest("sku_a", "sku_b").alias("sku_b")).distinct()
    return checkpoint(unordered.groupBy(ID).agg((2 * F.count(F.lit(1))).alias("sku_adjacency_orders")))


def adjacency(bronze: DataFrame, days: int = 14) -> DataFrame:
    """Counts and mean distances over :func:`adjacent_pairs`, without the pairs.

    Pairs within ``days`` minus pairs of one SKU minus pairs of one instant plus
    pairs of both: the three corrections and the self pairs cancel exactly.
    """
    rows = bronze.select(
        ID, F.col("q_sku_id").alias("sku"), F.col("order_date").alias("at"),
        day_number(F.col("order_date")).alias("day"), flag(is_returned()).alias("r"),
    )
    # The fold that all branches start from, worked out once. Lines without a SKU only tell that the customer exists.
    return adjacency_scores(stored(rows.groupBy(ID, "sku", "at", "day").agg(F.count(F.lit(1)).alias("n"), F.sum("r").alias("r")), "fold"), days)


def adjacency_scores(every: DataFrame, days: int = 14) -> DataFrame:
    """Adjacency from one row per (customer, SKU, instant) with its day, lines ``n`` and returned lines ``r``.

    Each branch ends in a checkpoint with a row for each customer, so that its shuffles are gone before the next one begins.
    """
    counts = every.where(F.col("sku").isNotNull())
    square = lambda c: F.sum(F.col(c).cast("double") * F.col(c))
    per_sku = checkpoint(_near_sums(counts, [ID, "sku"], days).groupBy(ID).agg(
        *[F.sum(c).alias(f"sku_{c}") for c in ("n_pairs", "r_pairs", "n_days", "r_days")]
    ))
    instant = counts.groupBy(ID, "at").agg(
        F.sum("n").alias("n"), F.sum("r").alias("r"), square("n").alias("n_both"), square("r").alias("r_both")
    )
    per_instant = checkpoint(instant.groupBy(ID).agg(
        *[(square(c) - F.sum(f"{c}_both")).alias(f"at_{c}") for c in ("n", "r")]
    ))
    sums = checkpoint(_near_sums(counts, [ID], days)).join(per_sku, ID).join(per_instant, ID)
    net = lambda c: F.col(f"{c}_pairs") - F.col(f"sku_{c}_pairs") - F.col(f"at_{c}")
    mean = lambda c: ratio(F.col(f"{c}_days") - F.col(f"sku_{c}_days"), net(c))
    measured = sums.join(_distinct_sku_pairs(counts, days), ID, "left").select(
        ID,
        F.col("sku_adjacency_orders"),
        net("r").cast("bigint").alias("sku_adjacency_returns"),
        F.when(net("n") > 0, mean("n")).alias("sku_adjacency_timing"),
        F.when(net("r") > 0, mean("r")).alias("sku_adjacency_return_timing"),
    )
    return on_every_customer(every, measured)


# --- seasons, trends, money -------------------------------------------------------


def seasonal(bronze: DataFrame, min_days: int = 730, min_seasons: int = 3) -> DataFrame:
    per_season = bronze.groupBy(ID, season(F.col("order_date")).alias("season")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("return_qty").alias("back"),
        F.min("order_date").alias("first"),
        F.max("order_date").alias("last"),
    )
    return season_scores(per_season, min_days, min_seasons)


def season_scores(per_season: DataFrame, min_days: int = 730, min_seasons: int = 3) -> DataFrame:
    """Seasonal variation from one row per (customer, season) with lines ``n``, ``back``, ``first`` and ``last`` instant."""
    # The customer's span comes from the season rows: no second pass over lines.
    variation = lambda c: ratio(F.stddev_samp(F.col(c).cast("double")), F.avg(c))
    stats = per_season.groupBy(ID).agg(
        calendar_days(F.min("first"), F.max("last")).alias("life"),
        F.count(F.lit(1)).alias("seasons"),
        variation("n").alias("n_cv"),
        variation("back").alias("back_cv"),
    )
    known = (F.col("life") > min_days) & (F.col("seasons") >= min_seasons)
    return stats.select(
        ID,
        F.coalesce(F.when(known, F.col("n_cv")), F.lit(0.0)).alias("seasonal_susceptibility_orders"),
        F.coalesce(F.when(known, F.col("back_cv")), F.lit(0.0)).alias("seasonal_susceptibility_returns"),
    )


def trend(bronze: DataFrame, min_points: int = 6) -> DataFrame:
    month = F.date_trunc("month", "order_date").alias("month")
    mine = (
        bronze.where(F.col("q_cls_id").isNotNull())
        .groupBy(ID, "q_cls_id", month)
        .agg(F.count(F.lit(1)).alias("n"), F.sum("return_qty").alias("back"))
    )
    return on_every_customer(bronze, trend_scores(mine, min_points))


def trend_scores(mine: DataFrame, min_points: int = 6) -> DataFrame:
    """Correlations with the market from one row per (customer, category, month) with lines ``n`` and ``back``."""
    # Category totals are sums of the customers' own rows: lines are read once.
    market = mine.groupBy("q_cls_id", "month").agg(F.sum("n").alias("all_n"), F.sum("back").alias("all_back"))
    return (
        mine.join(market, ["q_cls_id", "month"])
        .groupBy(ID)
        .agg(
            F.count(F.lit(1)).alias("points"),
            guarded_corr(F.col("n"), F.col("all_n")).alias("orders"),
            guarded_corr(F.col("back"), F.col("all_back")).alias("returns"),
        )
        .where(F.col("points") >= min_points)
        .select(
            ID,
            F.col("orders").alias("trend_product_category_order_rate"),
            F.col("returns").alias("trend_product_category_return_rate"),
        )
    )


def monetary_raw(bronze: DataFrame) -> DataFrame:
    """Order value, return value and high-value affinity before clipping."""
    limit = quantile_scalar(bronze, "gross", 0.75, discrete=True)
    high = F.col("gross") > F.col("_limit")
    returned_value = F.when(is_returned(), ratio(F.col("gross"), F.col("sales_qty")) * F.col("return_qty")).otherwise(0.0)
    sums = (
        bronze.where(F.col("gross").isNotNull())
        .withColumn("_limit", limit)
        .groupBy(ID)
        .agg(
            F.countDistinct("sales_order_no").alias("orders"),
            F.sum("gross").alias("value"),
            F.sum("return_qty").alias("back"),
            F.sum(returned_value).alias("back_value"),
            F.countDistinct(F.when(high, F.col("sales_order_no"))).alias("high"),
            F.countDistinct(F.when(high & is_returned(), F.col("sales_order_no"))).alias("high_back"),
        )
    )
    return sums.select(ID, *_monetary_columns())


def _monetary_columns(orders: str = "orders", back: str = "back") -> list[Column]:
    share = ratio(F.col("high_back"), F.col("high"))
    return [
        F.coalesce(ratio(F.col("value"), F.col(orders)), F.lit(0.0)).alias("avg_order_value"),
        F.when(F.col(back) == 0, 0.0).otherwise(ratio(F.col("back_value"), F.col(back))).alias("avg_return_value"),
        (F.coalesce(share, F.lit(0.0)) * 100).alias("high_value_return_affinity"),
    ]


def clip_scale_0_100(df: DataFrame, cols: list[str], p: float = 0.99) -> DataFrame:
    """Clip at the ``p`` quantile, then min-max to 0..100; constant columns stay."""
    ends = {c: (f"lo_{c}", f"hi_{c}", f"cap_{c}") for c in cols}
    wanted = {}
    for c, (lo, hi, cap) in ends.items():
        wanted |= {lo: (c, 0.0), hi: (c, 1.0), cap: (c, p)}
    out = with_row(df, quantile_row(df, wanted))
    for c, names in ends.items():
        lo, hi, cap = (F.col(f"_row.{n}") for n in names)
        # After clipping the maximum is the cap itself.
        scaled = F.try_divide(100 * (F.least(F.col(c), cap) - lo), cap - lo)
        out = out.withColumn(c, F.when(hi > lo, scaled).otherwise(F.col(c)))
    return out.drop("_row")


def monetary(bronze: DataFrame) -> DataFrame:
    return clip_scale_0_100(checkpoint(monetary_raw(bronze)), ["avg_order_value", "avg_return_value"])


# --- all groups ---------------------------------------------------------------------


def core_metrics(bronze: DataFrame, days: int = RECENT_DAYS, money: bool = True) -> DataFrame:
    """All sums behind F-01, F-02, F-04, F-05, F-10 and F-21 in two passes.

    Folding to (customer, order) first turns every distinct order count into a
    plain sum, so the wide aggregate needs no row expansion for distincts.
    """
    limit = quantile_scalar(bronze, "gross", 0.75, discrete=True) if money else F.lit(None).cast("double")
    recent = F.col("order_date") >= F.col("_cutoff")
    priced = F.col("gross").isNotNull()
    high = F.col("gross") > F.col("_limit")
    gap = F.when(is_returned() & F.col("return_date").isNotNull(), calendar_days(F.col("order_date"), F.col("return_date")))
    orders = (
        bronze.withColumns({"_cutoff": recent_cutoff(bronze, days), "_limit": limit})
        .groupBy(ID, "sales_order_no")
        .agg(
            F.count(F.lit(1)).alias("items"),
            F.sum(flag(is_returned())).alias("ret_items"),
            F.sum("sales_qty").alias("sold"),
            F.sum("return_qty").alias("back"),
            F.count("sales_qty").alias("sold_rows"),
            F.min("order_date").alias("first"),
            F.max("order_date").alias("last"),
            F.max(flag(recent)).alias("recent"),
            F.sum(flag(recent & is_returned())).alias("recent_ret"),
            F.sum("gross").alias("value"),
            F.max(flag(priced)).alias("priced"),
            F.sum(F.when(priced, F.col("return_qty"))).alias("priced_back"),
            F.sum(F.when(is_returned() & priced, ratio(F.col("gross"), F.col("sales_qty")) * F.col("return_qty"))).alias("back_value"),
            F.max(flag(high)).alias("high"),
            F.max(flag(high & is_returned())).alias("high_back"),
            F.count(gap).alias("gaps"),
            F.sum(gap).alias("gap_sum"),
            F.sum(gap * gap).alias("gap_squares"),
        )
    )
    named = flag(F.col("sales_order_no").isNotNull())
    total = lambda c: F.sum(c).alias(c)
    per_customer = orders.groupBy(ID).agg(
        F.sum(named).alias("orders"),
        *[total(c) for c in ("items", "ret_items", "sold", "back", "sold_rows", "value", "priced_back", "gaps", "gap_sum", "gap_squares")],
        F.sum("recent_ret").alias("recent_returns"),
        F.sum(F.col("recent") * named).alias("recent_orders"),
        F.coalesce(F.sum("back_value"), F.lit(0.0)).alias("back_value"),
        *[F.sum(F.col(c) * named).alias(c) for c in ("priced", "high", "high_back")],
        F.min("first").alias("first_order_date"),
        F.max("last").alias("last_order_date"),
        calendar_days(F.min("first"), F.max("last")).alias("life"),
    )
    skus = (
        bronze.where(F.col("q_sku_id").isNotNull())
        .groupBy(ID, "q_sku_id")
        .agg(F.max(flag(is_returned())).alias("ret"))
        .groupBy(ID)
        .agg(F.count(F.lit(1)).alias("skus"), F.sum("ret").alias("variety"))
    )
    return per_customer.join(skus, ID, "left").withColumns({"skus": or_zero(F.col("skus")), "variety": or_zero(F.col("variety"))})


CORE_GROUPS = {
    "basic_volume": ["sales_order_no_nunique", "sku_nunique", "items_returned_count", "sales_qty_mean", "avg_order_size"],
    "return_behavior": [
        "return_rate", "return_ratio", "return_product_variety", "avg_returns_per_order", "return_frequency_ratio", "return_intensity",
    ],
    "temporal": [
        "customer_lifetime_days", "avg_days_to_return", "return_timing_spread", "first_order_date", "last_order_date", "customer_tenure_stage",
    ],
    "recency": ["recent_orders", "recent_returns", "recent_vs_avg_ratio", "behavior_stability_score"],
    "totals": ["total_sales_qty", "total_return_qty"],
    "monetary": ["avg_order_value", "avg_return_value", "high_value_return_affinity"],
}


def core_table(bronze: DataFrame, days: int = RECENT_DAYS, money: bool = True) -> DataFrame:
    """The core groups side by side, one row per customer, from :func:`core_metrics`."""
    # Customers without any price have no monetary values.
    priced = [F.when(F.col("value").isNotNull(), c).alias(name) for c, name in zip(_monetary_columns("priced", "priced_back"), CORE_GROUPS["monetary"])] if money else []
    table = core_metrics(bronze, days, money).select(ID, *core_columns(days), *priced)
    # The clip limits need the finished values: the customer rows are cut off
    # here, or the lines would be read and aggregated a second time.
    return clip_scale_0_100(checkpoint(table), ["avg_order_value", "avg_return_value"]) if money else table


def core_columns(days: int = RECENT_DAYS) -> list[Column]:
    """The core groups but the monetary one as expressions over the sums of :func:`core_metrics`."""
    n, s, q = F.col("gaps"), F.col("gap_sum"), F.col("gap_squares")
    variance = F.try_divide(q - s * s.cast("double") / n, (n - 1).cast("double"))
    spread = F.coalesce(F.when(n > 1, F.sqrt(F.greatest(variance, F.lit(0.0)))), F.lit(0.0))
    return [
        F.col("orders").alias("sales_order_no_nunique"),
        F.col("skus").alias("sku_nunique"),
        F.col("ret_items").alias("items_returned_count"),
        ratio(F.col("sold"), F.col("sold_rows")).alias("sales_qty_mean"),
        ratio(F.col("items"), F.col("orders")).alias("avg_order_size"),
        *_behavior_columns(),
        F.col("life").alias("customer_lifetime_days"),
        F.coalesce(ratio(s, n), F.lit(0.0)).alias("avg_days_to_return"),
        spread.alias("return_timing_spread"),
        F.col("first_order_date"),
        F.col("last_order_date"),
        banded(F.col("life"), TENURE_BANDS, "Veteran").alias("customer_tenure_stage"),
        *_recency_columns(days),
        F.col("sold").alias("total_sales_qty"),
        F.col("back").alias("total_return_qty"),
    ]


def core_features(bronze: DataFrame, days: int = RECENT_DAYS) -> dict[str, DataFrame]:
    """The core groups as separate frames over one shared plan."""
    table = core_table(bronze, days)
    groups = {name: table.select(ID, *cols) for name, cols in CORE_GROUPS.items()}
    groups["monetary"] = groups["monetary"].where(F.col("avg_order_value").isNotNull())
    return groups


def create_all_features(bronze: DataFrame) -> dict[str, DataFrame]:
    """Every feature group as a lazy frame, by group name."""
    return {
        **core_features(bronze),
        "category": category_intelligence(bronze),
        "consecutive": consecutive_returns(bronze),
        "adjacency": adjacency(bronze),
        "seasonal": seasonal(bronze),
        "trend": trend(bronze),
    }


def customer_metadata(bronze: DataFrame) -> DataFrame:
    return bronze.groupBy(ID).agg(
        long_sum(F.col("sales_qty")).alias("total_sales_qty"),
        long_sum(F.col("return_qty")).alias("total_return_qty"),
        F.min("order_date").alias("first_order_date"),
        F.max("order_date").alias("last_order_date"),
    ).withColumn("customer_emailid_cleaned", F.lower(F.trim(ID)))


def new_customer_features(bronze: DataFrame, silver: DataFrame) -> DataFrame:
    """Reduced feature set of customers that have no silver row yet."""
    fresh = bronze.join(silver.select(ID).distinct(), ID, "left_anti")
    orders, classes, items = F.countDistinct("sales_order_no"), F.countDistinct("class_"), F.count(F.lit(1))
    back_items = F.sum(flag(is_returned()))
    sums = fresh.groupBy(ID).agg(
        classes.alias("classes"),
        orders.alias("orders"),
        F.countDistinct("return_no").alias("returns"),
        F.countDistinct(F.when(is_returned(), F.col("sales_order_no"))).alias("orders_back"),
        items.alias("items"),
        back_items.alias("items_back"),
        calendar_days(F.min("order_date"), F.max("order_date")).alias("life"),
    )
    return sums.withColumn("all_classes", class_count(bronze)).select(
        ID,
        ratio(F.col("classes"), F.col("all_classes")).alias("category_diversity_score"),
        F.col("orders").alias("sales_order_no_nunique"),
        F.col("classes").alias("sku_nunique"),
        F.col("returns").alias("items_returned_count"),
        F.col("items_back").cast("bigint").alias("return_qty_sum"),
        F.col("items").alias("sales_qty_sum"),
        ratio(F.col("items"), F.col("orders")).alias("sales_qty_mean"),
        ratio(F.col("items_back"), F.col("items")).alias("return_rate"),
        ratio(F.col("returns"), F.col("orders")).alias("avg_returns_per_order"),
        ratio(F.col("orders_back"), F.col("orders")).alias("return_frequency_ratio"),
        F.col("life").alias("customer_lifetime_days"),
    )


def category_diversity(bronze: DataFrame) -> DataFrame:
    """Distinct ``class_`` per customer over all distinct ``class_``."""
    mine = bronze.groupBy(ID).agg(F.countDistinct("class_").alias("n"))
    return mine.withColumn("total", class_count(bronze)).select(ID, ratio(F.col("n"), F.col("total")).alias("category_diversity_score"))
