"""Upserts, membership joins and the similarity join of customer ids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from backflow.functions.expressions import ID, with_row
from backflow.operators.clean import dedupe_keep_last


def upsert_keep_new(base: DataFrame, new: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Incoming row wins; repeats inside the batch keep their last row."""
    batch = dedupe_keep_last(new, key, order)
    return base.join(batch.select(*key), key, "left_anti").unionByName(batch)


def append_ignore(base: DataFrame, new: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Rows of ``new`` to add when the existing row wins: absent keys, one row each."""
    return dedupe_keep_last(new, key, order).join(base.select(*key), key, "left_anti").select(*new.columns)


def append_new(base: DataFrame, new: DataFrame, key: list[str], order: list[str]) -> tuple[DataFrame, DataFrame]:
    """The grown table and a one-row frame with the number of rows added."""
    added = append_ignore(base, new, key, order)
    return base.unionByName(added.select(*base.columns)), added.agg(F.count(F.lit(1)).alias("rows_added"))


def update_from(base: DataFrame, updates: DataFrame, key: list[str], cols: list[str]) -> DataFrame:
    """Overwrite ``cols`` where the key matches; ``updates`` must be unique on the key."""
    side = updates.select(*key, *[F.col(c).alias(f"_new_{c}") for c in cols], F.lit(True).alias("_hit"))
    joined = base.join(side, key, "left")
    values = {c: F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)) for c in cols}
    return joined.select(*[values.get(c, F.col(c)).alias(c) for c in base.columns])


def merge_feature_groups(groups: dict[str, DataFrame], base: str = "basic_volume", key: str = ID) -> DataFrame:
    """All groups left-joined onto the base group; every side is clustered by the key."""
    others = [g for name, g in groups.items() if name != base]
    return reduce(lambda left, right: left.join(right, key, "left"), others, groups[base])


def missing_keys(base: DataFrame, known: DataFrame, key: str = ID) -> DataFrame:
    return base.select(key).distinct().join(known.select(key).distinct(), key, "left_anti")


def not_in(df: DataFrame, listed: DataFrame, key: str = ID) -> DataFrame:
    """SQL NOT IN: a NULL in the list leaves no row."""
    has_null = listed.select(F.coalesce(F.bool_or(F.col(key).isNull()), F.lit(False))).scalar()
    return df.join(listed.select(key), key, "left_anti").where(~has_null & F.col(key).isNotNull())


def attach_sentiment(lines: DataFrame, reasons: DataFrame, key: str = "return_reason", score: str = "sentiment_score") -> DataFrame:
    """Score of each line's reason; repeated reasons in the lookup are averaged to one row."""
    lookup = reasons.groupBy(key).agg(F.avg(score).alias(score))
    return lines.join(lookup, key, "left")


def attach_clusters(lines: DataFrame, labels: DataFrame) -> DataFrame:
    return lines.join(labels.select(ID, "cluster"), ID, "left")


def key_overlap(batch: DataFrame, base: DataFrame, key: str = ID) -> DataFrame:
    """Distinct ids of the batch, shared with the base and new, plus the batch's date span."""
    per_id = batch.groupBy(key).agg(F.min("order_date").alias("lo"), F.max("order_date").alias("hi"))
    known = base.select(key).distinct().withColumn("known", F.lit(1))
    return per_id.join(known, key, "left").agg(
        F.count(key).alias("unique_customers"),
        F.count("known").alias("in_both"),
        (F.count(key) - F.count("known")).alias("only_in_batch"),
        F.min("lo").alias("earliest_order"),
        F.max("hi").alias("latest_order"),
    )


# --- similar ids --------------------------------------------------------------------


GRAMS = 512


def _gram(at: Column) -> Column:
    """Two characters of ``w`` from place ``at`` (from 0) on; one at its end."""
    return F.substring(F.col("w"), at + 1, F.lit(2))


def rare_segments(words: DataFrame, most: int = GRAMS) -> DataFrame:
    """(w, len, e, i, pos, seg): ``e + 1`` segments, i from 0, of each ``w`` that do not overlap, each around a rare pair of characters.

    How frequent a pair is says the table itself: the ``most`` frequent pairs go by their counts, all others come before them. The limit is the
    least level up to which an id has e + 1 pairs that do not overlap, so what a large share of the ids has in common
    names no segment while there is room for all segments in the rest. An id too short for that takes its rarest single places. A segment
    reaches half way to the next one and is no longer than an even share of the id.
    """
    counts = words.select(F.explode(F.transform(F.sequence(F.lit(0), F.col("len") - 1), lambda p: _gram(p))).alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    # One row of at most ``most`` pairs.
    frequent = counts.orderBy(F.desc("n"), "g").limit(most).agg(F.map_from_entries(F.collect_list(F.struct("g", "n"))).alias("known"))
    # Pairs as frequent as each other within a factor of two are on one level.
    level = lambda p: F.floor(F.log2(F.coalesce(F.try_element_at(F.col("_f.known"), _gram(p)), F.lit(0)) + 1)).cast("int")
    ranked = with_row(words, frequent, "_f").withColumn("places", F.transform(F.sequence(F.lit(0), F.col("len") - 1), lambda p: F.struct(level(p).alias("n"), p.alias("p")))).drop("_f")
    # Left to right, each pair that is rare enough and does not overlap the last one taken: as many as can be.
    taken = "aggregate(places, array(named_struct('n', -1, 'p', -2)), (a, x) -> CASE WHEN x.n <= t AND x.p >= a[size(a) - 1].p + 2 AND x.p < len - 1 THEN concat(a, array(x)) ELSE a END)"
    levels = ranked.withColumn("levels", F.expr("array_sort(array_distinct(transform(places, x -> x.n)))"))
    first = levels.withColumn("first", F.expr(f"get(filter(transform(levels, t -> {taken}), a -> size(a) > e + 1), 0)"))
    rarest = first.withColumn("rarest", F.expr("slice(array_sort(coalesce(slice(first, 2, len), places)), 1, e + 1)"))
    picked = rarest.withColumn("at", F.expr("array_sort(transform(rarest, x -> x.p))")).drop("places", "levels", "first", "rarest")
    edges = "concat(array(0), transform(sequence(1, e), k -> int((at[k - 1] + 2 + at[k]) DIV 2)), array(len))"
    cut = picked.withColumn("edges", F.when(F.col("e") > 0, F.expr(edges)).otherwise(F.array(F.lit(0), F.col("len"))))
    cut = cut.withColumn("cap", F.greatest(F.lit(2), F.ceil(F.col("len") / (F.col("e") + 1))).cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("e"))))
    spans = cut.select("w", "len", "e", "i", "cap", F.expr("edges[i]").alias("lo"), F.expr("edges[i + 1]").alias("hi"), F.expr("at[i]").alias("p"))
    begin = F.greatest("lo", F.least(F.col("p") - F.floor((F.col("cap") - 2) / 2), F.col("hi") - F.col("cap"))).cast("int")
    return spans.withColumn("pos", begin).select("w", "len", "e", "i", "pos", F.expr("substring(w, pos + 1, least(cap, hi - pos))").alias("seg"))


def similar_ids(ids: DataFrame, col: str = ID, threshold: float = 0.8) -> DataFrame:
    """Pairs of distinct ids with 1 - levenshtein / longer length >= threshold, for thresholds above 0.5.

    Exact segment join instead of all pairs. With at most ``e`` edits allowed for the longer id, the shorter is cut into
    e + 1 segments, none empty. One of them, the first before whose end fewer edits lie than segments, survives unchanged in the longer id,
    with exactly as many edits before it as segments; so segment i moves by at most i places, and what follows by at most e - i. The segments lie around
    rare places of the id (:func:`rare_segments`), so that neither a shared domain nor a stem of many ids brings two
    together. The distance is checked with its bound, and only real matches are deduplicated. An empty id is in no pair.
    """
    if not 0.5 < threshold <= 1:
        raise ValueError("at a threshold of 0.5 or less ids need not share a single character")
    gap = 1.0 - threshold
    edits = lambda length: F.floor(length * F.lit(gap) + F.lit(1e-9)).cast("int")
    # Dealt by a fixed number of parts: the ids are few bytes, which would be put together into one task, but each makes hundreds of rows.
    tasks = max(int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions")), ids.sparkSession.sparkContext.defaultParallelism)
    words = ids.select(F.col(col).alias("w")).where("w <> ''").repartition(tasks, "w").distinct().withColumn("len", F.length("w"))
    # Shorter side: once per edit bound its possible partners can have.
    longest = F.floor(F.col("len") / F.lit(threshold) + F.lit(1e-9)).cast("int")
    segments = rare_segments(words.withColumn("e", F.explode(F.sequence(edits(F.col("len")), edits(longest)))))
    short = segments.withColumn("move", F.explode(F.expr("sequence(-i, i)"))).withColumn("pos2", F.col("pos") + F.col("move")).where("pos2 >= 0")
    # Longer side: its own edit bound; substrings of every length such a segment can have.
    long = (
        words.withColumn("e", edits(F.col("len")))
        .withColumn("size", F.explode(F.sequence(F.lit(1), F.least("len", F.greatest(F.lit(2), F.ceil(F.col("len") / (F.col("e") + 1)))).cast("int"))))
        .withColumn("pos2", F.explode(F.expr("sequence(0, len - size)")))
        .select(F.col("w").alias("w2"), F.col("len").alias("len2"), "e", "pos2", F.expr("substring(w, pos2 + 1, size)").alias("seg"))
    )
    near = (F.col("len") <= F.col("len2")) & (F.col("w") != F.col("w2")) & (F.abs(F.col("len2") - F.col("len") - F.col("move")) <= F.col("e") - F.col("i"))
    # Each id has some two hundred substrings, of which size estimates from the ids know nothing: neither side is ever small enough to be sent out.
    # The distance is worked out only where lengths and places fit.
    close = F.when(near, F.expr("levenshtein(w, w2, e) >= 0")).otherwise(False)
    pairs = short.join(long.hint("merge"), ["e", "seg", "pos2"]).where(close)
    named = pairs.select(F.least("w", "w2").alias("email1"), F.greatest("w", "w2").alias("email2")).distinct()
    score = 1.0 - F.try_divide(F.levenshtein("email1", "email2").cast("double"), F.greatest(F.length("email1"), F.length("email2")))
    return named.withColumn("similarity", score).where(F.col("similarity") >= threshold)


def case_groups(lines: DataFrame, col: str = "customer_emailid_raw") -> DataFrame:
    """Ids equal but for case: one row per spelling with its records, and the number of spellings and records of the id."""
    spellings = lines.groupBy(F.lower(col).alias("email_standardized"), F.col(col).alias("email_variant")).agg(F.count(F.lit(1)).alias("variant_records"))
    totals = spellings.groupBy("email_standardized").agg(F.count(F.lit(1)).alias("variant_count"), F.sum("variant_records").alias("total_records")).where("variant_count > 1")
    return spellings.join(totals, "email_standardized")
