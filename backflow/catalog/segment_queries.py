"""Registered queries: preparation, selection, clustering and reports."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from backflow.catalog import common, quality_queries  # noqa: F401
from backflow.catalog.common import NUMERIC
from backflow.catalog.twins import cte, twin
from backflow.features import current as now, returners as rt
from backflow.functions import text as tx
from backflow.functions.expressions import ID, rounded
from backflow.operators import clean, dbscan as db, kmeans as km, metrics, outliers, prepare as pre, quality
from backflow.operators.quantiles import quantile_scalar
from backflow.plans import report
from backflow.plans.layers import LINE_COLUMNS
from backflow.session import checkpoint, stored
from backflow.sources.order_lines import order_lines, table

QUERIES: dict = {}
TWINS: dict[str, str] = {}
U = " UNION ALL "


def register(name, job, sql=None):
    QUERIES[name] = lambda spark, sf: rounded(job(spark, sf))
    if sql:
        TWINS[name] = twin(sql)


def on_base(name, job, sql=None):
    register(name, lambda spark, sf: job(common.customer_base(spark, sf)), sql)


def on_segments(name, job, sql=None):
    register(name, lambda spark, sf: job(common.segments(spark, sf)), sql)


def r6(expr: str, name: str) -> str:
    return f"round({expr}, 6) + 0.0 AS {name}"


# --- imputation ---------------------------------------------------------------------------------


def holes(s):
    """Base rows with NULLs punched in by rule."""
    n = F.col("sales_order_no_nunique")
    return s.withColumns({
        "sales_qty_mean": F.when(n % 7 != 0, F.col("sales_qty_mean")), "return_rate": F.when(n % 5 != 0, F.col("return_rate")),
        "avg_order_size": F.when(n % 3 != 0, F.col("avg_order_size")), "customer_tenure_stage": F.when(n % 4 != 0, F.col("customer_tenure_stage")),
        "avg_days_to_return": F.when(n % 6 != 0, F.col("avg_days_to_return")), "behavior_stability_score": F.when(n % 4 != 1, F.col("behavior_stability_score")),
    }).select(ID, "sales_order_no_nunique", "sales_qty_mean", "return_rate", "avg_order_size", "customer_tenure_stage", "avg_days_to_return", "behavior_stability_score")


cte("holes", """
SELECT customer_emailid, sales_order_no_nunique, CASE WHEN sales_order_no_nunique % 7 <> 0 THEN sales_qty_mean END AS sales_qty_mean, CASE WHEN sales_order_no_nunique % 5 <> 0 THEN return_rate END AS return_rate,
 CASE WHEN sales_order_no_nunique % 3 <> 0 THEN avg_order_size END AS avg_order_size, CASE WHEN sales_order_no_nunique % 4 <> 0 THEN customer_tenure_stage END AS customer_tenure_stage,
 CASE WHEN sales_order_no_nunique % 6 <> 0 THEN avg_days_to_return END AS avg_days_to_return, CASE WHEN sales_order_no_nunique % 4 <> 1 THEN behavior_stability_score END AS behavior_stability_score FROM base""")
on_base("im_01_drop_missing_core", lambda s: pre.drop_missing_core(holes(s)).select(ID, "sales_qty_mean"), f"SELECT customer_emailid, {r6('sales_qty_mean', 'sales_qty_mean')} FROM holes WHERE sales_qty_mean IS NOT NULL AND sales_order_no_nunique IS NOT NULL")
on_base("im_02_zero_fill", lambda s: pre.zero_fill(holes(s)).select(ID, "return_rate", "avg_days_to_return", "customer_tenure_stage"), f"""
SELECT customer_emailid, {r6('coalesce(return_rate, 0)', 'return_rate')}, {r6('coalesce(avg_days_to_return, 0)', 'avg_days_to_return')}, coalesce(customer_tenure_stage, 'New') AS customer_tenure_stage FROM holes""")
on_base("im_03_mean_fill", lambda s: pre.mean_fill(holes(s)).select(ID, "avg_order_size", "behavior_stability_score"), f"""
SELECT customer_emailid, {r6('coalesce(avg_order_size, (SELECT avg(avg_order_size) FROM holes))', 'avg_order_size')}, {r6('coalesce(behavior_stability_score, (SELECT avg(behavior_stability_score) FROM holes))', 'behavior_stability_score')} FROM holes""")
on_base("im_04_fill_by_name", lambda s: pre.fill_by_name(holes(s), ["return_rate", "avg_days_to_return", "behavior_stability_score", "avg_order_size"]).select(ID, "return_rate", "avg_days_to_return", "behavior_stability_score", "avg_order_size"), f"""
SELECT customer_emailid, {r6('coalesce(return_rate, 0)', 'return_rate')}, {r6('coalesce(avg_days_to_return, (SELECT quantile_cont(avg_days_to_return, 0.5) FROM holes))', 'avg_days_to_return')},
 {r6('coalesce(behavior_stability_score, (SELECT quantile_cont(behavior_stability_score, 0.5) FROM holes))', 'behavior_stability_score')}, {r6('coalesce(avg_order_size, 0)', 'avg_order_size')} FROM holes""")
_FLAGGED = ["sales_qty_mean", "return_rate", "avg_order_size"]
on_base("im_05_imputation_flags", lambda s: pre.imputation_flags(holes(s), _FLAGGED).select(ID, "imputed_columns", F.col("imputed_count").cast("bigint").alias("imputed_count")), f"""
SELECT customer_emailid, concat_ws(',', {', '.join(f"CASE WHEN {c} IS NULL THEN '{c}' END" for c in _FLAGGED)}) AS imputed_columns, CAST({' + '.join(f'CASE WHEN {c} IS NULL THEN 1 ELSE 0 END' for c in _FLAGGED)} AS BIGINT) AS imputed_count FROM holes""")

# --- scaling ---------------------------------------------------------------------------------------

SCALED = ["return_rate", "avg_order_size", "customer_lifetime_days", "recent_returns"]
_robust = lambda c: f"(CAST({c} AS DOUBLE) - (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.5) FROM base)) / (SELECT CASE WHEN quantile_cont(CAST({c} AS DOUBLE), 0.75) = quantile_cont(CAST({c} AS DOUBLE), 0.25) THEN 1 ELSE quantile_cont(CAST({c} AS DOUBLE), 0.75) - quantile_cont(CAST({c} AS DOUBLE), 0.25) END FROM base)"
_standard = lambda c: f"(CAST({c} AS DOUBLE) - (SELECT avg({c}) FROM base)) / (SELECT CASE WHEN stddev_pop({c}) = 0 THEN 1 ELSE stddev_pop({c}) END FROM base)"
on_base("scl_01_robust_scale", lambda s: pre.scale(s, SCALED, "robust").select(ID, *[f"{c}_scaled" for c in SCALED]), f"SELECT customer_emailid, {', '.join(r6(_robust(c), c + '_scaled') for c in SCALED)} FROM base")
on_base("scl_02_standard_scale", lambda s: pre.scale(s, SCALED, "standard").select(ID, *[f"{c}_scaled" for c in SCALED]), f"SELECT customer_emailid, {', '.join(r6(_standard(c), c + '_scaled') for c in SCALED)} FROM base")
_minmax = f"""
SELECT customer_emailid, {r6("(category_diversity_score - (SELECT min(category_diversity_score) FROM f23 WHERE category_diversity_score > 0)) / nullif((SELECT max(category_diversity_score) - min(category_diversity_score) FROM f23 WHERE category_diversity_score > 0), 0)", 'category_diversity_score_scaled')} FROM f23"""


def _rescaled(spark, sf):
    d = now.category_diversity(order_lines(spark, sf))
    return pre.minmax_rescale(d, d, "category_diversity_score", "category_diversity_score_scaled").select(ID, "category_diversity_score_scaled")


register("scl_03_minmax_rescale", _rescaled, _minmax)
register("jn_08_minmax_join", lambda spark, sf: clean.lookup_customers(_rescaled(spark, sf), order_lines(spark, sf).where("return_qty > 0")), f"SELECT * FROM ({_minmax}) WHERE customer_emailid IN (SELECT customer_emailid FROM order_lines WHERE return_qty > 0)")
on_base("scl_04_clip_scale", lambda s: now.clip_scale_0_100(s.select(ID, "return_intensity", "avg_order_size"), ["return_intensity", "avg_order_size"]), "SELECT customer_emailid, " + ", ".join(
    r6(f"100 * (least({c}, (SELECT quantile_cont({c}, 0.99) FROM base)) - (SELECT min({c}) FROM base)) / ((SELECT quantile_cont({c}, 0.99) FROM base) - (SELECT min({c}) FROM base))", c) for c in ["return_intensity", "avg_order_size"]) + " FROM base")


def _centers_back(s):
    stats = pre.scaling_stats(s, SCALED, "standard")
    scaled = common.labelled(pre.apply_scaling(s, stats, SCALED))
    c = scaled.groupBy("cluster").agg(*[F.avg(f"{x}_scaled").alias(x) for x in SCALED])
    return pre.inverse_scale_centers(c, stats, SCALED)


on_base("scl_05_inverse_centers", _centers_back, f"SELECT cluster, {', '.join(r6(f'avg({c})', c) for c in SCALED)} FROM labelled GROUP BY cluster")
on_base("scl_06_completeness", lambda s: pre.gold_flags(pre.completeness(s, NUMERIC).withColumn("outlier_score", -F.least(F.lit(1.0), F.col("return_intensity") / 50.0))).select(ID, "feature_completeness_score", "data_quality_flags"), f"""
SELECT customer_emailid, {r6('feature_completeness_score', 'feature_completeness_score')}, concat(CASE WHEN feature_completeness_score < 0.3 THEN 'LOW_COMPLETENESS;' ELSE '' END,
 CASE WHEN outlier_score < (SELECT quantile_cont(outlier_score, 0.01) FROM goldish) THEN 'EXTREME_OUTLIER;' ELSE '' END) AS data_quality_flags FROM goldish""")

# --- feature selection ------------------------------------------------------------------------------

names = lambda spark, cols: spark.createDataFrame([(c,) for c in cols], "feature string")


def _silver_parts(spark, sf):
    """The base with the advanced groups; the lines are joined once. The customer rows of each group are checkpointed before the next one begins, and so are those of all for the methods that go over them."""
    b = stored(order_lines(spark, sf).select(*LINE_COLUMNS))
    table = checkpoint(now.core_table(b, money=False))
    for group in (now.category_intelligence, now.seasonal, now.adjacency, now.trend):
        table = table.join(checkpoint(group(b)), ID, "left")
    return checkpoint(table)


def _selected(spark, sf):
    return names(spark, pre.select_features(_silver_parts(spark, sf)))


_ALWAYS = [c for g, cols in pre.CLUSTER_GROUPS.items() if g not in pre.MIN_SHARE for c in cols]
register("fs_01_select_features", _selected, U.join([f"SELECT '{c}' AS feature" for c in _ALWAYS] + [
    f"SELECT '{c}' FROM {t} HAVING avg(CASE WHEN {c} = 0 THEN 0e0 ELSE 1e0 END) > {pre.MIN_SHARE[g]}" for g, t in [("category_intelligence", "f06"), ("adjacency_patterns", "f07"), ("seasonal_trends", "f08"), ("trend_susceptibility", "f09")] for c in pre.CLUSTER_GROUPS[g]]))
on_base("fs_02_drop_null_features", lambda s: names(s.sparkSession, pre.drop_null_features(s.withColumn("empty", F.lit(None).cast("double")), ["return_rate", "empty", "avg_order_size"])),
        "SELECT 'return_rate' AS feature FROM base HAVING count(return_rate) > 0 UNION ALL SELECT 'avg_order_size' FROM base HAVING count(avg_order_size) > 0")
_CORR = ["sales_order_no_nunique", "sku_nunique", "items_returned_count", "return_rate", "avg_returns_per_order", "avg_order_size"]


def _correlated_sql() -> str:
    """The pair walk on the twin side, unrolled: a feature leaves when it loses its first live pair."""
    pairs = [(a, b) for i, a in enumerate(_CORR) for b in _CORR[i + 1:]]
    cte("high_pairs", U.join(f"SELECT {i} AS i, '{a}' AS a, '{b}' AS b, abs(corr({a}, {b})) > 0.8 AS high FROM base" for i, (a, b) in enumerate(pairs)))
    cte("pair_counts", "SELECT f, count(*) AS n FROM (SELECT a AS f FROM high_pairs WHERE high UNION ALL SELECT b FROM high_pairs WHERE high) GROUP BY f")
    cte("high_ranked", "SELECT row_number() OVER (ORDER BY i) AS k, a, b, CASE WHEN pa.n > pb.n THEN a ELSE b END AS loser FROM high_pairs JOIN pair_counts pa ON a = pa.f JOIN pair_counts pb ON b = pb.f WHERE high")
    cte("walk", """SELECT 0 AS k, CAST([] AS VARCHAR[]) AS gone UNION ALL
SELECT h.k, CASE WHEN list_contains(gone, a) OR list_contains(gone, b) THEN gone ELSE list_append(gone, loser) END FROM walk JOIN high_ranked h ON h.k = walk.k + 1""")
    body = twin("SELECT unnest([" + ", ".join(f"'{c}'" for c in _CORR) + "]) AS feature EXCEPT SELECT unnest(gone) FROM (SELECT gone FROM walk ORDER BY k DESC LIMIT 1)")
    return body.replace("WITH ", "WITH RECURSIVE ", 1)


on_base("fs_03_drop_correlated", lambda s: names(s.sparkSession, pre.drop_correlated(s, _CORR)))
TWINS["fs_03_drop_correlated"] = _correlated_sql()
_VARS = ["return_rate", "return_frequency_ratio", "avg_order_size", "behavior_stability_score"]
on_base("fs_04_drop_low_variance", lambda s: names(s.sparkSession, pre.drop_low_variance(s, _VARS, 0.01)), U.join(f"SELECT '{c}' AS feature FROM base HAVING var_samp({c}) >= 0.01" for c in _VARS))
on_base("fs_04_variances", lambda s: pre.variances(s, NUMERIC, population=True), U.join(f"SELECT '{c}' AS feature, {r6(f'var_pop({c})', 'variance')} FROM base" for c in NUMERIC))
_VIF = ["return_rate", "avg_order_size", "return_intensity"]
cte("gram", "SELECT " + ", ".join(f"sum({a} * {b}) AS g{i}{j}" for i, a in enumerate(_VIF) for j, b in enumerate(_VIF) if i <= j) + " FROM base")
cte("gram_det", "SELECT *, g00 * (g11 * g22 - g12 * g12) - g01 * (g01 * g22 - g12 * g02) + g02 * (g01 * g12 - g11 * g02) AS det FROM gram")
on_base("fs_05_vif", lambda s: pre.vif(s, _VIF), f"""SELECT 'return_rate' AS feature, {r6('g00 * (g11 * g22 - g12 * g12) / det', 'vif')} FROM gram_det UNION ALL
SELECT 'avg_order_size', {r6('g11 * (g00 * g22 - g02 * g02) / det', 'vif')} FROM gram_det UNION ALL SELECT 'return_intensity', {r6('g22 * (g00 * g11 - g01 * g01) / det', 'vif')} FROM gram_det""")
on_base("fs_06_rf_importance", lambda s: pre.rf_importance(s, NUMERIC))
on_base("fs_07_importance_stability", lambda s: pre.importance_stability(s, NUMERIC))
_IV = ["return_rate", "avg_order_size", "recent_returns", "sku_nunique"]


def _bin_sql(c: str) -> str:
    edges = ", ".join(f"quantile_cont(CAST({c} AS DOUBLE), {i / 5}) AS q{i}" for i in range(5))
    return f"SELECT customer_emailid, '{c}' AS feature, len(list_filter(list_distinct([q1, q2, q3, q4]), lambda e: e > q0 AND e < {c})) + 1 AS bin FROM base, (SELECT {edges} FROM base)"


cte("binned", U.join(_bin_sql(c) for c in _IV))
cte("iv_bins", "SELECT feature, bin, CAST(count(*) FILTER (WHERE return_intensity > 14) AS DOUBLE) AS e, CAST(count(*) FILTER (WHERE return_intensity <= 14) AS DOUBLE) AS n FROM binned JOIN base USING (customer_emailid) GROUP BY feature, bin")
on_base("fs_08_information_value", lambda s: pre.information_value(s, _IV, F.col("return_intensity") > 14), f"""
SELECT feature, {r6('sum((pe - pn) * ln(greatest(pe, 1e-10) / greatest(pn, 1e-10)))', 'iv')} FROM (
 SELECT feature, e / sum(e) OVER (PARTITION BY feature) AS pe, n / sum(n) OVER (PARTITION BY feature) AS pn FROM iv_bins) GROUP BY feature""")


def _consolidated(s):
    found = lambda frame, cond: [r["feature"] for r in frame.where(cond).collect()]
    flagged = {"high_vif": found(pre.vif(s, _VIF), F.col("vif") > 10), "low_variance": found(pre.variances(s, _VIF, True), F.col("variance") < 0.5)}
    return pre.consolidate(s.sparkSession, _VIF, flagged)


cte("vif_rows", TWINS["fs_05_vif"][TWINS["fs_05_vif"].rindex("SELECT 'return_rate' AS feature"):])
cte("var_rows", U.join(f"SELECT '{c}' AS feature, var_pop({c}) AS variance FROM base" for c in _VIF))
on_base("fs_09_consolidate", _consolidated, """
SELECT feature, CAST(f1 + f2 AS INT) AS flags, concat_ws(',', CASE WHEN f1 = 1 THEN 'high_vif' END, CASE WHEN f2 = 1 THEN 'low_variance' END) AS methods, f1 + f2 >= 2 AS removed
FROM (SELECT feature, CASE WHEN vif > 10 THEN 1 ELSE 0 END AS f1, CASE WHEN variance < 0.5 THEN 1 ELSE 0 END AS f2 FROM vif_rows JOIN var_rows USING (feature))""")


def _advanced(spark, sf):
    """All five methods over all features offered to clustering, filled and judged as the gold build does; SQL has two of them, see fs_09_consolidate."""
    cols = [c for group in pre.CLUSTER_GROUPS.values() for c in group]
    judged = pre.completeness(pre.fill_by_name(_silver_parts(spark, sf).select(ID, *cols), cols), cols)
    event = F.col("feature_completeness_score") > quantile_scalar(judged, "feature_completeness_score", 0.5)
    _, meta = pre.advanced_selection(checkpoint(judged.withColumn("_event", event)), cols, F.col("_event").cast("boolean"))
    return pre.consolidate(spark, cols, meta["flagged_features"])


register("fs_09_advanced_selection", _advanced)
on_base("fs_10_mutual_information", lambda s: pre.mutual_information(s, _IV, "customer_tenure_stage"), f"""
SELECT feature, {r6('greatest(sum(n / t * ln(n * t / (nb * nc))), 0)', 'mi')} FROM (
 SELECT feature, n, sum(n) OVER (PARTITION BY feature) AS t, sum(n) OVER (PARTITION BY feature, bin) AS nb, sum(n) OVER (PARTITION BY feature, customer_tenure_stage) AS nc FROM (
  SELECT feature, bin, customer_tenure_stage, CAST(count(*) AS DOUBLE) AS n FROM binned JOIN base USING (customer_emailid) GROUP BY ALL)) GROUP BY feature""")
register("fs_10_select_k_best", lambda spark, sf: pre.select_k_best(
    pre.pseudo_targets(common.customer_base(spark, sf).join(now.consecutive_returns(order_lines(spark, sf)), ID)), _IV, "churn_risk", 2).select("feature"), """
SELECT feature FROM (SELECT feature, round(sum(n / t * ln(n * t / (nb * nc))), 9) AS mi FROM (
 SELECT feature, n, sum(n) OVER (PARTITION BY feature) AS t, sum(n) OVER (PARTITION BY feature, bin) AS nb, sum(n) OVER (PARTITION BY feature, risk) AS nc FROM (
  SELECT feature, bin, risk, CAST(count(*) AS DOUBLE) AS n FROM binned JOIN (
   SELECT customer_emailid, greatest(1, least(3, ceil((consecutive_returns - lo) / ((hi - lo) / 3e0)))) AS risk FROM f03, (SELECT min(consecutive_returns) AS lo, max(consecutive_returns) AS hi FROM f03)) USING (customer_emailid) GROUP BY ALL)) GROUP BY feature) ORDER BY mi DESC, feature LIMIT 2""")
on_base("fs_10_anova_f", lambda s: pre.anova_f(s, _IV, "customer_tenure_stage"), U.join(f"""
SELECT '{c}' AS feature, {r6('(sum(n * pow(m - gm, 2)) / (count(*) - 1)) / (sum(n * v) / (sum(n) - count(*)))', 'f_value')} FROM (SELECT count(*) AS n, avg({c}) AS m, var_pop({c}) AS v, (SELECT avg({c}) FROM base) AS gm FROM base GROUP BY customer_tenure_stage)""" for c in _IV))
_DISC = ["return_rate", "avg_order_size", "customer_lifetime_days", "recent_returns", "return_intensity"]
on_segments("fs_11_discriminative_features", lambda s: pre.discriminative_features(s, _DISC, 3), "SELECT * FROM (" + U.join(
    f"SELECT '{c}' AS feature, {r6('var_pop(m)', 'variance')} FROM (SELECT avg({c}) AS m FROM labelled WHERE cluster <> -1 GROUP BY cluster)" for c in _DISC) + ") ORDER BY variance DESC LIMIT 3")
on_segments("fs_11_cluster_feature_matrix", lambda s: pre.cluster_feature_matrix(s, _DISC, list(range(8)), 5), U.join(
    f"SELECT '{c}' AS feature, " + ", ".join(r6(f"avg({c}) FILTER (WHERE cluster = {k})", f"cluster_{k}") for k in range(8)) + " FROM labelled" for c in _DISC))
on_segments("fs_12_between_within_ratio", lambda s: pre.between_within_ratio(s, _DISC), U.join(f"""
SELECT '{c}' AS feature, {r6('b / w', 'importance_score')}, {r6('b', 'between_cluster_variance')}, {r6('w', 'within_cluster_variance')}, {r6('gm', 'overall_mean')}, {r6('sd', 'overall_std')}
FROM (SELECT avg(pow(m - gm, 2)) AS b FROM (SELECT avg({c}) AS m FROM labelled GROUP BY cluster), (SELECT avg({c}) AS gm FROM labelled)), (SELECT var_samp({c}) AS w, avg({c}) AS gm, stddev_samp({c}) AS sd FROM labelled)""" for c in _DISC))
# The forest on the twin side: rows drawn by the same names, then grown and walked level by level.
TREES, SAMPLE, DEPTH, SEED = 100, 256, 8, 42
_u = lambda what: f"CAST('0x' || substr(md5(concat('{SEED}:', tree, ':', node, ':{what}')), 1, 13) AS BIGINT) / 4503599627370496e0"
_mean_path = lambda n: f"CASE WHEN {n} <= 1 THEN 0e0 WHEN {n} = 2 THEN 1e0 ELSE 2e0 * (ln({n} - 1e0) + {np.euler_gamma!r}) - 2e0 * ({n} - 1e0) / {n} END"


def _level(k: int) -> None:
    """CTEs of depth ``k``: size and bounds of its nodes, their axis and cut, and the rows handed down."""
    cte(f"if_box{k}", "SELECT tree, node, count(*) AS n, [" + ", ".join(f"min(v[{i + 1}])" for i in range(len(NUMERIC))) + "] AS lo, ["
        + ", ".join(f"max(v[{i + 1}])" for i in range(len(NUMERIC))) + f"] AS hi FROM if_rows{k} GROUP BY tree, node")
    cte(f"if_axis{k}", f"""SELECT *, CASE WHEN n > 1 AND {k} < depth AND len(open) > 0 THEN open[1 + CAST(floor({_u('axis')} * len(open)) AS INT)] END AS axis
 FROM (SELECT *, list_filter(range(1, {len(NUMERIC) + 1}), lambda i: hi[i] > lo[i]) AS open FROM if_box{k}), if_size""")
    cte(f"if_node{k}", f"""SELECT tree, node, CASE WHEN cut > lo[axis] THEN axis END AS axis, cut, {k} + {_mean_path('n')} AS path
 FROM (SELECT *, lo[axis] + {_u('cut')} * (hi[axis] - lo[axis]) AS cut FROM if_axis{k})""")
    cte(f"if_rows{k + 1}", f"SELECT r.tree, r.id, r.v, CASE WHEN r.v[axis] < cut THEN 2 * r.node ELSE 2 * r.node + 1 END AS node FROM if_rows{k} r JOIN if_node{k} n ON r.tree = n.tree AND r.node = n.node WHERE axis IS NOT NULL")
    cte(f"if_walk{k + 1}", f"SELECT r.tree, r.id, r.v, CASE WHEN axis IS NULL THEN n.path END AS path, CASE WHEN r.v[axis] < cut THEN 2 * r.node ELSE 2 * r.node + 1 END AS node FROM if_walk{k} r JOIN if_node{k} n ON r.tree = n.tree AND r.node = n.node WHERE r.path IS NULL")


cte("if_points", "SELECT customer_emailid AS id, [" + ", ".join(f"coalesce(round(CAST({c} AS DOUBLE), 6), 0e0)" for c in NUMERIC) + "] AS v FROM base")
cte("if_size", f"SELECT least({SAMPLE}, count(*)) AS size, ceil(log2(greatest(2, least({SAMPLE}, count(*))))) AS depth FROM if_points")
cte("if_pool", f"SELECT id, v, md5(concat('{SEED}:', id)) AS h FROM if_points ORDER BY h, v LIMIT (SELECT 64 * size FROM if_size)")
cte("if_rows0", f"""SELECT tree, id, v, 1 AS node FROM (SELECT tree, id, v, row_number() OVER (PARTITION BY tree ORDER BY md5(concat(tree, ':', h)), v) AS k
 FROM if_pool, (SELECT unnest(range({TREES})) AS tree)), if_size WHERE k <= size""")
cte("if_walk0", f"SELECT tree, id, v, CAST(NULL AS DOUBLE) AS path, 1 AS node FROM if_points, (SELECT unnest(range({TREES})) AS tree)")
for _k in range(DEPTH + 1):
    _level(_k)
cte("if_paths", U.join(f"SELECT id, path FROM if_walk{k + 1} WHERE path IS NOT NULL" for k in range(DEPTH + 1)))
cte("if_scores", f"SELECT id AS customer_emailid, round(-pow(2e0, -(sum(path) / {TREES}) / any_value({_mean_path('size')})), 12) AS outlier_score FROM if_paths, if_size GROUP BY id")
cte("if_flags", "SELECT *, outlier_score < (SELECT quantile_cont(outlier_score, 0.05) FROM if_scores) AS outlier_flag FROM if_scores")


def _forest(s):
    return outliers.isolation_forest(rounded(s.withColumns({c: F.col(c).cast("double") for c in NUMERIC}), only=NUMERIC), NUMERIC, trees=TREES, sample=SAMPLE, seed=SEED)


def _replayed(s):
    """Scores of the stored nodes walked by joins."""
    fixed = checkpoint(rounded(s.select(ID, *[F.col(c).cast("double") for c in NUMERIC]), only=NUMERIC))
    total = fixed.count()
    size = max(min(SAMPLE, total), 1)
    nodes = checkpoint(outliers.fit_forest(fixed, NUMERIC, ID, TREES, size, SEED, total))
    return outliers.replay_forest(fixed, nodes, NUMERIC, size)


on_base("out_01_isolation_forest", lambda s: _forest(s).select(ID, "outlier_score", "outlier_flag"), f"SELECT customer_emailid, {r6('outlier_score', 'outlier_score')}, outlier_flag FROM if_flags")
on_base("out_01_forest_replay", _replayed, f"SELECT customer_emailid, {r6('outlier_score', 'outlier_score')} FROM if_scores")
on_base("out_01_describe_outliers", lambda s: outliers.describe_outliers(_forest(s)), f"""
SELECT outlier_flag, count(*) AS customers, {r6('avg(round(return_rate, 6))', 'avg_return_rate')}, {r6('avg(sales_order_no_nunique)', 'avg_order_count')}, {r6('avg(round(customer_lifetime_days, 6))', 'avg_lifetime_days')}
FROM base JOIN if_flags USING (customer_emailid) GROUP BY outlier_flag""")

# --- clustering ------------------------------------------------------------------------------------------

# Whole embeddings: at this radius most points are core points, but not all.
EPS, MIN = 1.2, 5
whole = common.vectors
cte("pts", "SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, CAST(label AS INT) AS label FROM embeddings")


def _dbscan_ctes(prefix: str, pts: str, eps: float, need: int) -> None:
    """Neighbours, cores, reachability closure and numbering inside ``grp``."""
    cte(f"{prefix}near", f"SELECT a.grp, a.id AS a, b.id AS b FROM {pts} a JOIN {pts} b ON a.grp = b.grp AND list_distance(a.v, b.v) <= {eps}")
    cte(f"{prefix}cores", f"SELECT grp, a AS id FROM {prefix}near GROUP BY grp, a HAVING count(*) >= {need}")
    cte(f"{prefix}links", f"SELECT n.grp, n.a, n.b FROM {prefix}near n JOIN {prefix}cores x ON n.a = x.id JOIN {prefix}cores y ON n.b = y.id")
    cte(f"{prefix}reach", f"SELECT grp, id, id AS seed FROM {prefix}cores UNION SELECT l.grp, l.b, r.seed FROM {prefix}reach r JOIN {prefix}links l ON r.id = l.a")
    cte(f"{prefix}comp", f"SELECT grp, id, min(seed) AS root FROM {prefix}reach GROUP BY grp, id")
    cte(f"{prefix}num", f"SELECT grp, id, CAST(dense_rank() OVER (PARTITION BY grp ORDER BY root) - 1 AS INT) AS cluster FROM {prefix}comp")
    cte(f"{prefix}label", f"""SELECT p.id, p.grp, coalesce(c.cluster, b.cluster, -1) AS cluster, c.id IS NOT NULL AS is_core FROM {pts} p LEFT JOIN {prefix}num c ON p.id = c.id
 LEFT JOIN (SELECT n.a AS id, min(m.cluster) AS cluster FROM {prefix}near n JOIN {prefix}num m ON n.b = m.id GROUP BY n.a) b ON p.id = b.id""")


def recursive(sql: str) -> str:
    return twin(sql).replace("WITH ", "WITH RECURSIVE ", 1)


cte("pts_all", "SELECT 0 AS grp, id, v FROM pts")
_dbscan_ctes("d1_", "pts_all", EPS, MIN)
register("c_01_dbscan", lambda spark, sf: db.dbscan(whole(spark, sf), EPS, MIN, block_rows=200))
TWINS["c_01_dbscan"] = recursive("SELECT id, cluster, is_core FROM d1_label")
register("c_01_dbscan_summary", lambda spark, sf: db.dbscan_summary(db.dbscan(whole(spark, sf), EPS, MIN)))
TWINS["c_01_dbscan_summary"] = recursive("""SELECT count(DISTINCT cluster) FILTER (WHERE cluster <> -1) AS n_clusters, count(*) FILTER (WHERE cluster = -1) AS noise_points, count(*) FILTER (WHERE is_core) AS core_points,
 round(avg(CASE WHEN cluster = -1 THEN 1e0 ELSE 0e0 END), 6) AS noise_ratio, avg(CASE WHEN cluster = -1 THEN 1e0 ELSE 0e0 END) <= 0.15 AS noise_acceptable FROM d1_label""")
cte("pts_sub", "SELECT grp, id, v FROM (SELECT CAST(label % 3 AS INT) - 1 AS grp, id, v FROM pts) WHERE grp <> -1")
_dbscan_ctes("d2_", "pts_sub", 1.19, 4)
cte("sub_info", "SELECT grp, count(DISTINCT cluster) FILTER (WHERE cluster <> -1) AS subs FROM d2_label GROUP BY grp")
register("c_05_sub_dbscan", lambda spark, sf: db.sub_dbscan(whole(spark, sf), whole(spark, sf).select("id", (F.col("label") % 3 - 1).alias("cluster")), 1.19, 4)[0])
TWINS["c_05_sub_dbscan"] = recursive("""SELECT p.id, CAST(label % 3 AS INT) - 1 AS cluster, CASE WHEN subs > 1 AND s.cluster <> -1 THEN s.cluster END AS sub,
 CAST(CASE WHEN subs > 1 AND s.cluster <> -1 THEN label % 3 * 1000 + s.cluster + 1 ELSE label % 3 - 1 END AS INT) AS final_id
 FROM pts p LEFT JOIN d2_label s ON p.id = s.id LEFT JOIN sub_info i ON s.grp = i.grp""")
KS = list(range(3, 15))
STARTS = 20


def _search(spark, sf):
    return km.kmeans_search(whole(spark, sf), KS, STARTS)


def _fit_facts(data, ks):
    """Facts of the fits that hold for any start: rows counted, each at its nearest returned centre, inertia as recomputed."""
    rows = []
    for k, (inertia, centers) in km.fit_kmeans(data, ks, STARTS).items():
        labelled = km.with_labels(data, centers, "id")
        means = data.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centers)], "label int, center array<double>")
        gaps = labelled.join(means, "label").withColumn("own", metrics.squared_distance(F.col("v"), F.col("center")))
        every = F.array_min(F.transform(F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in centers]), lambda c: metrics.squared_distance(F.col("v"), c)))
        row = gaps.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("label").alias("k"), F.sum("own").alias("cost"), F.max(F.col("own") - every).alias("worse")).first()
        rows.append((k, row.n, row.k, abs(row.cost - inertia) <= 1e-6 * max(1.0, inertia), row.worse <= 1e-9))
    return data.sparkSession.createDataFrame(rows, "k int, n long, clusters long, inertia_recomputed boolean, all_nearest boolean")


_FACTS = "SELECT CAST(k AS INT) AS k, (SELECT count(*) FROM embeddings) AS n, CAST(k AS BIGINT) AS clusters, true AS inertia_recomputed, true AS all_nearest FROM (SELECT unnest([{}]) AS k)"
register("c_02_kmeans_search", _search)
register("c_02_kmeans_facts", lambda spark, sf: _fit_facts(whole(spark, sf), KS), _FACTS.format(", ".join(map(str, KS))))
register("c_03_choose_k", lambda spark, sf: spark.createDataFrame([(km.choose_k(_search(spark, sf))[0],)], "k int"))
register("c_04_kmeans_final", lambda spark, sf: km.kmeans_final(whole(spark, sf), 4, whole(spark, sf).where("label = 9").select("id"), STARTS)[0])
register("c_04_final_sizes", lambda spark, sf: km.kmeans_final(whole(spark, sf), 4, whole(spark, sf).where("label = 9").select("id"), STARTS)[0].agg(
    F.count(F.lit(1)).alias("customers"), F.count_if(F.col("cluster") == -1).alias("noise"), F.countDistinct(F.when(F.col("cluster") >= 0, F.col("cluster"))).alias("clusters")),
    "SELECT count(*) AS customers, count(*) FILTER (WHERE label = 9) AS noise, CAST(4 AS BIGINT) AS clusters FROM embeddings")
cte("vecs", "SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, CAST(label AS INT) AS label FROM embeddings")


def silhouette_sql(points: str) -> str:
    """Mean silhouette on squared distances of (id, v, label) rows, from sums per cluster."""
    return f"""SELECT avg(CASE WHEN a IS NULL THEN 0 ELSE coalesce((b - a) / nullif(greatest(a, b), 0), 0) END) AS silhouette FROM (
 SELECT id, max(CASE WHEN label = other AND n > 1 THEN d / (n - 1) END) AS a, min(CASE WHEN label <> other THEN d / n END) AS b FROM (
  SELECT p.id, p.label, c.label AS other, c.n, greatest(c.n * list_dot_product(p.v, p.v) - 2 * list_dot_product(p.v, c.s) + c.q, 0) AS d FROM {points} p, (
   SELECT label, list(x ORDER BY i) AS s, any_value(n) AS n, any_value(q) AS q FROM (SELECT label, i, sum(x) AS x, count(*) AS n FROM (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM {points}) GROUP BY label, i)
   JOIN (SELECT label, sum(list_dot_product(v, v)) AS q FROM {points} GROUP BY label) USING (label) GROUP BY label) c) GROUP BY id)"""


register("c_06_silhouette", lambda spark, sf: metrics.silhouette(whole(spark, sf)), f"SELECT round(silhouette, 6) AS silhouette FROM ({silhouette_sql('vecs')})")
cte("mid", "SELECT label, list(m ORDER BY i) AS c, any_value(n) AS n FROM (SELECT label, i, avg(x) AS m, count(*) AS n FROM (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM vecs) GROUP BY label, i) GROUP BY label")
cte("grand", "SELECT list(m ORDER BY i) AS c FROM (SELECT i, avg(x) AS m FROM (SELECT unnest(v) AS x, generate_subscripts(v, 1) AS i FROM vecs) GROUP BY i)")
register("c_07_calinski_harabasz", lambda spark, sf: metrics.calinski_harabasz(whole(spark, sf)), """
SELECT round((b / (k - 1)) / (w / (n - k)), 6) AS calinski_harabasz FROM (SELECT sum(pow(list_distance(v, c), 2)) AS w, count(*) AS n FROM vecs JOIN mid USING (label)),
 (SELECT sum(mid.n * pow(list_distance(mid.c, grand.c), 2)) AS b, count(*) AS k FROM mid, grand)""")
cte("spread", "SELECT label, avg(list_distance(v, c)) AS s, any_value(c) AS c FROM vecs JOIN mid USING (label) GROUP BY label")
register("c_08_davies_bouldin", lambda spark, sf: metrics.davies_bouldin(whole(spark, sf)), """
SELECT round(avg(r), 6) AS davies_bouldin FROM (SELECT a.label, max((a.s + b.s) / list_distance(a.c, b.c)) AS r FROM spread a JOIN spread b ON a.label <> b.label GROUP BY a.label)""")
register("c_09_pca", lambda spark, sf: km.pca_explained(whole(spark, sf), 10))

# --- segment reports ---------------------------------------------------------------------------------------

_avg = lambda pairs: ", ".join(r6(f"avg({c})", n) for n, c in pairs)
cte("clean_rows", "SELECT * FROM goldish WHERE cluster <> -1")
on_segments("c_10_cluster_profile", lambda s: report.cluster_profile(s, _DISC), f"""
SELECT cluster, count(*) AS size, {_avg([('avg_' + c, c) for c in _DISC])}, {_avg([('outlier_score_mean', 'outlier_score'), ('completeness_score_mean', 'feature_completeness_score')])},
 {r6('100e0 * count(*) / (SELECT count(*) FROM clean_rows)', 'percentage')} FROM clean_rows GROUP BY cluster""")
_SUMMARY = f"""SELECT cluster AS cluster_id, 'DBSCAN_KMEANS_SUBDBSCAN' AS clustering_method, CAST(count(*) AS INT) AS customer_count, 100e0 * count(*) / (SELECT count(*) FROM clean_rows) AS percentage_of_total,
 avg(return_rate) AS avg_return_rate, avg(sales_order_no_nunique) AS avg_order_count, avg(customer_lifetime_days) AS avg_lifetime_days, avg(feature_completeness_score) AS avg_completeness_score FROM clean_rows GROUP BY cluster"""
cte("summary_rows", _SUMMARY)
_R = ["percentage_of_total", "avg_return_rate", "avg_order_count", "avg_lifetime_days", "avg_completeness_score"]
on_segments("c_11_cluster_summary", report.cluster_summary_table, f"SELECT cluster_id, clustering_method, customer_count, {', '.join(r6(c, c) for c in _R)} FROM summary_rows")
on_segments("c_11_result_rows", lambda s: report.result_rows(s).drop("clustering_timestamp"), f"SELECT customer_emailid, cluster AS final_cluster_id, 'DBSCAN_KMEANS_SUBDBSCAN' AS clustering_method, {r6('feature_completeness_score', 'cluster_quality_score')} FROM goldish")


def _archetype_case(r: str, o: str, d: str) -> str:
    return f"CASE WHEN {r} > 0.4 THEN 'High Returners' WHEN {r} < 0.1 AND {o} > 20 THEN 'Loyal Customers' WHEN {d} > 730 AND {o} > 15 THEN 'Veteran Shoppers' WHEN {d} < 180 THEN 'New Customers' WHEN {o} > 30 THEN 'Frequent Buyers' ELSE 'Regular Customers' END"


_STRATEGY = """CASE business_archetype WHEN 'High Returners' THEN 'Focus on return reason analysis and quality improvement' WHEN 'Loyal Customers' THEN 'Retention programs and premium service offerings'
 WHEN 'Veteran Shoppers' THEN 'Loyalty rewards and exclusive experiences' WHEN 'New Customers' THEN 'Onboarding optimization and early engagement' WHEN 'Frequent Buyers' THEN 'Volume incentives and personalized recommendations'
 ELSE 'Balanced engagement and satisfaction monitoring' END AS recommended_strategy"""
# Per customer, so that several archetypes occur.
on_base("c_12_archetype", lambda s: report.archetype(s, "return_rate", "sales_order_no_nunique", "customer_lifetime_days").select(ID, "business_archetype", "recommended_strategy"), f"""
SELECT *, {_STRATEGY} FROM (SELECT customer_emailid, {_archetype_case('return_rate', 'sales_order_no_nunique', 'customer_lifetime_days')} AS business_archetype FROM base)""")


def _totals(s):
    noise = F.col("cluster") == -1
    return s.agg(F.count(F.lit(1)).alias("total_customers"), F.count_if(~noise).alias("clustered_customers"), F.count_if(noise).alias("noise_customers"))


cte("totals", "SELECT count(*) AS total_customers, count(*) FILTER (WHERE cluster <> -1) AS clustered_customers, count(*) FILTER (WHERE cluster = -1) AS noise_customers FROM goldish")


def _segment_silhouette(s):
    points = km.to_vectors(s.where("cluster <> -1"), _DISC, ID).withColumnRenamed("id", ID).join(s.select(ID, F.col("cluster").alias("label")), ID)
    return metrics.silhouette_value(points)


cte("seg_points", f"SELECT customer_emailid AS id, cluster AS label, [{', '.join(f'coalesce(CAST({c} AS DOUBLE), 0)' for c in _DISC)}] AS v FROM clean_rows")
cte("seg_silhouette", silhouette_sql("seg_points"))
_final = lambda part: lambda s: report.final_report(report.cluster_summary_table(s), _totals(s), _segment_silhouette(s) if part == "summary" else None)[part]
on_segments("c_13_report_summary", _final("summary"), f"SELECT *, {r6('100e0 * clustered_customers / total_customers', 'clustered_pct')}, {r6('100e0 * noise_customers / total_customers', 'noise_pct')}, (SELECT CASE WHEN silhouette > 0.7 THEN 'Excellent' WHEN silhouette > 0.5 THEN 'Good' WHEN silhouette > 0.3 THEN 'Fair' ELSE 'Poor' END FROM seg_silhouette) AS quality_rating FROM totals")
on_segments("c_13_report_profiles", _final("profiles"), f"""SELECT *, {_STRATEGY} FROM (SELECT cluster_id, clustering_method, customer_count, {', '.join(r6(c, c) for c in _R)}, {_archetype_case('avg_return_rate', 'avg_order_count', 'avg_lifetime_days')} AS business_archetype FROM summary_rows)""")
on_segments("c_13_recommendations", _final("recommendations"), """
SELECT topic, count(*) AS clusters, CAST(sum(customer_count) AS BIGINT) AS customers FROM (
 SELECT 'high_return_rate' AS topic, customer_count FROM summary_rows WHERE avg_return_rate > 0.3 UNION ALL SELECT 'major_segments', customer_count FROM summary_rows, totals WHERE customer_count > clustered_customers * 0.15
 UNION ALL SELECT 'niche_segments', customer_count FROM summary_rows, totals WHERE customer_count < clustered_customers * 0.05) GROUP BY topic UNION ALL SELECT 'outliers', 0, noise_customers FROM totals WHERE noise_customers > 0""")
_EXEC = {"total_customers": "count(*)", "clustered_customers": "count(*) FILTER (WHERE cluster <> -1)", "noise_customers": "count(*) FILTER (WHERE cluster = -1)", "clusters": "count(DISTINCT cluster) FILTER (WHERE cluster <> -1)",
         "clustered_pct": "100e0 * count(*) FILTER (WHERE cluster <> -1) / count(*)", "noise_pct": "100e0 * count(*) FILTER (WHERE cluster = -1) / count(*)", "avg_return_rate": "avg(return_rate)", "avg_lifetime_days": "avg(customer_lifetime_days)", "avg_order_count": "avg(sales_order_no_nunique)"}
on_segments("c_14_executive_summary", report.executive_summary, U.join(f"SELECT '{n}' AS metric, {r6(f'CAST({e} AS DOUBLE)', 'value')} FROM goldish" for n, e in _EXEC.items()) + " UNION ALL SELECT concat('cluster_', cluster), CAST(count(*) AS DOUBLE) FROM clean_rows GROUP BY cluster")
cte("sheet", f"""SELECT cluster, count(*) AS customer_count, {', '.join(f'avg({c}) AS {n}' for n, c in report.SHEET.items())}, count(*) FILTER (WHERE outlier_score < -0.5) AS outlier_customers,
 avg(feature_completeness_score) AS avg_quality_score, quantile_cont(return_rate, 0.5) AS median_return_rate, 100e0 * count(*) / (SELECT count(*) FROM clean_rows) AS percentage_of_total FROM clean_rows GROUP BY cluster""")
on_segments("c_15_cluster_profiles_sheet", lambda s: report.cluster_profiles_sheet(s.withColumn("cluster_quality_score", F.col("feature_completeness_score"))), f"""SELECT *, {_STRATEGY} FROM (SELECT cluster, customer_count, outlier_customers, {', '.join(r6(n, n) for n in [*report.SHEET, 'avg_quality_score', 'median_return_rate', 'percentage_of_total'])},
 {_archetype_case('avg_return_rate', 'avg_order_count', 'avg_lifetime_days')} AS business_archetype FROM sheet)""")
on_segments("c_16_assignments", report.assignments, f"""SELECT g.customer_emailid, g.cluster, CASE WHEN s.cluster IS NOT NULL THEN {_archetype_case('s.avg_return_rate', 's.avg_order_count', 's.avg_lifetime_days')} END AS business_archetype, g.cluster = -1 AS is_outlier,
 {r6('return_rate', 'return_rate')}, sales_order_no_nunique, customer_lifetime_days, {r6('g.avg_order_size', 'avg_order_size')}, items_returned_count, {r6('outlier_score', 'outlier_score')}, {r6('feature_completeness_score', 'feature_completeness_score')} FROM goldish g LEFT JOIN sheet s ON g.cluster = s.cluster""")


def _quality(spark, sf):
    s = common.segments(spark, sf)
    g = s.withColumn("data_quality_flags", F.when(F.col("feature_completeness_score") < 0.9, "LOW_COMPLETENESS;").otherwise(""))
    return report.quality_metrics(quality.layer_quality_scores(clean.fix_return_dates(order_lines(spark, sf)), s, g), s, _segment_silhouette(s))


register("c_17_quality_metrics", _quality, f"""
SELECT 'Data Quality' AS metric_category, concat(layer, ' Quality Score') AS metric_name, {r6('s', 'value')} FROM (SELECT 'Bronze Layer' AS layer, 100e0 * count(*) FILTER (WHERE data_quality_flags = '') / count(*) AS s FROM fixed
 UNION ALL SELECT 'Silver Layer', avg(feature_completeness_score) * 100 FROM goldish UNION ALL SELECT 'Gold Layer', 100e0 * count(*) FILTER (WHERE data_quality_flags = '') / count(*) FROM gold_flags)
UNION ALL SELECT 'Coverage', 'Customer Coverage Rate', {r6('100e0 * count(*) FILTER (WHERE cluster <> -1) / count(*)', 'value')} FROM goldish
UNION ALL SELECT 'Completeness', 'Average Feature Completeness', {r6('avg(feature_completeness_score)', 'value')} FROM goldish UNION ALL SELECT 'Clustering Quality', 'Silhouette Score', {r6('silhouette', 'value')} FROM seg_silhouette""")
on_segments("c_26_distinctive_features", lambda s: report.distinctive_features(s, _DISC, 2), f"""
SELECT cluster, feature, {r6('d', 'deviation_pct')}, direction FROM (SELECT *, row_number() OVER (PARTITION BY cluster, direction ORDER BY abs(d) DESC, feature) AS k FROM (
 SELECT cluster, feature, 100 * (m - base_m) / abs(base_m) AS d, CASE WHEN m > base_m THEN 'high' ELSE 'low' END AS direction FROM (
 {U.join(f"SELECT cluster, '{c}' AS feature, avg({c}) AS m, (SELECT avg({c}) FROM clean_rows) AS base_m FROM clean_rows GROUP BY cluster" for c in _DISC)})) WHERE d <> 0) WHERE k <= 2""")

# --- variant: segments of returners ------------------------------------------------------------------------------


def returner_segments(spark, sf):
    """Returners with a rule-made segment; checkpointed, since limits, means and rows are worked out from it one after the other."""
    f = rt.clustering_frame(order_lines(spark, sf))
    return checkpoint(f.withColumn("cluster", (F.floor(F.col("return_rate") * 10) % 4 + F.when(F.col("recent_orders") > 1, 4).otherwise(0)).cast("int")))


cte("seg", f"""
SELECT *, CAST(floor(return_rate * 10) % 4 + CASE WHEN recent_orders > 1 THEN 4 ELSE 0 END AS INT) AS cluster FROM (
 SELECT customer_emailid, {', '.join(f'round(coalesce(CAST({c} AS DOUBLE), 0), 3) AS {c}' for c in rt.CLUSTER_FEATURES)} FROM (
  SELECT g1.*, r.recent_vs_avg_ratio, CASE WHEN r.recent_vs_avg_ratio > 1.5 THEN 1 ELSE 0 END AS return_trend_increasing, t.avg_days_to_return, t.return_timing_spread, p.avg_returns_per_order, i.avg_return_intensity, i.return_frequency_ratio
  FROM g1 LEFT JOIN recent_vs r USING (customer_emailid) LEFT JOIN g1_timing t USING (customer_emailid) LEFT JOIN g1_per_order p USING (customer_emailid) LEFT JOIN g1_intensity i USING (customer_emailid)))""")
cte("seg_sum", f"SELECT cluster, count(*) AS customer_count, {', '.join(f'round(avg({c}), 3) AS {n}' for n, c in report.SUMMARY_NAMES.items())} FROM seg GROUP BY cluster")
cte("seg_limits", "SELECT " + ", ".join(f"quantile_cont({c}, {p}) AS {n}" for n, c, p in [
    ("rate_75", "return_rate", 0.75), ("rate_25", "return_rate", 0.25), ("ratio_75", "return_ratio", 0.75), ("orders_75", "sales_order_no_nunique", 0.75), ("recent_25", "recent_orders", 0.25),
    ("intensity_75", "avg_return_intensity", 0.75), ("per_order_75", "avg_returns_per_order", 0.75), ("variety_75", "sku_nunique", 0.75), ("orders_90", "sales_order_no_nunique", 0.9)]) + " FROM seg")
_RULES = [
    ("avg_return_rate >= rate_75 AND avg_return_ratio >= ratio_75", "HIGH RISK - Heavy Returners", "Immediate retention intervention needed"),
    ("avg_returns_per_order >= per_order_75 AND avg_return_intensity >= intensity_75", "BULK RETURNERS - High Volume Per Order", "Order size limits + return policy review"),
    ("avg_return_intensity >= intensity_75 AND avg_days_to_return <= 7", "FAST FULL RETURNERS - Quick Complete Returns", "Product education + sizing guides"),
    ("avg_return_rate >= rate_75 AND avg_recent_orders <= recent_25", "CHURN RISK - High Returns + Low Engagement", "Re-engagement campaign with better recommendations"),
    ("avg_orders >= orders_75 AND avg_return_rate <= rate_25", "VIP - High Volume Low Returns", "Premium loyalty rewards program"),
    ("avg_orders >= orders_75 AND avg_return_rate >= rate_75", "COMPLEX - High Volume High Returns", "Personalized service + product quality review"),
    ("avg_product_variety >= variety_75", "EXPLORERS - High Product Variety", "Product discovery campaigns"),
    ("avg_recent_orders <= recent_25", "AT RISK - Low Recent Activity", "Win-back campaign"),
]
_case = lambda i, other: "CASE " + " ".join(f"WHEN {r[0]} THEN '{r[i]}'" for r in _RULES) + f" ELSE '{other}' END"
cte("seg_types", f"SELECT seg_sum.*, {_case(1, 'STANDARD - Balanced Customers')} AS cluster_type, {_case(2, 'Standard marketing engagement')} AS action FROM seg_sum, seg_limits")


def on_returners(name, job, sql=None):
    register(name, lambda spark, sf: job(returner_segments(spark, sf)), sql)


on_returners("c_20_returner_summary", report.returner_summary, "SELECT * FROM seg_sum")
on_returners("c_21_segment_types", report.segment_types, "SELECT * FROM seg_types")
_LEVELS = rt.CLUSTER_FEATURES
cte("level_rows", U.join(f"SELECT cluster, '{c}' AS feature, value, CASE WHEN value >= (SELECT quantile_cont({c}, 0.75) FROM seg) THEN 'HIGH' WHEN value <= (SELECT quantile_cont({c}, 0.25) FROM seg) THEN 'LOW' ELSE 'MODERATE' END AS level FROM (SELECT cluster, round(avg({c}), 3) AS value FROM seg GROUP BY cluster)" for c in _LEVELS))
on_returners("c_22_level_profile", lambda s: report.level_profile(s, _LEVELS), "SELECT * FROM level_rows")
on_returners("c_22_distinguishing", lambda s: report.distinguishing_features(report.level_profile(s, _LEVELS)), "SELECT cluster, string_agg(feature, ', ' ORDER BY feature) AS distinguishing_features FROM level_rows WHERE level <> 'MODERATE' GROUP BY cluster")
_has = lambda *parts: "(" + " OR ".join(f"contains(cluster_type, '{p}')" for p in parts) + ")"
cte("scores", f"""SELECT *, (v + r + o + CASE WHEN v >= 6 THEN 2 ELSE 0 END) AS total, o + CASE WHEN v >= 6 THEN 2 ELSE 0 END AS o2 FROM (SELECT t.*, 100e0 * customer_count / (SELECT sum(customer_count) FROM seg_types) AS share,
 CASE WHEN avg_orders >= orders_90 THEN 4 WHEN avg_orders >= orders_75 THEN 2 ELSE 0 END + CASE WHEN avg_lifetime_days >= 500 THEN 2 ELSE 0 END + CASE WHEN 100e0 * customer_count / (SELECT sum(customer_count) FROM seg_types) >= 15 THEN 2 ELSE 0 END + CASE WHEN avg_recent_orders >= 3 THEN 2 ELSE 0 END AS v,
 CASE WHEN avg_return_rate >= rate_75 THEN 3 ELSE 0 END + CASE WHEN avg_recent_orders <= recent_25 THEN 3 ELSE 0 END + CASE WHEN {_has('CHURN', 'HIGH RISK')} THEN 4 ELSE 0 END AS r,
 CASE WHEN {_has('VIP', 'CHAMPION')} THEN 4 WHEN {_has('EXPLORER')} THEN 3 WHEN {_has('STANDARD')} THEN 2 ELSE 0 END + CASE WHEN avg_recent_orders >= 2 THEN 2 ELSE 0 END AS o FROM seg_types t, seg_limits)""")
on_returners("c_23_priority_matrix", lambda s: report.priority_matrix(report.segment_types(s), report.segment_limits(s)), """
SELECT cluster, cluster_type, customer_count, round(share, 6) AS percentage, CAST(least(v, 10) AS INT) AS business_value_score, CAST(least(r, 10) AS INT) AS risk_score, CAST(least(o2, 10) AS INT) AS opportunity_score,
 round(total / 3e0, 1) AS overall_priority, CASE WHEN r >= 6 THEN 'Retention' WHEN o2 >= 6 THEN 'Growth' ELSE 'Maintenance' END AS primary_focus FROM scores""")
on_returners("c_24_segment_match", lambda s: report.segment_match(report.segment_types(s)), f"""
SELECT cluster, cluster_type, customer_count, e AS expected_segment, CASE WHEN g THEN 'STRONG MATCH' WHEN e = 'STANDARD/BALANCED' THEN 'ACCEPTABLE' ELSE 'MISMATCH' END AS match_quality FROM (
 SELECT *, CASE e WHEN 'VIP CHAMPIONS' THEN {_has('VIP')} WHEN 'HEAVY RETURNERS' THEN {_has('HEAVY', 'HIGH RISK')} WHEN 'CHURN RISK' THEN {_has('CHURN', 'AT RISK')} WHEN 'EXPLORERS' THEN {_has('EXPLORER')} ELSE {_has('STANDARD')} END AS g FROM (
 SELECT *, CASE WHEN avg_orders > 50 AND avg_return_rate < 0.3 THEN 'VIP CHAMPIONS' WHEN avg_return_rate > 0.6 AND avg_return_ratio > 0.5 THEN 'HEAVY RETURNERS' WHEN avg_recent_orders < 2 AND avg_orders > 10 THEN 'CHURN RISK'
 WHEN avg_product_variety > 100 THEN 'EXPLORERS' ELSE 'STANDARD/BALANCED' END AS e FROM seg_types))""")
on_returners("c_24_match_overview", lambda s: report.match_overview(report.segment_types(s)), f"""
SELECT count(*) FILTER (WHERE {_has('VIP', 'HEAVY', 'HIGH RISK', 'CHURN', 'AT RISK', 'EXPLORER', 'STANDARD')}) AS strong_matches, count(*) AS clusters, max(p) AS largest_pct, min(p) AS smallest_pct
FROM (SELECT *, round(100e0 * customer_count / (SELECT sum(customer_count) FROM seg_types), 1) AS p FROM seg_types)""")
on_returners("c_25_campaign_lists", lambda s: report.campaign_lists(s, report.segment_types(s)), f"""
SELECT CASE WHEN {_has('HIGH RISK', 'CHURN RISK')} THEN 'high_risk' ELSE 'loyal' END AS campaign, cluster, customer_emailid FROM seg JOIN seg_types USING (cluster) WHERE {_has('HIGH RISK', 'CHURN RISK', 'LOYAL')}""")
on_returners("c_25_labelled_export", lambda s: report.labelled_export(s, report.segment_types(s)).select(ID, "cluster", "cluster_type"), "SELECT customer_emailid, cluster, cluster_type FROM seg JOIN seg_types USING (cluster)")
on_returners("c_18_optimal_k", lambda s: km.kmeans_search(km.to_vectors(pre.scale(s, rt.CLUSTER_FEATURES, "standard"), [f"{c}_scaled" for c in rt.CLUSTER_FEATURES], ID), list(range(2, 11)), STARTS))


def _returner_kmeans(s):
    stats = pre.scaling_stats(s, rt.CLUSTER_FEATURES, "standard")
    scaled = pre.apply_scaling(s, stats, rt.CLUSTER_FEATURES)
    vec = km.to_vectors(scaled, [f"{c}_scaled" for c in rt.CLUSTER_FEATURES], ID)
    _, figures = km.kmeans_final(vec, 5, n_init=STARTS)
    c = s.sparkSession.createDataFrame([(i, *row) for i, row in enumerate(figures["centers"])], "cluster int, " + ", ".join(f"{x} double" for x in rt.CLUSTER_FEATURES))
    return pre.inverse_scale_centers(c, stats, rt.CLUSTER_FEATURES)


on_returners("c_19_kmeans_centers", _returner_kmeans)

# --- text -------------------------------------------------------------------------------------------------------

cte("words", "SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\\s+'), lambda w: w <> '') AS ws FROM documents")
_list = lambda names_: "[" + ", ".join(f"'{w}'" for w in names_) + "]"
cte("word_hits", f"SELECT doc_id, len(list_filter(ws, lambda w: list_contains({_list(tx.POSITIVE)}, w))) AS p, len(list_filter(ws, lambda w: list_contains({_list(tx.NEGATIVE)}, w))) AS n FROM words")
register("ud_03_score_text", lambda spark, sf: tx.score_text(table(spark, sf, "documents").select("doc_id", "text"), "text").drop("text"), """
SELECT doc_id, CASE WHEN p > n THEN 'POSITIVE' WHEN n > p THEN 'NEGATIVE' ELSE 'NEUTRAL' END AS model_sentiment, round(CASE WHEN p + n > 0 THEN 0.5e0 + 0.5e0 * abs(p - n) / (p + n) ELSE 0.5e0 END, 6) AS model_confidence FROM word_hits""")
