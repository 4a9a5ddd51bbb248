"""Queries over scored predictions: confusion metrics, thresholds, prefixes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from flowlab.operators import metrics as M
from flowlab.operators import prefix as X
from flowlab.operators import ranking as R
from flowlab.plans.adapters import FRACTIONS, importances, preds, r6, runs, sql_metrics, sql_r6, unsw_like
from flowlab.plans.registry import query

ORDER = ["ts", "row_id"]
ALL_METRICS = [
    "accuracy", "balanced_accuracy", "precision_macro", "recall_macro", "f1_macro", "precision_weighted", "recall_weighted", "f1_weighted",
    "precision_benign", "recall_benign", "f1_benign", "precision_attack", "recall_attack", "f1_attack",
]
CM_SQL = """count(*) FILTER (WHERE y_true = 0 AND y_pred = 0) AS tn, count(*) FILTER (WHERE y_true = 0 AND y_pred = 1) AS fp,
  count(*) FILTER (WHERE y_true = 1 AND y_pred = 0) AS fn, count(*) FILTER (WHERE y_true = 1 AND y_pred = 1) AS tp"""


@query("early_detection_by_scenario", f"""
SELECT scenario, n_rows, tn, fp, fn, tp, {sql_r6('accuracy', 'f1_macro', 'recall_attack', 'f1_attack')}
FROM ({sql_metrics(f"SELECT scenario, {CM_SQL} FROM prefixes WHERE fraction = 0.1::DOUBLE GROUP BY scenario")}) m
""")
def early_detection_by_scenario(spark, sf):
    """Flagship: detection quality per scenario when only the earliest 10% of its flows is seen."""
    seen = X.prefix(preds(spark, sf), 0.1, ["scenario"], ORDER)
    return M.metrics_present(M.confusion(seen, ["scenario"])).select(
        "scenario", "n_rows", *M.CELLS, *r6("accuracy", "f1_macro", "recall_attack", "f1_attack")
    )


@query("m01_confusion", f"SELECT scenario, {CM_SQL} FROM preds GROUP BY scenario")
def m01(spark, sf):
    return M.confusion(preds(spark, sf), ["scenario"])


@query("m02_metrics_fixed", f"SELECT scenario, n_rows, support_benign, support_attack, {sql_r6(*ALL_METRICS)} FROM ({sql_metrics(f'SELECT scenario, {CM_SQL} FROM preds GROUP BY scenario', 'fixed')}) m")
def m02(spark, sf):
    return M.metrics_fixed(M.confusion(preds(spark, sf), ["scenario"])).select("scenario", "n_rows", "support_benign", "support_attack", *r6(*ALL_METRICS))


_one_class = f"SELECT scenario, y_true AS side, {CM_SQL} FROM preds GROUP BY scenario, y_true"


@query("m03_metrics_present", f"SELECT scenario, side, n_rows, {sql_r6(*ALL_METRICS)} FROM ({sql_metrics(_one_class)}) m")
def m03(spark, sf):
    """Also on one-class groups, where present and fixed averages differ."""
    sided = preds(spark, sf).withColumn("side", F.col("y_true"))
    return M.metrics_present(M.confusion(sided, ["scenario", "side"])).select("scenario", "side", "n_rows", *r6(*ALL_METRICS))


def _cat_preds(spark, sf):
    """Multiclass predictions on the second domain: the class a line count points at."""
    u = unsw_like(spark, sf)
    guess = (
        F.when(F.col("spkts") % 5 == 0, "Normal").when(F.col("dpkts") % 4 == 1, "DoS").when(F.col("smean") > 45, "Exploits").otherwise(F.col("attack_cat"))
    )
    return u.select("id", F.col("attack_cat").alias("y_true"), guess.alias("y_pred"))


_CAT = """cat_preds AS (SELECT id, attack_cat AS y_true, CASE WHEN spkts % 5 = 0 THEN 'Normal' WHEN dpkts % 4 = 1 THEN 'DoS' WHEN smean > 45 THEN 'Exploits' ELSE attack_cat END AS y_pred FROM unsw_like),
classes AS (SELECT cls, tp, support, predicted, p AS precision, r AS recall, coalesce(2.0 * p * r / nullif(p + r, 0), 0)::DOUBLE AS f1
 FROM (SELECT *, coalesce(tp::DOUBLE / nullif(predicted, 0), 0) AS p, coalesce(tp::DOUBLE / nullif(support, 0), 0) AS r
  FROM (SELECT cls, sum(tp)::BIGINT AS tp, sum(support)::BIGINT AS support, sum(predicted)::BIGINT AS predicted FROM (
   SELECT y_true AS cls, count(*) FILTER (WHERE y_true = y_pred) AS tp, count(*) AS support, 0 AS predicted FROM cat_preds GROUP BY 1
   UNION ALL SELECT y_pred AS cls, 0, 0, count(*) FROM cat_preds GROUP BY 1) s GROUP BY cls) c) d)"""
_MULTI = ["accuracy", "balanced_accuracy", "precision_macro", "recall_macro", "f1_macro", "precision_weighted", "recall_weighted", "f1_weighted"]


@query("m04_metrics_multiclass", f"""WITH {_CAT}
SELECT sum(support)::BIGINT AS n_rows, round(sum(tp)::DOUBLE / sum(support), 6) AS accuracy, round(avg(recall), 6) AS balanced_accuracy,
 round(avg(precision), 6) AS precision_macro, round(avg(recall), 6) AS recall_macro, round(avg(f1), 6) AS f1_macro,
 round(sum(precision * support) / sum(support), 6) AS precision_weighted, round(sum(recall * support) / sum(support), 6) AS recall_weighted,
 round(sum(f1 * support) / sum(support), 6) AS f1_weighted FROM classes""")
def m04(spark, sf):
    return M.multiclass_summary(M.per_class(_cat_preds(spark, sf))).select("n_rows", *r6(*_MULTI))


@query("m05_overall_report", f"""
SELECT n_rows, support_benign, support_attack, {sql_r6('attack_rate', 'predicted_attack_rate', *ALL_METRICS)}
FROM (SELECT *, support_attack::DOUBLE / n_rows AS attack_rate, (tp + fp)::DOUBLE / n_rows AS predicted_attack_rate FROM ({sql_metrics(f'SELECT {CM_SQL} FROM preds')}) m) r""")
def m05(spark, sf):
    cm = M.metrics_present(M.confusion(preds(spark, sf)))
    rates = {"attack_rate": F.col("support_attack") / F.col("n_rows"), "predicted_attack_rate": (F.col("tp") + F.col("fp")) / F.col("n_rows")}
    return cm.withColumns(rates).select("n_rows", "support_benign", "support_attack", *r6(*rates, *ALL_METRICS))


@query("m06_roc_auc", """
SELECT scenario, round(sum(pos * (run_neg - neg / 2.0::DOUBLE)) / (sum(pos)::DOUBLE * sum(neg)), 9) AS roc_auc
FROM (SELECT *, sum(neg) OVER (PARTITION BY scenario ORDER BY y_score) AS run_neg
  FROM (SELECT scenario, y_score, sum(y_true) AS pos, sum(1 - y_true) AS neg FROM preds GROUP BY scenario, y_score) a) b GROUP BY scenario""")
def m06(spark, sf):
    return M.roc_auc(preds(spark, sf), ["scenario"]).select("scenario", F.round("roc_auc", 9).alias("roc_auc"))


@query("m07_average_precision", """
SELECT scenario, round(sum(pos * run_pos::DOUBLE / (run_pos + run_neg)) / sum(pos), 9) AS pr_auc
FROM (SELECT *, sum(neg) OVER w AS run_neg, sum(pos) OVER w AS run_pos
  FROM (SELECT scenario, y_score, sum(y_true) AS pos, sum(1 - y_true) AS neg FROM preds GROUP BY scenario, y_score) a
  WINDOW w AS (PARTITION BY scenario ORDER BY y_score DESC)) b GROUP BY scenario""")
def m07(spark, sf):
    return M.average_precision(preds(spark, sf), ["scenario"]).select("scenario", F.round("pr_auc", 9).alias("pr_auc"))


@query("m08_metrics_by_scenario", f"""
SELECT scenario, n_rows, tn, fp, fn, tp, round(attack_rate, 6) AS attack_rate, first_ts, last_ts, {sql_r6('accuracy', 'balanced_accuracy', 'f1_macro', 'f1_attack')}
FROM ({sql_metrics(f'SELECT scenario, {CM_SQL}, avg(y_true) AS attack_rate, min(ts) AS first_ts, max(ts) AS last_ts FROM preds GROUP BY scenario')}) m""")
def m08(spark, sf):
    out = M.metrics_by(preds(spark, sf), ["scenario"], "ts")
    return out.select("scenario", "n_rows", *M.CELLS, *r6("attack_rate"), "first_ts", "last_ts", *r6("accuracy", "balanced_accuracy", "f1_macro", "f1_attack"))


@query("m08_metrics_by_attack_category", f"""
SELECT attack_cat, n_rows, tn, fp, fn, tp, round(attack_rate, 6) AS attack_rate, first_id, last_id, {sql_r6('accuracy', 'f1_macro', 'f1_attack')}
FROM ({sql_metrics(f'SELECT attack_cat, {CM_SQL}, avg(y_true) AS attack_rate, min(id) AS first_id, max(id) AS last_id FROM (SELECT id, attack_cat, label AS y_true, CASE WHEN spkts >= 4 THEN 1 ELSE 0 END AS y_pred FROM unsw_like) p GROUP BY attack_cat')}) m""")
def m08_category(spark, sf):
    scored = unsw_like(spark, sf).select("id", "attack_cat", F.col("label").alias("y_true"), (F.col("spkts") >= 4).cast("int").alias("y_pred"))
    out = M.metrics_by(scored, ["attack_cat"], "id")
    return out.select("attack_cat", "n_rows", *M.CELLS, *r6("attack_rate"), "first_id", "last_id", *r6("accuracy", "f1_macro", "f1_attack"))


@query("m09_classification_report", f"""WITH {_CAT}, total AS (SELECT sum(support)::BIGINT AS n, sum(tp)::DOUBLE / sum(support) AS acc FROM classes)
SELECT cls AS row, {sql_r6('precision', 'recall', 'f1')}, support FROM classes
UNION ALL SELECT 'accuracy', round(acc, 6), round(acc, 6), round(acc, 6), n FROM total
UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), sum(support)::BIGINT FROM classes
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6), sum(support)::BIGINT FROM classes""")
def m09(spark, sf):
    return M.class_report(M.per_class(_cat_preds(spark, sf))).select("row", *r6("precision", "recall", "f1"), "support")


def _drawn(cell: str, hits: str) -> str:
    """One step of the redraw: the cell's binomial share of ``rest`` rows, with ``mass`` rows of the table still undecided."""
    u, v = (f"(CAST(CAST('0x' || substr(md5(concat('42:', scenario, ':', resample, ':{cell}:{k}')), 1, 12) AS UBIGINT) AS DOUBLE) + 0.5) / 281474976710656.0::DOUBLE" for k in (1, 2))
    z, p = f"sqrt(-2 * ln({u})) * cos({v} * 2 * pi())", f"({hits}::DOUBLE / mass)"
    x = f"floor(rest * {p} + sqrt(rest * {p} * (1 - {p})) * z + (1 - 2 * {p}) * (z * z - 1) / 6 + 0.5)"
    return f"SELECT * REPLACE (rest - {cell} AS rest, mass - {hits} AS mass) FROM (SELECT * EXCLUDE (z), CASE WHEN rest <= 0 OR {hits} <= 0 THEN 0 WHEN {hits} >= mass THEN rest ELSE greatest(0, least(rest, {x})) END::BIGINT AS {cell} FROM (SELECT *, {z} AS z FROM (%s) a) b) c"


_redrawn = "SELECT scenario, c_tn, c_fp, c_fn, resample, n AS rest, n AS mass FROM (SELECT scenario, count(*) AS n, count(*) FILTER (WHERE y_true = 0 AND y_pred = 0) AS c_tn, count(*) FILTER (WHERE y_true = 0 AND y_pred = 1) AS c_fp, count(*) FILTER (WHERE y_true = 1 AND y_pred = 0) AS c_fn FROM preds GROUP BY scenario) g CROSS JOIN (SELECT unnest(range(1, 1001)) AS resample) r"
for _cell in ("tn", "fp", "fn"):
    _redrawn = _drawn(_cell, f"c_{_cell}") % _redrawn
_redrawn = sql_metrics(f"SELECT scenario, resample, tn, fp, fn, rest AS tp FROM ({_redrawn}) d")


@query("m10_bootstrap_ci", f"""
SELECT scenario, metric, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.025), 6) AS ci_low, round(quantile_cont(v, 0.975), 6) AS ci_high, count(*) AS n_resamples
FROM (SELECT scenario, unnest([{', '.join(f"'{m}'" for m in M.BOOTSTRAP_METRICS)}]) AS metric, unnest([{', '.join(M.BOOTSTRAP_METRICS)}]) AS v FROM ({_redrawn}) m) l GROUP BY scenario, metric""")
def m10(spark, sf):
    """1000 multinomial redraws of each scenario's confusion cells."""
    return M.bootstrap_ci(preds(spark, sf), ["scenario"], 1000).select("scenario", "metric", *r6("mean", "ci_low", "ci_high"), "n_resamples")


# The default sweep thresholds.
SWEEP = [0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1]
_sweep_src = f"""SELECT threshold, {CM_SQL.replace('y_pred = 0', 'NOT up').replace('y_pred = 1', 'up')} FROM (SELECT y_true, threshold, y_score >= threshold AS up FROM preds
  CROSS JOIN (VALUES {', '.join(f'({t}::DOUBLE)' for t in SWEEP)}) t(threshold)) s GROUP BY threshold"""
_SWEEP_SQL = sql_metrics(_sweep_src, "fixed")


def _sweep(spark, sf):
    return M.threshold_sweep(preds(spark, sf), SWEEP)


@query("m11_threshold_sweep", f"SELECT threshold, tn, fp, fn, tp, {sql_r6(*ALL_METRICS)} FROM ({_SWEEP_SQL}) m")
def m11(spark, sf):
    return _sweep(spark, sf).select("threshold", *M.CELLS, *r6(*ALL_METRICS))


@query("m12_best_threshold_macro", f"SELECT threshold, {sql_r6('f1_macro')} FROM ({_SWEEP_SQL}) m ORDER BY f1_macro DESC, threshold LIMIT 1")
def m12_macro(spark, sf):
    return M.best_threshold(_sweep(spark, sf)).select("threshold", *r6("f1_macro"))


_sc = _sweep_src.replace("SELECT threshold,", "SELECT scenario, threshold,", 1).replace("SELECT y_true,", "SELECT scenario, y_true,").replace("GROUP BY threshold", "GROUP BY scenario, threshold")


@query("m12_best_threshold_recipe", f"""
SELECT scenario, threshold, {sql_r6('f1_macro', 'f1_attack', 'accuracy')} FROM ({sql_metrics(_sc, 'fixed')}) m
QUALIFY row_number() OVER (PARTITION BY scenario ORDER BY f1_macro DESC, f1_attack DESC, accuracy DESC, threshold) = 1""")
def m12_recipe(spark, sf):
    sweep = M.threshold_sweep(preds(spark, sf), SWEEP, ["scenario"])
    return M.best_threshold(sweep, ["scenario"], "recipe").select("scenario", "threshold", *r6("f1_macro", "f1_attack", "accuracy"))


@query("m13_best_thresholds", " UNION ALL ".join(
    f"(SELECT '{c}' AS criterion, threshold, round({c}, 6) AS value FROM ({_SWEEP_SQL}) m ORDER BY {c} DESC, threshold DESC LIMIT 1)" for c in M.CRITERIA))
def m13(spark, sf):
    return M.best_thresholds(_sweep(spark, sf)).select("criterion", "threshold", *r6("value"))


@query("m14_score_histogram", """
SELECT y_true, least(59, floor((y_score - 0.0::DOUBLE) / (1.0::DOUBLE / 60)))::INT AS bin, count(*) AS n_rows FROM preds GROUP BY ALL""")
def m14(spark, sf):
    return M.histogram(preds(spark, sf), "y_score", 60, ["y_true"], 0.0, 1.0).select("y_true", "bin", "n_rows")


@query("m14_duration_histogram", """
SELECT least(49, floor((duration - lo) / ((hi - lo) / 50)))::INT AS bin, count(*) AS n_rows
FROM flows, (SELECT min(duration) AS lo, max(duration) AS hi FROM flows) b GROUP BY ALL""")
def m14_duration(spark, sf):
    from flowlab.plans.adapters import flows

    return M.histogram(flows(spark, sf), "duration", 50).select("bin", "n_rows")


@query("w01_normalize_share", "SELECT fold_name, feature, round(importance / (sum(importance) OVER (PARTITION BY fold_name) + 1e-12), 9) AS importance_norm FROM importances")
def w01(spark, sf):
    return R.normalize_share(importances(spark, sf), ["fold_name"], "importance").select("fold_name", "feature", F.round("importance_norm", 9).alias("importance_norm"))


@query("w02_rank_first", """
SELECT fold_name, feature, rank::BIGINT AS rank, round(rank::DOUBLE / max(rank) OVER (PARTITION BY fold_name), 9) AS rank_norm
FROM (SELECT *, row_number() OVER (PARTITION BY fold_name ORDER BY importance DESC, feature) AS rank FROM importances) r""")
def w02(spark, sf):
    return R.rank_first(importances(spark, sf), ["fold_name"], "importance", "feature").select("fold_name", "feature", F.col("rank").cast("long").alias("rank"), F.round("rank_norm", 9).alias("rank_norm"))


@query("w03_top_k_per_group", "SELECT fold_name, feature, importance FROM importances QUALIFY row_number() OVER (PARTITION BY fold_name ORDER BY importance DESC, feature) <= 3")
def w03(spark, sf):
    return R.top_k_per_group(importances(spark, sf), ["fold_name"], [F.col("importance").desc(), F.col("feature")], 3)


@query("w04_top_n", "SELECT fold_name, feature, importance FROM importances ORDER BY importance DESC, fold_name, feature LIMIT 30")
def w04(spark, sf):
    return R.top_n(importances(spark, sf), [F.col("importance").desc(), F.col("fold_name"), F.col("feature")], 30)


@query("w05_cap_earliest_per_scenario", "SELECT row_id, scenario, ts FROM preds QUALIFY row_number() OVER (PARTITION BY scenario ORDER BY ts, row_id) <= 250")
def w05(spark, sf):
    return X.cap_earliest(preds(spark, sf), ["scenario"], ORDER, 250).select("row_id", "scenario", "ts")


@query("w05_cap_earliest_global", "SELECT id, attack_cat, label FROM unsw_like ORDER BY id LIMIT 5000")
def w05_global(spark, sf):
    return X.cap_earliest(unsw_like(spark, sf), [], ["id"], 5000).select("id", "attack_cat", "label")


@query("w06_prefix_per_scenario", "SELECT row_id, scenario, y_true, score_milli FROM prefixes WHERE fraction = 0.2::DOUBLE")
def w06(spark, sf):
    return X.prefix(preds(spark, sf), 0.2, ["scenario"], ORDER).select("row_id", "scenario", "y_true", "score_milli")


@query("w07_prefix_global", "SELECT id, label FROM (SELECT *, row_number() OVER (ORDER BY id) AS rn, count(*) OVER () AS n FROM unsw_like) u WHERE rn <= greatest(1, floor(n * 0.29::DOUBLE))")
def w07(spark, sf):
    return X.prefix(unsw_like(spark, sf), 0.29, [], ["id"]).select("id", "label")


_w8 = ["accuracy", "precision_macro", "recall_macro", "f1_macro", "precision_attack", "recall_attack", "f1_attack"]


@query("w08_prefix_metrics", f"""
SELECT m.fraction, n_rows AS rows_evaluated, n_scenarios, tn, fp, fn, tp, round(rate, 6) AS malicious_scenarios_detected_rate, {sql_r6(*_w8)}
FROM ({sql_metrics(f'SELECT fraction, {CM_SQL}, count(DISTINCT scenario) AS n_scenarios FROM prefixes GROUP BY fraction')}) m
JOIN (SELECT fraction, avg(CASE WHEN hit THEN 1.0::DOUBLE ELSE 0 END) AS rate FROM (
  SELECT fraction, scenario, bool_or(y_true = 1 AND y_pred = 1) AS hit FROM prefixes
  WHERE scenario IN (SELECT scenario FROM preds WHERE y_true = 1) GROUP BY ALL) h GROUP BY fraction) d ON m.fraction = d.fraction""")
def w08(spark, sf):
    out = X.prefix_metrics(preds(spark, sf), FRACTIONS, ["scenario"], ORDER)
    return out.select("fraction", "rows_evaluated", "n_scenarios", *M.CELLS, *r6("malicious_scenarios_detected_rate", *_w8))


_u = "SELECT id, label AS y_true, CASE WHEN spkts >= 4 THEN 1 ELSE 0 END AS y_pred, row_number() OVER (ORDER BY id) AS pos, count(*) OVER () AS n FROM unsw_like"


@query("w08_prefix_metrics_global", f"""
SELECT fraction, n_rows AS rows_evaluated, tn, fp, fn, tp, {sql_r6(*_w8)}
FROM ({sql_metrics(f'SELECT fraction, {CM_SQL} FROM ({_u}) p CROSS JOIN fractions WHERE pos <= greatest(1, floor(n * fraction)) GROUP BY fraction')}) m""")
def w08_global(spark, sf):
    scored = unsw_like(spark, sf).select("id", F.col("label").alias("y_true"), (F.col("spkts") >= 4).cast("int").alias("y_pred"))
    return X.prefix_metrics(scored, FRACTIONS, [], ["id"]).select("fraction", "rows_evaluated", *M.CELLS, *r6(*_w8))


# Predictions with rare alarms, so that hits come late in some scenarios.
_rare = "latency_table AS (SELECT scenario, fraction, max(rows_seen) AS rows_seen, max(n_group) AS scenario_rows_total, any_value(att) AS scenario_attack_rows_total, bool_or(y_true = 1) AS prefix_has_true_attack, bool_or(score_milli >= 1390) AS prefix_has_predicted_attack, bool_or(y_true = 1 AND score_milli >= 1390) AS prefix_has_true_positive FROM prefixes JOIN (SELECT scenario, sum(y_true)::BIGINT AS att FROM preds GROUP BY scenario) a USING (scenario) GROUP BY scenario, fraction)"


def _latency(spark, sf):
    rare = preds(spark, sf).withColumn("y_pred", (F.col("score_milli") >= 1390).cast("int"))
    return X.latency(rare, FRACTIONS, ["scenario"], ORDER)


@query("w09_latency", f"WITH {_rare} SELECT * FROM latency_table")
def w09(spark, sf):
    return _latency(spark, sf)


@query("w10_first_true_positive", f"WITH {_rare} SELECT scenario, min(fraction) FILTER (WHERE prefix_has_true_positive) AS first_true_positive_fraction FROM latency_table GROUP BY scenario")
def w10(spark, sf):
    return X.first_tp(_latency(spark, sf), ["scenario"])


@query("w11_first_tp_summary", f"""WITH {_rare}, firsts AS (SELECT scenario, {'CASE WHEN scenario IN (' + "'CTU-Cap-09', 'CTU-Cap-10', 'CTU-Cap-11'" + ") THEN 'test' WHEN scenario = 'CTU-Cap-08' THEN 'val' ELSE 'train' END"} AS split, min(fraction) FILTER (WHERE prefix_has_true_positive) AS f FROM latency_table GROUP BY scenario)
SELECT split, count(*) AS n_rows, count(f) AS n_valid_rows, round(avg(f), 6) AS mean_fraction, round(quantile_cont(f, 0.5), 6) AS median_fraction, min(f) AS min_fraction, max(f) AS max_fraction FROM firsts GROUP BY split""")
def w11(spark, sf):
    from flowlab.plans.adapters import split_of

    firsts = X.first_tp(_latency(spark, sf), ["scenario"]).withColumn("split", split_of(F.col("scenario")))
    return X.first_tp_summary(firsts, ["split"]).select("split", "n_rows", "n_valid_rows", *r6("mean_fraction", "median_fraction"), "min_fraction", "max_fraction")


@query("w12_detection_rate", f"WITH {_rare} SELECT fraction, round(avg(prefix_has_true_positive::INT), 6) AS detection_rate, count(*) AS n_scenarios FROM latency_table WHERE scenario_attack_rows_total > 0 GROUP BY fraction")
def w12(spark, sf):
    return X.detection_rate(_latency(spark, sf)).select("fraction", *r6("detection_rate"), "n_scenarios")


_auc = ["f1_attack", "recall_attack", "f1_macro", "accuracy"]
_auc_sql = ", ".join(
    f"round(sum(coalesce((fraction - px) * ({m} + p_{m}) / 2, 0)), 6) AS auc_{m}, round(CASE WHEN max(fraction) > min(fraction) THEN sum(coalesce((fraction - px) * ({m} + p_{m}) / 2, 0)) / (max(fraction) - min(fraction)) ELSE min({m}) END, 6) AS auc_{m}_normalized, "
    f"round(avg({m}) FILTER (WHERE fraction <= 0.2::DOUBLE), 6) AS low_fraction_mean_{m}, round(arg_max({m}, fraction), 6) AS full_fraction_{m}" for m in _auc)


@query("w13_curve_auc", f"""
SELECT direction, model, seed, {_auc_sql}
FROM (SELECT *, lag(fraction) OVER w AS px, {', '.join(f'lag({m}) OVER w AS p_{m}' for m in _auc)} FROM runs WINDOW w AS (PARTITION BY direction, model, seed ORDER BY fraction)) r
GROUP BY direction, model, seed""")
def w13(spark, sf):
    out = R.curve_auc(runs(spark, sf), ["direction", "model", "seed"], _auc)
    return out.select("direction", "model", "seed", *r6(*[c for c in out.columns if c not in ("direction", "model", "seed")]))


def _overlap_sql(k):
    top = f"QUALIFY row_number() OVER (PARTITION BY fold_name ORDER BY importance DESC, feature) <= {k}"
    return f"""
SELECT fold_name, {k} AS k, o AS overlap_count, round(o / {k}.0::DOUBLE, 6) AS overlap_ratio, round(o::DOUBLE / (na + nb - o), 6) AS jaccard
FROM (SELECT fold_name, count(a.feature) AS na, count(b.feature) AS nb, count(*) FILTER (WHERE a.feature IS NOT NULL AND b.feature IS NOT NULL) AS o
 FROM (SELECT fold_name, feature FROM importances {top}) a FULL JOIN (SELECT fold_name, feature FROM importances_b {top}) b USING (fold_name, feature) GROUP BY fold_name) x"""


@query("w14_topk_overlap", " UNION ALL ".join(map(_overlap_sql, (3, 5))))
def w14(spark, sf):
    from flowlab.plans.adapters import importances_b

    parts = [R.topk_overlap(importances(spark, sf), importances_b(spark, sf), ["fold_name"], "feature", "importance", k).withColumn("k", F.lit(k)) for k in (3, 5)]
    return parts[0].unionByName(parts[1]).select("fold_name", "k", "overlap_count", *r6("overlap_ratio", "jaccard"))


@query("w15_spearman", """
SELECT scenario, count(*) AS n_rows, round(corr(rx, ry), 6) AS spearman FROM (
 SELECT scenario, rank() OVER (PARTITION BY scenario ORDER BY duration) + (count(*) OVER (PARTITION BY scenario, duration) - 1) / 2.0::DOUBLE AS rx,
  rank() OVER (PARTITION BY scenario ORDER BY orig_bytes) + (count(*) OVER (PARTITION BY scenario, orig_bytes) - 1) / 2.0::DOUBLE AS ry FROM flows) r GROUP BY scenario""")
def w15(spark, sf):
    from flowlab.plans.adapters import flows

    return R.spearman(flows(spark, sf), "duration", "orig_bytes", ["scenario"]).select("scenario", "n_rows", *r6("spearman"))
