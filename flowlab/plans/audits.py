"""Queries for audits, profiles and aggregates over run tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlab.functions.labels import fold_category, transfer_label
from flowlab.operators import metrics as M
from flowlab.operators import profile as P
from flowlab.operators import reports as R
from flowlab.operators.joins import gain_table
from flowlab.plans.adapters import FRACTIONS, METRICS, flows, importances, pair_runs, pairs_meta, preds, r6, run_cells, runs, sql_metrics, sql_r6, unsw_like
from flowlab.plans.registry import query, table
from flowlab.schemas import CATEGORICAL, FEATURES, UNSW_LIKE_SCHEMA

FOLD_METRICS = ["accuracy", "balanced_accuracy", "f1_macro", "f1_weighted", "precision_macro", "recall_macro", "precision_benign", "recall_benign", "f1_benign", "precision_attack", "recall_attack", "f1_attack"]
_CM = """count(*) FILTER (WHERE y_true = 0 AND y_pred = 0) AS tn, count(*) FILTER (WHERE y_true = 0 AND y_pred = 1) AS fp,
  count(*) FILTER (WHERE y_true = 1 AND y_pred = 0) AS fn, count(*) FILTER (WHERE y_true = 1 AND y_pred = 1) AS tp"""
table("folds", f"SELECT scenario, n_rows, support_benign AS n_benign, support_attack AS n_attack, {', '.join(FOLD_METRICS)}, tn, fp, fn, tp FROM ({sql_metrics(f'SELECT scenario, {_CM} FROM preds GROUP BY scenario', 'fixed')}) m")
table("folds_b", f"SELECT scenario, {', '.join(FOLD_METRICS)} FROM ({sql_metrics(f'SELECT scenario, {_CM} FROM (SELECT scenario, y_true, CASE WHEN score_milli >= 900 THEN 1 ELSE 0 END AS y_pred FROM preds) p GROUP BY scenario', 'fixed')}) m")
table("final_runs", f"SELECT direction, CASE model WHEN 'rf' THEN 'target_only_updated' ELSE 'transfer_learning_updated' END AS condition, fraction AS target_fraction, {', '.join(f'avg({m}) AS {m}' for m in METRICS)} FROM runs GROUP BY direction, model, fraction")


def folds(spark, sf):
    """One metrics row per held-out scenario."""
    m = M.metrics_fixed(M.confusion(preds(spark, sf), ["scenario"]))
    return m.select("scenario", "n_rows", F.col("support_benign").alias("n_benign"), F.col("support_attack").alias("n_attack"), *FOLD_METRICS, *M.CELLS)


def folds_b(spark, sf):
    scored = preds(spark, sf).withColumn("y_pred", (F.col("score_milli") >= 900).cast("int"))
    return M.metrics_fixed(M.confusion(scored, ["scenario"])).select("scenario", *FOLD_METRICS)


def final_runs(spark, sf):
    """Mean run metrics per direction, condition and target fraction."""
    cond = F.when(F.col("model") == "rf", "target_only_updated").otherwise("transfer_learning_updated")
    return runs(spark, sf).groupBy("direction", cond.alias("condition"), F.col("fraction").alias("target_fraction")).agg(*[F.avg(m).alias(m) for m in METRICS])


KEYS6 = "scenario, split, label, detailed_label, label_phase, label_binary"


@query("a01_label_stats", f'SELECT {KEYS6}, count(*) AS "count" FROM flows GROUP BY ALL')
def a01(spark, sf):
    return P.label_stats(flows(spark, sf))


@query("a02_label_mapping", 'SELECT label, detailed_label, label_phase, label_binary, count(*) AS "count" FROM flows GROUP BY ALL')
def a02(spark, sf):
    return P.label_mapping(flows(spark, sf))


@query("a03_scenario_summary", """
SELECT scenario, min(split) AS split, count(*) AS n_rows, count(*) FILTER (WHERE label_binary = 0) AS n_benign, count(*) FILTER (WHERE label_binary = 1) AS n_malicious,
 count(*) FILTER (WHERE ts IS NULL) AS n_unknown_ts, count(*) FILTER (WHERE duration = 0) AS n_zero_duration, count(*) FILTER (WHERE label = 'unknown') AS n_unknown_label,
 count(*) FILTER (WHERE detailed_label = 'unknown') AS n_unknown_detailed_label, count(*) FILTER (WHERE label_phase = 'other_malicious') AS n_other_malicious,
 coalesce(min(ts), 0) AS ts_min, coalesce(max(ts), 0) AS ts_max FROM flows GROUP BY scenario""")
def a03(spark, sf):
    return P.scenario_summary(flows(spark, sf))


def _map_text(col):
    return F.array_join(F.transform(F.map_entries(col), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), "|")


@query("a04_split_summary", """
WITH b AS (SELECT split, string_agg(k || '=' || n, '|' ORDER BY k) AS t FROM (SELECT split, CAST(label_binary AS VARCHAR) AS k, count(*) AS n FROM flows GROUP BY ALL) x GROUP BY split),
p AS (SELECT split, string_agg(k || '=' || n, '|' ORDER BY k) AS t FROM (SELECT split, label_phase AS k, count(*) AS n FROM flows GROUP BY ALL) x GROUP BY split)
SELECT s.*, b.t AS label_binary_counts, p.t AS label_phase_counts FROM (SELECT split, count(*) AS n_rows, count(DISTINCT scenario) AS n_scenarios, (SELECT string_agg(scenario, '|' ORDER BY scenario) FROM (SELECT DISTINCT split, scenario FROM flows) d WHERE d.split = f.split) AS scenarios FROM flows f GROUP BY split) s JOIN b USING (split) JOIN p USING (split)""")
def a04(spark, sf):
    """Map and list results flattened to text for the comparison."""
    out = P.split_summary(flows(spark, sf))
    return out.select("split", "n_rows", "n_scenarios", F.array_join("scenarios", "|").alias("scenarios"), _map_text("label_binary_counts").alias("label_binary_counts"), _map_text("label_phase_counts").alias("label_phase_counts"))


_q = ", ".join(f"round(quantile_cont(duration, {p}), 6) AS {n}" for n, p in P.QUALITY_PROBS.items())


@query("a05_quality_report", f"""
SELECT count(*) AS n_rows_total, count(DISTINCT scenario) AS n_scenarios_total, count(*) FILTER (WHERE ts IS NULL) AS n_missing_ts, count(*) FILTER (WHERE duration = 0) AS n_zero_duration,
 count(*) FILTER (WHERE label = 'unknown') AS n_unknown_label, count(*) FILTER (WHERE detailed_label = 'unknown') AS n_unknown_detailed_label, count(*) FILTER (WHERE label_phase = 'other_malicious') AS n_other_malicious,
 count(*) FILTER (WHERE orig_bytes = 0 AND resp_bytes = 0 AND orig_pkts = 0 AND resp_pkts = 0) AS n_all_zero_traffic_rows, count(DISTINCT proto) AS cardinality_proto, count(DISTINCT service) AS cardinality_service, count(DISTINCT conn_state) AS cardinality_conn_state, {_q} FROM flows""")
def a05(spark, sf):
    out = P.quality_report(flows(spark, sf))
    return out.withColumns({c: F.round(c, 6) for c in P.QUALITY_PROBS})


@query("a06_numeric_describe", " UNION ALL ".join(f"SELECT '{c}' AS feature, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, min({c}) AS min, max({c}) AS max, count(*) FILTER (WHERE {c} IS NULL) AS n_null FROM flows" for c in FEATURES))
def a06(spark, sf):
    return P.numeric_describe(flows(spark, sf), FEATURES).withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


@query("a06_top_categories", " UNION ALL ".join(f"SELECT '{c}' AS feature, {c} AS value, count(*) AS \"count\" FROM flows GROUP BY {c}" for c in CATEGORICAL))
def a06_categories(spark, sf):
    return P.top_categories(flows(spark, sf), CATEGORICAL, 30)


def _pct(test):
    return f"round(100.0::DOUBLE * count(*) FILTER (WHERE {test}) / count(*), 4)"


_summary = {
    "total_flows": "count(*)", "total_scenarios": "count(DISTINCT scenario)", "benign_flows": "count(*) FILTER (WHERE label_binary = 0)", "malicious_flows": "count(*) FILTER (WHERE label_binary = 1)",
    **{f"{s}_flows": f"count(*) FILTER (WHERE split = '{s}')" for s in ("train", "val", "test")},
    "unique_attack_types_detailed_label": "count(DISTINCT detailed_label) FILTER (WHERE label_binary = 1 AND detailed_label <> 'unknown')",
    "unique_attack_types_label_phase": "count(DISTINCT label_phase) FILTER (WHERE label_binary = 1 AND label_phase <> 'unknown')",
    "zero_duration_flows": "count(*) FILTER (WHERE duration = 0)", "missing_timestamps": "count(*) FILTER (WHERE ts IS NULL)",
    "benign_percentage": _pct("label_binary = 0"), "malicious_percentage": _pct("label_binary = 1"), **{f"{s}_percentage": _pct(f"split = '{s}'") for s in ("train", "val", "test")},
    "zero_duration_percentage": _pct("duration = 0"), "missing_timestamp_percentage": _pct("ts IS NULL"),
    "duration_mean": "round(avg(duration), 6)", "duration_median": "round(quantile_cont(duration, 0.5), 6)", "duration_std": "round(stddev_samp(duration), 6)",
    "duration_p95": "round(quantile_cont(duration, 0.95), 6)", "duration_p99": "round(quantile_cont(duration, 0.99), 6)",
}


@query("a07_data_summary", "SELECT metric, value FROM (SELECT " + ", ".join(f"({e})::DOUBLE AS {n}" for n, e in _summary.items()) + " FROM flows) s UNPIVOT (value FOR metric IN (" + ", ".join(_summary) + "))")
def a07(spark, sf):
    return P.data_summary(flows(spark, sf))


@query("a08_scenario_statistics", f"""
WITH kinds AS (SELECT scenario, detailed_label AS d, count(*) AS c FROM flows WHERE label_binary = 1 AND detailed_label <> 'unknown' GROUP BY ALL),
modes AS (SELECT scenario, count(*) AS n_unique_attack_types, first(d ORDER BY c DESC, d) AS most_common_attack_type FROM kinds GROUP BY scenario)
SELECT scenario, split, n_flows, n_benign, n_malicious, pct_benign, pct_malicious, coalesce(n_unique_attack_types, 0) AS n_unique_attack_types, coalesce(most_common_attack_type, 'none') AS most_common_attack_type, duration_mean, duration_median, duration_p95, ts_min, ts_max, n_zero_duration
FROM (SELECT scenario, min(split) AS split, count(*) AS n_flows, count(*) FILTER (WHERE label_binary = 0) AS n_benign, count(*) FILTER (WHERE label_binary = 1) AS n_malicious, {_pct('label_binary = 0')} AS pct_benign, {_pct('label_binary = 1')} AS pct_malicious,
 round(avg(duration), 6) AS duration_mean, round(quantile_cont(duration, 0.5), 6) AS duration_median, round(quantile_cont(duration, 0.95), 6) AS duration_p95, coalesce(min(ts), 0) AS ts_min, coalesce(max(ts), 0) AS ts_max, count(*) FILTER (WHERE duration = 0) AS n_zero_duration FROM flows GROUP BY scenario) f LEFT JOIN modes USING (scenario)""")
def a08(spark, sf):
    return P.scenario_statistics(flows(spark, sf))


@query("a09_split_statistics", f"""
SELECT split, count(*) AS n_flows, count(DISTINCT scenario) AS n_scenarios, count(*) FILTER (WHERE label_binary = 0) AS n_benign, count(*) FILTER (WHERE label_binary = 1) AS n_malicious, {_pct('label_binary = 0')} AS pct_benign, {_pct('label_binary = 1')} AS pct_malicious,
 round(avg(duration), 6) AS duration_mean, round(quantile_cont(duration, 0.5), 6) AS duration_median, round(quantile_cont(duration, 0.95), 6) AS duration_p95 FROM flows GROUP BY split""")
def a09(spark, sf):
    return P.split_statistics(flows(spark, sf))


@query("a10_attack_type_distribution", 'SELECT detailed_label, count(*) AS "count", round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 4) AS percentage FROM flows WHERE label_binary = 1 GROUP BY detailed_label')
def a10(spark, sf):
    return P.distribution(flows(spark, sf).where("label_binary = 1"), "detailed_label")


@query("a10_phase_distribution", 'SELECT label_phase, count(*) AS "count", round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 4) AS percentage FROM flows GROUP BY label_phase')
def a10_phase(spark, sf):
    return P.distribution(flows(spark, sf), "label_phase")


_FAMILY = """CASE WHEN s = 'benign' THEN 'benign' WHEN s LIKE '%c&c%' OR s LIKE '%cnc%' OR s LIKE '%command%' THEN 'c&c' WHEN s LIKE '%ddos%' OR s LIKE '%dos%' THEN 'ddos'
 WHEN s LIKE '%scan%' THEN 'scanning' WHEN s LIKE '%download%' THEN 'filedownload' WHEN s LIKE '%attack%' THEN 'attack' ELSE s END"""
# Labels with a benign class, as the full scenario statistics use them.
table("named_flows", "SELECT *, CASE WHEN label = 'benign' THEN 'benign' ELSE detailed_label END AS kind FROM flows")
table("scenario_kinds", "SELECT scenario, kind, count(*) AS n, sum(count(*)) OVER (PARTITION BY scenario) AS total FROM named_flows GROUP BY scenario, kind")
table("scenario_stats_v2", """
SELECT scenario, sum(n)::BIGINT AS total_flows, (sum(n) FILTER (WHERE kind = 'benign'))::BIGINT AS benign_flows, (sum(n) FILTER (WHERE kind <> 'benign'))::BIGINT AS malicious_flows,
 count(*) AS num_unique_labels, count(*) FILTER (WHERE kind <> 'benign') AS num_attack_types, first(kind ORDER BY n DESC, kind) FILTER (WHERE kind <> 'benign') AS dominant_attack_type, max(n) FILTER (WHERE kind <> 'benign') AS dominant_attack_type_count,
 (sum(n) FILTER (WHERE kind = 'benign'))::DOUBLE / sum(n) AS benign_ratio, (sum(n) FILTER (WHERE kind <> 'benign'))::DOUBLE / sum(n) AS malicious_ratio, (max(n) FILTER (WHERE kind <> 'benign'))::DOUBLE / sum(n) AS dominant_attack_type_ratio_within_scenario
FROM scenario_kinds GROUP BY scenario""")


def named_flows(spark, sf):
    return flows(spark, sf).withColumn("kind", F.when(F.col("label") == "benign", "benign").otherwise(F.col("detailed_label")))


@query("a11_scenario_stats", "SELECT * REPLACE (round(benign_ratio, 6) AS benign_ratio, round(malicious_ratio, 6) AS malicious_ratio, round(dominant_attack_type_ratio_within_scenario, 6) AS dominant_attack_type_ratio_within_scenario) FROM scenario_stats_v2")
def a11(spark, sf):
    out = P.scenario_stats(named_flows(spark, sf), "kind")
    return out.withColumns({c: F.round(c, 6) for c in ("benign_ratio", "malicious_ratio", "dominant_attack_type_ratio_within_scenario")})


@query("a12_attack_type_counts", f"SELECT scenario, kind AS label, {_FAMILY.replace(' s ', ' kind ').replace('ELSE s END', 'ELSE kind END')} AS attack_family, n AS flow_count, round(n::DOUBLE / total, 6) AS ratio_within_scenario FROM scenario_kinds")
def a12(spark, sf):
    return P.attack_type_counts(named_flows(spark, sf), "kind").withColumn("ratio_within_scenario", F.round("ratio_within_scenario", 6))


@query("a13_global_labels", f"SELECT s AS label, {_FAMILY} AS attack_family, n AS flow_count, round(n::DOUBLE / sum(n) OVER (), 6) AS global_ratio FROM (SELECT kind AS s, sum(n)::BIGINT AS n FROM scenario_kinds GROUP BY kind) k")
def a13(spark, sf):
    return P.global_labels(named_flows(spark, sf), "kind").withColumn("global_ratio", F.round("global_ratio", 6))


_long = " UNION ALL ".join(f"SELECT scenario, '{c}' AS feature, {c} AS value FROM flows" for c in FEATURES)
table("feature_stats", f"""
SELECT scenario, feature, count(value) AS non_null_count, avg(value) AS mean, stddev_pop(value) AS std, min(value) AS min, max(value) AS max, stddev_pop(value) / nullif(abs(avg(value)), 0) AS cv,
 quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q75, quantile_cont(value, 0.95) AS p95 FROM ({_long}) l GROUP BY scenario, feature""")
_fs = ["mean", "std", "cv", "q25", "median", "q75", "p95"]


@query("a14_feature_summary", f"SELECT scenario, feature, non_null_count, min, max, {sql_r6(*_fs)} FROM feature_stats")
def a14(spark, sf):
    return P.feature_summary(flows(spark, sf), FEATURES).select("scenario", "feature", "non_null_count", "min", "max", *r6(*_fs))


_shift = ["mean_of_scenario_means", "scenario_mean_std", "scenario_mean_range", "scenario_mean_iqr", "scenario_median_std", "mean_of_within_scenario_std", "mean_cv_across_scenarios"]


@query("a15_feature_shift", f"""
SELECT feature, n_scenarios_present, {sql_r6(*_shift)} FROM (SELECT *, scenario_mean_std / nullif(abs(mean_of_scenario_means), 0) AS mean_cv_across_scenarios FROM (
 SELECT feature, count(*) AS n_scenarios_present, avg(mean) AS mean_of_scenario_means, stddev_pop(mean) AS scenario_mean_std, max(mean) - min(mean) AS scenario_mean_range, quantile_cont(mean, 0.75) - quantile_cont(mean, 0.25) AS scenario_mean_iqr,
 stddev_pop(median) AS scenario_median_std, avg(std) AS mean_of_within_scenario_std FROM feature_stats GROUP BY feature) a) b""")
def a15(spark, sf):
    return P.feature_shift(P.feature_summary(flows(spark, sf), FEATURES)).select("feature", "n_scenarios_present", *r6(*_shift))


_ls = ["mean_ratio_across_scenarios", "std_ratio_across_scenarios", "cv_ratio_across_scenarios", "max_ratio", "min_ratio", "range_ratio"]


@query("a16_label_shift", f"""
WITH grid AS (SELECT s.scenario, l.kind, coalesce(k.n::DOUBLE / k.total, 0) AS r FROM (SELECT DISTINCT scenario FROM scenario_kinds) s CROSS JOIN (SELECT DISTINCT kind FROM scenario_kinds) l LEFT JOIN scenario_kinds k ON k.scenario = s.scenario AND k.kind = l.kind)
SELECT s AS label, {_FAMILY} AS attack_family, {sql_r6(*_ls)} FROM (SELECT kind AS s, avg(r) AS mean_ratio_across_scenarios, stddev_pop(r) AS std_ratio_across_scenarios, stddev_pop(r) / nullif(abs(avg(r)), 0) AS cv_ratio_across_scenarios, max(r) AS max_ratio, min(r) AS min_ratio, max(r) - min(r) AS range_ratio FROM grid GROUP BY kind) g""")
def a16(spark, sf):
    return P.label_shift(named_flows(spark, sf), "kind").select("label", "attack_family", *r6(*_ls))


@query("a17_dataset_summary", """
SELECT count(*) AS n_scenarios, sum(total_flows)::BIGINT AS total_flows, sum(benign_flows)::BIGINT AS total_benign, sum(malicious_flows)::BIGINT AS total_malicious, max(total_flows) AS max_scenario_flows, min(total_flows) AS min_scenario_flows,
 round(avg(malicious_ratio), 6) AS mean_malicious_ratio, round(stddev_pop(malicious_ratio), 6) AS std_malicious_ratio FROM scenario_stats_v2""")
def a17(spark, sf):
    out = P.dataset_summary(P.scenario_stats(named_flows(spark, sf), "kind"))
    return out.withColumns({c: F.round(c, 6) for c in ("mean_malicious_ratio", "std_malicious_ratio")})


def unsw_split(spark, sf):
    """The second domain with a train and test part by id."""
    return unsw_like(spark, sf).withColumn("split", F.when(F.col("id") % 10 < 7, "train").otherwise("test"))


table("unsw_split", "SELECT *, CASE WHEN id % 10 < 7 THEN 'train' ELSE 'test' END AS split FROM unsw_like")
table("unsw_groups", " UNION ALL ".join(f"SELECT '{c}' AS grouping, trim(coalesce(CAST({c} AS VARCHAR), 'missing')) AS group_value, split, count(*) AS n_rows, sum(label)::BIGINT AS n_attack, count(*) - sum(label)::BIGINT AS n_benign FROM unsw_split GROUP BY ALL" for c in ("proto", "service")))


@query("a18_group_counts", "SELECT grouping, group_value, split, n_rows, n_attack, n_benign FROM unsw_groups")
def a18(spark, sf):
    return P.group_counts(unsw_split(spark, sf), ["proto", "service"])


@query("a19_class_counts", """
SELECT scenario, b AS n_benign, a AS n_attack, round(CASE WHEN a = 0 THEN 1.0::DOUBLE ELSE greatest(b::DOUBLE / a, 1e-6) END, 6) AS scale_pos_weight, b > 0 AND a > 0 AS has_both_classes
FROM (SELECT scenario, count(*) FILTER (WHERE label_binary = 0) AS b, count(*) FILTER (WHERE label_binary = 1) AS a FROM flows GROUP BY scenario) c""")
def a19(spark, sf):
    return P.class_counts(flows(spark, sf), ["scenario"]).withColumn("scale_pos_weight", F.round("scale_pos_weight", 6))


_unsw_kinds = {c: t for c, t in (f.split() for f in UNSW_LIKE_SCHEMA.split(", "))}


@query("a20_inspect", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", '{t}' AS dtype, count(*) FILTER (WHERE {c} IS NULL) AS n_null FROM unsw_like" for c, t in _unsw_kinds.items()))
def a20(spark, sf):
    rows = unsw_like(spark, sf)
    return P.inspect(rows.select(*[F.col(c).cast(t).alias(c) for c, t in _unsw_kinds.items()]))


@query("a20_label_counts", "SELECT attack_cat, label, count(*) AS n_rows FROM unsw_like GROUP BY attack_cat, label")
def a20_labels(spark, sf):
    return P.label_counts(unsw_like(spark, sf), ["attack_cat", "label"])


_fa = ["accuracy", "f1_macro", "recall_attack"]


def _fold_sql(std):
    stats = ", ".join(f"round(avg({m}), 6) AS mean_{m}, round({std}({m}), 6) AS std_{m}" for m in _fa)
    return f"SELECT count(*) AS n_folds, {stats}, first(scenario ORDER BY f1_macro DESC, scenario) AS best_fold, first(scenario ORDER BY f1_macro, scenario) AS worst_fold, {', '.join(f'sum({c})::BIGINT AS {c}' for c in M.CELLS)} FROM folds"


def _fold_agg(spark, sf, ddof):
    return R.fold_aggregate(folds(spark, sf), _fa, ddof).withColumns({f"{p}_{m}": F.round(f"{p}_{m}", 6) for p in ("mean", "std") for m in _fa})


@query("a21_fold_aggregate_sample", _fold_sql("stddev_samp"))
def a21(spark, sf):
    return _fold_agg(spark, sf, 1)


@query("a21_fold_aggregate_population", _fold_sql("stddev_pop"))
def a21_population(spark, sf):
    return _fold_agg(spark, sf, 0)


table("fold_words", """
SELECT *, n_attack::DOUBLE / n_rows AS attack_ratio, 1.0 - recall_attack AS fnr_attack, 1.0 - recall_benign AS fpr_benign, (n_benign = 0 OR n_attack = 0) AS single_class_test, CASE WHEN n_attack::DOUBLE / n_rows > 0.5 THEN 'attack' ELSE 'benign' END AS dominant_class,
 CASE WHEN f1_macro IS NULL THEN 'unknown' WHEN f1_macro >= 0.90 THEN 'excellent' WHEN f1_macro >= 0.75 THEN 'strong' WHEN f1_macro >= 0.55 THEN 'unstable' WHEN accuracy >= 0.95 AND n_attack <= 1 THEN 'trivial_or_single_class' ELSE 'failure' END AS category FROM folds""")
_fw = ["f1_macro", "recall_attack", "recall_benign"]
_words = ["excellent", "strong", "unstable", "trivial_or_single_class", "failure", "unknown"]


@query("a22_fold_report", f"""
SELECT count(*) AS n_folds, sum(n_rows)::BIGINT AS n_rows_total, count(*) FILTER (WHERE single_class_test) AS single_class_folds, {', '.join(f'round(sum({m} * n_rows) / sum(n_rows), 6) AS weighted_mean_{m}' for m in _fw)},
 {', '.join(f"count(*) FILTER (WHERE category = '{w}') AS n_{w}" for w in _words)}, {', '.join(f'first(scenario ORDER BY {m}, scenario) AS worst_by_{m}' for m in _fw)} FROM fold_words""")
def a22(spark, sf):
    return R.fold_report(fold_category(folds(spark, sf)), _fw).withColumns({f"weighted_mean_{m}": F.round(f"weighted_mean_{m}", 6) for m in _fw})


@query("a23_metric_summary", " UNION ALL ".join(f"SELECT '{m}' AS metric, count({m}) AS n, round(avg({m}), 6) AS mean, round(stddev_samp({m}), 6) AS std, round(min({m}), 6) AS min, round(max({m}), 6) AS max FROM folds" for m in FOLD_METRICS))
def a23(spark, sf):
    return R.summarize_metrics(folds(spark, sf), FOLD_METRICS).select("metric", "n", *r6("mean", "std", "min", "max"))


@query("a24_best_worst", "(SELECT 'best' AS which, scenario, round(f1_macro, 6) AS f1_macro FROM folds ORDER BY folds.f1_macro DESC, scenario LIMIT 1) UNION ALL (SELECT 'worst', scenario, round(f1_macro, 6) FROM folds ORDER BY folds.f1_macro, scenario LIMIT 1)")
def a24(spark, sf):
    return R.best_worst(folds(spark, sf).select("scenario", "f1_macro"), "f1_macro", "scenario").withColumn("f1_macro", F.round("f1_macro", 6))


_ss = ["f1_macro", "f1_attack"]


@query("a25_seed_stability", f"SELECT direction, model, fraction, count(DISTINCT seed) AS n_seeds, {', '.join(f'round({f}({m}), 6) AS {m}_{s}' for m in _ss for s, f in (('mean', 'avg'), ('std', 'stddev_samp'), ('min', 'min'), ('max', 'max')))} FROM runs GROUP BY direction, model, fraction")
def a25(spark, sf):
    out = R.seed_stability(runs(spark, sf), ["direction", "model", "fraction"], _ss)
    return out.select("direction", "model", "fraction", "n_seeds", *r6(*[c for c in out.columns if c.startswith("f1_")]))


_g7 = ", ".join(f"t.{m} AS target_only_{m}, x.{m} AS transfer_{m}, s.{m} AS source_only_{m}, x.{m} - t.{m} AS gain_{m}, x.{m} - s.{m} AS delta_vs_source_{m}, t.{m} - s.{m} AS target_minus_source_{m}" for m in METRICS)
table("gains", f"""
SELECT t.pair_id, t.pair_family, t.source_domain_id, t.target_test_domain_id, t.seed, t.target_fraction, {_g7}, abs(m.source_attack_rate - m.target_attack_rate) AS abs_attack_rate_gap, x.f1_attack - t.f1_attack AS primary_gain,
 CASE WHEN x.f1_attack - t.f1_attack > 0.01::DOUBLE THEN 'positive' WHEN x.f1_attack - t.f1_attack < -0.01::DOUBLE THEN 'negative' ELSE 'neutral' END AS transfer_label
FROM (SELECT * FROM pair_runs WHERE condition = 'target_only_updated') t JOIN (SELECT * FROM pair_runs WHERE condition = 'transfer_learning_updated') x ON t.pair_id = x.pair_id AND t.seed = x.seed AND t.target_fraction = x.target_fraction
LEFT JOIN (SELECT * FROM pair_runs WHERE condition = 'source_only') s ON t.pair_id = s.pair_id AND t.seed = s.seed LEFT JOIN pairs_meta m ON m.pair_id = t.pair_id""")


def gains(spark, sf):
    """Gain table with pair metadata and outcome words."""
    from flowlab.operators.joins import attach_pairs

    out = attach_pairs(gain_table(pair_runs(spark, sf), METRICS), pairs_meta(spark, sf))
    return out.withColumn("primary_gain", F.col("gain_f1_attack")).withColumn("transfer_label", transfer_label(F.col("primary_gain"), 0.01))


_gs = ["mean_primary_gain", "median_primary_gain", "min_primary_gain", "max_primary_gain", "mean_source_only_f1_attack", "mean_target_only_f1_attack", "mean_transfer_f1_attack", "positive_rate", "negative_rate"]


def _gain_sql(by):
    return f"""SELECT {by}, n_runs, n_pairs, n_seeds, positive_transfer, negative_transfer, neutral_transfer, fractions_seen, positive_transfer - negative_transfer AS net_positive_minus_negative, {sql_r6(*_gs)} FROM (SELECT *, positive_transfer::DOUBLE / n_runs AS positive_rate, negative_transfer::DOUBLE / n_runs AS negative_rate FROM (
 SELECT {by}, count(*) AS n_runs, count(DISTINCT pair_id) AS n_pairs, count(DISTINCT seed) AS n_seeds, count(*) FILTER (WHERE transfer_label = 'positive') AS positive_transfer, count(*) FILTER (WHERE transfer_label = 'negative') AS negative_transfer, count(*) FILTER (WHERE transfer_label = 'neutral') AS neutral_transfer,
 avg(primary_gain) AS mean_primary_gain, quantile_cont(primary_gain, 0.5) AS median_primary_gain, min(primary_gain) AS min_primary_gain, max(primary_gain) AS max_primary_gain, avg(source_only_f1_attack) AS mean_source_only_f1_attack, avg(target_only_f1_attack) AS mean_target_only_f1_attack, avg(transfer_f1_attack) AS mean_transfer_f1_attack,
 string_agg(DISTINCT CAST(target_fraction AS VARCHAR), '|' ORDER BY CAST(target_fraction AS VARCHAR)) AS fractions_seen FROM gains GROUP BY {by}) a) b"""


def _gain_query(name, by):
    @query(name, _gain_sql(", ".join(by)))
    def run(spark, sf):
        out = R.gain_summary(gains(spark, sf), by)
        return out.withColumns({c: F.round(c, 6) for c in _gs})

    return run


_gain_query("a26_gain_by_fraction", ["target_fraction"])
_gain_query("a26_gain_by_pair", ["pair_id", "pair_family"])
_gain_query("a26_gain_by_direction", ["pair_family"])
_gain_query("a26_gain_by_direction_fraction", ["pair_family", "target_fraction"])


@query("a26_gain_by_metric_fraction", " UNION ALL ".join(f"SELECT '{m}' AS metric, target_fraction, count(*) AS n_runs, round(avg(gain_{m}), 6) AS mean_gain, round(quantile_cont(gain_{m}, 0.5), 6) AS median_gain, round(max(gain_{m}), 6) AS max_gain, round(min(gain_{m}), 6) AS min_gain FROM gains GROUP BY target_fraction" for m in METRICS))
def a26_metric(spark, sf):
    return R.metric_gains(gains(spark, sf), METRICS, ["target_fraction"]).select("metric", "target_fraction", "n_runs", *r6("mean_gain", "median_gain", "max_gain", "min_gain"))


@query("a27_scenario_variability", f"SELECT model, fraction, count(*) AS n_scenarios, round(avg(f1_attack), 6) AS mean, round(stddev_samp(f1_attack), 6) AS std, round(min(f1_attack), 6) AS min, round(max(f1_attack), 6) AS max FROM ({sql_metrics('SELECT * FROM run_cells')}) m GROUP BY model, fraction")
def a27(spark, sf):
    out = R.variability(M.metrics_present(run_cells(spark, sf)), ["model", "fraction"])
    return out.select("model", "fraction", "n_scenarios", *r6("mean", "std", "min", "max"))


_pv = ["f1_macro", "f1_attack", "recall_attack", "accuracy"]
_conds = ["target_only_updated", "transfer_learning_updated"]


@query("a28_pivot_conditions", f"""SELECT direction, target_fraction, {', '.join(f"round(avg({m}) FILTER (WHERE condition = '{c}'), 6) AS {m}_{c}" for m in _pv for c in _conds)} FROM final_runs GROUP BY direction, target_fraction""")
def a28(spark, sf):
    out = R.pivot_metrics(final_runs(spark, sf), ["direction", "target_fraction"], "condition", _conds, _pv)
    return out.select("direction", "target_fraction", *r6(*out.columns[2:]))


@query("a28_pivot_scenario_fraction", f"""SELECT scenario, {', '.join(f"round(avg(f1_attack) FILTER (WHERE fraction = {f}::DOUBLE), 6) AS f1_at_{i}" for i, f in enumerate(FRACTIONS))} FROM ({sql_metrics('SELECT * FROM run_cells')}) m GROUP BY scenario""")
def a28_matrix(spark, sf):
    out = R.pivot_metrics(M.metrics_present(run_cells(spark, sf)), ["scenario"], "fraction", FRACTIONS, ["f1_attack"])
    return out.select("scenario", *[F.round(F.col(f"`f1_attack_{f}`"), 6).alias(f"f1_at_{i}") for i, f in enumerate(FRACTIONS)])


_brands = [f"{m}{n}" for m in range(1, 6) for n in range(1, 6)]


@query("a28_pivot_label_scenario", "SELECT kind, " + ", ".join(f"count(*) FILTER (WHERE scenario = 'CTU-Cap-{i:02d}') AS n_{i:02d}" for i in range(12)) + " FROM named_flows GROUP BY kind")
def a28_labels(spark, sf):
    out = R.pivot_counts(named_flows(spark, sf), ["kind"], "scenario", [f"CTU-Cap-{i:02d}" for i in range(12)])
    return out.select("kind", *[F.col(f"`n_CTU-Cap-{i:02d}`").alias(f"n_{i:02d}") for i in range(12)])


@query("a28_pivot_category_fraction", "SELECT attack_cat, " + ", ".join(f"count(*) FILTER (WHERE id % 10 < {10 * f}) AS n_at_{i}" for i, f in enumerate(FRACTIONS)) + " FROM unsw_like GROUP BY attack_cat")
def a28_categories(spark, sf):
    rows = unsw_like(spark, sf)
    reached = F.filter(F.array(*map(F.lit, FRACTIONS)), lambda f: F.col("id") % 10 < 10 * f)
    out = R.pivot_counts(rows.select("attack_cat", F.explode_outer(reached).alias("fraction")), ["attack_cat"], "fraction", FRACTIONS)
    return out.select("attack_cat", *[F.col(f"`n_{f}`").alias(f"n_at_{i}") for i, f in enumerate(FRACTIONS)])


@query("a28_pivot_feature_run", "SELECT feature, " + ", ".join(f"round(avg(importance) FILTER (WHERE fold_name = 'Brand#{b}'), 6) AS importance_{b}" for b in _brands) + " FROM importances GROUP BY feature")
def a28_features(spark, sf):
    out = R.pivot_metrics(importances(spark, sf), ["feature"], "fold_name", [f"Brand#{b}" for b in _brands], ["importance"])
    return out.select("feature", *[F.round(F.col(f"`importance_Brand#{b}`"), 6).alias(f"importance_{b}") for b in _brands])


@query("a29_key_findings", """
SELECT direction, round(max(a), 6) AS best_target_only_macro_f1, round(max(b), 6) AS best_transfer_macro_f1, round(max(b - a), 6) AS best_macro_f1_gain_vs_target_only,
 coalesce(string_agg(CAST(target_fraction AS VARCHAR), ',' ORDER BY target_fraction) FILTER (WHERE b - a > 0.005::DOUBLE), 'none') AS target_fractions_with_positive_macro_f1_gain,
 CASE WHEN count(*) FILTER (WHERE b - a > 0.005::DOUBLE) > 0 THEN 'transfer helps under limited target data' ELSE 'transfer does not meaningfully improve target-only' END AS overall_interpretation
FROM (SELECT direction, target_fraction, avg(f1_macro) FILTER (WHERE condition = 'target_only_updated') AS a, avg(f1_macro) FILTER (WHERE condition = 'transfer_learning_updated') AS b FROM final_runs GROUP BY ALL) w GROUP BY direction""")
def a29(spark, sf):
    out = R.key_findings(final_runs(spark, sf))
    return out.withColumns({c: F.round(c, 6) for c in ("best_target_only_macro_f1", "best_transfer_macro_f1", "best_macro_f1_gain_vs_target_only")})


@query("a30_low_fraction", "SELECT direction, model, count(*) AS n_fractions, round(avg(f1_macro), 6) AS mean_f1_macro, round(avg(recall_attack), 6) AS mean_recall_attack FROM runs WHERE fraction <= 0.2::DOUBLE GROUP BY direction, model")
def a30(spark, sf):
    return R.low_fraction(runs(spark, sf), ["direction", "model"], ["f1_macro", "recall_attack"]).select("direction", "model", "n_fractions", *r6("mean_f1_macro", "mean_recall_attack"))


@query("a31_run_notes", "SELECT DISTINCT direction, model, rows_evaluated FROM runs")
def a31(spark, sf):
    return R.run_notes(runs(spark, sf), ["direction", "model", "rows_evaluated"])


@query("a32_grid_signature", "SELECT direction, model, seed, count(DISTINCT fraction) AS fraction_count, max(fraction) AS max_fraction, min(fraction) AS min_fraction, max(rows_evaluated) AS signature_rows_evaluated FROM runs GROUP BY direction, model, seed")
def a32(spark, sf):
    return R.grid_signature(runs(spark, sf), ["direction", "model", "seed"], ["rows_evaluated"])


