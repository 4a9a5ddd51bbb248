"""Queries for joins, alignment, domains, validation and run bookkeeping."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlab.operators import align as A
from flowlab.operators import checks as V
from flowlab.operators import domains as K
from flowlab.operators import joins as J
from flowlab.operators import profile as P
from flowlab.operators import runs as R
from flowlab.operators import sampling as H
from flowlab.operators.prefix import first_tp, latency
from flowlab.operators.profile import one_row
from flowlab.operators.stability import compatibility, importance_summary
from flowlab.plans.adapters import FRACTIONS, METRICS, SQL_SPLIT, flows, importances, importances_b, pair_runs, pairs_meta, preds, r6, runs, sql_r6, unsw_like
from flowlab.plans.audits import FOLD_METRICS, final_runs, folds, folds_b, gains, named_flows, unsw_split
from flowlab.plans.drift import _summary_sql
from flowlab.plans.registry import query, table
from flowlab.plans.scoring import _rare
from flowlab.schemas import METRICS as ALL7
from flowlab.session import settle


@query("j01_difficulty_join", "SELECT s.scenario, total_flows, num_attack_types, round(malicious_ratio, 6) AS malicious_ratio, round(1.0 - f1_macro, 6) AS difficulty FROM scenario_stats_v2 s JOIN folds f ON s.scenario = f.scenario")
def j01(spark, sf):
    out = J.difficulty_join(P.scenario_stats(named_flows(spark, sf), "kind"), folds(spark, sf))
    return out.select("scenario", "total_flows", "num_attack_types", *r6("malicious_ratio", "difficulty"))


@query("j02_with_first_tp", f"WITH {_rare} SELECT f.scenario, n_rows, round(f1_macro, 6) AS f1_macro, first_true_positive_fraction FROM folds f LEFT JOIN (SELECT scenario, min(fraction) FILTER (WHERE prefix_has_true_positive) AS first_true_positive_fraction FROM latency_table GROUP BY scenario) t ON f.scenario = t.scenario")
def j02(spark, sf):
    rare = preds(spark, sf).withColumn("y_pred", (F.col("score_milli") >= 1390).cast("int"))
    first = first_tp(latency(rare, FRACTIONS, ["scenario"], ["ts", "row_id"]), ["scenario"])
    return J.with_first_tp(folds(spark, sf), first).select("scenario", "n_rows", *r6("f1_macro"), "first_true_positive_fraction")


_ci = ["importance_a", "importance_b", "common_importance", "importance_gap"]


@query("j03_compare_importance", f"SELECT feature, {sql_r6(*_ci)} FROM (SELECT *, least(importance_a, importance_b) AS common_importance, abs(importance_a - importance_b) AS importance_gap FROM (SELECT coalesce(a.feature, b.feature) AS feature, coalesce(a.mean_importance, 0) AS importance_a, coalesce(b.mean_importance, 0) AS importance_b FROM ({_summary_sql('importances')}) a FULL JOIN ({_summary_sql('importances_b')}) b ON a.feature = b.feature) j) k")
def j03(spark, sf):
    out = J.compare_importance(importance_summary(importances(spark, sf)), importance_summary(importances_b(spark, sf)))
    return out.select("feature", *r6(*_ci))


_cm = [c for m in FOLD_METRICS for c in (f"{m}_rf", f"{m}_xgb", f"{m}_delta")]


@query("j04_compare_models", f"SELECT a.scenario, {', '.join(f'round(a.{m}, 6) AS {m}_rf, round(b.{m}, 6) AS {m}_xgb, round(a.{m} - b.{m}, 6) AS {m}_delta' for m in FOLD_METRICS)} FROM folds a JOIN folds_b b ON a.scenario = b.scenario")
def j04(spark, sf):
    return J.compare_models(folds(spark, sf), folds_b(spark, sf), "scenario", FOLD_METRICS).select("scenario", *r6(*_cm))


_g = [f"{p}_{m}" for m in ALL7 for p in ("gain", "delta_vs_source", "target_minus_source")]


@query("j05_gain_table", f"SELECT pair_id, pair_family, source_domain_id, target_test_domain_id, seed, target_fraction, {sql_r6(*_g)} FROM gains")
def j05(spark, sf):
    return J.gain_table(pair_runs(spark, sf), METRICS).select(*J.RUN_KEYS, *r6(*_g))


_gv = ["macro_f1_gain_vs_target_only", "attack_f1_gain_vs_target_only", "attack_recall_gain_vs_target_only", "accuracy_gain_vs_target_only"]


@query("j06_gain_vs_target", """
SELECT x.direction, x.target_fraction, round(x.f1_macro - t.f1_macro, 6) AS macro_f1_gain_vs_target_only, round(x.f1_attack - t.f1_attack, 6) AS attack_f1_gain_vs_target_only, round(x.recall_attack - t.recall_attack, 6) AS attack_recall_gain_vs_target_only, round(x.accuracy - t.accuracy, 6) AS accuracy_gain_vs_target_only
FROM final_runs x LEFT JOIN final_runs t ON x.direction = t.direction AND x.target_fraction = t.target_fraction AND t.condition = 'target_only_updated' WHERE x.condition = 'transfer_learning_updated'""")
def j06(spark, sf):
    return J.gain_vs_target(final_runs(spark, sf)).select("direction", "target_fraction", *r6(*_gv))


_slug = "trim(regexp_replace(lower(trim({})), '[^a-z0-9]+', '_', 'g'), '_')"
table("iot_registry", f"""
SELECT concat('iot23__scenario__', split, '__', {_slug.format('scenario')}) AS domain_id, 'iot23' AS dataset, 'scenario' AS grouping, scenario AS group_value, {_slug.format('scenario')} AS group_slug, 'other' AS domain_family, split, n_rows, n_benign, n_attack, n_attack::DOUBLE / n_rows AS attack_rate,
 '{{"dataset":"iot23","filters":[{{"column":"scenario","op":"eq","value":"' || scenario || '"}}],"path":"' || split || '"}}' AS filter_json
FROM (SELECT scenario, min(split) AS split, count(*) AS n_rows, count(*) FILTER (WHERE label_binary = 0) AS n_benign, count(*) FILTER (WHERE label_binary = 1) AS n_attack FROM flows GROUP BY scenario) s WHERE n_rows >= 50 AND n_attack >= 10 AND n_benign >= 10""")
table("group_members", """
SELECT 'all_train_mixed' AS mix, * FROM iot_registry WHERE split = 'train' UNION ALL SELECT 'moderate_attack_mix', * FROM iot_registry WHERE split = 'train' AND attack_rate <= 0.61
UNION ALL SELECT 'benign_rich_mix', * FROM (SELECT * FROM iot_registry WHERE split = 'train' ORDER BY n_benign DESC, group_value LIMIT 5) r""")
table("group_registry", """
SELECT concat('iot23__source_group__train__', mix) AS domain_id, 'iot23' AS dataset, 'source_group' AS grouping, mix AS group_value, mix AS group_slug, 'iot_source_group' AS domain_family, 'train' AS split, sum(n_rows)::BIGINT AS n_rows, sum(n_benign)::BIGINT AS n_benign, sum(n_attack)::BIGINT AS n_attack, sum(n_attack)::DOUBLE / sum(n_rows) AS attack_rate,
 '{"dataset":"iot23","filters":[{"column":"scenario","op":"in","values":[' || string_agg('"' || group_value || '"', ',' ORDER BY group_value) || ']}],"path":"train"}' AS filter_json FROM group_members GROUP BY mix""")
table("unsw_registry", f"""
SELECT concat('unsw__', grouping, '__', split, '__', {_slug.format('group_value')}) AS domain_id, 'unsw' AS dataset, grouping, group_value, {_slug.format('group_value')} AS group_slug, grouping AS domain_family, split, n_rows, n_benign, n_attack, n_attack::DOUBLE / n_rows AS attack_rate,
 '{{"dataset":"unsw","filters":[{{"column":"' || grouping || '","op":"eq","value":"' || group_value || '"}}],"path":"' || split || '"}}' AS filter_json
FROM unsw_groups WHERE n_rows >= 50 AND n_attack >= 10 AND n_benign >= 10 QUALIFY row_number() OVER (PARTITION BY grouping, split ORDER BY n_rows DESC, group_value) <= 3""")
table("registry", "SELECT * FROM iot_registry UNION ALL SELECT * FROM group_registry UNION ALL SELECT * FROM unsw_registry")
table("domain_pairs", """
SELECT concat(s.domain_id, '__TO__', t.domain_id) AS pair_id, concat(s.dataset, '_to_', t.dataset) AS pair_family, s.domain_id AS source_domain_id, t.domain_id AS target_domain_id, s.n_rows AS source_n_rows, t.n_rows AS target_n_rows, s.attack_rate AS source_attack_rate, t.attack_rate AS target_attack_rate
FROM registry s JOIN registry t ON s.dataset <> t.dataset WHERE s.split = 'train' AND (s.dataset = 'unsw' OR s.grouping = 'source_group') AND ((t.dataset = 'iot23' AND t.grouping = 'scenario' AND t.split IN ('val', 'test')) OR (t.dataset = 'unsw' AND t.split = 'test'))""")
_reg = ["domain_id", "dataset", "grouping", "group_value", "group_slug", "domain_family", "split", "n_rows", "n_benign", "n_attack"]


def iot_registry(spark, sf):
    return K.iot_domains(P.scenario_summary(flows(spark, sf)), 50, 10, 10)


def registry(spark, sf):
    """Scenario domains, source groups and second-domain groups in one table."""
    from flowlab.session import settle

    iot = settle(iot_registry(spark, sf))
    unsw = K.unsw_domains(P.group_counts(unsw_split(spark, sf), ["proto", "service"]), 50, 10, 10, 3)
    return settle(iot.unionByName(K.source_groups(iot, 0.61)).unionByName(unsw))


@query("j07_domain_pairs", f"SELECT pair_id, pair_family, source_domain_id, target_domain_id, source_n_rows, target_n_rows, {sql_r6('source_attack_rate', 'target_attack_rate')} FROM domain_pairs")
def j07(spark, sf):
    out = K.domain_pairs(registry(spark, sf))
    return out.select("pair_id", "pair_family", "source_domain_id", "target_domain_id", "source_n_rows", "target_n_rows", *r6("source_attack_rate", "target_attack_rate"))


@query("j08_attach_pairs", "SELECT r.pair_id, seed, condition, target_fraction, round(source_attack_rate, 6) AS source_attack_rate, round(target_attack_rate, 6) AS target_attack_rate, round(source_attack_rate - target_attack_rate, 6) AS attack_rate_gap, round(abs(source_attack_rate - target_attack_rate), 6) AS abs_attack_rate_gap FROM pair_runs r LEFT JOIN pairs_meta m ON r.pair_id = m.pair_id AND r.pair_family = m.pair_family")
def j08(spark, sf):
    out = J.attach_pairs(pair_runs(spark, sf), pairs_meta(spark, sf))
    return out.select("pair_id", "seed", "condition", "target_fraction", *r6("source_attack_rate", "target_attack_rate", "attack_rate_gap", "abs_attack_rate_gap"))


@query("j09_semi_join", "SELECT row_id, scenario FROM flows WHERE scenario IN (SELECT scenario FROM folds WHERE f1_macro >= (SELECT avg(f1_macro) FROM folds))")
def j09(spark, sf):
    good = folds(spark, sf)
    mean = one_row(good.agg(F.avg("f1_macro").alias("mean")), ["mean"])["mean"]
    return J.semi(flows(spark, sf), good.where(F.col("f1_macro") >= mean), ["scenario"]).select("row_id", "scenario")


@query("j10_anti_join", "SELECT row_id, scenario FROM flows WHERE row_id NOT IN (SELECT row_id FROM preds WHERE y_pred = 1)")
def j10(spark, sf):
    return J.anti(flows(spark, sf), preds(spark, sf).where("y_pred = 1"), ["row_id"]).select("row_id", "scenario")


# Sensitivity runs: the same grid with other numbers, for two studies.
table("sens_runs", "SELECT study, direction, model, seed, fraction, f1_attack * 0.5 AS f1_attack FROM runs CROSS JOIN (VALUES ('train_size'), ('eval_size')) s(study) WHERE seed <= 3")


def sens_runs(spark, sf):
    base = runs(spark, sf).where("seed <= 3")
    return base.select(F.explode(F.array(F.lit("train_size"), F.lit("eval_size"))).alias("study"), "direction", "model", "seed", "fraction", (F.col("f1_attack") * 0.5).alias("f1_attack"))


@query("j11_matched_comparison", "SELECT study, direction, model, seed, fraction, config_group, round(f1_attack, 6) AS f1_attack FROM (SELECT *, 'sensitivity' AS config_group FROM sens_runs UNION ALL SELECT s.study, r.direction, r.model, r.seed, r.fraction, r.f1_attack, 'baseline' FROM runs r CROSS JOIN (VALUES ('train_size'), ('eval_size')) s(study) WHERE seed <= 3) u")
def j11(spark, sf):
    base = runs(spark, sf).select("direction", "model", "seed", "fraction", "f1_attack")
    return J.matched_comparison(base, sens_runs(spark, sf)).select("study", "direction", "model", "seed", "fraction", "config_group", *r6("f1_attack"))


table("compat", """
SELECT fold_name, rank_spearman, o AS top_3_overlap_count FROM (SELECT fold_name, CASE WHEN stddev_pop(rx) = 0 OR stddev_pop(ry) = 0 THEN NULL ELSE corr(rx, ry) END AS rank_spearman FROM (
 SELECT fold_name, rank() OVER (PARTITION BY fold_name ORDER BY x) + (count(*) OVER (PARTITION BY fold_name, x) - 1) / 2.0::DOUBLE AS rx, rank() OVER (PARTITION BY fold_name ORDER BY y) + (count(*) OVER (PARTITION BY fold_name, y) - 1) / 2.0::DOUBLE AS ry
 FROM (SELECT coalesce(a.fold_name, b.fold_name) AS fold_name, coalesce(a.importance, 0) AS x, coalesce(b.importance, 0) AS y FROM importances a FULL JOIN importances_b b ON a.fold_name = b.fold_name AND a.feature = b.feature) j) r GROUP BY fold_name) s
LEFT JOIN (SELECT fold_name, count(*) FILTER (WHERE a AND b) AS o FROM (SELECT fold_name, feature, bool_or(src = 'a') AS a, bool_or(src = 'b') AS b FROM (
 (SELECT 'a' AS src, fold_name, feature FROM importances QUALIFY row_number() OVER (PARTITION BY fold_name ORDER BY importance DESC, feature) <= 3) UNION ALL
 (SELECT 'b' AS src, fold_name, feature FROM importances_b QUALIFY row_number() OVER (PARTITION BY fold_name ORDER BY importance DESC, feature) <= 3)) t GROUP BY fold_name, feature) m GROUP BY fold_name) k USING (fold_name)""")


@query("j12_with_compatibility", "SELECT g.pair_id, g.seed, g.target_fraction, round(primary_gain, 6) AS primary_gain, round(rank_spearman, 6) AS rank_spearman, top_3_overlap_count FROM gains g LEFT JOIN compat c ON c.fold_name = concat('Brand#', g.seed)")
def j12(spark, sf):
    """Seeds stand for importance folds: fold "Brand#<seed>" belongs to a run's seed."""
    compat = compatibility(importances(spark, sf), importances_b(spark, sf), ["fold_name"])
    compat = compat.select(F.replace("fold_name", F.lit("Brand#"), F.lit("")).cast("int").alias("seed"), "rank_spearman", "top_3_overlap_count")
    return J.with_compat(gains(spark, sf), compat, ["seed"]).select("pair_id", "seed", "target_fraction", *r6("primary_gain", "rank_spearman"), "top_3_overlap_count")


@query("j13_resolve_pool", """
SELECT target_domain_id, resolution, string_agg(domain_id, '|' ORDER BY domain_id) AS train_domain_ids FROM (
 SELECT t.domain_id AS target_domain_id, r.domain_id, CASE WHEN r.grouping = t.grouping AND r.group_value = t.group_value THEN 1 WHEN r.domain_family = t.domain_family THEN 2 ELSE 3 END AS lvl,
  min(CASE WHEN r.grouping = t.grouping AND r.group_value = t.group_value THEN 1 WHEN r.domain_family = t.domain_family THEN 2 ELSE 3 END) OVER (PARTITION BY t.domain_id) AS best,
  CASE min(CASE WHEN r.grouping = t.grouping AND r.group_value = t.group_value THEN 1 WHEN r.domain_family = t.domain_family THEN 2 ELSE 3 END) OVER (PARTITION BY t.domain_id) WHEN 1 THEN 'exact_group_match' WHEN 2 THEN 'family_train_pool' ELSE 'full_train_pool' END AS resolution
 FROM registry t JOIN registry r ON r.dataset = t.dataset AND r.split = 'train' WHERE t.split <> 'train') x WHERE lvl <= best GROUP BY 1, 2""")
def j13(spark, sf):
    reg = registry(spark, sf)
    return J.resolve_pool(reg.where("split <> 'train'"), reg).select("target_domain_id", "resolution", F.array_join("train_domain_ids", "|").alias("train_domain_ids"))


_map1, _map2 = A.mapping("iot23"), A.mapping("unsw")


@query("l01_alignment_coverage", " UNION ALL ".join(f"SELECT '{n}' AS aligned_feature, 'iot23' AS domain, count({c}) AS n_known FROM flows" for c, n in _map1.items()) + " UNION ALL " + " UNION ALL ".join(f"SELECT '{n}', 'unsw', count({c}) FROM unsw_like" for c, n in _map2.items()))
def l01(spark, sf):
    """The accepted alignment rows, with how many values each domain holds for them."""
    accepted = A.accepted_features(A.alignment_table(spark)).select("aligned_feature")
    parts = [A.coverage(df, names).withColumn("domain", F.lit(d)) for df, names, d in ((flows(spark, sf), _map1, "iot23"), (unsw_like(spark, sf), _map2, "unsw"))]
    return parts[0].unionByName(parts[1]).join(accepted, "aligned_feature", "left_semi").select("aligned_feature", "domain", "n_known")


@query("l02_alignment_violations", "SELECT s.col AS \"column\", s.f AS aligned_feature, 'unsw' AS domain, count(*) AS n_rows FROM unsw_like CROSS JOIN (VALUES ('state', 'connection_state')) s(col, f) GROUP BY 1, 2")
def l02(spark, sf):
    """Columns the alignment expects but the given tables lack, with the rows concerned."""
    bad = A.validate_alignment(A.alignment_table(spark), flows(spark, sf), unsw_like(spark, sf))
    n = unsw_like(spark, sf).agg(F.count(F.lit(1)).alias("n_rows")).withColumn("domain", F.lit("unsw"))
    return bad.join(n, "domain").select("column", "aligned_feature", "domain", "n_rows")


_dom = f"{', '.join(_reg)}, round(attack_rate, 6) AS attack_rate, filter_json"


@query("k01_scenario_domains", f"SELECT {_dom} FROM iot_registry")
def k01(spark, sf):
    return iot_registry(spark, sf).withColumn("attack_rate", F.round("attack_rate", 6))


@query("k02_source_groups", f"SELECT {_dom} FROM group_registry")
def k02(spark, sf):
    return K.source_groups(iot_registry(spark, sf), 0.61).withColumn("attack_rate", F.round("attack_rate", 6))


@query("k03_group_domains", f"SELECT {_dom} FROM unsw_registry")
def k03(spark, sf):
    counts = P.group_counts(unsw_split(spark, sf), ["proto", "service"])
    return K.unsw_domains(counts, 50, 10, 10, 3).withColumn("attack_rate", F.round("attack_rate", 6))


table("v01_rows", "SELECT scenario, orig_bytes AS o, nullif(duration, '-') AS duration, nullif(label, '-') AS label FROM flows_raw")


table("pool_caps", """
SELECT domain_id, CASE WHEN cnt = 1 THEN 301 ELSE fl + CASE WHEN row_number() OVER (PARTITION BY grouping, split ORDER BY raw - fl DESC, n_rows DESC, domain_id DESC) <= 301 - sum(fl) OVER (PARTITION BY grouping, split) THEN 1 ELSE 0 END END AS k
FROM (SELECT *, floor(raw) AS fl FROM (SELECT *, 301 * (n_rows::DOUBLE / sum(n_rows) OVER (PARTITION BY grouping, split)) AS raw, count(*) OVER (PARTITION BY grouping, split) AS cnt FROM unsw_registry) a) b""")
table("pool_rows", """
SELECT u.id, u.label, r.domain_id FROM unsw_split u JOIN unsw_registry r ON r.grouping = 'proto' AND r.group_value = trim(u.proto) AND r.split = u.split
UNION ALL SELECT u.id, u.label, r.domain_id FROM unsw_split u JOIN unsw_registry r ON r.grouping = 'service' AND r.group_value = trim(u.service) AND r.split = u.split""")


@query("h13_group_pools", """
SELECT p.domain_id, id, label FROM (SELECT *, row_number() OVER (PARTITION BY domain_id ORDER BY md5(concat(CAST(id AS VARCHAR), ':42'))) AS rn FROM pool_rows) p JOIN pool_caps c ON p.domain_id = c.domain_id WHERE rn <= k""")
def h13_groups(spark, sf):
    """Second-domain pools: one cap per grouping and split, apportioned over its domains, all drawn in one job."""
    rows = settle(unsw_split(spark, sf).select("id", "label", "proto", "service", "split"))
    reg = settle(K.unsw_domains(P.group_counts(rows, ["proto", "service"]), 50, 10, 10, 3))
    caps = H.allocate_caps(reg.withColumn("cap", F.lit(301)), ["grouping", "split"], "n_rows", "cap").select("domain_id", F.col("allocated").alias("k"))
    pools = K.domain_rows(rows, reg, ["proto", "service"])
    return H.load_pool(pools, "domain_id", caps, "id", 42).select("domain_id", "id", "label")


@query("v01_input_contract", """
SELECT * FROM (SELECT 'null_duration' AS violation, count(*) FILTER (WHERE duration IS NULL) AS n_rows FROM v01_rows UNION ALL SELECT 'null_label', count(*) FILTER (WHERE label IS NULL) FROM v01_rows
UNION ALL SELECT 'repeated_key', coalesce(sum(n), 0)::BIGINT FROM (SELECT count(*) AS n FROM v01_rows GROUP BY scenario, o HAVING count(*) > 1) d) v WHERE n_rows > 0""")
def v01(spark, sf):
    from flowlab.functions.clean import null_tokens
    from flowlab.plans.adapters import flows_raw

    rows = null_tokens(flows_raw(spark, sf)).withColumn("o", F.col("orig_bytes"))
    return V.check_contract(rows, ["scenario", "duration", "label"], ["scenario", "duration", "label"], ["scenario", "o"])




@query("v02_domain_checks", "SELECT 'invalid_label_phase' AS violation, count(*) AS n_rows FROM flows WHERE label_phase = 'ddos' UNION ALL SELECT 'other_scenario', count(*) FROM flows WHERE scenario <> 'CTU-Cap-03'")
def v02(spark, sf):
    odd = flows(spark, sf).withColumn("label_phase", F.when(F.col("label_phase") == "ddos", "flood").otherwise(F.col("label_phase")))
    return V.check_flows(odd, "CTU-Cap-03")


@query("v03_split_checks", f"""
WITH leaky AS (SELECT scenario, CASE WHEN scenario = 'CTU-Cap-08' AND row_id % 2 = 0 THEN 'train' ELSE {SQL_SPLIT} END AS split FROM flows WHERE scenario <> 'CTU-Cap-02'), expected AS (SELECT DISTINCT scenario FROM preds WHERE scenario <> 'CTU-Cap-05')
SELECT 'several_splits' AS violation, scenario FROM leaky GROUP BY scenario HAVING count(DISTINCT split) > 1 UNION ALL SELECT 'missing_scenario', scenario FROM expected WHERE scenario NOT IN (SELECT scenario FROM leaky)
UNION ALL SELECT DISTINCT 'unexpected_scenario', scenario FROM leaky WHERE scenario NOT IN (SELECT scenario FROM expected)""")
def v03(spark, sf):
    """Faults are put in on purpose: the flows of one scenario and the expectation of another are left out."""
    f = flows(spark, sf).where("scenario <> 'CTU-Cap-02'")
    leaky = f.withColumn("split", F.when((F.col("scenario") == "CTU-Cap-08") & (F.col("row_id") % 2 == 0), "train").otherwise(F.col("split")))
    return V.check_splits(leaky, preds(spark, sf).where("scenario <> 'CTU-Cap-05'").select("scenario"))


@query("v04_run_matching", "SELECT direction, model, count(DISTINCT seed) AS n_seeds, count(DISTINCT fraction) AS fraction_count, min(fraction) AS min_fraction, max(fraction) AS max_fraction, max(rows_evaluated) AS rows_evaluated FROM runs GROUP BY direction, model")
def v04(spark, sf):
    return V.check_matching(runs(spark, sf), ["direction", "model"], ["rows_evaluated"])


_GRID = "(VALUES ('a_to_b'), ('b_to_a'), ('c_to_d')) d(direction) CROSS JOIN (VALUES ('target_only_updated'), ('transfer_learning_updated')) c(condition) CROSS JOIN (VALUES (0.1::DOUBLE), (0.2::DOUBLE), (0.25::DOUBLE)) f(target_fraction)"


@query("v05_missing_runs", f"SELECT direction, condition, target_fraction, 'missing_from_summary' AS reason FROM {_GRID} WHERE NOT EXISTS (SELECT 1 FROM final_runs r WHERE r.direction = d.direction AND r.condition = c.condition AND r.target_fraction = f.target_fraction)")
def v05(spark, sf):
    keys = ["direction", "condition", "target_fraction"]
    axes = {"direction": ["a_to_b", "b_to_a", "c_to_d"], "condition": ["target_only_updated", "transfer_learning_updated"], "target_fraction": [0.1, 0.2, 0.25]}
    grid = R.run_grid(spark, axes, {"direction": "string", "condition": "string", "target_fraction": "double"})
    return V.missing_runs(final_runs(spark, sf), grid, keys)


@query("r01_plan_runs", "SELECT direction, model, seed, concat('outputs_', direction, '_', model, '_seed', seed) AS run_name FROM (VALUES ('a_to_b'), ('b_to_a')) d(direction) CROSS JOIN (VALUES ('rf'), ('mlp'), ('gbt')) m(model) CROSS JOIN (VALUES (4), (5), (6)) s(seed) WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.direction = d.direction AND r.model = m.model AND r.seed = s.seed)")
def r01(spark, sf):
    axes = {"direction": ["a_to_b", "b_to_a"], "model": ["rf", "mlp", "gbt"], "seed": [4, 5, 6]}
    grid = R.run_grid(spark, axes, {"direction": "string", "model": "string", "seed": "int"})
    return R.plan_runs(grid, runs(spark, sf), ["direction", "model", "seed"])


@query("r01_study_caps", "SELECT study, direction, model, seed, CASE study WHEN 'train_size' THEN 175341 ELSE 100000 END AS source_max_rows, CASE study WHEN 'eval_size' THEN 60000 ELSE 30000 END AS target_max_rows FROM sens_runs WHERE fraction = 1.0::DOUBLE")
def r01_caps(spark, sf):
    full = sens_runs(spark, sf).where("fraction = 1.0D")
    caps = R.study_caps(F.col("study"), F.col("direction"), 100_000, 30_000, {"train_size": (175_341, 30_000), "eval_size": (100_000, 60_000)})
    return full.select("study", "direction", "model", "seed", *caps)


@query("r02_select_best_runs", """
SELECT direction, model, seed, fraction, round(f1_attack, 6) AS f1_attack FROM runs r JOIN (
 SELECT * FROM (SELECT direction AS d, model AS m, seed AS s, count(DISTINCT fraction) AS n, max(fraction) AS mx, min(fraction) AS mn, max(rows_evaluated) AS cap, count(DISTINCT model) OVER () AS nm FROM runs GROUP BY direction, model, seed) g) g
 ON g.d = r.direction AND g.m = r.model AND g.s = r.seed WHERE fraction = 1.0::DOUBLE QUALIFY row_number() OVER (PARTITION BY direction, model ORDER BY r.f1_attack DESC, seed DESC) = 1""")
def r02(spark, sf):
    out = R.select_best_runs(runs(spark, sf), "direction", "model", "seed", ["rows_evaluated"], later="seed")
    return out.select("direction", "model", "seed", "fraction", *r6("f1_attack"))


_fc = ["accuracy", "f1_macro", "f1_attack", "recall_attack", "precision_attack"]


@query("r03_final_comparison", f"SELECT r.direction, r.model, r.fraction, {sql_r6(*_fc, prefix='r.')} FROM runs r JOIN (SELECT direction, model, seed FROM runs WHERE fraction = 1.0::DOUBLE QUALIFY row_number() OVER (PARTITION BY direction, model ORDER BY f1_attack DESC, seed DESC) = 1) b ON r.direction = b.direction AND r.model = b.model AND r.seed = b.seed")
def r03(spark, sf):
    from flowlab.session import settle

    all_runs = settle(runs(spark, sf))
    chosen = R.select_best_runs(all_runs, "direction", "model", "seed", ["rows_evaluated"], later="seed")
    out = R.final_comparison(all_runs, chosen, ["direction", "model", "seed"], ["direction", "model", "fraction", *_fc])
    return out.select("direction", "model", "fraction", *r6(*_fc))


@query("r04_config_rows", "SELECT direction, model, seed, fraction, coalesce(nullif(CASE WHEN direction = 'a_to_b' THEN rows_evaluated ELSE 0 END, 0), nullif(tp + fp, 0)) AS source_train_rows FROM runs")
def r04(spark, sf):
    named = runs(spark, sf).withColumns({"iot_train_rows": F.when(F.col("direction") == "a_to_b", F.col("rows_evaluated")).otherwise(0), "unsw_train_rows": F.col("tp") + F.col("fp")})
    return R.config_rows(named, {"source_train_rows": ["iot_train_rows", "unsw_train_rows"]}).select("direction", "model", "seed", "fraction", "source_train_rows")


@query("r05_pair_skip_table", """
SELECT p.pair_id, CASE WHEN s.n_benign = 0 OR s.n_attack = 0 THEN 'skipped_invalid_source' WHEN t.n_benign = 0 OR t.n_attack < 50 THEN 'skipped_invalid_target_test' ELSE 'valid' END AS condition,
 CASE WHEN s.n_benign = 0 OR s.n_attack = 0 THEN 'source_train_single_class' WHEN t.n_benign = 0 OR t.n_attack < 50 THEN 'target_test_single_class' END AS skip_reason
FROM domain_pairs p JOIN registry s ON s.domain_id = p.source_domain_id JOIN registry t ON t.domain_id = p.target_domain_id""")
def r05(spark, sf):
    """Pools with fewer than 50 attack rows count as one-class here, so that some pairs are skipped."""
    reg = registry(spark, sf)
    sides = reg.select("domain_id", "n_benign", "n_attack")
    pairs = K.domain_pairs(reg).select("pair_id", "source_domain_id", "target_domain_id")

    def side(name, key, attack):
        return sides.select(F.col("domain_id").alias(key), F.col("n_benign").alias(f"{name}_n_benign"), attack.alias(f"{name}_n_attack"))

    few = F.when(F.col("n_attack") < 50, 0).otherwise(F.col("n_attack"))
    pools = pairs.join(side("source", "source_domain_id", F.col("n_attack")), "source_domain_id").join(side("target_test", "target_domain_id", few), "target_domain_id")
    pools = pools.withColumns({"target_train_n_benign": F.col("source_n_benign"), "target_train_n_attack": F.col("source_n_attack")})
    return R.skip_table(pools).select("pair_id", "condition", "skip_reason")


