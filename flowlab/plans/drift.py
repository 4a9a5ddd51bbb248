"""Queries for drift, similarity, stability and seed statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlab.operators import drift as D
from flowlab.operators import profile as P
from flowlab.operators import seeds as S
from flowlab.operators import stability as T
from flowlab.operators.joins import difficulty_join
from flowlab.operators.ranking import curve_auc, normalize_share
from flowlab.operators.stability import compatibility
from flowlab.plans.adapters import METRICS, flows, importances, importances_b, r6, runs, sql_r6
from flowlab.plans.audits import folds, gains, named_flows
from flowlab.plans.registry import query, table
from flowlab.schemas import FEATURES

table("log_profiles", "SELECT scenario, feature, CASE WHEN min(mean) OVER (PARTITION BY feature) >= 0 THEN ln(1 + abs(mean)) ELSE mean END AS value FROM feature_stats")
table("z_profiles", "SELECT scenario, feature, (value - avg(value) OVER (PARTITION BY feature)) / CASE WHEN stddev_pop(value) OVER (PARTITION BY feature) = 0 THEN 1 ELSE stddev_pop(value) OVER (PARTITION BY feature) END AS value FROM log_profiles")


@query("d01_profiles", "SELECT scenario, feature, round(value, 6) AS value FROM z_profiles")
def d01(spark, sf):
    return D.profiles(flows(spark, sf), FEATURES).select("scenario", "feature", *r6("value"))


@query("d01_log_profile", "SELECT scenario, feature, round(value, 6) AS value FROM log_profiles")
def d01_log(spark, sf):
    return D.log_profile(D.feature_means(flows(spark, sf), FEATURES)).select("scenario", "feature", *r6("value"))


def _cos(source, key):
    unit = f"SELECT scenario, {key}, value / greatest(sqrt(sum(value * value) OVER (PARTITION BY scenario)), 1e-12::DOUBLE) AS u FROM ({source}) s"
    return f"SELECT a.scenario AS a, b.scenario AS b, round(sum(a.u * b.u), 6) AS cosine FROM ({unit}) a JOIN ({unit}) b ON a.{key} = b.{key} GROUP BY 1, 2"


@query("d02_cosine_numeric", _cos("SELECT scenario, feature, value FROM z_profiles", "feature"))
def d02(spark, sf):
    return D.cosine_matrix(D.profiles(flows(spark, sf), FEATURES)).select("a", "b", *r6("cosine"))


@query("d02_cosine_labels", _cos("SELECT scenario, kind, n::DOUBLE / total AS value FROM scenario_kinds", "kind"))
def d02_labels(spark, sf):
    profile = D.label_profile(P.attack_type_counts(named_flows(spark, sf), "kind")).withColumnRenamed("ratio", "value")
    return D.cosine_matrix(profile, key="label").select("a", "b", *r6("cosine"))


@query("d03_mean_js", """
WITH grid AS (SELECT s.scenario, l.kind, greatest(coalesce(k.n::DOUBLE / k.total, 0), 1e-12) AS p FROM (SELECT DISTINCT scenario FROM scenario_kinds) s CROSS JOIN (SELECT DISTINCT kind FROM scenario_kinds) l LEFT JOIN scenario_kinds k ON k.scenario = s.scenario AND k.kind = l.kind),
dist AS (SELECT scenario, kind, p / sum(p) OVER (PARTITION BY scenario) AS p FROM grid),
js AS (SELECT a.scenario AS x, b.scenario AS y, 0.5::DOUBLE * sum(a.p * log2(a.p / ((a.p + b.p) / 2))) + 0.5::DOUBLE * sum(b.p * log2(b.p / ((a.p + b.p) / 2))) AS v FROM dist a JOIN dist b ON a.kind = b.kind AND a.scenario < b.scenario GROUP BY 1, 2)
SELECT round(avg(v), 6) AS mean_pairwise_js_divergence, (SELECT count(DISTINCT scenario) FROM grid) AS n_scenarios, (SELECT count(DISTINCT kind) FROM grid) AS n_labels FROM js""")
def d03(spark, sf):
    profile = D.label_profile(P.attack_type_counts(named_flows(spark, sf), "kind"))
    return D.mean_js(profile).select(*r6("mean_pairwise_js_divergence"), "n_scenarios", "n_labels")


@query("d04_label_profile", "SELECT scenario, kind AS label, round(n::DOUBLE / total, 6) AS ratio FROM scenario_kinds")
def d04(spark, sf):
    return D.label_profile(P.attack_type_counts(named_flows(spark, sf), "kind")).select("scenario", "label", *r6("ratio"))


def _ranks(x, y, by):
    return f"""SELECT *, rank() OVER (PARTITION BY {by} ORDER BY {x}) + (count(*) OVER (PARTITION BY {by}, {x}) - 1) / 2.0::DOUBLE AS rx, rank() OVER (PARTITION BY {by} ORDER BY {y}) + (count(*) OVER (PARTITION BY {by}, {y}) - 1) / 2.0::DOUBLE AS ry"""


def _corr(x, y):
    return f"CASE WHEN stddev_pop({x}) = 0 OR stddev_pop({y}) = 0 THEN NULL ELSE corr({x}, {y}) END"


_diff = " UNION ALL ".join(f"SELECT '{v}' AS variable, s.{v}::DOUBLE AS value, 1.0 - f.f1_macro AS difficulty FROM scenario_stats_v2 s JOIN folds f ON s.scenario = f.scenario" for v in D.DIFFICULTY_VARIABLES)


@query("d05_difficulty_correlations", f"SELECT variable, count(*) AS n_rows, round({_corr('rx', 'ry')}, 6) AS spearman_corr_with_difficulty FROM ({_ranks('value', 'difficulty', 'variable')} FROM ({_diff}) l) r GROUP BY variable")
def d05(spark, sf):
    joined = difficulty_join(P.scenario_stats(named_flows(spark, sf), "kind"), folds(spark, sf))
    return D.difficulty_corr(joined).select("variable", "n_rows", *r6("spearman_corr_with_difficulty"))


RUN_PREDICTORS = ["source_only_accuracy", "source_only_f1_macro", "source_only_f1_attack", "target_minus_source_f1_attack", "abs_attack_rate_gap"]
RANK_PREDICTORS = ["pretrain_target_rank_spearman", "adapted_target_rank_spearman", "source_target_rank_spearman", "pretrain_target_top_3_overlap_ratio", "pretrain_target_top_5_overlap_ratio"]
PREDICTORS = RUN_PREDICTORS + RANK_PREDICTORS
#: Importance tables of the three stages stand beside the runs: a run's seed names the fold "Brand#<seed + 10>" of pretraining, + 20 of adaptation, + 30 of the source.
STAGE_FOLDS = {"pretrain": 10, "adapted": 20, "source": 30}
_pl = " UNION ALL ".join(f"SELECT scope, '{p}' AS predictor, {p} AS value, primary_gain FROM scoped WHERE {p} IS NOT NULL" for p in PREDICTORS)
table("compat_stage", f"""
SELECT s.fold_name, round(s.rank_spearman, 9) AS rank_spearman, t.r3 AS top_3_overlap_ratio, t.r5 AS top_5_overlap_ratio FROM compat s LEFT JOIN (
 SELECT fold_name, count(*) FILTER (WHERE ra <= 3 AND rb <= 3) / 3.0::DOUBLE AS r3, count(*) FILTER (WHERE ra <= 5 AND rb <= 5) / 5.0::DOUBLE AS r5
 FROM (SELECT fold_name, feature, row_number() OVER (PARTITION BY fold_name ORDER BY importance DESC, feature) AS ra FROM importances) a
 JOIN (SELECT fold_name, feature, row_number() OVER (PARTITION BY fold_name ORDER BY importance DESC, feature) AS rb FROM importances_b) b USING (fold_name, feature) GROUP BY fold_name) t USING (fold_name)""")
table("stage_gains", """
SELECT g.*, p.rank_spearman AS pretrain_target_rank_spearman, a.rank_spearman AS adapted_target_rank_spearman, s.rank_spearman AS source_target_rank_spearman,
 p.top_3_overlap_ratio AS pretrain_target_top_3_overlap_ratio, p.top_5_overlap_ratio AS pretrain_target_top_5_overlap_ratio FROM gains g
 LEFT JOIN compat_stage p ON p.fold_name = concat('Brand#', g.seed + 10) LEFT JOIN compat_stage a ON a.fold_name = concat('Brand#', g.seed + 20) LEFT JOIN compat_stage s ON s.fold_name = concat('Brand#', g.seed + 30)""")


def stage_gains(spark, sf):
    """Runs beside the compatibility of their three stages: each fold is dealt to its stages' runs, one join attaches them.

    Rank correlations are taken to nine places, so that equal ones stay ties however their sums were rounded.
    """
    compat = compatibility(importances(spark, sf), importances_b(spark, sf), ["fold_name"])
    fold = F.regexp_extract("fold_name", r"(\d+)$", 1).cast("int")
    stages = F.explode(F.array(*[F.struct(F.lit(s).alias("stage"), (fold - shift).alias("seed")) for s, shift in STAGE_FOLDS.items()]))
    measures = ["rank_spearman", "top_3_overlap_ratio", "top_5_overlap_ratio"]
    dealt = compat.withColumn("rank_spearman", F.round("rank_spearman", 9)).select(stages.alias("at"), *measures)
    wide = dealt.groupBy(F.col("at.seed").alias("stage_seed")).agg(
        *[F.max(F.when(F.col("at.stage") == s, F.col(c))).alias(f"{s}_target_{c}") for s in STAGE_FOLDS for c in measures if f"{s}_target_{c}" in RANK_PREDICTORS]
    )
    out = gains(spark, sf)
    return out.join(wide, out["seed"] == wide["stage_seed"], "left").drop("stage_seed")


@query("d06_predictor_correlations", f"""
WITH scoped AS (SELECT 'overall' AS scope, * FROM stage_gains UNION ALL SELECT concat('target_fraction=', CAST(target_fraction AS VARCHAR)) AS scope, * FROM stage_gains)
SELECT scope, predictor, count(*) AS n_runs, round({_corr('value', 'primary_gain')}, 6) AS pearson_corr, round({_corr('rx', 'ry')}, 6) AS spearman_corr, abs(round({_corr('value', 'primary_gain')}, 6)) AS abs_pearson_corr, abs(round({_corr('rx', 'ry')}, 6)) AS abs_spearman_corr
FROM ({_ranks('value', 'primary_gain', 'scope, predictor')} FROM ({_pl}) l) r GROUP BY scope, predictor HAVING count(*) >= 3""")
def d06(spark, sf):
    out = D.predictor_corr(stage_gains(spark, sf), PREDICTORS)
    return out.select("scope", "predictor", "n_runs", *r6("pearson_corr", "spearman_corr", "abs_pearson_corr", "abs_spearman_corr"))


_fsi = ["mean_importance", "std_importance", "min_importance", "max_importance", "mean_rank", "std_rank", "presence_rate", "cv_importance", "feature_stability_index", "transfer_utility", "stability_score_old"]
table("shares", "SELECT fold_name, feature, importance / (sum(importance) OVER (PARTITION BY fold_name) + 1e-12) AS v FROM importances")
table("shares_b", "SELECT fold_name, feature, importance / (sum(importance) OVER (PARTITION BY fold_name) + 1e-12) AS v FROM importances_b")
table("stability", """
SELECT *, mean_importance * feature_stability_index AS transfer_utility, mean_importance / (std_importance + 1e-12) AS stability_score_old FROM (
 SELECT *, presence_rate * (1.0 / (1.0 + cv_importance)) * (1.0 / (1.0 + std_rank)) AS feature_stability_index FROM (SELECT *, std_importance / (mean_importance + 1e-12) AS cv_importance FROM (
  SELECT feature, avg(v) AS mean_importance, coalesce(stddev_samp(v), 0) AS std_importance, min(v) AS min_importance, max(v) AS max_importance, count(v) AS n_folds, avg(rn) AS mean_rank, coalesce(stddev_samp(rn), 0) AS std_rank, avg(CASE WHEN v > 1e-8 THEN 1.0::DOUBLE ELSE 0 END) AS presence_rate
  FROM (SELECT *, rank::DOUBLE / max(rank) OVER (PARTITION BY fold_name) AS rn FROM (SELECT *, row_number() OVER (PARTITION BY fold_name ORDER BY v DESC, feature) AS rank FROM shares) a) b GROUP BY feature) c) d) e""")


@query("d07_feature_stability", f"SELECT feature, n_folds, {sql_r6(*_fsi)} FROM stability")
def d07(spark, sf):
    return T.feature_stability(importances(spark, sf)).select("feature", "n_folds", *r6(*_fsi))


_is = ["mean_importance", "std_importance", "min_importance", "max_importance", "cv_importance", "stability_score"]


def _summary_sql(t):
    return f"SELECT *, std_importance / (mean_importance + 1e-12) AS cv_importance, mean_importance / (std_importance + 1e-12) AS stability_score FROM (SELECT feature, avg(importance) AS mean_importance, coalesce(stddev_samp(importance), 0) AS std_importance, min(importance) AS min_importance, max(importance) AS max_importance, count(*) AS n_folds FROM {t} GROUP BY feature) s"


@query("d08_importance_summary", f"SELECT feature, n_folds, {sql_r6(*_is)} FROM ({_summary_sql('importances')}) i")
def d08(spark, sf):
    return T.importance_summary(importances(spark, sf)).select("feature", "n_folds", *r6(*_is))


table("importance_runs", """
SELECT feature, CASE WHEN CAST(replace(fold_name, 'Brand#', '') AS INT) % 2 = 0 THEN 'a_to_b' ELSE 'b_to_a' END AS direction, model, fold_name AS run, importance FROM (SELECT *, 'rf' AS model FROM importances UNION ALL SELECT *, 'xgb' AS model FROM importances_b) i""")


def importance_runs(spark, sf):
    both = importances(spark, sf).withColumn("model", F.lit("rf")).unionByName(importances_b(spark, sf).withColumn("model", F.lit("xgb")))
    even = F.replace("fold_name", F.lit("Brand#"), F.lit("")).cast("int") % 2 == 0
    return both.select("feature", F.when(even, "a_to_b").otherwise("b_to_a").alias("direction"), "model", F.col("fold_name").alias("run"), "importance")


@query("d09_importance_by_run", "SELECT feature, direction, model, round(avg(importance), 6) AS mean_importance, round(coalesce(stddev_samp(importance), 0), 6) AS std_importance, count(*) AS n_runs FROM importance_runs GROUP BY ALL")
def d09(spark, sf):
    out = T.importance_by_run(importance_runs(spark, sf))
    return out.select("feature", "direction", "model", *r6("mean_importance", "std_importance"), "n_runs")


@query("d10_importance_shift", """
SELECT fold_name, feature, round(p, 6) AS pretrain_importance, round(q, 6) AS adapted_importance, round(abs(q - p), 6) AS absolute_shift
FROM (SELECT coalesce(a.fold_name, b.fold_name) AS fold_name, coalesce(a.feature, b.feature) AS feature, coalesce(a.v, 0) AS p, coalesce(b.v, 0) AS q FROM shares a FULL JOIN shares_b b ON a.fold_name = b.fold_name AND a.feature = b.feature) j
QUALIFY row_number() OVER (PARTITION BY fold_name ORDER BY abs(q - p) DESC, feature) <= 3""")
def d10(spark, sf):
    a, b = (normalize_share(t(spark, sf), ["fold_name"], "importance").select("fold_name", "feature", F.col("importance_norm").alias("importance")) for t in (importances, importances_b))
    return T.importance_shift(a, b, ["fold_name"]).select("fold_name", "feature", *r6("pretrain_importance", "adapted_importance", "absolute_shift"))


_t = "CASE n_seeds - 1 " + " ".join(f"WHEN {i + 1} THEN {t}" for i, t in enumerate(S.T95)) + " ELSE 1.96 END::DOUBLE"


def _ci_sql(source, keys, extra=""):
    return f"""SELECT {keys}, metric, n_seeds{extra}, round(mean, 6) AS mean, round(std, 6) AS std, round(se, 6) AS se, round(mean - {_t} * se, 6) AS ci95_low, round(mean + {_t} * se, 6) AS ci95_high
 FROM (SELECT *, CASE WHEN n_seeds > 1 THEN std / sqrt(n_seeds) ELSE 0 END AS se FROM (SELECT * REPLACE (coalesce(std, 0) AS std) FROM ({source}) a) b) c"""


_long_runs = " UNION ALL ".join(f"SELECT direction, model, seed, fraction, '{m}' AS metric, {m} AS v FROM runs" for m in METRICS)
_stats = ["mean", "std", "se", "ci95_low", "ci95_high"]


@query("d11_seed_intervals", _ci_sql(f"SELECT direction, model, fraction, metric, count(v) AS n_seeds, avg(v) AS mean, stddev_samp(v) AS std FROM ({_long_runs}) l GROUP BY ALL", "direction, model, fraction"))
def d11(spark, sf):
    out = S.seed_ci(runs(spark, sf), ["direction", "model", "fraction"], METRICS)
    return out.select("direction", "model", "fraction", "metric", "n_seeds", *r6(*_stats))


_P = "CASE WHEN positive_seeds + negative_seeds = 0 THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, 2.0::DOUBLE * list_sum([factorial((positive_seeds + negative_seeds)::INT)::DOUBLE / (factorial(k::INT)::DOUBLE * factorial((positive_seeds + negative_seeds - k)::INT)::DOUBLE) FOR k IN range(0, least(positive_seeds, negative_seeds) + 1)]) / pow(2.0::DOUBLE, positive_seeds + negative_seeds)) END"
_DELTA = "count(v) AS n_seeds, avg(v) AS mean, stddev_samp(v) AS std, count(*) FILTER (WHERE v > 0) AS positive_seeds, count(*) FILTER (WHERE v < 0) AS negative_seeds"
_extra = f", positive_seeds, negative_seeds, positive_seeds + negative_seeds AS nonzero_seeds, round({_P}, 6) AS sign_test_pvalue"
_signs = ["positive_seeds", "negative_seeds", "nonzero_seeds"]


@query("d12_paired_fraction_deltas", _ci_sql(f"SELECT direction, fraction, metric, {_DELTA} FROM (SELECT a.direction, a.fraction, a.metric, b.v - a.v AS v FROM ({_long_runs}) a JOIN ({_long_runs}) b ON a.direction = b.direction AND a.fraction = b.fraction AND a.seed = b.seed AND a.metric = b.metric AND a.model = 'rf' AND b.model = 'mlp') d GROUP BY ALL", "direction, fraction", _extra))
def d12(spark, sf):
    out = S.paired_deltas(runs(spark, sf), ["direction", "fraction"], "seed", "model", "rf", "mlp", METRICS)
    return out.select("direction", "fraction", "metric", "n_seeds", *_signs, *r6("sign_test_pvalue", *_stats))


table("curves", """
SELECT direction, model, seed, sum(coalesce((fraction - px) * (f1_attack + p) / 2, 0)) / (max(fraction) - min(fraction)) AS v
FROM (SELECT *, lag(fraction) OVER w AS px, lag(f1_attack) OVER w AS p FROM runs WINDOW w AS (PARTITION BY direction, model, seed ORDER BY fraction)) r GROUP BY direction, model, seed""")
_curve = "auc_f1_attack_normalized"


@query("d12_paired_curve_deltas", _ci_sql(f"""SELECT direction, '{_curve}' AS metric, {_DELTA} FROM (SELECT a.direction, b.v - a.v AS v FROM (SELECT * FROM curves WHERE model = 'rf') a JOIN (SELECT * FROM curves WHERE model = 'mlp') b ON a.direction = b.direction AND a.seed = b.seed) d GROUP BY direction""", "direction", _extra))
def d12_curve(spark, sf):
    curves = curve_auc(runs(spark, sf), ["direction", "model", "seed"], ["f1_attack"])
    out = S.paired_deltas(curves, ["direction"], "seed", "model", "rf", "mlp", [_curve])
    return out.select("direction", "metric", "n_seeds", *_signs, *r6("sign_test_pvalue", *_stats))


@query("d13_sign_test", f"""
SELECT pair_id, target_fraction, positive_seeds, negative_seeds, round({_P}, 6) AS p_value FROM (SELECT pair_id, target_fraction, count(*) FILTER (WHERE primary_gain > 0) AS positive_seeds, count(*) FILTER (WHERE primary_gain < 0) AS negative_seeds FROM gains GROUP BY ALL) g""")
def d13(spark, sf):
    g = F.col("primary_gain")
    counts = gains(spark, sf).groupBy("pair_id", "target_fraction").agg(F.count_if(g > 0).alias("positive_seeds"), F.count_if(g < 0).alias("negative_seeds"))
    return counts.withColumn("p_value", F.round(S.sign_test(F.col("positive_seeds"), F.col("negative_seeds")), 6))
