"""Drift and similarity between scenarios.

Inputs are aggregates with one row per scenario and feature or label; the
matrices have one cell per pair of scenarios because that is the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlab.operators.profile import one_row
from flowlab.operators.ranking import pearson, spearman
from flowlab.session import settle

NORM_FLOOR = 1e-12


def feature_means(df: DataFrame, cols: list[str], by: str = "scenario") -> DataFrame:
    """Long (scenario, feature, value) means from one wide aggregate; a missing mean is 0."""
    wide = df.groupBy(by).agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in cols])
    return wide.unpivot([by], cols, "feature", "value")


def log_profile(long: DataFrame) -> DataFrame:
    """log1p of the features that are nowhere negative."""
    lowest = F.min("value").over(Window.partitionBy("feature"))
    return long.withColumn("value", F.when(lowest >= 0, F.log1p(F.abs("value"))).otherwise(F.col("value")))


def profiles(df: DataFrame, cols: list[str], by: str = "scenario") -> DataFrame:
    """Feature means per scenario, log scaled where possible, then z-scored per feature (std 0 counts as 1)."""
    scaled = log_profile(feature_means(df, cols, by))
    whole = Window.partitionBy("feature")
    std = F.stddev_pop("value").over(whole)
    return scaled.withColumn("value", (F.col("value") - F.avg("value").over(whole)) / F.when(std == 0, 1.0).otherwise(std))


#: Parts that the right side of a pair join is dealt in; the left side, one row per scenario and key, is repeated as often.
TILES = 8


def tiled(left: DataFrame, right: DataFrame, key: str, owner: str) -> tuple[DataFrame, DataFrame]:
    """Both sides with a second join key, so that a key which all scenarios share is joined in TILES tasks."""
    left = left.withColumn("_tile", F.explode(F.sequence(F.lit(0), F.lit(TILES - 1))))
    return left, right.withColumn("_tile", F.pmod(F.xxhash64(owner), F.lit(TILES)).cast("int"))


def cosine_matrix(long: DataFrame, by: str = "scenario", key: str = "feature") -> DataFrame:
    """Cosine of every two scenarios that share a key; pairs without one are 0 and not listed."""
    norm = F.greatest(F.sqrt(F.sum(F.col("value") * F.col("value"))), F.lit(NORM_FLOOR))
    unit = long.join(long.groupBy(by).agg(norm.alias("_norm")), by).select(by, key, (F.col("value") / F.col("_norm")).alias("u"))
    unit = settle(unit)
    left = unit.select(F.col(by).alias("a"), key, F.col("u").alias("ua"))
    right = unit.select(F.col(by).alias("b"), key, F.col("u").alias("ub"))
    left, right = tiled(left, right, key, "b")
    return left.join(right, [key, "_tile"]).groupBy("a", "b").agg(F.sum(F.col("ua") * F.col("ub")).alias("cosine"))


def mean_js(profile: DataFrame, by: str = "scenario", key: str = "label", value: str = "ratio") -> DataFrame:
    """Mean Jensen-Shannon divergence (base 2) over all pairs of scenarios.

    A pair's divergence is one plus half of what each common label adds, so the sum over
    pairs is a sum over labels.  Scenarios that give a label the same ratio are one weighted
    class of it; only the classes of a label meet, never the scenarios.
    """
    p = settle(profile.where(F.col(value) > 0).groupBy(key, value).agg(F.count(F.lit(1)).cast("double").alias("w")))
    size = profile.where(F.col(value) > 0).agg(F.count_distinct(by).alias("n_scenarios"), F.count_distinct(key).alias("n_labels"))
    left = p.select(key, F.col(value).alias("p"), F.col("w").alias("wp"))
    right = p.select(key, F.col(value).alias("q"), F.col("w").alias("wq"))
    left, right = tiled(left, right, key, "q")
    m = (F.col("p") + F.col("q")) / 2
    adds = F.col("p") * F.log2(F.col("p") / m) + F.col("q") * F.log2(F.col("q") / m) - F.col("p") - F.col("q")
    times = F.when(F.col("p") == F.col("q"), F.col("wp") * (F.col("wp") - 1) / 2).otherwise(F.col("wp") * F.col("wq"))
    met = left.join(right, [key, "_tile"]).where(F.col("p") <= F.col("q")).agg(F.coalesce(F.sum(times * adds), F.lit(0.0)).alias("adds"))
    pairs = F.col("n_scenarios") * (F.col("n_scenarios") - 1) / 2
    (added,) = one_row(met, ["adds"]).values()
    return size.select(F.coalesce(F.try_divide(pairs + added / 2, pairs), F.lit(0.0)).alias("mean_pairwise_js_divergence"), "n_scenarios", "n_labels")


def label_profile(counts: DataFrame) -> DataFrame:
    """Label proportions per scenario from attack type counts."""
    return counts.select("scenario", "label", F.col("ratio_within_scenario").alias("ratio"))


DIFFICULTY_VARIABLES = [
    "total_flows", "benign_flows", "malicious_flows", "benign_ratio", "malicious_ratio", "num_unique_labels", "num_attack_types",
    "dominant_attack_type_ratio_within_scenario",
]


def difficulty_corr(joined: DataFrame, variables: list[str] = DIFFICULTY_VARIABLES, target: str = "difficulty") -> DataFrame:
    """Spearman correlation of scenario properties with difficulty, strongest first."""
    long = joined.select(target, *[F.col(v).cast("double").alias(v) for v in variables]).unpivot([target], variables, "variable", "value")
    out = spearman(settle(long), "value", target, ["variable"]).withColumnRenamed("spearman", "spearman_corr_with_difficulty")
    return out.orderBy(F.desc_nulls_last(F.abs("spearman_corr_with_difficulty")), "variable")


def predictor_corr(gain: DataFrame, predictors: list[str], target: str = "primary_gain", scope: str = "target_fraction", min_rows: int = 3) -> DataFrame:
    """Pearson and Spearman correlation of each predictor with the gain, overall and per fraction."""
    long = gain.select(scope, target, *[F.col(p).cast("double").alias(p) for p in predictors]).unpivot([scope, target], predictors, "predictor", "value")
    # Run tables are small; fixing them keeps the four reads below from repeating the runs' own plan.
    long = settle(long.where(F.col("value").isNotNull() & F.col(target).isNotNull()))
    name = F.concat(F.lit(f"{scope}="), F.col(scope).cast("string"))
    scoped = long.select(F.explode(F.array(F.lit("overall"), name)).alias("scope"), "predictor", "value", target)
    keys = ["scope", "predictor"]
    linear = scoped.groupBy(*keys).agg(pearson(F.col("value"), F.col(target)).alias("pearson_corr"))
    ranked = spearman(scoped, "value", target, keys).withColumnsRenamed({"n_rows": "n_runs", "spearman": "spearman_corr"})
    out = linear.join(ranked, keys).where(F.col("n_runs") >= min_rows)
    return out.withColumns({"abs_pearson_corr": F.abs("pearson_corr"), "abs_spearman_corr": F.abs("spearman_corr")})
