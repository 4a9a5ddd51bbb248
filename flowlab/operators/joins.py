"""Joins of statistics, runs, pairs and domains."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


PAIR_KEYS = ["pair_id", "pair_family", "source_domain_id", "target_test_domain_id", "seed"]
RUN_KEYS = [*PAIR_KEYS, "target_fraction"]


def same(left: DataFrame, right: DataFrame, keys: list[str], suffix: str) -> tuple[DataFrame, Column]:
    """Null-safe equality on keys, since a missing fraction equals a missing fraction here."""
    renamed = right.withColumnsRenamed({k: f"{k}{suffix}" for k in keys})
    tests = [F.col(k).eqNullSafe(F.col(f"{k}{suffix}")) for k in keys]
    return renamed, reduce(lambda a, b: a & b, tests)


def difficulty_join(stats: DataFrame, folds: DataFrame) -> DataFrame:
    """Scenario statistics beside difficulty = 1 - f1."""
    return stats.join(folds.select("scenario", (1.0 - F.col("f1_macro")).alias("difficulty")), "scenario")


def with_first_tp(metrics: DataFrame, first: DataFrame, by: list[str] = ("scenario",)) -> DataFrame:
    return metrics.join(first, list(by), "left")


def compare_importance(a: DataFrame, b: DataFrame, value: str = "mean_importance", names: tuple[str, str] = ("a", "b")) -> DataFrame:
    """Both models' importances side by side: missing counts as 0; the common part and the gap."""
    left = a.select("feature", F.col(value).alias(f"importance_{names[0]}"))
    right = b.select("feature", F.col(value).alias(f"importance_{names[1]}"))
    both = left.join(right, "feature", "full").fillna(0.0)
    x, y = F.col(f"importance_{names[0]}"), F.col(f"importance_{names[1]}")
    return both.withColumns({"common_importance": F.least(x, y), "importance_gap": F.abs(x - y)})


def compare_models(a: DataFrame, b: DataFrame, key: str, metrics: list[str], names: tuple[str, str] = ("rf", "xgb")) -> DataFrame:
    """Two models by fold, with a-b per metric."""
    left = a.select(key, *[F.col(m).alias(f"{m}_{names[0]}") for m in metrics])
    right = b.select(key, *[F.col(m).alias(f"{m}_{names[1]}") for m in metrics])
    deltas = {f"{m}_delta": F.col(f"{m}_{names[0]}") - F.col(f"{m}_{names[1]}") for m in metrics}
    return left.join(right, key).withColumns(deltas)


def gain_table(runs: DataFrame, metrics: list[str]) -> DataFrame:
    """target_only with transfer on the run keys, source_only on the pair keys, and the three differences per metric."""

    def part(condition: str, keys: list[str], prefix: str) -> DataFrame:
        rows = runs.where(F.col("condition") == condition)
        return rows.select(*keys, *[F.col(m).alias(f"{prefix}_{m}") for m in metrics]).distinct()

    target = part("target_only_updated", RUN_KEYS, "target_only")
    transfer, on_run = same(target, part("transfer_learning_updated", RUN_KEYS, "transfer"), RUN_KEYS, "_x")
    source, on_pair = same(target, part("source_only", PAIR_KEYS, "source_only"), PAIR_KEYS, "_s")
    joined = target.join(transfer, on_run).join(source, on_pair, "left").drop(*[f"{k}_x" for k in RUN_KEYS], *[f"{k}_s" for k in PAIR_KEYS])
    out = {}
    for m in metrics:
        out[f"gain_{m}"] = F.col(f"transfer_{m}") - F.col(f"target_only_{m}")
        out[f"delta_vs_source_{m}"] = F.col(f"transfer_{m}") - F.col(f"source_only_{m}")
        out[f"target_minus_source_{m}"] = F.col(f"target_only_{m}") - F.col(f"source_only_{m}")
    return joined.withColumns(out)


# Result names of the compared metrics.
GAIN_NAMES = {"f1_macro": "macro_f1", "f1_attack": "attack_f1", "recall_attack": "attack_recall", "accuracy": "accuracy"}


def gain_vs_target(df: DataFrame) -> DataFrame:
    """Transfer rows beside target-only rows of the same direction and fraction."""
    keys = ["direction", "target_fraction"]
    base = df.where(F.col("condition") == "target_only_updated").select(*keys, *[F.col(m).alias(f"base_{m}") for m in GAIN_NAMES])
    joined = df.where(F.col("condition") == "transfer_learning_updated").join(base, keys, "left")
    return joined.select(*keys, *[(F.col(m) - F.col(f"base_{m}")).alias(f"{name}_gain_vs_target_only") for m, name in GAIN_NAMES.items()])


def attach_pairs(runs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Runs beside their pair's attack rates and the gap between them."""
    gap = F.col("source_attack_rate") - F.col("target_attack_rate")
    meta = pairs.withColumns({"attack_rate_gap": gap, "abs_attack_rate_gap": F.abs(gap)})
    return runs.join(meta, ["pair_id", "pair_family", "source_domain_id", "target_test_domain_id"], "left")


CONDITIONS = ["source_only", "target_only_updated", "transfer_learning_updated"]


def valid_runs(runs: DataFrame, metrics: list[str]) -> DataFrame:
    known = reduce(lambda a, b: a & b, [F.col(m).isNotNull() for m in metrics])
    return runs.where(F.col("condition").isin(*CONDITIONS) & known)


def semi(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows with a partner among ``keys``; Spark chooses between broadcast and shuffle by the keys' size."""
    return df.join(keys.select(*on), on, "left_semi")


def anti(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return df.join(keys.select(*on), on, "left_anti")


def matched_comparison(base: DataFrame, sens: DataFrame) -> DataFrame:
    """Sensitivity rows of every study stacked on the baseline rows of the same direction, model and seed.

    A group whose fraction sets differ, or that has no baseline, fails the job.
    """
    group = ["direction", "model"]
    seeds = sens.select("study", *group, "seed").distinct()
    matched = base.join(seeds, [*group, "seed"])
    grid = F.array_sort(F.collect_set("fraction"))
    mine = sens.groupBy("study", *group).agg(grid.alias("grid"))
    theirs = matched.groupBy("study", *group).agg(grid.alias("base_grid"))
    checked = mine.join(theirs, ["study", *group], "left")
    message = F.concat(F.lit("fraction mismatch: "), F.concat_ws("/", "study", *group))
    checked = checked.select("study", *group, F.when(F.col("grid").eqNullSafe(F.col("base_grid")), True).otherwise(F.raise_error(message).cast("boolean")).alias("ok"))
    stacked = matched.withColumn("config_group", F.lit("baseline")).unionByName(sens.withColumn("config_group", F.lit("sensitivity")), allowMissingColumns=True)
    return stacked.join(checked.where("ok"), ["study", *group]).drop("ok")


def with_compat(gain: DataFrame, compat: DataFrame, keys: list[str] = ("pair_id", "seed", "target_fraction")) -> DataFrame:
    renamed, test = same(gain, compat, list(keys), "_c")
    return gain.join(renamed, test, "left").drop(*[f"{k}_c" for k in keys])


def resolve_pool(targets: DataFrame, registry: DataFrame) -> DataFrame:
    """Training pool of each target: exact group match, else same family, else every train domain.

    Each level is its own equi-join and sees only the targets that no level before it
    matched, so a full pool is listed only where nothing narrower exists. Registry
    rows, not data rows, are paired.
    """
    train = registry.where("split = 'train'")
    open_ = targets.select(F.col("domain_id").alias("target_domain_id"), "dataset", "grouping", "group_value", "domain_family")
    levels = [
        ("exact_group_match", ["dataset", "grouping", "group_value"]),
        ("family_train_pool", ["dataset", "domain_family"]),
        ("full_train_pool", ["dataset"]),
    ]
    parts = []
    for name, keys in levels:
        pool = train.select(*keys, "domain_id")
        hit = open_.join(pool, keys)
        parts.append(hit.groupBy("target_domain_id").agg(F.lit(name).alias("resolution"), F.array_sort(F.collect_set("domain_id")).alias("train_domain_ids")))
        open_ = open_.join(pool.select(*keys).distinct(), keys, "left_anti")
    return reduce(lambda a, b: a.unionByName(b), parts)
