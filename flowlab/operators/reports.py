"""Aggregates over fold, seed and run tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlab.operators.metrics import CELLS


def fold_aggregate(folds: DataFrame, metrics: list[str], ddof: int = 1, score: str = "f1_macro", name: str = "scenario") -> DataFrame:
    """Mean and std over folds, pooled cells, best and worst fold (ties by name)."""
    spread = F.stddev_samp if ddof else F.stddev_pop
    stats = [f(m).alias(f"{p}_{m}") for m in metrics for p, f in (("mean", F.avg), ("std", spread))]
    best = F.min_by(name, F.struct(-F.col(score), F.col(name))).alias("best_fold")
    worst = F.min_by(name, F.struct(F.col(score), F.col(name))).alias("worst_fold")
    return folds.agg(F.count(F.lit(1)).alias("n_folds"), *stats, best, worst, *[F.sum(c).alias(c) for c in CELLS])


def fold_report(folds: DataFrame, weighted: list[str], name: str = "scenario") -> DataFrame:
    """Row-weighted means, category counts and the worst fold by each weighted metric."""
    w = F.col("n_rows")
    means = [(F.sum(F.coalesce(F.col(m), F.lit(0.0)) * w) / F.sum(w)).alias(f"weighted_mean_{m}") for m in weighted]
    words = ["excellent", "strong", "unstable", "trivial_or_single_class", "failure", "unknown"]
    kinds = [F.count_if(F.col("category") == c).alias(f"n_{c}") for c in words]
    worst = [F.min_by(name, F.struct(F.col(m), F.col(name))).alias(f"worst_by_{m}") for m in weighted]
    return folds.agg(F.count(F.lit(1)).alias("n_folds"), F.sum(w).alias("n_rows_total"), F.count_if("single_class_test").alias("single_class_folds"), *means, *kinds, *worst)


def summarize_metrics(df: DataFrame, metrics: list[str], by: list[str] = (), stats: tuple[str, ...] = ("mean", "std", "min", "max")) -> DataFrame:
    """Long summary (by..., metric, n, mean, std, min, max) from one wide aggregate."""
    fns = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max, "median": lambda c: F.percentile(c, 0.5)}
    wide = df.groupBy(*by).agg(*[F.struct(F.lit(m).alias("metric"), F.count(m).alias("n"), *[fns[s](m).alias(s) for s in stats]).alias(f"s_{m}") for m in metrics])
    return wide.select(*by, F.inline(F.array(*[f"s_{m}" for m in metrics])))


def best_worst(df: DataFrame, metric: str, name: str) -> DataFrame:
    """The best and the worst row, ties by name, without sorting the table."""
    row = F.struct(*df.columns)
    picks = df.agg(
        F.min_by(row, F.struct(-F.col(metric), F.col(name))).alias("best"), F.min_by(row, F.struct(F.col(metric), F.col(name))).alias("worst")
    )
    return picks.select(F.inline(F.array(F.struct(F.lit("best").alias("which"), "best.*"), F.struct(F.lit("worst").alias("which"), "worst.*"))))


def seed_stability(df: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    fns = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    return df.groupBy(*by).agg(F.count_distinct("seed").alias("n_seeds"), *[f(m).alias(f"{m}_{s}") for m in metrics for s, f in fns.items()])


def flag_sum(test: Column, name: str) -> Column:
    return F.count_if(test).alias(name)


def gain_summary(gain: DataFrame, by: list[str]) -> DataFrame:
    """Run counts, outcome counts and rates, gain statistics and the fractions seen, for any grouping."""
    g, label = F.col("primary_gain"), F.col("transfer_label")
    seen = F.array_join(F.transform(F.array_sort(F.collect_set("target_fraction")), lambda x: x.cast("string")), "|")
    out = gain.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_runs"), F.count_distinct("pair_id").alias("n_pairs"), F.count_distinct("seed").alias("n_seeds"),
        flag_sum(label == "positive", "positive_transfer"), flag_sum(label == "negative", "negative_transfer"), flag_sum(label == "neutral", "neutral_transfer"),
        F.avg(g).alias("mean_primary_gain"), F.percentile(g, 0.5).alias("median_primary_gain"), F.min(g).alias("min_primary_gain"), F.max(g).alias("max_primary_gain"),
        *[F.avg(f"{c}_f1_attack").alias(f"mean_{c}_f1_attack") for c in ("source_only", "target_only", "transfer")], seen.alias("fractions_seen"),
    )
    return out.withColumns({
        "positive_rate": F.col("positive_transfer") / F.col("n_runs"), "negative_rate": F.col("negative_transfer") / F.col("n_runs"),
        "net_positive_minus_negative": F.col("positive_transfer") - F.col("negative_transfer"),
    })


def metric_gains(gain: DataFrame, metrics: list[str], by: list[str]) -> DataFrame:
    """Mean, median, max and min gain per metric and group."""
    wide = gain.groupBy(*by).agg(F.count(F.lit(1)).alias("n_runs"), *[
        F.struct(
            F.lit(m).alias("metric"), F.avg(f"gain_{m}").alias("mean_gain"), F.percentile(f"gain_{m}", 0.5).alias("median_gain"),
            F.max(f"gain_{m}").alias("max_gain"), F.min(f"gain_{m}").alias("min_gain"),
        ).alias(f"s_{m}") for m in metrics
    ])
    return wide.select(*by, "n_runs", F.inline(F.array(*[f"s_{m}" for m in metrics])))


def variability(df: DataFrame, by: list[str], metric: str = "f1_attack") -> DataFrame:
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_scenarios"), F.avg(metric).alias("mean"), F.stddev_samp(metric).alias("std"), F.min(metric).alias("min"), F.max(metric).alias("max")
    )


def pivot_metrics(df: DataFrame, rows: list[str], col: str, values: list, metrics: list[str]) -> DataFrame:
    """Wide <metric>_<value> columns; the value list is given, so no job has to find it."""
    return df.groupBy(*rows).agg(*[F.avg(F.when(F.col(col) == v, F.col(m))).alias(f"{m}_{v}") for m in metrics for v in values])


def pivot_counts(df: DataFrame, rows: list[str], col: str, values: list) -> DataFrame:
    """Wide n_<value> columns: rows per value of ``col``; other values count nowhere."""
    return df.groupBy(*rows).agg(*[F.count_if(F.col(col) == v).alias(f"n_{v}") for v in values])


def key_findings(df: DataFrame, min_gain: float = 0.005) -> DataFrame:
    """Best score per condition, best gain and the fractions where adaptation helps, per direction."""
    wide = pivot_metrics(df, ["direction", "target_fraction"], "condition", ["target_only_updated", "transfer_learning_updated"], ["f1_macro"])
    wide = wide.withColumn("gain", F.col("f1_macro_transfer_learning_updated") - F.col("f1_macro_target_only_updated"))
    helped = F.array_sort(F.collect_list(F.when(F.col("gain") > min_gain, F.col("target_fraction"))))
    text = F.array_join(F.transform(helped, lambda x: x.cast("string")), ",")
    out = wide.groupBy("direction").agg(
        F.max("f1_macro_target_only_updated").alias("best_target_only_macro_f1"), F.max("f1_macro_transfer_learning_updated").alias("best_transfer_macro_f1"),
        F.max("gain").alias("best_macro_f1_gain_vs_target_only"), F.when(F.size(helped) > 0, text).otherwise("none").alias("target_fractions_with_positive_macro_f1_gain"),
    )
    helps = F.col("target_fractions_with_positive_macro_f1_gain") != "none"
    return out.withColumn(
        "overall_interpretation",
        F.when(helps, "transfer helps under limited target data").otherwise("transfer does not meaningfully improve target-only"),
    )


def low_fraction(df: DataFrame, by: list[str], metrics: list[str], low_max: float | None = 0.20, low_set: list[float] | None = None) -> DataFrame:
    """Means over the low fractions, given by a bound or as a list."""
    low = F.col("fraction").isin(*low_set) if low_set else F.col("fraction") <= low_max
    return df.where(low).groupBy(*by).agg(F.count(F.lit(1)).alias("n_fractions"), *[F.avg(m).alias(f"mean_{m}") for m in metrics])


def run_notes(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.select(*cols).distinct()


def grid_signature(df: DataFrame, by: list[str], caps: list[str] = ()) -> DataFrame:
    """Fraction grid and row caps of each run."""
    return df.groupBy(*by).agg(
        F.count_distinct("fraction").alias("fraction_count"), F.max("fraction").alias("max_fraction"), F.min("fraction").alias("min_fraction"),
        *[F.max(c).alias(f"signature_{c}") for c in caps],
    )
