"""Feature-importance stability across folds and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlab.operators.ranking import normalize_share, rank_first, spearman, top_k_per_group, topk_overlap

EPS = 1e-12
PRESENCE = 1e-8


def feature_stability(long: DataFrame, fold: str = "fold_name") -> DataFrame:
    """Presence x low variation x steady rank, and that index times the mean share."""
    shared = normalize_share(long, [fold], "importance")
    ranked = rank_first(shared, [fold], "importance_norm", "feature")
    v = F.col("importance_norm")
    out = ranked.groupBy("feature").agg(
        F.avg(v).alias("mean_importance"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("std_importance"), F.min(v).alias("min_importance"), F.max(v).alias("max_importance"),
        F.count(v).alias("n_folds"), F.avg("rank_norm").alias("mean_rank"), F.coalesce(F.stddev_samp("rank_norm"), F.lit(0.0)).alias("std_rank"),
        F.avg((v > PRESENCE).cast("double")).alias("presence_rate"),
    )
    out = out.withColumn("cv_importance", F.col("std_importance") / (F.col("mean_importance") + EPS))
    out = out.withColumn("feature_stability_index", F.col("presence_rate") * (1.0 / (1.0 + F.col("cv_importance"))) * (1.0 / (1.0 + F.col("std_rank"))))
    return out.withColumns({
        "transfer_utility": F.col("mean_importance") * F.col("feature_stability_index"), "stability_score_old": F.col("mean_importance") / (F.col("std_importance") + EPS),
    })


def importance_summary(long: DataFrame) -> DataFrame:
    v = F.col("importance")
    out = long.groupBy("feature").agg(
        F.avg(v).alias("mean_importance"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("std_importance"), F.min(v).alias("min_importance"),
        F.max(v).alias("max_importance"), F.count(v).alias("n_folds"),
    )
    return out.withColumns({
        "cv_importance": F.col("std_importance") / (F.col("mean_importance") + EPS), "stability_score": F.col("mean_importance") / (F.col("std_importance") + EPS),
    })


def importance_by_run(long: DataFrame, by: list[str] = ("feature", "direction", "model")) -> DataFrame:
    return long.groupBy(*by).agg(
        F.avg("importance").alias("mean_importance"), F.coalesce(F.stddev_samp("importance"), F.lit(0.0)).alias("std_importance"), F.count(F.lit(1)).alias("n_runs")
    )


def importance_shift(before: DataFrame, after: DataFrame, by: list[str], k: int = 3) -> DataFrame:
    """The k features whose importance moved most, per run; a missing feature counts as 0."""
    old = before.select(*by, "feature", F.col("importance").alias("pretrain_importance"))
    new = after.select(*by, "feature", F.col("importance").alias("adapted_importance"))
    both = old.join(new, [*by, "feature"], "full").fillna(0.0, ["pretrain_importance", "adapted_importance"])
    moved = both.withColumn("absolute_shift", F.abs(F.col("adapted_importance") - F.col("pretrain_importance")))
    return top_k_per_group(moved, by, [F.desc("absolute_shift"), F.col("feature")], k)


def compatibility(a: DataFrame, b: DataFrame, by: list[str], ks: tuple[int, ...] = (3, 5)) -> DataFrame:
    """Rank correlation and top-k overlaps of two importance tables per group."""
    left = a.select(*by, "feature", F.col("importance").alias("x"))
    right = b.select(*by, "feature", F.col("importance").alias("y"))
    both = left.join(right, [*by, "feature"], "full").fillna(0.0, ["x", "y"])
    out = spearman(both, "x", "y", by).select(*by, F.col("spearman").alias("rank_spearman"))
    for k in ks:
        o = topk_overlap(a, b, by, "feature", "importance", k)
        out = out.join(o.select(*by, *[F.col(c).alias(f"top_{k}_{c}") for c in ("overlap_count", "overlap_ratio", "jaccard")]), by, "left")
    return out
