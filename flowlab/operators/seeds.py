"""Repeated-seed statistics: t intervals, paired deltas, sign test."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlab.session import lit_map

# Two-sided 95% t quantiles for 1 to 30 degrees of freedom; 1.96 beyond.
T95 = [
    12.706, 4.303, 3.182, 2.776, 2.571, 2.447, 2.365, 2.306, 2.262, 2.228, 2.201, 2.179, 2.160, 2.145, 2.131, 2.120, 2.110, 2.101, 2.093, 2.086,
    2.080, 2.074, 2.069, 2.064, 2.060, 2.056, 2.052, 2.048, 2.045, 2.042,
]


def t_quantile(n: Column) -> Column:
    return F.coalesce(F.try_element_at(lit_map({i + 1: t for i, t in enumerate(T95)}), (n - 1).cast("int")), F.lit(1.96))


def _interval(out: DataFrame) -> DataFrame:
    one = F.col("n_seeds") <= 1
    out = out.withColumn("std", F.when(one & F.col("mean").isNotNull(), 0.0).otherwise(F.col("std")))
    out = out.withColumn("se", F.when(one, F.col("std")).otherwise(F.col("std") / F.sqrt("n_seeds")))
    margin = F.when(one, 0.0).otherwise(t_quantile(F.col("n_seeds")) * F.col("se"))
    return out.withColumns({"ci95_low": F.col("mean") - margin, "ci95_high": F.col("mean") + margin})


def seed_ci(df: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """Mean, std, standard error and 95% interval of each metric over seeds; one seed gives width 0."""
    long = df.select(*by, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(list(by), metrics, "metric", "value")
    stats = long.groupBy(*by, "metric").agg(F.count("value").alias("n_seeds"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
    return _interval(stats)


def sign_test(pos: Column, neg: Column) -> Column:
    """Exact two-sided sign test: 2*sum C(n,k)/2^n for k up to the smaller side, at most 1; 1 without any difference.

    Terms are built one from the other in a fold over k, so no factorial is needed.
    """
    n, few = (pos + neg).cast("double"), F.least(pos, neg).cast("int")
    start = F.struct(F.pow(F.lit(0.5), n).alias("term"), F.pow(F.lit(0.5), n).alias("total"))

    def step(acc: Column, k: Column) -> Column:
        term = acc["term"] * (n - k + 1) / k
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    tail = F.aggregate(F.when(few > 0, F.sequence(F.lit(1), few)).otherwise(F.array().cast("array<int>")), start, step, lambda acc: acc["total"])
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2.0 * tail))


def paired_deltas(df: DataFrame, keys: list[str], seed: str, pair: str, minus: str, plus: str, metrics: list[str]) -> DataFrame:
    """Per key and metric: plus - minus over the seeds both sides share, its interval, sign counts and sign test."""
    wide = df.groupBy(*keys, seed).agg(*[F.max(F.when(F.col(pair) == side, F.col(m))).alias(f"{m}__{tag}") for m in metrics for tag, side in (("p", plus), ("m", minus))])
    deltas = wide.select(*keys, *[(F.col(f"{m}__p") - F.col(f"{m}__m")).alias(m) for m in metrics]).unpivot(list(keys), metrics, "metric", "delta")
    d = F.col("delta")
    stats = deltas.groupBy(*keys, "metric").agg(
        F.count(d).alias("n_seeds"), F.avg(d).alias("mean"), F.stddev_samp(d).alias("std"), F.count_if(d > 0).alias("positive_seeds"), F.count_if(d < 0).alias("negative_seeds")
    )
    out = _interval(stats).withColumn("nonzero_seeds", F.col("positive_seeds") + F.col("negative_seeds"))
    return out.withColumn("sign_test_pvalue", sign_test(F.col("positive_seeds"), F.col("negative_seeds")))
