"""Shares, ranks, top-k, curve areas and rank correlation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlab.functions.clean import safe_div
from flowlab.operators.order import group_sizes, row_ranks, running_sums, whole
from flowlab.session import settle


def normalize_share(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Share of the group total; totals are aggregated and settled first, so rows of a large group stay where they are."""
    totals = settle(df.groupBy(*by).agg(F.sum(value).alias("_total")))
    return df.join(totals, by).withColumn(f"{value}_norm", F.col(value) / (F.col("_total") + 1e-12)).drop("_total")


def rank_first(df: DataFrame, by: list[str], value: str, tie: str, group_limit: int | None = None) -> DataFrame:
    """Falling order rank without gaps, ties by name, and its share of the largest rank, which is the group's size."""
    sizes = group_sizes(df, by)
    ranked = row_ranks(df, by, [F.col(value).desc(), F.col(tie).asc()], "rank", group_limit, sizes)
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in by]
    named = sizes.select(*[F.col(c).alias(f"_of_{c}") for c in by], "n_group")
    return ranked.join(named, same).withColumn("rank_norm", F.col("rank") / F.col("n_group")).drop("n_group", *[f"_of_{c}" for c in by])


def top_k_per_group(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """A small k: every task keeps at most k rows per group before the shuffle (WindowGroupLimit)."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_rn") <= k).drop("_rn")


def top_n(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def topk_overlap(a: DataFrame, b: DataFrame, by: list[str], item: str, value: str, k: int) -> DataFrame:
    """Size, ratio to k and Jaccard index of the common part of two top-k sets per group."""

    def tops(df: DataFrame, name: str) -> DataFrame:
        best = top_k_per_group(df, by, [F.col(value).desc(), F.col(item)], k)
        return best.groupBy(*by).agg(F.collect_set(item).alias(name))

    both = tops(a, "top_a").join(tops(b, "top_b"), by)
    common = F.size(F.array_intersect("top_a", "top_b")).cast("long")
    return both.select(
        *by, common.alias("overlap_count"), (common / float(k)).alias("overlap_ratio"),
        safe_div(common, F.size(F.array_union("top_a", "top_b"))).alias("jaccard"),
    )


def curve_auc(df: DataFrame, keys: list[str], metrics: list[str], x: str = "fraction", low_max: float = 0.20, low_set: list[float] | None = None) -> DataFrame:
    """Trapezoid area of each metric over x, raw and per span, with low-x mean and the value at the largest x."""
    along = Window.partitionBy(*keys).orderBy(x)
    step = df.withColumn("_dx", F.col(x) - F.lag(x).over(along))
    step = step.withColumns({f"_a_{m}": F.coalesce(F.col("_dx") * (F.col(m) + F.lag(m).over(along)) / 2, F.lit(0.0)) for m in metrics})
    span = F.max(x) - F.min(x)
    is_low = F.col(x).isin(*low_set) if low_set else F.col(x) <= low_max
    out = []
    for m in metrics:
        area = F.sum(f"_a_{m}")
        out += [
            area.alias(f"auc_{m}"), F.when(span > 0, area / span).otherwise(F.min_by(m, x)).alias(f"auc_{m}_normalized"),
            F.avg(F.when(is_low, F.col(m))).alias(f"low_fraction_mean_{m}"), F.max_by(m, x).alias(f"full_fraction_{m}"),
        ]
    return step.groupBy(*keys).agg(*out)


def pearson(x: Column, y: Column) -> Column:
    """Correlation that is null, not an error, when a side is constant."""
    ok = x.isNotNull() & y.isNotNull()
    a, b = F.when(ok, x), F.when(ok, y)
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def spearman(df: DataFrame, x: str, y: str, by: list[str], group_limit: int | None = None) -> DataFrame:
    """Pearson correlation of average ranks over rows where both sides are known."""
    if not by:
        return spearman(whole(df), x, y, ["_all"], group_limit).drop("_all")
    known = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, F.col(x).alias("_x"), F.col(y).alias("_y"))
    near = settle(known.groupBy(*by).agg(F.approx_count_distinct("_x").alias("_x"), F.approx_count_distinct("_y").alias("_y")))
    # Equal pairs are counted once, so the rank joins see distinct pairs only.
    known = known.groupBy(*by, "_x", "_y").agg(F.count(F.lit(1)).alias("_n"))
    rx = _weighted_ranks(known, by, "_x", group_limit, near).withColumnRenamed("_rank", "_rx")
    ry = _weighted_ranks(known, by, "_y", group_limit, near).withColumnRenamed("_rank", "_ry")
    ranked = known.join(rx, [*by, "_x"]).join(ry, [*by, "_y"])
    n = F.sum("_n")
    # Ranks are centred on (n+1)/2, known from the group size, before they are multiplied.
    sizes = known.groupBy(*by).agg(F.sum("_n").alias("_size"))
    ranked = ranked.join(sizes, by)
    cx, cy = F.col("_rx") - (F.col("_size") + 1) / 2, F.col("_ry") - (F.col("_size") + 1) / 2
    cov, vx, vy = F.sum(F.col("_n") * cx * cy), F.sum(F.col("_n") * cx * cx), F.sum(F.col("_n") * cy * cy)
    return ranked.groupBy(*by).agg(n.alias("n_rows"), F.try_divide(cov, F.sqrt(vx) * F.sqrt(vy)).alias("spearman"))


def _weighted_ranks(pairs: DataFrame, by: list[str], value: str, group_limit: int | None, near: DataFrame) -> DataFrame:
    """Average rank of each value: its running count less half of its own ties."""
    counts = pairs.groupBy(*by, value).agg(F.sum("_n").alias("_c"))
    run = running_sums(counts, by, value, ["_c"], group_limit=group_limit, sizes=near.select(*by, F.col(value).alias("n_group")))
    return run.select(*by, value, (F.col("run__c") - (F.col("_c") - 1) / 2).alias("_rank"))
