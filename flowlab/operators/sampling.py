"""Sampling, capping, balancing and splitting.

Every draw takes the first rows in a seeded hash order of a unique key, so it
is exact in size, independent of partitioning and repeatable after a lost
executor.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlab.operators.order import first_rows, group_sizes, hash_key, hash_lead, largest, mark_first, whole, window_limit
from flowlab.session import settle

DRAW = ["_lead", "_hash"]


def with_draw(df: DataFrame, key: str, seed: int) -> DataFrame:
    return df.withColumn("_hash", hash_key(F.col(key), seed)).withColumn("_lead", hash_lead(F.col("_hash")))


def draw_cuts(rows: DataFrame, by: list[str], quota: DataFrame, sizes: DataFrame) -> DataFrame | None:
    """(by..., _cut_lead, _cut_hash): the k-th place of each group in hash order; None where it lies far from its expected place.

    Leads are spread evenly, so rank k lies within a few roots of k of the share k / n: rows
    below that band are counted, the few inside are ranked.  Nothing is sorted but the band.
    """
    slack = 8 * F.sqrt("k") + 50
    bound = lambda k: F.least(F.lit(1.0), F.greatest(F.lit(0.0), k / F.col("n_group"))) * F.lit(float(2**48))
    wanted = sizes.join(quota.select(*by, "k"), by).withColumn("k", F.least("k", "n_group")).where("k >= 1")
    wanted = settle(wanted.select(*by, "k", bound(F.col("k") - slack).alias("_low"), bound(F.col("k") + slack).alias("_high")))
    keyed = rows.select(*by, *DRAW).join(wanted, by)
    below = settle(keyed.where("_lead < _low").groupBy(*by).agg(F.count(F.lit(1)).alias("_below")))
    band = settle(keyed.where("_lead >= _low AND _lead <= _high").select(*by, "k", *DRAW))
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*DRAW)) + F.coalesce("_below", F.lit(0))
    cuts = settle(band.join(below, by, "left").withColumn("_place", place).where("_place = k").select(*by, F.col("_lead").alias("_cut_lead"), F.col("_hash").alias("_cut_hash")))
    return cuts if cuts.count() == wanted.count() else None


def mark_drawn(df: DataFrame, by: list[str], quota: DataFrame, key: str, seed: int, out: str, group_limit: int | None = None, sizes: DataFrame | None = None) -> DataFrame:
    """Adds ``out``: is the row among the first ``k`` of its group in hash order?"""
    rows = with_draw(df, key, seed)
    sizes = group_sizes(df, by) if sizes is None else sizes
    cuts = draw_cuts(rows, by, quota, sizes) if largest(sizes) > window_limit(by, group_limit) else None
    if cuts is None:
        return mark_first(rows, by, DRAW, quota, out, group_limit, sizes).drop(*DRAW)
    inside = (F.col("_lead") < F.col("_cut_lead")) | ((F.col("_lead") == F.col("_cut_lead")) & (F.col("_hash") <= F.col("_cut_hash")))
    return rows.join(cuts, by, "left").select(*df.columns, F.coalesce(inside, F.lit(False)).alias(out))


def draw(df: DataFrame, by: list[str], quota: DataFrame, key: str, seed: int, group_limit: int | None = None, sizes: DataFrame | None = None) -> DataFrame:
    """``k`` pseudo-random rows of each group."""
    return mark_drawn(df, by, quota, key, seed, "_first", group_limit, sizes).where("_first").drop("_first")


def share(n: Column, fraction: float, rounding: str = "even") -> Column:
    """Rows for a fraction: half to even, or up; at least one, at most all."""
    size = {"even": F.bround(n * F.lit(float(fraction)), 0), "ceil": F.ceil(n * F.lit(float(fraction)))}[rounding]
    return F.least(n, F.greatest(F.lit(1), size.cast("long")))


def stratified_sample(df: DataFrame, by: list[str], fraction: float, key: str, seed: int, rounding: str = "even", group_limit: int | None = None) -> DataFrame:
    if fraction >= 1.0:
        return df
    sizes = group_sizes(df, by)
    return draw(df, by, sizes.select(*by, share(F.col("n_group"), fraction, rounding).alias("k")), key, seed, group_limit, sizes)


def cap_stratified(df: DataFrame, n: int, label: str, key: str, seed: int, group_limit: int | None = None) -> DataFrame:
    """At most ``n`` rows with both classes in proportion; class 0 takes what class 1 leaves."""
    sizes = group_sizes(df, [label])
    totals = {r[label]: r["n_group"] for r in sizes.where(F.col(label).isin(0, 1)).collect()}
    ones, zeros = totals.get(1, 0), totals.get(0, 0)
    keep_one = min(round(n * (ones / max(ones + zeros, 1))), ones)
    keep = F.when(F.col(label) == 1, keep_one).otherwise(min(n - keep_one, zeros))
    return draw(df, [label], sizes.select(label, keep.alias("k")), key, seed, group_limit, sizes)


def cap_random(df: DataFrame, n: int, key: str, seed: int, group_limit: int | None = None) -> DataFrame:
    one = whole(df)
    sizes = group_sizes(one, ["_all"])
    return draw(one, ["_all"], sizes.select("_all", F.lit(n).alias("k")), key, seed, group_limit, sizes).drop("_all")


def sample_scan(df: DataFrame, n: int, key: str, seed: int, margin: float = 1.2, group_limit: int | None = None) -> DataFrame:
    """A hash threshold thins rows during the scan, then the exact cap is taken from what is left.

    Both steps use one hash order, so the result equals ``cap_random``; if the
    threshold left too few rows, the cap is taken from the whole table.
    """
    total = df.count()
    if n >= total:
        return df
    bound = int(min(1.0, margin * n / total) * 2**48)
    thinned = df.where(hash_lead(hash_key(F.col(key), seed)) < bound)
    return cap_random(thinned if thinned.count() >= n else df, n, key, seed, group_limit)


def label_quotas(counts: DataFrame, by: list[str], label: str, n: int) -> DataFrame:
    """Rows per label: proportional, at least one; overshoot is trimmed from the largest quotas down to one each."""
    group = Window.partitionBy(*by)
    total = F.sum("n_group").over(group)
    first = F.least("n_group", F.greatest(F.lit(1), F.bround(F.col("n_group") / total * n, 0).cast("long")))
    quota = counts.withColumns({"total": total, "q": F.when(total <= n, F.col("n_group")).otherwise(first)})
    falling = group.orderBy(F.desc("q"), label).rowsBetween(Window.unboundedPreceding, -1)
    over = F.greatest(F.sum("q").over(group) - F.greatest(F.lit(n), F.lit(0)), F.lit(0))
    quota = quota.withColumns({"over": F.when(F.col("total") > n, over).otherwise(0), "spare_before": F.coalesce(F.sum(F.col("q") - 1).over(falling), F.lit(0))})
    trim = F.least(F.col("q") - 1, F.greatest(F.col("over") - F.col("spare_before"), F.lit(0)))
    quota = quota.withColumn("k", F.col("q") - trim)
    top_up = F.greatest(F.least(F.lit(n), F.col("total")) - F.sum("k").over(group), F.lit(0))
    return quota.withColumn("top_up", top_up).select(*by, label, "n_group", "k", "top_up")


def label_preserving_sample(df: DataFrame, by: list[str], label: str, n: int, key: str, seed: int, group_limit: int | None = None) -> DataFrame:
    """About ``n`` rows per group that keep every label; a shortfall is filled from the rows left over."""
    sizes = group_sizes(df, [*by, label])
    quotas = settle(label_quotas(sizes, by, label, n))
    marked = mark_first(with_draw(df, key, seed), [*by, label], DRAW, quotas.select(*by, label, "k"), "_kept", group_limit, sizes)
    short = settle(quotas.groupBy(*by).agg(F.max("top_up").alias("k")).where("k > 0"))
    chosen = marked.where("_kept").select(df.columns)
    if short.isEmpty():
        return chosen
    extra = first_rows(marked.where("not _kept"), by, DRAW, short, group_limit)
    return chosen.unionByName(extra.select(df.columns))


def sample_manifest(before: DataFrame, after: DataFrame, by: list[str], label: str) -> DataFrame:
    """Original and sampled rows per label and whether the label was lost."""
    old = before.groupBy(*by, label).agg(F.count(F.lit(1)).alias("original_rows"))
    new = after.groupBy(*by, label).agg(F.count(F.lit(1)).alias("sampled_rows"))
    joined = old.join(new, [*by, label], "left").fillna(0, ["sampled_rows"])
    return joined.withColumn("lost", F.col("sampled_rows") == 0)


def balance(df: DataFrame, label: str, key: str, seed: int, ratio: float = 1.0, group_limit: int | None = None) -> DataFrame:
    """Keep the smaller class, draw round(min*ratio) rows of the larger one; one-class tables stay as they are.

    A label other than 0 and 1, or a missing one, raises an error.
    """
    sizes = group_sizes(df, [label])
    if not sizes.where(F.col(label).isNull() | ~F.col(label).isin(0, 1)).isEmpty():
        raise ValueError(f"{label} must be 0 or 1")
    counts = {r[label]: r["n_group"] for r in sizes.where(F.col(label).isin(0, 1)).collect()}
    if len(counts) < 2:
        return df
    small = min(counts.values())
    target = max(1, round(small * ratio))
    keep = F.when(F.col("n_group") == small, F.col("n_group")).otherwise(F.least(F.col("n_group"), F.lit(target)))
    return draw(df, [label], sizes.select(label, keep.alias("k")), key, seed, group_limit, sizes)


def holdout(df: DataFrame, fraction: float, label: str, key: str, seed: int, on_empty: str = "skip", group_limit: int | None = None) -> DataFrame:
    """Adds ``role``: a stratified share of each class is held out.

    ``skip`` holds nothing out when a class has fewer than two rows, ``clamp``
    keeps at least one row on each side, ``raise`` fails on an empty side.
    """
    sizes = group_sizes(df, [label])
    n = F.col("n_group")
    k = F.bround(n * F.lit(float(fraction)), 0).cast("long")
    if on_empty == "skip":
        few = sizes.agg(F.count(F.lit(1)), F.min("n_group")).first()
        if few[0] < 2 or few[1] < 2:
            return df.withColumn("role", F.lit("fit"))
    elif on_empty == "clamp":
        k = F.greatest(F.lit(1), F.least(n - 1, k))
    elif on_empty == "raise":
        if not sizes.where((k <= 0) | (k >= n)).isEmpty():
            raise ValueError("a class would be empty on one side of the split")
    marked = mark_drawn(df, [label], sizes.select(label, k.alias("k")), key, seed, "_out", group_limit, sizes)
    return marked.withColumn("role", F.when(F.col("_out"), "holdout").otherwise("fit")).drop("_out")


def group_split(df: DataFrame, group: str, fraction: float, seed: int, min_groups: int = 3) -> DataFrame:
    """Adds ``role``: whole groups, ceil(n*fraction) of them, go to validation."""
    groups = settle(df.select(group).distinct())
    n = groups.count()
    if n < min_groups:
        raise ValueError(f"{n} groups are too few to split")
    chosen = cap_random(groups, math.ceil(n * fraction), group, seed).withColumn("_v", F.lit(True))
    return df.join(settle(chosen), group, "left").withColumn("role", F.when(F.col("_v"), "val").otherwise("train")).drop("_v")


def allocate_caps(domains: DataFrame, by: list[str], weight: str, cap: str, name: str = "domain_id") -> DataFrame:
    """Adds ``cap``: a pool's total split over its domains by largest remainder; ties to the heavier, later domain."""
    pool = Window.partitionBy(*by)
    w = F.greatest(F.col(weight).cast("double"), F.lit(0.0))
    total, n = F.sum(w).over(pool), F.count(F.lit(1)).over(pool)
    even = F.when(F.row_number().over(pool.orderBy(name)) <= F.col(cap) % n, 1).otherwise(0) + F.floor(F.col(cap) / n)
    raw = F.col(cap) * F.try_divide(w, total)
    out = domains.withColumns({"_even": even, "_total": total, "_n": n, "_raw": raw, "_w": w})
    out = out.withColumns({"_floor": F.floor("_raw"), "_rest": F.col("_raw") - F.floor("_raw")})
    rank = F.row_number().over(pool.orderBy(F.desc("_rest"), F.desc("_w"), F.desc(name)))
    left = F.col(cap) - F.sum("_floor").over(pool)
    spread = F.col("_floor") + F.when(rank <= left, 1).otherwise(0)
    value = F.when(F.col("_n") == 1, F.col(cap)).when(F.col(cap) <= 0, 0).when(F.col("_total") <= 0, F.col("_even")).otherwise(spread)
    return out.withColumn("allocated", value.cast("long")).drop("_even", "_total", "_n", "_raw", "_w", "_floor", "_rest")


def load_pool(df: DataFrame, domain: str, caps: DataFrame, key: str, seed: int, group_limit: int | None = None) -> DataFrame:
    """Capped pseudo-random rows of every domain in one job; ``caps`` is (domain, k), zero caps drop the domain."""
    return draw(df, [domain], caps.where("k > 0"), key, seed, group_limit)
