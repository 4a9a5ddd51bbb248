"""Early-detection prefixes: what is known after the first part of each scenario."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlab.operators.metrics import CELLS, cell_counts, metrics_present
from flowlab.operators.order import cut_keys, first_rows, group_sizes, key_after, largest, total_order, whole, window_limit
from flowlab.session import settle


def prefix_size(n: Column, fraction) -> Column:
    """max(1, trunc(n*f)) with IEEE truncation."""
    f = fraction if isinstance(fraction, Column) else F.lit(float(fraction))
    return F.greatest(F.lit(1), F.floor(n * f)).cast("long")


def cap_earliest(df: DataFrame, by: list[str], order: list[str], n: int, group_limit: int | None = None) -> DataFrame:
    """Earliest ``n`` rows of each group, or of the table when ``by`` is empty."""
    if not by:
        return cap_earliest(whole(df), ["_all"], order, n, group_limit).drop("_all")
    sizes = group_sizes(df, by)
    return first_rows(df, by, order, sizes.select(*by, F.lit(n).alias("k")), group_limit, sizes)


def prefix(df: DataFrame, fraction: float, by: list[str], order: list[str], group_limit: int | None = None) -> DataFrame:
    """Earliest max(1, trunc(n*fraction)) rows of each group, or of the table when ``by`` is empty."""
    if not by:
        return prefix(whole(df), fraction, ["_all"], order, group_limit).drop("_all")
    sizes = group_sizes(df, by)
    return first_rows(df, by, order, sizes.select(*by, prefix_size(F.col("n_group"), fraction).alias("k")), group_limit, sizes)


def prefix_bucket(df: DataFrame, fractions: list[float], by: list[str], order: list[str], sizes: DataFrame, group_limit: int | None = None) -> DataFrame:
    """Adds ``bucket``: how many of the rising fractions end before the row; rows without a time come last."""
    columns = df.columns
    df, order = total_order(df, order)
    if largest(sizes) <= window_limit(by, group_limit):
        pos = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
        ended = sum(((F.col("_pos") > prefix_size(F.col("n_group"), f)).cast("int") for f in fractions), F.lit(0))
        return df.withColumn("_pos", pos).join(sizes, by).select(*columns, ended.alias("bucket"))
    ranks = sizes.select(*by, "n_group", F.posexplode(F.array(*map(F.lit, fractions))).alias("tag", "f"))
    ranks = settle(ranks.select(*by, "tag", prefix_size(F.col("n_group"), F.col("f")).alias("k")))
    cuts = cut_keys(df, by, order, ranks, group_limit)
    ends = settle(cuts.groupBy(*by).agg(F.collect_list(F.struct(*[f"cut_{c}" for c in order])).alias("ends")))
    ended = F.size(F.filter("ends", lambda e: key_after(order, [e[f"cut_{c}"] for c in order])))
    return df.join(ends, by).select(*columns, ended.alias("bucket"))


def prefix_cells(df: DataFrame, fractions: list[float], by: list[str], order: list[str], counts: list[Column], extra: list[str] = (), group_limit: int | None = None) -> DataFrame:
    """Counts over every prefix from one pass: rows are counted once, in the first prefix
    that holds them, and the few counts are summed up along the fractions."""
    fractions, names = sorted(fractions), [*by, *extra]
    sizes = group_sizes(df, by)
    bucketed = prefix_bucket(df, fractions, by, order, sizes, group_limit)
    counted = settle(bucketed.groupBy(*names, "bucket").agg(F.count(F.lit(1)).alias("rows_in"), *counts))
    cells = [c for c in counted.columns if c not in (*names, "bucket")]
    grid = counted.select(*names).distinct().join(sizes, by).select("*", F.posexplode(F.array(*map(F.lit, fractions))).alias("bucket", "fraction"))
    upto = Window.partitionBy(*names).orderBy("bucket")
    dense = grid.join(counted, [*names, "bucket"], "left").fillna(0, cells)
    summed = dense.select(*names, "fraction", "n_group", *[F.sum(c).over(upto).alias(c) for c in cells])
    return summed.withColumn("rows_seen", prefix_size(F.col("n_group"), F.col("fraction")))


def metrics_of_cells(cells: DataFrame, by: list[str]) -> DataFrame:
    """Metrics per fraction over all groups of ``prefix_cells``, with the detection rate of groups that hold attacks."""
    last = F.max(F.col("tp") + F.col("fn")).over(Window.partitionBy(*by))
    cells = cells.withColumn("attacks", last)
    rate = F.avg(F.when(F.col("attacks") > 0, (F.col("tp") > 0).cast("double")))
    total = cells.groupBy("fraction").agg(
        F.count(F.lit(1)).alias("n_scenarios"), rate.alias("malicious_scenarios_detected_rate"), *[F.sum(c).alias(c) for c in CELLS]
    )
    return metrics_present(total).withColumnRenamed("n_rows", "rows_evaluated")


def latency_of_cells(cells: DataFrame, by: list[str]) -> DataFrame:
    """Per group and fraction of ``prefix_cells``, whose fractions end at 1: rows seen and whether the prefix holds an attack, an alarm, a hit."""
    attacks = F.max(F.col("tp") + F.col("fn")).over(Window.partitionBy(*by))
    return cells.select(
        *by, "fraction", "rows_seen", F.col("n_group").alias("scenario_rows_total"), attacks.alias("scenario_attack_rows_total"),
        (F.col("tp") + F.col("fn") > 0).alias("prefix_has_true_attack"),
        (F.col("tp") + F.col("fp") > 0).alias("prefix_has_predicted_attack"),
        (F.col("tp") > 0).alias("prefix_has_true_positive"),
    )


def prefix_metrics(df: DataFrame, fractions: list[float], by: list[str], order: list[str], y_true: str = "y_true", y_pred: str = "y_pred", group_limit: int | None = None) -> DataFrame:
    """Metrics of each fraction over all groups, with the detection rate of groups that hold attacks."""
    if not by:
        return prefix_metrics(whole(df), fractions, ["_all"], order, y_true, y_pred, group_limit)
    return metrics_of_cells(prefix_cells(df, fractions, by, order, cell_counts(y_true, y_pred), group_limit=group_limit), by)


def latency(df: DataFrame, fractions: list[float], by: list[str], order: list[str], y_true: str = "y_true", y_pred: str = "y_pred", group_limit: int | None = None) -> DataFrame:
    """Per group and fraction: rows seen and whether the prefix holds an attack, an alarm, a hit."""
    tops = sorted({*fractions, 1.0})
    cells = prefix_cells(df, tops, by, order, cell_counts(y_true, y_pred), group_limit=group_limit)
    return latency_of_cells(cells, by).where(F.col("fraction").isin(*map(float, fractions)))


def first_tp(table: DataFrame, by: list[str]) -> DataFrame:
    """Smallest fraction with a hit, null if there is none."""
    return table.groupBy(*by).agg(F.min(F.when(F.col("prefix_has_true_positive"), F.col("fraction"))).alias("first_true_positive_fraction"))


def first_tp_summary(table: DataFrame, by: list[str]) -> DataFrame:
    v = F.col("first_true_positive_fraction")
    return table.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count(v).alias("n_valid_rows"), F.avg(v).alias("mean_fraction"),
        F.percentile(v, 0.5).alias("median_fraction"), F.min(v).alias("min_fraction"), F.max(v).alias("max_fraction"),
    )


def detection_rate(table: DataFrame, by: list[str] = ("fraction",)) -> DataFrame:
    hit = F.avg(F.col("prefix_has_true_positive").cast("double"))
    return table.where("scenario_attack_rows_total > 0").groupBy(*by).agg(hit.alias("detection_rate"), F.count(F.lit(1)).alias("n_scenarios"))
