"""Audits and profiles.

Most reports need only label counts, so they start from ``label_stats``: one
map-side combined count over low-cardinality keys that every other report
re-aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlab.functions.clean import pct, safe_div, to_double
from flowlab.functions.labels import attack_family, is_benign
from flowlab.operators.order import column_quantiles, whole
from flowlab.session import settle
from flowlab.schemas import CATEGORICAL

LABEL_KEYS = ["scenario", "split", "label", "detailed_label", "label_phase", "label_binary"]
N = F.sum  # counts of counts


def count_rows(name: str = "n_rows") -> Column:
    return F.count(F.lit(1)).alias(name)


def one_row(df: DataFrame, cols: list[str]) -> dict[str, Column]:
    """The cells of a one-row table as scalar columns for another table."""
    row = df.select(F.struct(*cols)).scalar()
    return {c: row[c] for c in cols}


def label_stats(df: DataFrame) -> DataFrame:
    return df.groupBy(*LABEL_KEYS).agg(count_rows("count"))


def label_mapping(df: DataFrame) -> DataFrame:
    return df.groupBy("label", "detailed_label", "label_phase", "label_binary").agg(count_rows("count")).orderBy(F.desc("count"), "label", "detailed_label")


def scenario_summary(df: DataFrame) -> DataFrame:
    def n_if(test: Column, name: str) -> Column:
        return F.count_if(test).alias(name)

    return df.groupBy("scenario").agg(
        F.min("split").alias("split"), count_rows(), n_if(F.col("label_binary") == 0, "n_benign"), n_if(F.col("label_binary") == 1, "n_malicious"),
        n_if(F.col("ts").isNull(), "n_unknown_ts"), n_if(F.col("duration") == 0, "n_zero_duration"), n_if(F.col("label") == "unknown", "n_unknown_label"),
        n_if(F.col("detailed_label") == "unknown", "n_unknown_detailed_label"), n_if(F.col("label_phase") == "other_malicious", "n_other_malicious"),
        F.coalesce(F.min("ts"), F.lit(0.0)).alias("ts_min"), F.coalesce(F.max("ts"), F.lit(0.0)).alias("ts_max"),
    )


def _count_map(counts: DataFrame, by: str, key: str, name: str) -> DataFrame:
    per = counts.groupBy(by, F.col(key).cast("string").alias("k")).agg(F.sum("count").alias("n"))
    return per.groupBy(by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n")))).alias(name))


def split_summary(df: DataFrame) -> DataFrame:
    """Rows, sorted scenario list and class and phase counts as maps, per split."""
    counts = df.groupBy("split", "scenario", "label_binary", "label_phase").agg(count_rows("count"))
    base = counts.groupBy("split").agg(
        F.sum("count").alias("n_rows"), F.count_distinct("scenario").alias("n_scenarios"), F.array_sort(F.collect_set("scenario")).alias("scenarios")
    )
    return base.join(_count_map(counts, "split", "label_binary", "label_binary_counts"), "split").join(
        _count_map(counts, "split", "label_phase", "label_phase_counts"), "split"
    )


def pivot_quantiles(df: DataFrame, by: list[str], value: str, probs: dict[str, float], group_limit: int | None = None, sizes: DataFrame | None = None) -> DataFrame:
    """Exact quantiles as named columns."""
    return column_quantiles(df, by, [value], probs, group_limit, sizes).drop("feature")


def counted_rows(counts: DataFrame) -> DataFrame:
    """The size of the whole table, from counts that were taken already."""
    return whole(counts).groupBy("_all").agg(F.sum("n").alias("n_group"))


QUALITY_PROBS = {"p00": 0.0, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99, "p100": 1.0}


def quality_report(df: DataFrame, group_limit: int | None = None) -> DataFrame:
    """Counts of suspicious rows, duration quantiles and category counts (null counts as a value).

    Rows are first counted per combination of the categorical columns; distinct
    values are then taken over that small table.
    """
    zero_traffic = (F.col("orig_bytes") == 0) & (F.col("resp_bytes") == 0) & (F.col("orig_pkts") == 0) & (F.col("resp_pkts") == 0)
    tests = {
        "n_missing_ts": F.col("ts").isNull(), "n_zero_duration": F.col("duration") == 0, "n_unknown_label": F.col("label") == "unknown",
        "n_unknown_detailed_label": F.col("detailed_label") == "unknown", "n_other_malicious": F.col("label_phase") == "other_malicious",
        "n_all_zero_traffic_rows": zero_traffic,
    }
    combos = settle(df.groupBy("scenario", *CATEGORICAL).agg(count_rows("n"), *[F.count_if(t).alias(c) for c, t in tests.items()]))
    kinds = [(F.count_distinct(c) + F.max(F.col(c).isNull().cast("long"))).alias(f"cardinality_{c}") for c in CATEGORICAL]
    counts = combos.agg(F.sum("n").alias("n_rows_total"), F.count_distinct("scenario").alias("n_scenarios_total"), *[F.sum(c).alias(c) for c in tests], *kinds)
    spans = pivot_quantiles(whole(df), ["_all"], "duration", QUALITY_PROBS, group_limit, counted_rows(combos))
    return counts.withColumns(one_row(spans, list(QUALITY_PROBS)))


def numeric_describe(df: DataFrame, cols: list[str]) -> DataFrame:
    """Mean, sample std, bounds and null count of every numeric column, from one wide aggregate."""
    wide = df.agg(*[
        F.struct(
            F.lit(c).alias("feature"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).cast("double").alias("min"),
            F.max(c).cast("double").alias("max"), F.count_if(F.col(c).isNull()).alias("n_null"),
        ).alias(c) for c in cols
    ])
    return wide.select(F.inline(F.array(*cols)))


def top_categories(df: DataFrame, cols: list[str], n: int = 30) -> DataFrame:
    """Most frequent values of each column; ties by value."""
    counts = df.groupBy(*cols).agg(count_rows("n")).unpivot(["n"], cols, "feature", "value").groupBy("feature", "value").agg(F.sum("n").alias("count"))
    best = Window.partitionBy("feature").orderBy(F.desc("count"), F.asc_nulls_last("value"))
    return counts.withColumn("_rn", F.row_number().over(best)).where(F.col("_rn") <= n).drop("_rn")


def data_summary(df: DataFrame, group_limit: int | None = None) -> DataFrame:
    """Key-value summary: counts, percentages (4 places) and duration statistics (6 places)."""
    counts = settle(df.groupBy(*LABEL_KEYS).agg(
        count_rows("n"), F.count_if(F.col("duration") == 0).alias("zero"), F.count_if(F.col("ts").isNull()).alias("no_ts"),
    ))
    bad = F.col("label_binary") == 1

    def total(test: Column) -> Column:
        return F.sum(F.when(test, F.col("n")).otherwise(0))

    def kinds(c: str) -> Column:
        return F.count_distinct(F.when(bad & (F.col(c) != "unknown"), F.col(c)))

    n = F.sum("n")
    flows = counts.agg(
        n.alias("total_flows"), F.count_distinct("scenario").alias("total_scenarios"), total(~bad).alias("benign_flows"), total(bad).alias("malicious_flows"),
        *[total(F.col("split") == s).alias(f"{s}_flows") for s in ("train", "val", "test")], kinds("detailed_label").alias("unique_attack_types_detailed_label"),
        kinds("label_phase").alias("unique_attack_types_label_phase"), F.sum("zero").alias("zero_duration_flows"), F.sum("no_ts").alias("missing_timestamps"),
    )
    parts = {"benign_flows": "benign_percentage", "malicious_flows": "malicious_percentage", "train_flows": "train_percentage", "val_flows": "val_percentage",
             "test_flows": "test_percentage", "zero_duration_flows": "zero_duration_percentage", "missing_timestamps": "missing_timestamp_percentage"}
    flows = flows.withColumns({name: F.round(pct(F.col(c), F.col("total_flows")), 4) for c, name in parts.items()})
    spans = pivot_quantiles(whole(df), ["_all"], "duration", {"duration_median": 0.5, "duration_p95": 0.95, "duration_p99": 0.99}, group_limit, counted_rows(counts))
    stats = df.agg(F.avg("duration").alias("duration_mean"), F.stddev_samp("duration").alias("duration_std"))
    durations = one_row(spans, ["duration_median", "duration_p95", "duration_p99"]) | one_row(stats, ["duration_mean", "duration_std"])
    one = flows.withColumns({c: F.round(F.coalesce(v, F.lit(0.0)), 6) for c, v in durations.items()})
    return one.select([F.col(c).cast("double").alias(c) for c in one.columns]).unpivot([], one.columns, "metric", "value")


def _durations(df: DataFrame, by: str, probs: dict[str, float], group_limit: int | None) -> DataFrame:
    means = settle(df.groupBy(by).agg(
        count_rows("n_flows"), F.count_if(F.col("label_binary") == 0).alias("n_benign"), F.count_if(F.col("label_binary") == 1).alias("n_malicious"),
        F.avg("duration").alias("duration_mean"), F.coalesce(F.min("ts"), F.lit(0.0)).alias("ts_min"), F.coalesce(F.max("ts"), F.lit(0.0)).alias("ts_max"),
        F.count_if(F.col("duration") == 0).alias("n_zero_duration"), F.min("split").alias("split_name"),
    ))
    joined = means.join(pivot_quantiles(df, [by], "duration", probs, group_limit, means.select(by, F.col("n_flows").alias("n_group"))), by)
    shares = {f"pct_{k}": F.round(pct(F.col(f"n_{k}"), F.col("n_flows")), 4) for k in ("benign", "malicious")}
    return joined.withColumns(shares | {c: F.round(c, 6) for c in ["duration_mean", *probs]})


DURATION_PROBS = {"duration_median": 0.5, "duration_p95": 0.95}


def scenario_statistics(df: DataFrame, group_limit: int | None = None) -> DataFrame:
    """Per scenario: classes, attack types, the most common one (ties by name), durations and time span."""
    kinds = label_stats(df).where("label_binary = 1 and detailed_label <> 'unknown'").groupBy("scenario", "detailed_label").agg(F.sum("count").alias("c"))
    modes = kinds.groupBy("scenario").agg(
        F.count(F.lit(1)).alias("n_unique_attack_types"), F.min_by("detailed_label", F.struct(-F.col("c"), F.col("detailed_label"))).alias("most_common_attack_type")
    )
    out = _durations(df, "scenario", DURATION_PROBS, group_limit).withColumnRenamed("split_name", "split")
    return out.join(modes, "scenario", "left").fillna({"n_unique_attack_types": 0, "most_common_attack_type": "none"})


def split_statistics(df: DataFrame, group_limit: int | None = None) -> DataFrame:
    scenarios = df.groupBy("split", "scenario").agg(count_rows("n")).groupBy("split").agg(F.count(F.lit(1)).alias("n_scenarios"))
    out = _durations(df, "split", DURATION_PROBS, group_limit).drop("split_name", "ts_min", "ts_max", "n_zero_duration")
    return out.join(scenarios, "split")


def distribution(df: DataFrame, col: str) -> DataFrame:
    """Counts and percent of all rows given."""
    counts = df.groupBy(F.coalesce(F.col(col), F.lit("unknown")).alias(col)).agg(count_rows("count"))
    total = counts.agg(F.sum("count")).scalar()
    return counts.select(col, "count", F.round(pct(F.col("count"), total), 4).alias("percentage"))


def attack_type_counts(df: DataFrame, label: str = "detailed_label") -> DataFrame:
    counts = df.groupBy("scenario", F.col(label).alias("label")).agg(count_rows("flow_count"))
    totals = counts.groupBy("scenario").agg(F.sum("flow_count").alias("_n"))
    return counts.join(totals, "scenario").select(
        "scenario", "label", attack_family(F.col("label")).alias("attack_family"), "flow_count", (F.col("flow_count") / F.col("_n")).alias("ratio_within_scenario")
    )


def scenario_stats(df: DataFrame, label: str = "detailed_label", binary: str = "label_binary") -> DataFrame:
    """Ratios, label counts and the dominant attack type ("none" when benign only; ties by name)."""
    counts = df.groupBy("scenario", F.col(label).alias("label"), F.col(binary).alias("b")).agg(count_rows("n"))
    labels = counts.groupBy("scenario", "label").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("b") == 0, F.col("n")).otherwise(0)).alias("benign"))
    attack = ~is_benign(F.col("label"))
    top = F.max(F.when(attack, F.col("n")))
    out = labels.groupBy("scenario").agg(
        F.sum("n").alias("total_flows"), F.sum("benign").alias("benign_flows"), F.count(F.lit(1)).alias("num_unique_labels"), F.count_if(attack).alias("num_attack_types"),
        F.min_by(F.when(attack, F.col("label")), F.when(attack, F.struct(-F.col("n"), F.col("label")))).alias("dominant_attack_type"), top.alias("dominant_attack_type_count"),
    ).fillna({"dominant_attack_type": "none", "dominant_attack_type_count": 0})
    out = out.withColumn("malicious_flows", F.col("total_flows") - F.col("benign_flows"))
    return out.withColumns({
        "benign_ratio": safe_div(F.col("benign_flows"), F.col("total_flows")), "malicious_ratio": safe_div(F.col("malicious_flows"), F.col("total_flows")),
        "dominant_attack_type_ratio_within_scenario": safe_div(F.col("dominant_attack_type_count"), F.col("total_flows")),
    })


def global_labels(df: DataFrame, label: str = "detailed_label") -> DataFrame:
    counts = df.groupBy(F.col(label).alias("label")).agg(count_rows("flow_count"))
    total = counts.agg(F.sum("flow_count")).scalar()
    return counts.select("label", attack_family(F.col("label")).alias("attack_family"), "flow_count", (F.col("flow_count") / total).alias("global_ratio"))


def feature_summary(df: DataFrame, cols: list[str], by: str = "scenario", group_limit: int | None = None) -> DataFrame:
    """Population statistics and exact quantiles per group and feature; NaN and infinities are left out."""
    usable = df.select(by, *[to_double(F.col(c).cast("string"), finite=True).alias(c) if dict(df.dtypes)[c] == "string" else
                             F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c).cast("double")).alias(c) for c in cols])
    wide = settle(usable.groupBy(by).agg(count_rows("n_group"), *[
        F.struct(
            F.lit(c).alias("feature"), F.count(c).alias("non_null_count"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max")
        ).alias(c) for c in cols
    ]))
    stats = wide.select(by, F.inline(F.array(*cols))).where("non_null_count > 0")
    stats = stats.withColumn("cv", F.try_divide(F.col("std"), F.abs("mean")))
    spans = column_quantiles(usable, [by], cols, {"q25": 0.25, "median": 0.5, "q75": 0.75, "p95": 0.95}, group_limit, wide.select(by, "n_group"))
    return stats.join(spans, [by, "feature"])


def feature_shift(summary: DataFrame) -> DataFrame:
    """How far each feature's scenario means lie apart."""
    out = summary.groupBy("feature").agg(
        F.count(F.lit(1)).alias("n_scenarios_present"), F.avg("mean").alias("mean_of_scenario_means"), F.stddev_pop("mean").alias("scenario_mean_std"),
        (F.max("mean") - F.min("mean")).alias("scenario_mean_range"), (F.percentile("mean", 0.75) - F.percentile("mean", 0.25)).alias("scenario_mean_iqr"),
        F.stddev_pop("median").alias("scenario_median_std"), F.avg("std").alias("mean_of_within_scenario_std"),
    )
    return out.withColumn("mean_cv_across_scenarios", F.try_divide(F.col("scenario_mean_std"), F.abs("mean_of_scenario_means"))).orderBy(
        F.desc_nulls_last("mean_cv_across_scenarios"), F.desc("scenario_mean_std"), "feature"
    )


def label_shift(df: DataFrame, label: str = "detailed_label") -> DataFrame:
    """Spread of label ratios over all scenarios; an absent label counts as ratio 0.

    Absent scenarios enter the sums as (n - present) zeros, so no scenario x
    label grid is built.
    """
    ratios = attack_type_counts(df, label)
    ratios = ratios.withColumns({"r": F.col("ratio_within_scenario"), "n": ratios.agg(F.count_distinct("scenario")).scalar()})
    means = ratios.groupBy("label").agg((F.sum("r") / F.first("n")).alias("m"))
    present, m = F.count(F.lit(1)), F.first("m")
    absent = F.first("n") - present
    spread = F.sqrt((F.sum(F.pow(F.col("r") - F.col("m"), 2)) + absent * m * m) / F.first("n"))
    lowest = F.when(absent > 0, 0.0).otherwise(F.min("r"))
    out = ratios.join(means, "label").groupBy("label", "attack_family").agg(
        m.alias("mean_ratio_across_scenarios"), spread.alias("std_ratio_across_scenarios"), F.max("r").alias("max_ratio"), lowest.alias("min_ratio")
    )
    return out.withColumns({
        "cv_ratio_across_scenarios": F.try_divide(F.col("std_ratio_across_scenarios"), F.abs("mean_ratio_across_scenarios")),
        "range_ratio": F.col("max_ratio") - F.col("min_ratio"),
    })


def dataset_summary(stats: DataFrame) -> DataFrame:
    return stats.agg(
        F.count(F.lit(1)).alias("n_scenarios"), F.sum("total_flows").alias("total_flows"), F.sum("benign_flows").alias("total_benign"),
        F.sum("malicious_flows").alias("total_malicious"), F.max("total_flows").alias("max_scenario_flows"), F.min("total_flows").alias("min_scenario_flows"),
        F.avg("malicious_ratio").alias("mean_malicious_ratio"), F.stddev_pop("malicious_ratio").alias("std_malicious_ratio"),
    )


def group_counts(df: DataFrame, cols: list[str], split: str = "split", label: str = "label") -> DataFrame:
    """Class counts for several single groupings: rows are counted per combination once, then unfolded."""
    combos = df.groupBy(split, *cols).agg(count_rows("n"), F.sum(F.col(label).cast("long")).alias("a"))
    words = combos.select(split, "n", "a", *[F.trim(F.coalesce(F.col(c).cast("string"), F.lit("missing"))).alias(c) for c in cols])
    long = words.unpivot([split, "n", "a"], cols, "grouping", "group_value").where("group_value <> ''")
    out = long.groupBy("grouping", "group_value", F.col(split).alias("split")).agg(F.sum("n").alias("n_rows"), F.sum("a").alias("n_attack"))
    return out.withColumn("n_benign", F.col("n_rows") - F.col("n_attack"))


def class_counts(df: DataFrame, by: list[str] = (), label: str = "label_binary") -> DataFrame:
    """Class sizes, the weight n_neg/n_pos (1 without positives, at least 1e-6) and the both-classes test."""
    out = df.groupBy(*by).agg(F.count_if(F.col(label) == 0).alias("n_benign"), F.count_if(F.col(label) == 1).alias("n_attack"))
    weight = F.when(F.col("n_attack") == 0, 1.0).otherwise(F.greatest(F.try_divide(F.col("n_benign").cast("double"), F.col("n_attack").cast("double")), F.lit(1e-6)))
    return out.withColumns({"scale_pos_weight": weight, "has_both_classes": (F.col("n_benign") > 0) & (F.col("n_attack") > 0)})


def label_counts(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"))


def inspect(df: DataFrame) -> DataFrame:
    """Type and null count of every column."""
    wide = df.agg(*[F.struct(F.lit(c).alias("column"), F.lit(t).alias("dtype"), F.count_if(F.col(c).isNull()).alias("n_null")).alias(c) for c, t in df.dtypes])
    return wide.select(F.inline(F.array(*df.columns)))
