"""Validation as tables of violations; an empty result means the input is sound."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlab.functions.labels import ALLOWED_PHASES


def _violations(counts: DataFrame, tests: dict[str, Column]) -> DataFrame:
    rows = [F.struct(F.lit(name).alias("violation"), c.cast("long").alias("n_rows")) for name, c in tests.items()]
    return counts.select(F.inline(F.array(*rows))).where("n_rows > 0")


def check_contract(df: DataFrame, required: list[str], not_null: list[str], key: list[str]) -> DataFrame:
    """Missing columns raise; null cells, repeated keys and an empty table are listed."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    one = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in not_null])
    found = _violations(one, {"empty_table": F.col("n") == 0, **{f"null_{c}": F.col(f"null_{c}") for c in not_null}})
    repeated = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    return found.unionByName(_violations(repeated, {"repeated_key": F.col("n")}))


def check_flows(df: DataFrame, scenario: str | None = None) -> DataFrame:
    """Label and phase domains, a constant scenario on request, and rows at all."""
    binary, phase = F.col("label_binary"), F.col("label_phase")
    tests = {"invalid_label_binary": F.count_if(binary.isNotNull() & ~binary.isin(0, 1)), "invalid_label_phase": F.count_if(phase.isNotNull() & ~phase.isin(*ALLOWED_PHASES))}
    if scenario is not None:
        tests["other_scenario"] = F.count_if(~F.col("scenario").eqNullSafe(F.lit(scenario)))
    one = df.agg(F.count(F.lit(1)).alias("n"), *[t.alias(name) for name, t in tests.items()])
    return _violations(one, {"empty_table": F.col("n") == 0, **{name: F.col(name) for name in tests}})


def check_splits(df: DataFrame, expected: DataFrame) -> DataFrame:
    """Scenarios in several splits, missing or unexpected scenarios, and a training part without benign rows."""
    per = df.groupBy("scenario", "split").agg(F.count_if(F.col("label_binary") == 0).alias("benign"))
    leaked = per.groupBy("scenario").agg(F.count_distinct("split").alias("n")).where("n > 1").select(F.lit("several_splits").alias("violation"), "scenario")
    seen, wanted = per.select("scenario").distinct(), expected.select("scenario").distinct()
    lost = wanted.join(seen, "scenario", "left_anti").select(F.lit("missing_scenario").alias("violation"), "scenario")
    extra = seen.join(wanted, "scenario", "left_anti").select(F.lit("unexpected_scenario").alias("violation"), "scenario")
    train = per.where("split = 'train'").agg(F.coalesce(F.sum("benign"), F.lit(0)).alias("n")).where("n = 0")
    none = train.select(F.lit("no_benign_training_rows").alias("violation"), F.lit(None).cast("string").alias("scenario"))
    return reduce(lambda a, b: a.unionByName(b), [leaked, lost, extra, none])


def check_matching(df: DataFrame, by: list[str], caps: list[str] = ()) -> DataFrame:
    """Seeds, fraction grid and row caps per group, for comparison across models."""
    return df.groupBy(*by).agg(
        F.count_distinct("seed").alias("n_seeds"), F.count_distinct("fraction").alias("fraction_count"), F.min("fraction").alias("min_fraction"),
        F.max("fraction").alias("max_fraction"), *[F.max(c).alias(c) for c in caps],
    )


def missing_runs(found: DataFrame, grid: DataFrame, keys: list[str]) -> DataFrame:
    """Expected runs that were not found, with the reason."""
    return grid.join(found.select(*keys), keys, "left_anti").select(*keys, F.lit("missing_from_summary").alias("reason"))
