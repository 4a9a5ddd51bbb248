"""Run bookkeeping: planning, matched selection, comparison tables."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowlab.operators.reports import grid_signature
from flowlab.session import values


def run_grid(spark: SparkSession, axes: dict[str, list], types: dict[str, str]) -> DataFrame:
    """All combinations of the given value lists, as a literal table."""
    return values(spark, list(product(*axes.values())), ", ".join(f"{c} {types[c]}" for c in axes))


def plan_runs(grid: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Runs still to do, with their folder name."""
    name = F.concat(F.lit("outputs_"), "direction", F.lit("_"), "model", F.lit("_seed"), F.col("seed").cast("string"))
    return grid.join(done.select(*keys).distinct(), keys, "left_anti").withColumn("run_name", name)


def study_caps(study: Column, direction: Column, source_cap: int, target_cap: int, sizes: dict[str, tuple[int, int]]) -> list[Column]:
    """Row caps of a study: its own (source, target) caps, or the default ones."""
    src, tgt = F.lit(source_cap), F.lit(target_cap)
    for name, (s, t) in sizes.items():
        src = F.when(study == name, F.lit(s)).otherwise(src)
        tgt = F.when(study == name, F.lit(t)).otherwise(tgt)
    return [src.alias("source_max_rows"), tgt.alias("target_max_rows")]


def select_best_runs(runs: DataFrame, group: str, model: str, run: str, caps: list[str], score: str = "f1_attack", later: str = "exp") -> DataFrame:
    """Per group: the grid signature shared by all models (most fractions, largest maximum and caps, smallest minimum),
    then each model's best full-fraction run, the later one on ties."""
    signed = grid_signature(runs, [group, model, run], caps)
    shape = ["fraction_count", "max_fraction", "min_fraction", *[f"signature_{c}" for c in caps]]
    models = runs.groupBy(group).agg(F.count_distinct(model).alias("n_models"))
    shared = signed.groupBy(group, *shape).agg(F.count_distinct(model).alias("n")).join(models, group).where("n = n_models")
    order = [F.desc("fraction_count"), F.desc("max_fraction"), *[F.desc(f"signature_{c}") for c in reversed(caps)], F.asc("min_fraction")]
    chosen = shared.withColumn("_rn", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where("_rn = 1").select(group, *shape)
    matched = signed.join(chosen, [group, *shape], "left_semi")
    full = runs.where(F.col("fraction") == 1.0).join(matched.select(group, model, run), [group, model, run], "left_semi")
    best = Window.partitionBy(group, model).orderBy(F.desc(score), F.desc(later))
    return full.withColumn("_rn", F.row_number().over(best)).where("_rn = 1").drop("_rn")


def final_comparison(runs: DataFrame, chosen: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    return runs.join(chosen.select(*keys), keys, "left_semi").select(*columns).orderBy(*columns[:3])


def config_rows(df: DataFrame, names: dict[str, list[str]]) -> DataFrame:
    """Row-count fields that go by several names: the first one that is neither missing nor 0."""
    return df.withColumns({out: F.coalesce(*[F.nullif(F.col(c), F.lit(0)) for c in given]) for out, given in names.items()})


def skip_table(pools: DataFrame) -> DataFrame:
    """Condition and reason of pairs that cannot be run because a pool holds one class only."""
    def single(p: str) -> Column:
        return (F.col(f"{p}_n_benign") == 0) | (F.col(f"{p}_n_attack") == 0)

    condition = F.when(single("source"), "skipped_invalid_source").when(single("target_train"), "skipped_invalid_target_train").when(single("target_test"), "skipped_invalid_target_test").otherwise("valid")
    reason = F.when(single("source"), "source_train_single_class").when(single("target_train"), "target_train_single_class").when(single("target_test"), "target_test_single_class")
    return pools.withColumns({"condition": condition, "skip_reason": reason})
