"""Crawls over folders of run results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlab.sources.tables import csv_by_name

# The run folder grammars.
SEED_RUN = r"outputs_(?<direction>.+)_(?<model>rf|mlp)_seed(?<seed>\d+)"
STUDY_RUN = r"outputs_(?<direction>.+)_(?<model>rf|mlp)_(?<study>train_size|eval_size|[a-z_]+?)_seed(?<seed>\d+)"
EXPERIMENT_RUN = r"outputs_(?<dataset>iot23|unsw)(?<mlp>_mlp)?_exp(?<exp>\d+)"

RUN_CONFIG = "source_train_rows bigint, target_val_rows bigint, target_test_rows bigint, seed bigint"


def group_names(pattern: str) -> list[str]:
    import re

    return re.findall(r"\(\?<([a-z]+)>", pattern)


def parse_run_name(name: Column, pattern: str = SEED_RUN) -> list[Column]:
    return [F.nullif(F.regexp_extract(name, pattern, i + 1), F.lit("")).alias(g) for i, g in enumerate(group_names(pattern))]


def folder_of(path: Column) -> Column:
    """Name of the run folder that holds a file, also when it is written as run=<name>."""
    return F.regexp_extract(F.url_decode(path), r"/(?:run=)?([^/=]+)/[^/]+$", 1)


def crawl_runs(spark: SparkSession, summary_root: str, config_root: str, schema: str, pattern: str = SEED_RUN) -> DataFrame:
    """Summary rows of every run folder beside the parsed name parts and the run's config."""
    path = F.col("_metadata.file_path")
    rows = csv_by_name(spark, summary_root, schema, recursive=True)
    rows = rows.withColumn("run_name", folder_of(path)).drop("_metadata")
    configs = spark.read.option("recursiveFileLookup", True).schema(RUN_CONFIG).json(config_root)
    configs = configs.select(folder_of(path).alias("run_name"), *[F.col(f.strip().split()[0]).alias(f.strip().split()[0] + "_config") for f in RUN_CONFIG.split(",")])
    named = rows.select(*parse_run_name(F.col("run_name"), pattern), "*")
    return named.where(F.col(group_names(pattern)[0]).isNotNull()).join(configs, "run_name")


def run_inventory(rows: DataFrame, keys: list[str]) -> DataFrame:
    fractions = F.array_sort(F.collect_set("fraction"))
    return rows.groupBy("run_name", *keys).agg(
        F.array_join(F.transform(fractions, lambda x: x.cast("string")), ",").alias("fractions"), F.count_distinct("fraction").alias("fraction_count"),
        F.first("source_train_rows_config").alias("source_train_rows_config"), F.first("target_test_rows_config").alias("target_test_rows_config"),
    )


def crawl_folds(spark: SparkSession, root: str, schema: str, multi_line: bool = True) -> DataFrame:
    """One row per fold JSON; ``multi_line`` reads indented files, one document each."""
    return spark.read.option("recursiveFileLookup", True).option("multiLine", multi_line).schema(schema).json(root)


def crawl_importances(spark: SparkSession, root: str) -> DataFrame:
    """Long (fold_name, feature, importance) from one CSV folder per fold; repeated features are summed."""
    rows = csv_by_name(spark, root, "feature string, importance double", recursive=True)
    named = rows.select(folder_of(F.col("_metadata.file_path")).alias("fold_name"), "feature", "importance")
    return named.groupBy("fold_name", "feature").agg(F.sum("importance").alias("importance"))
