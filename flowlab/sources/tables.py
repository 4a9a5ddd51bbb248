"""Parquet, CSV and JSON scans and sinks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from flowlab.functions.clean import to_double
from flowlab.schemas import FLOW_TYPES, PRED_SCHEMA


def read_flows(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    return spark.read.parquet(path).select(*columns)


def typed_scan(df: DataFrame, numeric: list[str], categorical: list[str], target: str, keep: list[str] = ()) -> DataFrame:
    """float32 numbers, filled text and an int8 target, in the scan's own projection."""
    numbers = [to_double(F.col(c).cast("string")).cast("float").alias(c) for c in numeric]
    words = [F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias(c) for c in categorical]
    label = F.coalesce(F.col(target).cast("string").try_cast("double").try_cast("tinyint"), F.lit(0).cast("tinyint")).alias(target)
    return df.select(*keep, *numbers, *words, label)


def csv_by_name(spark: SparkSession, path: str, schema: str, recursive: bool = False) -> DataFrame:
    """CSV columns matched to the declared schema by the header's names.

    The files' own header decides where a column stands; other columns are left out.
    A declared column that the header lacks raises an error; a value that does not
    fit its type is null. Files of one scan share a header; a file whose header
    differs from the first one's fails the job instead of being misread.
    """
    reader = spark.read.option("recursiveFileLookup", recursive)
    text = reader.csv(path, header=True, inferSchema=False, enforceSchema=False)
    wanted = StructType.fromDDL(schema).fields
    there = {c.strip().lower(): c for c in text.columns}
    missing = [f.name for f in wanted if f.name.lower() not in there]
    if missing:
        raise ValueError(f"columns missing in {path}: {', '.join(missing)}")
    return text.select("*", "_metadata").select(*[F.col(f"`{there[f.name.lower()]}`").try_cast(f.dataType).alias(f.name) for f in wanted], "_metadata")


def read_csv_cols(spark: SparkSession, path: str, schema: str, columns: list[str]) -> DataFrame:
    """Declared types, never inferred; only the chosen columns have to be there."""
    kinds = {f.name: f.dataType.simpleString() for f in StructType.fromDDL(schema).fields}
    return csv_by_name(spark, path, ", ".join(f"{c} {kinds[c]}" for c in columns)).select(*columns)


def filtered_csv(spark: SparkSession, path: str, schema: str, col: str, value: str) -> DataFrame:
    rows = csv_by_name(spark, path, schema).drop("_metadata")
    return rows.where(F.trim(F.coalesce(F.col(col).cast("string"), F.lit("missing"))) == value)


def union_all(*dfs: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def write_flows(df: DataFrame, path: str) -> None:
    """One folder per split and scenario, so later reads of a scenario prune to its folder.

    The rebalance hint gathers a folder's rows into few well-sized files; its
    adaptive skew rule splits a scenario with a third of all rows over many tasks.
    """
    df.hint("rebalance", "split", "scenario").write.mode("overwrite").partitionBy("split", "scenario").parquet(path)


def normalize_schema(df: DataFrame, scenario: str | None = None, split: str | None = None) -> DataFrame:
    """The 22 flow columns in their declared types, scenario and split overwritten on request."""
    if scenario is not None:
        df = df.withColumn("scenario", F.lit(scenario))
    if split is not None:
        df = df.withColumn("split", F.lit(split))
    return df.select(*[F.col(c).try_cast(t).alias(c) for c, t in FLOW_TYPES.items()])


def class_count_audit(df: DataFrame) -> DataFrame:
    return df.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("label_binary") == 0).alias("n_benign"), F.count_if(F.col("label_binary") == 1).alias("n_malicious")
    )


def prediction_columns(df: DataFrame, target: str = "y_true", y_pred: str = "y_pred", score: str = "y_score") -> DataFrame:
    return df.select(
        F.col("scenario").cast("string"), F.col(target).cast("tinyint").alias("label_binary"),
        F.col(y_pred).cast("tinyint").alias("y_pred"), F.col(score).cast("float").alias("y_score"),
    )


def write_predictions(df: DataFrame, path: str, **names: str) -> None:
    prediction_columns(df, **names).write.mode("overwrite").parquet(path)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PRED_SCHEMA).parquet(path)


def write_table(df: DataFrame, path: str, fmt: str = "csv") -> None:
    if fmt not in ("csv", "json"):
        raise ValueError(f"unknown format: {fmt}")
    writer = df.write.mode("overwrite")
    writer.option("header", True).csv(path) if fmt == "csv" else writer.json(path)


def row_count(spark: SparkSession, path: str) -> DataFrame:
    """No column is read: parquet counts come from the file footers."""
    return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n_rows"))
