"""Session helpers: the shared work folder and settled tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(master: str | None = None, partitions: int | None = None, driver_memory: str | None = None) -> SparkSession:
    """A session with the settings that results rely on.

    Master, shuffle partitions and memory are the cluster's own unless given, as bench and tests do.
    """
    builder = (
        SparkSession.builder.appName("flowlab")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.parquet.aggregatePushdown", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # The JVM leaves larger methods interpreted; beyond this size Spark splits the stage instead.
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master)
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    if driver_memory:
        builder = builder.config("spark.driver.memory", driver_memory)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: the session's ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder of its own machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    made = tempfile.mkdtemp(prefix="flowlab-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def work_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/flowlab/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder, so a lost executor costs a re-read and no re-fit."""
    spark = df.sparkSession
    folder = shared_dir(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()


def settle(df: DataFrame) -> DataFrame:
    """Fix a derived table, so that all later uses of it see the same rows.

    It is written once to the shared folder and read from there: nothing passes the
    driver, a lost executor costs a read, and Catalyst weighs the size on disk
    against its broadcast threshold.
    """
    target = work_path(df.sparkSession, "settled")
    df.write.parquet(target)
    return df.sparkSession.read.schema(df.schema).parquet(target)


def values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A literal lookup table."""
    return spark.createDataFrame(rows, schema)


def lit_map(mapping: dict):
    return F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
