"""Structured Streaming forms of the running counters, first detections and log ingestion."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from flowlab.operators.metrics import cell_counts
from flowlab.sources.logs import parse_lines, prepare_flows, scenario_from_path


def event_time(ts: Column) -> Column:
    """Epoch seconds to a timestamp, for watermarks only."""
    return F.timestamp_micros(F.round(ts * 1_000_000).cast("long"))


def stream_confusion(scored: DataFrame, by: list[str] = ("scenario",), window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Confusion cells per event-time window and group; also runs on a batch table, as its twin."""
    timed = scored.withColumn("event_time", event_time(F.col("ts"))).withWatermark("event_time", late)
    out = timed.groupBy(F.window("event_time", window), *by).agg(*cell_counts())
    return out.select(F.unix_micros("window.start").alias("window_start_us"), *by, "tn", "fp", "fn", "tp")


def stream_first_tp(scored: DataFrame, by: list[str] = ("scenario",)) -> DataFrame:
    """Time and count of true positives per group; the state is one small row per group."""
    hit = (F.col("y_true") == 1) & (F.col("y_pred") == 1)
    return scored.groupBy(*by).agg(F.min(F.when(hit, F.col("ts"))).alias("first_tp_ts"), F.min("ts").alias("first_ts"), F.count_if(hit).alias("n_tp"), F.count(F.lit(1)).alias("n_rows"))


def run_to_table(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Drain what is there into parquet, exactly once."""
    return df.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_batches(df: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None], mode: str = "complete") -> StreamingQuery:
    """Hand every micro-batch to an idempotent writer keyed by its batch id."""
    return df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_ingest(spark: SparkSession, root: str, out: str, checkpoint: str, name: str = "conn.log.labeled", test: list[str] | None = None, val: list[str] | None = None, files_per_batch: int = 1000, scenario: Column | None = None) -> StreamingQuery:
    """New scenario logs to the split table: only files not seen before are read."""
    lines = (
        spark.readStream.format("text").schema("value string").option("recursiveFileLookup", True).option("pathGlobFilter", name)
        .option("maxFilesPerTrigger", files_per_batch).load(root).select("value", F.col("_metadata.file_path").alias("path"))
    )
    parsed = parse_lines(lines.withColumn("scenario", scenario_from_path(F.col("path")) if scenario is None else scenario))
    flows = prepare_flows(parsed, test, val)
    return flows.writeStream.foreachBatch(ingest_writer(out)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_writer(out: str) -> Callable[[DataFrame, int], None]:
    """Writes a micro-batch to a folder of its own, so that a batch which is run again replaces its rows.

    The rebalance hint packs a scenario's rows into few files and splits a hot one, whatever the number of tasks.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.hint("rebalance", "split", "scenario").write.mode("overwrite").partitionBy("split", "scenario").parquet(f"{out}/batch_id={batch_id}")

    return write
