"""Labelled connection logs: discovery, parsing, incremental-friendly cleaning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlab.functions.clean import clean_flows
from flowlab.functions.labels import assign_labels, assign_split
from flowlab.schemas import LOG_FIELDS

MIN_FIELDS = 21
LOG_NAME = "conn.log.labeled"


def scenario_from_path(path: Column) -> Column:
    """The nearer of the two folders above ``bro`` that starts with CTU-, else the folder above the file's own."""
    def folder(pattern: str) -> Column:
        return F.nullif(F.regexp_extract(path, pattern, 1), F.lit(""))

    near = folder(r"/(CTU-[^/]*)/bro/[^/]*$")
    far = folder(r"/(CTU-[^/]*)/[^/]+/bro/[^/]*$")
    return F.coalesce(near, far, folder(r"([^/]+)/[^/]+/[^/]*$"))


def tail_parts(tail: Column) -> Column:
    """Non-empty parts of the packed last field, split on runs of three or more blanks."""
    return F.filter(F.transform(F.split(F.trim(tail), r"\s{3,}"), lambda p: F.trim(p)), lambda p: p != "")


def data_fields(value: Column) -> Column:
    """The TAB fields of a data line in a one-element array; empty for comments, blank and short lines.

    Exploding it drops the other lines and splits each line once: a filter on
    the split fields would be pushed below the split and repeat it.
    """
    def usable(f: Column) -> Column:
        return (F.size(f) >= MIN_FIELDS) & ~f[0].startswith("#") & F.exists(f, lambda x: F.trim(x) != "")

    return F.filter(F.array(F.split(value, "\t")), usable)


def parse_lines(lines: DataFrame, keep: list[str] = ("scenario",), value: str = "value") -> DataFrame:
    """TAB fields to named strings; lines with fewer than 21 fields are left out."""
    parts = lines.select(*keep, F.explode(data_fields(F.col(value))).alias("_f"))
    packed = parts.withColumn("_t", tail_parts(F.col("_f")[20]))
    named = [F.col("_f")[i].alias(name) for i, name in enumerate(LOG_FIELDS)]
    tail = [F.coalesce(F.get("_t", F.lit(i)), F.lit("-")).alias(n) for i, n in enumerate(["tunnel_parents", "label", "detailed_label"])]
    return packed.select(*keep, *named, *tail)


def line_audit(lines: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """Lines seen, comment lines, malformed and parsed rows."""
    text = F.col(value)
    blank, comment = F.trim(text) == "", text.startswith("#")
    data = ~blank & ~comment
    fields = F.size(F.split(text, "\t"))
    return lines.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_lines"), F.count_if(comment).alias("n_comments"),
        F.count_if(data & (fields < MIN_FIELDS)).alias("n_malformed"), F.count_if(data & (fields >= MIN_FIELDS)).alias("n_parsed"),
    )


def read_log_lines(spark: SparkSession, root: str, name: str = LOG_NAME) -> DataFrame:
    """Every log below ``root``, with its path and scenario; files are split by Spark's own partitioning."""
    text = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", name).text(root)
    path = F.col("_metadata.file_path")
    return text.select("value", path.alias("path")).withColumn("scenario", scenario_from_path(F.col("path")))


def zeek_scan(spark: SparkSession, root: str, name: str = LOG_NAME) -> DataFrame:
    return parse_lines(read_log_lines(spark, root, name))


def prepare_flows(parsed: DataFrame, test: list[str] | None = None, val: list[str] | None = None) -> DataFrame:
    """Parsed strings to the labelled, split flow table, in one narrow stage."""
    return assign_labels(clean_flows(parsed)).withColumn("split", assign_split(F.col("scenario"), test, val))
