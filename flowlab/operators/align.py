"""Schema alignment between two flow domains."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlab.session import values

# The curated alignment (aligned name, first domain, second domain, status, match type, semantic group).
ALIGNMENT = [
    ("protocol", "proto", "proto", "accepted", "direct_name_match", "categorical_flow_metadata"),
    ("service", "service", "service", "accepted_with_normalization", "direct_name_match", "categorical_flow_metadata"),
    ("connection_state", "conn_state", "state", "review_required", "semantic_candidate", "connection_state"),
    ("flow_duration", "duration", "dur", "accepted", "semantic_candidate", "time"),
    ("source_to_destination_packets", "orig_pkts", "spkts", "accepted", "semantic_candidate", "traffic_volume"),
    ("destination_to_source_packets", "resp_pkts", "dpkts", "accepted", "semantic_candidate", "traffic_volume"),
    ("source_to_destination_bytes", "orig_bytes", "sbytes", "accepted", "semantic_candidate", "traffic_volume"),
    ("destination_to_source_bytes", "resp_bytes", "dbytes", "accepted", "semantic_candidate", "traffic_volume"),
    ("source_mean_bytes_per_packet", "orig_bytes_per_pkt", "smean", "accepted", "derived_semantic_candidate", "traffic_intensity"),
    ("destination_mean_bytes_per_packet", "resp_bytes_per_pkt", "dmean", "accepted", "derived_semantic_candidate", "traffic_intensity"),
    ("bidirectional_byte_ratio", "bytes_ratio", None, "rejected_no_unsw_match", "iot23_only", "derived_ratio"),
    ("bidirectional_packet_ratio", "pkts_ratio", None, "rejected_no_unsw_match", "iot23_only", "derived_ratio"),
    ("source_ip_bytes", "orig_ip_bytes", None, "rejected_no_unsw_match", "iot23_only", "traffic_volume"),
    ("destination_ip_bytes", "resp_ip_bytes", None, "rejected_no_unsw_match", "iot23_only", "traffic_volume"),
    ("missed_bytes", "missed_bytes", None, "rejected_no_unsw_match", "iot23_only", "capture_artifact"),
]
ACCEPTED = ["accepted", "accepted_with_normalization"]
ALIGNMENT_SCHEMA = "aligned_feature string, iot23_feature string, unsw_feature string, status string, match_type string, semantic_group string"


def alignment_table(spark: SparkSession) -> DataFrame:
    return values(spark, ALIGNMENT, ALIGNMENT_SCHEMA)


def status_summary(table: DataFrame) -> DataFrame:
    kind = F.when(F.col("status").startswith("accepted"), "accepted").when(F.col("status").startswith("rejected"), "rejected").otherwise("review")
    return table.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n_features"))


def accepted_features(table: DataFrame, include_review: bool = False) -> DataFrame:
    return table.where(F.col("status").isin(*ACCEPTED, *(["review_required"] if include_review else [])))


def mapping(domain: str, include_review: bool = False) -> dict[str, str]:
    """Native column -> aligned name of one domain ("iot23" or "unsw")."""
    at = {"iot23": 1, "unsw": 2}[domain]
    kept = [*ACCEPTED, *(["review_required"] if include_review else [])]
    return {row[at]: row[0] for row in ALIGNMENT if row[3] in kept}


def align(df: DataFrame, names: dict[str, str], meta: list[str] = (), numeric_as: str = "double") -> DataFrame:
    """Mapped columns under their aligned names beside the label and meta columns; a missing column raises."""
    missing = [c for c in [*names, *meta] if c not in df.columns]
    if missing:
        raise ValueError(f"missing aligned columns: {missing}")
    types = dict(df.dtypes)
    cols = [F.col(c) if types[c] == "string" else F.col(c).cast(numeric_as) for c in names]
    return df.select(*meta, *[c.alias(n) for c, n in zip(cols, names.values())])


def missing_columns(table: DataFrame, columns: DataFrame, feature: str) -> DataFrame:
    """Mapped columns that the domain's exported column list does not hold; empty when the alignment is valid."""
    used = table.where(F.col(feature).isNotNull()).select(F.col(feature).alias("column"), "aligned_feature")
    return used.join(columns, "column", "left_anti")


def column_list(df: DataFrame) -> DataFrame:
    return values(df.sparkSession, [(c,) for c in df.columns], "column string")


def validate_alignment(table: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    a = missing_columns(table, column_list(first), "iot23_feature").withColumn("domain", F.lit("iot23"))
    return a.unionByName(missing_columns(table, column_list(second), "unsw_feature").withColumn("domain", F.lit("unsw")))


def coverage(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Known values per aligned feature, from one aggregate."""
    wide = df.agg(*[F.struct(F.lit(n).alias("aligned_feature"), F.count(c).alias("n_known"), F.approx_count_distinct(c).alias("_d")).alias(c) for c, n in names.items()])
    return wide.select(F.inline(F.array(*names))).drop("_d")


def compare_sets(a: DataFrame, b: DataFrame, col: str) -> DataFrame:
    """Members of either one-column set, with where they were found."""
    left = a.select(col).where(F.col(col).isNotNull()).distinct().withColumn("in_a", F.lit(True))
    right = b.select(col).where(F.col(col).isNotNull()).distinct().withColumn("in_b", F.lit(True))
    where = F.when(F.col("in_a") & F.col("in_b"), "both").when(F.col("in_a"), "only_a").otherwise("only_b")
    return left.join(right, col, "full").select(col, where.alias("found_in"))
