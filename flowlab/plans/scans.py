"""Queries for sources and sinks.  Round trips write into the session's shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlab.plans.adapters import flows, flows_raw, importances, preds, r6, runs, unsw_like, zeek_lines
from flowlab.plans.registry import query
from flowlab.schemas import CATEGORICAL, FLOW_TYPES, LOG_FIELDS, NUMERIC, UNSW_COLUMNS, UNSW_LIKE_SCHEMA, UNSW_SCHEMA
from flowlab.session import work_path
from flowlab.sources import crawl, logs
from flowlab.sources import tables as S

_fields = ", ".join(f"f[{i + 1}] AS {n}" for i, n in enumerate(LOG_FIELDS))
_tail = ", ".join(f"coalesce(t[{i + 1}], '-') AS {n}" for i, n in enumerate(["tunnel_parents", "label", "detailed_label"]))


@query("s01_zeek_scan", f"""
SELECT scenario, {_fields}, {_tail} FROM (
 SELECT scenario, f, [trim(x) FOR x IN regexp_split_to_array(trim(f[21]), '\\s{{3,}}') IF trim(x) <> ''] AS t
 FROM (SELECT scenario, string_split(value, chr(9)) AS f FROM zeek_lines WHERE value NOT LIKE '#%' AND trim(value) <> '') a WHERE len(f) >= 21) b""")
def s01(spark, sf):
    return logs.parse_lines(zeek_lines(spark, sf))


@query("s01_log_files", f"""
SELECT scenario, {_fields}, {_tail} FROM (
 SELECT scenario, f, [trim(x) FOR x IN regexp_split_to_array(trim(f[21]), '\\s{{3,}}') IF trim(x) <> ''] AS t
 FROM (SELECT scenario, string_split(value, chr(9)) AS f FROM zeek_lines WHERE value NOT LIKE '#%' AND trim(value) <> '') a WHERE len(f) >= 21) b""")
def s01_files(spark, sf):
    """The scan itself: log files under one folder per scenario, found and parsed, their scenario taken from the path."""
    root = work_path(spark, "bro-logs")
    zeek_lines(spark, sf).select("value", F.col("scenario").alias("capture"), F.lit("x").alias("bro")).write.partitionBy("capture", "bro").text(root)
    lines = logs.read_log_lines(spark, root, "part-*")
    named = lines.select("value", F.regexp_extract("scenario", r"^(?:capture=)?(.*)$", 1).alias("scenario"))
    return logs.parse_lines(named)


@query("s01_file_audit", """
SELECT scenario, count(*) AS n_lines, count(*) FILTER (WHERE value LIKE '#%') AS n_comments,
 count(*) FILTER (WHERE value NOT LIKE '#%' AND len(string_split(value, chr(9))) < 21) AS n_malformed,
 count(*) FILTER (WHERE value NOT LIKE '#%' AND len(string_split(value, chr(9))) >= 21) AS n_parsed FROM zeek_lines GROUP BY scenario""")
def s01_file_audit(spark, sf):
    """Dropped and kept lines of the same files."""
    root = work_path(spark, "audit-logs")
    zeek_lines(spark, sf).select("value", F.col("scenario").alias("capture"), F.lit("x").alias("bro")).write.partitionBy("capture", "bro").text(root)
    lines = logs.read_log_lines(spark, root, "part-*")
    return logs.line_audit(lines.select("value", F.regexp_extract("scenario", r"^(?:capture=)?(.*)$", 1).alias("scenario")), ["scenario"])


@query("s01_line_audit", """
SELECT scenario, count(*) AS n_lines, count(*) FILTER (WHERE value LIKE '#%') AS n_comments,
 count(*) FILTER (WHERE value NOT LIKE '#%' AND len(string_split(value, chr(9))) < 21) AS n_malformed,
 count(*) FILTER (WHERE value NOT LIKE '#%' AND len(string_split(value, chr(9))) >= 21) AS n_parsed FROM zeek_lines GROUP BY scenario""")
def s01_audit(spark, sf):
    return logs.line_audit(zeek_lines(spark, sf), ["scenario"])


@query("s02_scenario_from_path", """
SELECT row_id, CASE row_id % 3 WHEN 2 THEN concat('site', row_id % 5) ELSE scenario END AS scenario FROM flows_raw""")
def s02(spark, sf):
    i = F.col("row_id")
    near = F.concat(F.lit("/logs/iot/"), "scenario", F.lit("/bro/conn.log.labeled"))
    far = F.concat(F.lit("/logs/"), "scenario", F.lit("/part/bro/conn.log.labeled"))
    other = F.concat(F.lit("/logs/site"), (i % 5).cast("string"), F.lit("/bro/conn.log.labeled"))
    paths = flows_raw(spark, sf).select("row_id", F.when(i % 3 == 0, near).when(i % 3 == 1, far).otherwise(other).alias("path"))
    return paths.select("row_id", logs.scenario_from_path(F.col("path")).alias("scenario"))


@query("s02_file_discovery", "SELECT scenario, count(*) AS n_rows FROM zeek_lines WHERE value LIKE concat('%', chr(9), '%', chr(9), '%') GROUP BY scenario")
def s02_files(spark, sf):
    """Log text written one folder per scenario, found again by recursive lookup."""
    root = work_path(spark, "logs")
    zeek_lines(spark, sf).select("value", "scenario").write.partitionBy("scenario").text(root)
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "part-*").text(root)
    found = lines.select("value", F.regexp_extract("_metadata.file_path", r"scenario=([^/]+)/", 1).alias("scenario"))
    return logs.parse_lines(found).groupBy("scenario").agg(F.count(F.lit(1)).alias("n_rows"))


@query("s03_parquet_columns", "SELECT o_orderkey, o_orderpriority FROM orders")
def s03(spark, sf):
    return S.read_flows(spark, f"{sf}/orders.parquet", ["o_orderkey", "o_orderpriority"])


_floats = ", ".join(f"TRY_CAST({c} AS FLOAT) AS {c}" for c in NUMERIC)


@query("s04_typed_scan", f"""
SELECT row_id, {_floats}, proto, service, conn_state, coalesce(TRY_CAST(CASE label WHEN 'benign' THEN '0' WHEN 'Malicious' THEN '1' END AS TINYINT), 0::TINYINT) AS label FROM flows_raw""")
def s04(spark, sf):
    raw = flows_raw(spark, sf).withColumn("label", F.when(F.col("label") == "benign", "0").when(F.col("label") == "Malicious", "1"))
    return S.typed_scan(raw, NUMERIC, CATEGORICAL, "label", ["row_id"])


def _csv(spark, sf):
    """The second domain as CSV with its columns in another order and one that nobody asked for."""
    path = work_path(spark, "unsw-csv")
    rows = unsw_like(spark, sf)
    S.write_table(rows.select(*sorted(rows.columns, reverse=True), F.lit("x").alias("note")), path, "csv")
    return path


_native = [(c, t) for c, t in UNSW_COLUMNS if c in ("proto", "service", "dur", "spkts", "dpkts", "sbytes", "dbytes", "smean", "dmean", "id", "attack_cat", "label")]
_null_sql = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "int": "INTEGER"}


@query("s05_native_csv", "SELECT " + ", ".join(f"CAST({f'floor({c})' if t == 'bigint' else c} AS {_null_sql[t]}) AS {c}" if (c, t) in _native else f"CAST(NULL AS {_null_sql[t]}) AS {c}" for c, t in UNSW_COLUMNS) + " FROM unsw_like")
def s05_native(spark, sf):
    """All native columns by name from a file in another column order; numbers that the tables here lack are empty fields."""
    path = work_path(spark, "unsw-native")
    rows = unsw_like(spark, sf)
    there = {c: F.floor(c).alias(c) if t == "bigint" else F.col(c) for c, t in _native}
    S.write_table(rows.select(*[there.get(c, F.lit(None).cast("string").alias(c)) for c, _ in sorted(UNSW_COLUMNS)]), path, "csv")
    return S.read_csv_cols(spark, path, UNSW_SCHEMA, [c for c, _ in UNSW_COLUMNS])


@query("s05_csv_columns", "SELECT id, service, dur, sbytes, label FROM unsw_like")
def s05(spark, sf):
    return S.read_csv_cols(spark, _csv(spark, sf), UNSW_LIKE_SCHEMA, ["id", "service", "dur", "sbytes", "label"])


@query("s06_union_all", """
SELECT id, attack_cat, dur, CAST(NULL AS DOUBLE) AS duration FROM unsw_like UNION ALL SELECT row_id, NULL, NULL, duration FROM flows""")
def s06(spark, sf):
    left = unsw_like(spark, sf).select("id", "attack_cat", "dur")
    return S.union_all(left, flows(spark, sf).select(F.col("row_id").alias("id"), "duration"))


@query("s07_filtered_csv", "SELECT id, service, label FROM unsw_like WHERE trim(coalesce(service, 'missing')) = 'BUILDING'")
def s07(spark, sf):
    return S.filtered_csv(spark, _csv(spark, sf), UNSW_LIKE_SCHEMA, "service", "BUILDING").select("id", "service", "label")


@query("s09_partitioned_sink", "SELECT split, scenario, count(*) AS n_rows, round(sum(duration), 3) AS total_duration FROM flows GROUP BY ALL")
def s09(spark, sf):
    path = work_path(spark, "flows")
    S.write_flows(flows(spark, sf), path)
    back = spark.read.parquet(path)
    return back.groupBy("split", "scenario").agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.sum("duration"), 3).alias("total_duration"))


_duck = {"double": "DOUBLE", "string": "VARCHAR", "bigint": "BIGINT"}
_norm = ", ".join(f"TRY_CAST({c} AS {_duck[t]}) AS {c}" for c, t in FLOW_TYPES.items() if c != "split")


@query("s10_normalize_schema", f"SELECT {_norm}, 'all' AS split FROM flows")
def s10(spark, sf):
    return S.normalize_schema(flows(spark, sf), split="all")


@query("s10_class_counts", "SELECT split, count(*) AS n_rows, count(*) FILTER (WHERE label_binary = 0) AS n_benign, count(*) FILTER (WHERE label_binary = 1) AS n_malicious FROM flows GROUP BY split")
def s10_counts(spark, sf):
    return S.class_count_audit(S.normalize_schema(flows(spark, sf)))


@query("s11_prediction_sink", "SELECT scenario, y_true::TINYINT AS label_binary, y_pred::TINYINT AS y_pred, y_score::FLOAT AS y_score FROM preds")
def s11(spark, sf):
    path = work_path(spark, "predictions")
    S.write_predictions(preds(spark, sf), path)
    return S.read_predictions(spark, path)


@query("s12_result_tables", "SELECT fmt, scenario, n_rows, round(mean_duration, 6) AS mean_duration FROM (SELECT scenario, count(*) AS n_rows, avg(duration) AS mean_duration FROM flows GROUP BY scenario) s CROSS JOIN (VALUES ('csv'), ('json')) f(fmt)")
def s12(spark, sf):
    schema = "scenario string, n_rows bigint, mean_duration double"
    stats = flows(spark, sf).groupBy("scenario").agg(F.count(F.lit(1)).alias("n_rows"), F.avg("duration").alias("mean_duration"))
    parts = []
    for fmt in ("csv", "json"):
        path = work_path(spark, fmt)
        S.write_table(stats, path, fmt)
        back = spark.read.csv(path, header=True, schema=schema) if fmt == "csv" else spark.read.schema(schema).json(path)
        parts.append(back.select(F.lit(fmt).alias("fmt"), "scenario", "n_rows", *r6("mean_duration")))
    return S.union_all(*parts)


def _crawled_runs(spark, sf):
    rows = runs(spark, sf).withColumn("run", F.concat_ws("_", F.lit("outputs"), "direction", "model", F.concat(F.lit("seed"), "seed")))
    summaries, configs = work_path(spark, "run-summaries"), work_path(spark, "run-configs")
    rows.select("run", "fraction", "rows_evaluated", "f1_attack").write.partitionBy("run").option("header", True).csv(summaries)
    config = rows.groupBy("run", F.col("seed").cast("long").alias("seed")).agg(F.max("rows_evaluated").alias("target_test_rows"), F.min("rows_evaluated").alias("source_train_rows"))
    config.write.partitionBy("run").json(configs)
    return crawl.crawl_runs(spark, summaries, configs, "fraction double, rows_evaluated bigint, f1_attack double")


@query("s13_crawl_runs", """
SELECT concat('outputs_', direction, '_', model, '_seed', seed) AS run_name, direction, model, CAST(seed AS VARCHAR) AS seed, '0.1,0.2,0.5,1.0' AS fractions,
 count(DISTINCT fraction) AS fraction_count, min(rows_evaluated) AS source_train_rows_config, max(rows_evaluated) AS target_test_rows_config
FROM runs GROUP BY direction, model, seed""")
def s13(spark, sf):
    return crawl.run_inventory(_crawled_runs(spark, sf), ["direction", "model", "seed"])


@query("s14_crawl_folds", "SELECT scenario, n_rows, n_benign, n_attack, round(f1_macro, 6) AS f1_macro, round(recall_attack, 6) AS recall_attack FROM folds")
def s14(spark, sf):
    from flowlab.plans.audits import folds

    path = work_path(spark, "folds")
    nested = folds(spark, sf).select("scenario", F.struct("n_rows", "n_benign", "n_attack").alias("counts"), F.struct("f1_macro", "recall_attack").alias("metrics"))
    nested.write.json(path)
    schema = "scenario string, counts struct<n_rows: bigint, n_benign: bigint, n_attack: bigint>, metrics struct<f1_macro: double, recall_attack: double>"
    back = crawl.crawl_folds(spark, path, schema, multi_line=False)
    return back.select("scenario", "counts.*", "metrics.*").select("scenario", "n_rows", "n_benign", "n_attack", *r6("f1_macro", "recall_attack"))


@query("s15_crawl_importances", "SELECT replace(fold_name, '#', '') AS fold_name, feature, importance FROM importances")
def s15(spark, sf):
    path = work_path(spark, "importances")
    named = importances(spark, sf).withColumn("run", F.replace("fold_name", F.lit("#"), F.lit("")))
    named.select("run", "feature", "importance").write.partitionBy("run").option("header", True).csv(path)
    return crawl.crawl_importances(spark, path)


@query("s16_row_count", "SELECT 'events' AS name, count(*) AS n_rows FROM events UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem")
def s16(spark, sf):
    return S.union_all(*[S.row_count(spark, f"{sf}/{n}.parquet").select(F.lit(n).alias("name"), "n_rows") for n in ("events", "orders", "lineitem")])


