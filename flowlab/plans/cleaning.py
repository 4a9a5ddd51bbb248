"""Queries for projections, scalar functions and filters."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from flowlab.functions import clean as C
from flowlab.functions import labels as L
from flowlab.operators import align as A
from flowlab.operators import domains as D
from flowlab.operators.joins import valid_runs
from flowlab.plans.adapters import METRICS, flows, flows_raw, pair_runs, r6, runs, sql_r6, unsw_like
from flowlab.plans.audits import _FAMILY, folds, gains
from flowlab.plans.registry import query
from flowlab.schemas import CATEGORICAL, ENGINEERED, NUMERIC

_text = ["proto", "service", "conn_state", *NUMERIC, "label", "detailed_label"]


@query("p01_null_tokens", f"SELECT row_id, {', '.join(f'CASE WHEN {c} IN (' + repr('-') + ', ' + repr('(empty)') + f') THEN NULL ELSE {c} END AS {c}' for c in _text)} FROM flows_raw")
def p01(spark, sf):
    return C.null_tokens(flows_raw(spark, sf)).select("row_id", *_text)


@query("p02_numeric_coercion", "SELECT row_id, TRY_CAST(duration AS DOUBLE) AS duration, TRY_CAST(orig_bytes AS DOUBLE) AS orig_bytes, TRY_CAST(label AS DOUBLE) AS label FROM flows_raw")
def p02(spark, sf):
    return flows_raw(spark, sf).select("row_id", *[C.to_double(F.col(c)).alias(c) for c in ("duration", "orig_bytes", "label")])


@query("p03_fill_missing", "SELECT row_id, coalesce(TRY_CAST(duration AS DOUBLE), 0.0) AS duration, coalesce(nullif(service, '-'), 'missing') AS service, coalesce(nullif(label, '-'), 'missing') AS label FROM flows_raw")
def p03(spark, sf):
    cleaned = C.null_tokens(flows_raw(spark, sf)).withColumn("duration", C.to_double(F.col("duration")))
    return C.fill_missing(cleaned, ["duration"], ["service", "label"], "missing").select("row_id", "duration", "service", "label")


@query("p04_ratio_features", f"SELECT row_id, {sql_r6(*ENGINEERED)} FROM (SELECT row_id, orig_bytes / (resp_bytes + 1.0) AS bytes_ratio, orig_pkts / (resp_pkts + 1.0) AS pkts_ratio, orig_bytes / (orig_pkts + 1.0) AS orig_bytes_per_pkt, resp_bytes / (resp_pkts + 1.0) AS resp_bytes_per_pkt FROM flows) r")
def p04(spark, sf):
    base = flows(spark, sf).drop(*ENGINEERED)
    return C.ratio_features(base).select("row_id", *r6(*ENGINEERED))


@query("p05_clip", "SELECT row_id, least(greatest(bytes_ratio, 0.0::DOUBLE), 20.0::DOUBLE) AS bytes_ratio, least(greatest(orig_pkts, 0.0::DOUBLE), 1.0::DOUBLE) AS has_pkts FROM flows")
def p05(spark, sf):
    return flows(spark, sf).select("row_id", C.clip(F.col("bytes_ratio"), 0.0, 20.0).alias("bytes_ratio"), C.clip(F.col("orig_pkts"), 0.0, 1.0).alias("has_pkts"))


@query("p06_norm_label", "SELECT row_id, coalesce(lower(trim(nullif(label, '-'))), 'unknown') AS label, coalesce(lower(trim(nullif(detailed_label, '-'))), 'unknown') AS detailed_label FROM flows_raw")
def p06(spark, sf):
    cleaned = C.null_tokens(flows_raw(spark, sf))
    return cleaned.select("row_id", *[L.norm_label(F.col(c)).alias(c) for c in ("label", "detailed_label")])


@query("p07_label_binary", "SELECT row_id, label, CASE WHEN label = 'benign' THEN 0 ELSE 1 END::BIGINT AS label_binary FROM flows")
def p07(spark, sf):
    return flows(spark, sf).select("row_id", "label", L.label_binary(F.col("label")).alias("label_binary"))


@query("p08_label_phase", "SELECT row_id, detailed_label, label_phase FROM flows")
def p08(spark, sf):
    return flows(spark, sf).select("row_id", "detailed_label", L.label_phase(F.col("detailed_label")).alias("label_phase"))


@query("p09_strict_vocabulary", "SELECT id, CASE WHEN attack_cat = 'Normal' THEN 0 ELSE 1 END AS code FROM unsw_like")
def p09(spark, sf):
    word = F.when(F.col("attack_cat") == "Normal", " Normal ").when(F.col("attack_cat") == "DoS", "ATTACK").when(F.col("attack_cat") == "Generic", "anomaly").otherwise("1")
    return unsw_like(spark, sf).select("id", L.binary_vocab(word).alias("code"))


@query("p09_unknown_words", "SELECT lower(trim(label)) AS word, count(*) AS n_rows FROM flows_raw WHERE lower(trim(label)) NOT IN ('0', '1', 'benign', 'normal', 'background', 'malicious', 'attack', 'anomaly') GROUP BY 1")
def p09_words(spark, sf):
    return L.unknown_words(flows_raw(spark, sf), "label")


@query("p10_lenient_vocabulary", "SELECT row_id, CASE lower(trim(label)) WHEN 'malicious' THEN 1 ELSE 0 END AS code FROM flows_raw")
def p10(spark, sf):
    return flows_raw(spark, sf).select("row_id", L.binary_vocab(F.col("label"), strict=False).alias("code"))


@query("p11_is_benign", "SELECT id, lower(trim(attack_cat)) IN ('benign', 'normal', 'background', 'legitimate', 'clean', '0', 'false') AS is_benign FROM unsw_like")
def p11(spark, sf):
    return unsw_like(spark, sf).select("id", L.is_benign(F.col("attack_cat")).alias("is_benign"))


@query("p12_attack_family", f"SELECT row_id, d AS detailed_label, {_FAMILY} AS attack_family FROM (SELECT row_id, detailed_label AS d, lower(trim(detailed_label)) AS s FROM flows_raw) f")
def p12(spark, sf):
    return flows_raw(spark, sf).select("row_id", "detailed_label", L.attack_family(F.col("detailed_label")).alias("attack_family"))


@query("p15_align_first_domain", "SELECT row_id, scenario, label_binary, proto AS protocol, service, duration AS flow_duration, orig_pkts AS source_to_destination_packets, resp_pkts AS destination_to_source_packets, orig_bytes AS source_to_destination_bytes, resp_bytes AS destination_to_source_bytes, orig_bytes_per_pkt AS source_mean_bytes_per_packet, resp_bytes_per_pkt AS destination_mean_bytes_per_packet FROM flows")
def p15(spark, sf):
    return A.align(flows(spark, sf), A.mapping("iot23"), ["row_id", "scenario", "label_binary"])


@query("p15_align_second_domain", "SELECT id, label, proto AS protocol, service, dur AS flow_duration, spkts::DOUBLE AS source_to_destination_packets, dpkts::DOUBLE AS destination_to_source_packets, sbytes AS source_to_destination_bytes, dbytes AS destination_to_source_bytes, smean AS source_mean_bytes_per_packet, dmean AS destination_mean_bytes_per_packet FROM unsw_like")
def p15_second(spark, sf):
    return A.align(unsw_like(spark, sf), A.mapping("unsw"), ["id", "label"])


@query("p16_downcast", "SELECT id, dur::FLOAT AS dur, spkts::INTEGER AS spkts, dpkts::SMALLINT AS dpkts, label::TINYINT AS label FROM unsw_like")
def p16(spark, sf):
    return C.downcast(unsw_like(spark, sf), {"dur": "float", "spkts": "int", "dpkts": "smallint", "label": "tinyint"}).select("id", "dur", "spkts", "dpkts", "label")


@query("p17_slugs", "SELECT o_orderkey, CASE WHEN s = '' THEN 'missing' ELSE s END AS slug, replace(CAST(f AS VARCHAR), '.', 'p') AS fraction_slug FROM (SELECT o_orderkey, trim(regexp_replace(lower(trim(o_orderpriority)), '[^a-z0-9]+', '_', 'g'), '_') AS s, (o_orderkey % 100 + 1) / 128.0::DOUBLE AS f FROM orders) o")
def p17(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_orderpriority")
    fraction = (F.col("o_orderkey") % 100 + 1) / F.lit(128.0)
    return orders.select("o_orderkey", C.slugify(F.col("o_orderpriority")).alias("slug"), C.fraction_slug(fraction).alias("fraction_slug"))


@query("p18_scenario_family", "SELECT row_id, CASE WHEN event_id % 3 = 0 THEN 'honeypot_benign' WHEN event_id % 3 = 1 THEN 'iot_malware' ELSE 'other' END AS family FROM (SELECT row_id, row_id AS event_id FROM flows_raw) f")
def p18(spark, sf):
    i = F.col("row_id")
    name = F.concat(F.when(i % 3 == 0, "CTU-Honeypot-").when(i % 3 == 1, "CTU-IoT-Malware-").otherwise("CTU-Lab-"), F.col("scenario"))
    return flows_raw(spark, sf).select("row_id", L.scenario_family(name).alias("family"))


@query("p19_fold_category", f"SELECT scenario, n_rows, {sql_r6('attack_ratio', 'fnr_attack', 'fpr_benign')}, single_class_test, dominant_class, category FROM fold_words")
def p19(spark, sf):
    out = L.fold_category(folds(spark, sf))
    return out.select("scenario", "n_rows", *r6("attack_ratio", "fnr_attack", "fpr_benign"), "single_class_test", "dominant_class", "category")


@query("p20_transfer_outcome", "SELECT pair_id, seed, target_fraction, round(primary_gain, 6) AS primary_gain, transfer_label FROM gains")
def p20(spark, sf):
    return gains(spark, sf).select("pair_id", "seed", "target_fraction", *r6("primary_gain"), "transfer_label")


@query("p21_safe_ratios", "SELECT row_id, coalesce(orig_bytes / nullif(resp_bytes, 0), 0) AS ratio, coalesce(100.0::DOUBLE * orig_pkts / nullif(resp_pkts, 0), 0) AS percent, coalesce(2.0::DOUBLE * orig_pkts * resp_pkts / nullif(orig_pkts + resp_pkts, 0), 0) AS harmonic FROM flows")
def p21(spark, sf):
    a, b, c, d = (F.col(x) for x in ("orig_bytes", "resp_bytes", "orig_pkts", "resp_pkts"))
    return flows(spark, sf).select("row_id", C.safe_div(a, b).alias("ratio"), C.pct(c, d).alias("percent"), C.f1(c, d).alias("harmonic"))


_SPEC = {"dataset": "iot23", "filters": [{"column": "scenario", "op": "in", "values": ["CTU-Cap-01", "CTU-Cap-09"]}, {"column": "proto", "op": "eq", "value": "tcp"}]}


@query("p22_filter_spec", "SELECT row_id, scenario, proto FROM flows WHERE scenario IN ('CTU-Cap-01', 'CTU-Cap-09') AND proto = 'tcp'")
def p22(spark, sf):
    return D.apply_filter(flows(spark, sf), json.dumps(_SPEC)).select("row_id", "scenario", "proto")


@query("p23_valid_runs", f"SELECT pair_id, seed, condition, target_fraction, {sql_r6(*METRICS)} FROM pair_runs WHERE condition IN ('source_only', 'target_only_updated', 'transfer_learning_updated')")
def p23(spark, sf):
    return valid_runs(pair_runs(spark, sf), METRICS).select("pair_id", "seed", "condition", "target_fraction", *r6(*METRICS))


@query("p24_label_columns", "SELECT direction, model, seed, fraction, CASE direction WHEN 'a_to_b' THEN 'A -> B' ELSE 'B -> A' END AS direction_label, upper(model) AS model_label, 'test' AS split FROM runs")
def p24(spark, sf):
    from flowlab.session import lit_map

    names = lit_map({"a_to_b": "A -> B", "b_to_a": "B -> A"})
    return runs(spark, sf).select("direction", "model", "seed", "fraction", names[F.col("direction")].alias("direction_label"), F.upper("model").alias("model_label"), F.lit("test").alias("split"))


@query("p25_log_transforms", "SELECT row_id, round(CASE WHEN duration > 0 THEN log10(duration + 1e-9) END, 6) AS log_duration, round(ln(1 + orig_bytes), 6) AS log_bytes FROM flows")
def p25(spark, sf):
    return flows(spark, sf).select("row_id", F.round(C.log10_positive(F.col("duration")), 6).alias("log_duration"), F.round(F.log1p("orig_bytes"), 6).alias("log_bytes"))


_clean = [*CATEGORICAL, *NUMERIC, "label", "detailed_label", "label_binary", "label_phase"]


@query("p00_clean_flows", f"SELECT row_id, ts, scenario, split, {', '.join(_clean)}, {sql_r6(*ENGINEERED)} FROM flows")
def p00(spark, sf):
    """All cleaning steps together, as ingestion applies them."""
    return flows(spark, sf).select("row_id", "ts", "scenario", "split", *_clean, *r6(*ENGINEERED))


