"""Queries for sampling, splitting and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlab.operators import align as A
from flowlab.operators import sampling as H
from flowlab.operators import splits as L
from flowlab.plans.adapters import flows, flows_raw, preds, split_of, unsw_like, zeek_lines
from flowlab.plans.registry import query, table
from flowlab.sources.logs import parse_lines

SEED = 42


def rank_sql(source: str, by: str, key: str = "row_id", seed: int = SEED) -> str:
    return f"SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY md5(concat(CAST({key} AS VARCHAR), ':{seed}'))) AS rn, count(*) OVER (PARTITION BY {by}) AS n FROM {source}"


table("flows_drawn", rank_sql("flows", "label_binary"))
table("unsw_drawn", rank_sql("unsw_like", "label", "id"))


@query("h01_fixed_split", "SELECT scenario, split, count(*) AS n_rows FROM flows GROUP BY ALL")
def h01(spark, sf):
    return flows_raw(spark, sf).groupBy("scenario", split_of(F.col("scenario")).alias("split")).agg(F.count(F.lit(1)).alias("n_rows"))


@query("h02_loso_folds", """
SELECT concat('loso_', scenario) AS fold_name, scenario AS test_group, n AS n_test, a AS n_test_attack, (sum(n) OVER ())::BIGINT - n AS n_train, (sum(a) OVER ())::BIGINT - a AS n_train_attack, count(*) OVER () - 1 AS n_train_groups
FROM (SELECT scenario, count(*) AS n, count(*) FILTER (WHERE label_binary = 1) AS a FROM flows GROUP BY scenario) s""")
def h02(spark, sf):
    return L.loso_folds(flows(spark, sf))


@query("h03_loao_folds", """
SELECT k AS held_out_attack, b + a - n AS n_train, a - n AS n_train_attack, b + n AS n_test, n AS n_test_attack, b AS n_benign FROM (SELECT attack_cat AS k, count(*) AS n FROM unsw_like WHERE attack_cat <> 'Normal' GROUP BY attack_cat) c,
 (SELECT count(*) FILTER (WHERE attack_cat = 'Normal') AS b, count(*) FILTER (WHERE attack_cat <> 'Normal') AS a FROM unsw_like) t""")
def h03(spark, sf):
    return L.loao_folds(unsw_like(spark, sf))


@query("h04_stratified_sample", "SELECT row_id, scenario, label_binary FROM flows_drawn WHERE rn <= least(n, greatest(1, round_even(n * 0.1::DOUBLE, 0)))")
def h04(spark, sf):
    return H.stratified_sample(flows(spark, sf), ["label_binary"], 0.1, "row_id", SEED).select("row_id", "scenario", "label_binary")


@query("h04_stratified_by_scenario", f"SELECT row_id, scenario, label_binary FROM ({rank_sql('flows', 'scenario, label_binary')}) r WHERE rn <= least(n, greatest(1, ceil(n * 0.05::DOUBLE)))")
def h04_scenario(spark, sf):
    return H.stratified_sample(flows(spark, sf), ["scenario", "label_binary"], 0.05, "row_id", SEED, "ceil").select("row_id", "scenario", "label_binary")


@query("h05_cap_stratified", """
SELECT row_id, label_binary FROM flows_drawn, (SELECT count(*) AS t, count(*) FILTER (WHERE label_binary = 1) AS a, count(*) FILTER (WHERE label_binary = 0) AS b FROM flows) c
WHERE rn <= CASE label_binary WHEN 1 THEN least(round_even(500 * (a::DOUBLE / t), 0), a) ELSE least(500 - least(round_even(500 * (a::DOUBLE / t), 0), a), b) END""")
def h05(spark, sf):
    return H.cap_stratified(flows(spark, sf), 500, "label_binary", "row_id", SEED).select("row_id", "label_binary")


@query("h06_cap_random", "SELECT row_id, scenario FROM flows ORDER BY md5(concat(CAST(row_id AS VARCHAR), ':42')) LIMIT 700")
def h06(spark, sf):
    return H.cap_random(flows(spark, sf), 700, "row_id", SEED).select("row_id", "scenario")


@query("h07_sample_scan", "SELECT id, attack_cat FROM unsw_like ORDER BY md5(concat(CAST(id AS VARCHAR), ':7')) LIMIT 900")
def h07(spark, sf):
    return H.sample_scan(unsw_like(spark, sf), 900, "id", 7).select("id", "attack_cat")


_N = 40
table("lines_labelled", """
SELECT CAST(f[1] AS BIGINT) AS row_id, scenario, coalesce(lower(t[2]), 'unknown') AS label FROM (
 SELECT scenario, f, [trim(x) FOR x IN regexp_split_to_array(trim(f[21]), '\\s{3,}') IF trim(x) <> ''] AS t FROM (SELECT scenario, string_split(value, chr(9)) AS f FROM zeek_lines WHERE value NOT LIKE '#%') a WHERE len(f) >= 21) b""")
table("line_quotas", f"""
SELECT scenario, label, c, k, greatest(least({_N}, total) - sum(k) OVER (PARTITION BY scenario), 0) AS top_up FROM (
 SELECT scenario, label, c, total, q - least(q - 1, greatest(CASE WHEN total > {_N} THEN greatest(sum(q) OVER (PARTITION BY scenario) - {_N}, 0) ELSE 0 END - coalesce(sum(q - 1) OVER (PARTITION BY scenario ORDER BY q DESC, label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0)) AS k
 FROM (SELECT scenario, label, c, total, CASE WHEN total <= {_N} THEN c ELSE least(c, greatest(1, round_even(c::DOUBLE / total * {_N}, 0)::BIGINT)) END AS q FROM (SELECT scenario, label, count(*) AS c, sum(count(*)) OVER (PARTITION BY scenario) AS total FROM lines_labelled GROUP BY scenario, label) x) y) z""")
table("line_sample", f"""
SELECT row_id, scenario, label FROM (
 SELECT *, sum(CASE WHEN kept THEN 0 ELSE 1 END) OVER (PARTITION BY scenario ORDER BY h ROWS UNBOUNDED PRECEDING) AS left_over FROM (
  SELECT l.*, q.top_up, row_number() OVER (PARTITION BY l.scenario, l.label ORDER BY md5(concat(CAST(row_id AS VARCHAR), ':{SEED}'))) <= q.k AS kept, md5(concat(CAST(row_id AS VARCHAR), ':{SEED}')) AS h
  FROM lines_labelled l JOIN line_quotas q ON l.scenario = q.scenario AND l.label = q.label) m) n WHERE kept OR left_over <= top_up""")


def _labelled_lines(spark, sf):
    parsed = parse_lines(zeek_lines(spark, sf))
    return parsed.select(F.col("ts").cast("long").alias("row_id"), "scenario", F.lower("label").alias("label"))


@query("h08_label_preserving_sample", "SELECT row_id, scenario, label FROM line_sample")
def h08(spark, sf):
    return H.label_preserving_sample(_labelled_lines(spark, sf), ["scenario"], "label", _N, "row_id", SEED)


@query("h08_sample_manifest", "SELECT o.scenario, o.label, c AS original_rows, coalesce(s.n, 0) AS sampled_rows, s.n IS NULL AS lost FROM line_quotas o LEFT JOIN (SELECT scenario, label, count(*) AS n FROM line_sample GROUP BY ALL) s ON o.scenario = s.scenario AND o.label = s.label")
def h08_manifest(spark, sf):
    lines = _labelled_lines(spark, sf)
    return H.sample_manifest(lines, H.label_preserving_sample(lines, ["scenario"], "label", _N, "row_id", SEED), ["scenario"], "label")


@query("h09_balance", "SELECT id, label FROM unsw_drawn WHERE rn <= CASE WHEN n = (SELECT min(n) FROM unsw_drawn) THEN n ELSE least(n, round_even((SELECT min(n) FROM unsw_drawn) * 1.5::DOUBLE, 0)) END")
def h09(spark, sf):
    return H.balance(unsw_like(spark, sf), "label", "id", SEED, 1.5).select("id", "label")


@query("h10_holdout", "SELECT id, label, CASE WHEN rn <= round_even(n * 0.2::DOUBLE, 0) THEN 'holdout' ELSE 'fit' END AS role FROM unsw_drawn")
def h10(spark, sf):
    return H.holdout(unsw_like(spark, sf), 0.2, "label", "id", SEED).select("id", "label", "role")


@query("h11_group_split", """
SELECT f.scenario, CASE WHEN rn <= ceil(n * 0.2::DOUBLE) THEN 'val' ELSE 'train' END AS role, count(*) AS n_rows FROM flows f
JOIN (SELECT scenario, row_number() OVER (ORDER BY md5(concat(scenario, ':42'))) AS rn, count(*) OVER () AS n FROM (SELECT DISTINCT scenario FROM flows) d) g ON f.scenario = g.scenario GROUP BY ALL""")
def h11(spark, sf):
    return H.group_split(flows(spark, sf), "scenario", 0.2, SEED).groupBy("scenario", "role").agg(F.count(F.lit(1)).alias("n_rows"))


table("cap_domains", "SELECT split AS pool, scenario AS domain_id, count(*) AS n_rows, 1003 AS cap FROM flows GROUP BY ALL")
table("caps_allocated", """
SELECT pool, domain_id, n_rows, CASE WHEN cnt = 1 THEN cap ELSE fl + CASE WHEN row_number() OVER (PARTITION BY pool ORDER BY raw - fl DESC, n_rows DESC, domain_id DESC) <= cap - sum(fl) OVER (PARTITION BY pool) THEN 1 ELSE 0 END END::BIGINT AS allocated
FROM (SELECT *, floor(raw) AS fl FROM (SELECT *, cap * (n_rows::DOUBLE / sum(n_rows) OVER (PARTITION BY pool)) AS raw, count(*) OVER (PARTITION BY pool) AS cnt FROM cap_domains) a) b""")


def _caps(spark, sf):
    sizes = flows(spark, sf).groupBy(F.col("split").alias("pool"), F.col("scenario").alias("domain_id")).agg(F.count(F.lit(1)).alias("n_rows"))
    return H.allocate_caps(sizes.withColumn("cap", F.lit(1003)), ["pool"], "n_rows", "cap")


@query("h12_allocate_caps", "SELECT pool, domain_id, n_rows, allocated FROM caps_allocated")
def h12(spark, sf):
    return _caps(spark, sf).select("pool", "domain_id", "n_rows", "allocated")


@query("h13_load_pool", f"SELECT r.row_id, r.scenario FROM ({rank_sql('flows', 'scenario')}) r JOIN caps_allocated c ON r.scenario = c.domain_id WHERE r.rn <= c.allocated")
def h13(spark, sf):
    caps = _caps(spark, sf).select(F.col("domain_id").alias("scenario"), F.col("allocated").alias("k"))
    return H.load_pool(flows(spark, sf), "scenario", caps, "row_id", SEED).select("row_id", "scenario")


@query("h14_compare_vocabularies", """
SELECT coalesce(a.service, b.service) AS service, CASE WHEN b.service IS NULL THEN 'only_a' WHEN a.service IS NULL THEN 'only_b' ELSE 'both' END AS found_in
FROM (SELECT DISTINCT service FROM flows) a FULL JOIN (SELECT DISTINCT lower(service) AS service FROM unsw_like UNION SELECT 'http' FROM unsw_like) b ON a.service = b.service""")
def h14(spark, sf):
    second = unsw_like(spark, sf).select(F.explode(F.array(F.lower("service"), F.lit("http"))).alias("service"))
    return A.compare_sets(flows(spark, sf), second, "service")


@query("h14_compare_scenarios", """
SELECT coalesce(a.scenario, b.scenario) AS scenario, CASE WHEN b.scenario IS NULL THEN 'only_a' WHEN a.scenario IS NULL THEN 'only_b' ELSE 'both' END AS found_in
FROM (SELECT DISTINCT scenario FROM flows WHERE label_phase = 'ddos' AND split <> 'val') a FULL JOIN (SELECT DISTINCT scenario FROM preds WHERE ts >= 0 AND scenario <> 'CTU-Cap-09') b ON a.scenario = b.scenario""")
def h14_scenarios(spark, sf):
    """One scenario is left out of the second side on purpose, so that each of the three answers occurs."""
    a = flows(spark, sf).where("label_phase = 'ddos' and split <> 'val'")
    return A.compare_sets(a, preds(spark, sf).where("scenario <> 'CTU-Cap-09'"), "scenario")
