"""Domain tables derived from the driver's tables, in Spark and, under the same name, in SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlab.functions.clean import clean_flows
from flowlab.functions.labels import PHASES, assign_labels, assign_split
from flowlab.operators.metrics import metrics_present
from flowlab.operators.prefix import prefix_cells
from flowlab.plans.registry import table
from flowlab.schemas import METRICS
from flowlab.session import settle

TEST = ["CTU-Cap-09", "CTU-Cap-10", "CTU-Cap-11"]
VAL = ["CTU-Cap-08"]
FRACTIONS = [0.1, 0.2, 0.5, 1.0]
MODELS = {"rf": 800, "mlp": 900}
SEEDS = [1, 2, 3, 4, 5]


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r6(*names: str) -> list[Column]:
    return [F.round(n, 6).alias(n) for n in names]


def sql_r6(*names: str, prefix: str = "") -> str:
    return ", ".join(f"round({prefix}{n}, 6) AS {n}" for n in names)


def pick(number: Column, words: list[str]) -> Column:
    return F.element_at(F.array(*map(F.lit, words)), (number % len(words) + 1).cast("int"))


def flows_raw(spark: SparkSession, sf: str) -> DataFrame:
    """Parsed, uncleaned flow log: strings with null tokens."""
    k = F.col("k")
    i = F.col("event_id")
    cents = F.round(F.col("value") * 100).cast("long").cast("string")
    family = F.when(F.col("event_type") == "error", "DDoS").when(F.col("event_type") == "signup", "C&C-HeartBeat")
    events = read(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("long").alias("k"))
    return events.select(
        i.alias("row_id"),
        F.expr("date_diff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts) / 1e6D").alias("ts"),
        F.concat(F.lit("CTU-Cap-"), F.lpad((F.col("user_id") % 12).cast("string"), 2, "0")).alias("scenario"),
        pick(i, ["tcp", "udp", "icmp"]).alias("proto"),
        pick(i, ["http", "dns", "-", "ssh"]).alias("service"),
        pick(i, ["SF", "S0", "REJ", "RSTO", "OTH"]).alias("conn_state"),
        F.when(i % 17 == 0, "-").otherwise(cents).alias("duration"),
        (k * 3).cast("string").alias("orig_bytes"), (k % 7).cast("string").alias("resp_bytes"), F.lit("0").alias("missed_bytes"),
        (k % 11).cast("string").alias("orig_pkts"), (k * 4).cast("string").alias("orig_ip_bytes"),
        (k % 5).cast("string").alias("resp_pkts"), (k % 13).cast("string").alias("resp_ip_bytes"),
        F.when(F.col("event_type").isin("click", "view"), "benign").when(i % 101 == 0, "-").otherwise("Malicious").alias("label"),
        family.when(F.col("event_type") == "purchase", "PartOfAHorizontalPortScan").otherwise("-").alias("detailed_label"),
    )


table("flows_raw", """
SELECT event_id AS row_id, epoch_us(ts) / 1e6 AS ts, concat('CTU-Cap-', lpad(CAST(user_id % 12 AS VARCHAR), 2, '0')) AS scenario,
  CASE event_id % 3 WHEN 0 THEN 'tcp' WHEN 1 THEN 'udp' ELSE 'icmp' END AS proto,
  CASE event_id % 4 WHEN 0 THEN 'http' WHEN 1 THEN 'dns' WHEN 2 THEN '-' ELSE 'ssh' END AS service,
  CASE event_id % 5 WHEN 0 THEN 'SF' WHEN 1 THEN 'S0' WHEN 2 THEN 'REJ' WHEN 3 THEN 'RSTO' ELSE 'OTH' END AS conn_state,
  CASE WHEN event_id % 17 = 0 THEN '-' ELSE CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR) END AS duration,
  CAST(k * 3 AS VARCHAR) AS orig_bytes, CAST(k % 7 AS VARCHAR) AS resp_bytes, '0' AS missed_bytes,
  CAST(k % 11 AS VARCHAR) AS orig_pkts, CAST(k * 4 AS VARCHAR) AS orig_ip_bytes,
  CAST(k % 5 AS VARCHAR) AS resp_pkts, CAST(k % 13 AS VARCHAR) AS resp_ip_bytes,
  CASE WHEN event_type IN ('click', 'view') THEN 'benign' WHEN event_id % 101 = 0 THEN '-' ELSE 'Malicious' END AS label,
  CASE event_type WHEN 'error' THEN 'DDoS' WHEN 'signup' THEN 'C&C-HeartBeat' WHEN 'purchase' THEN 'PartOfAHorizontalPortScan' ELSE '-' END AS detailed_label
FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) e
""")


def split_of(scenario: Column) -> Column:
    return assign_split(scenario, TEST, VAL)


def flows(spark: SparkSession, sf: str) -> DataFrame:
    """Cleaned, engineered, labelled flows with their split."""
    return assign_labels(clean_flows(flows_raw(spark, sf))).withColumn("split", split_of(F.col("scenario")))


SQL_PHASE = "CASE detailed_label " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in PHASES.items()) + " WHEN 'unknown' THEN 'unknown' ELSE 'other_malicious' END"
SQL_SPLIT = "CASE WHEN scenario IN ('CTU-Cap-09', 'CTU-Cap-10', 'CTU-Cap-11') THEN 'test' WHEN scenario = 'CTU-Cap-08' THEN 'val' ELSE 'train' END"
_numeric = ", ".join(
    f"coalesce(TRY_CAST(nullif({c}, '-') AS DOUBLE), 0.0) AS {c}"
    for c in ["duration", "orig_bytes", "resp_bytes", "missed_bytes", "orig_pkts", "orig_ip_bytes", "resp_pkts", "resp_ip_bytes"]
)
table("flows", f"""
SELECT *, CASE WHEN label = 'benign' THEN 0 ELSE 1 END::BIGINT AS label_binary, {SQL_PHASE} AS label_phase, {SQL_SPLIT} AS split
FROM (SELECT *, least(greatest(orig_bytes / (resp_bytes + 1.0), 0.0), 1e6) AS bytes_ratio,
    least(greatest(orig_pkts / (resp_pkts + 1.0), 0.0), 1e6) AS pkts_ratio,
    least(greatest(orig_bytes / (orig_pkts + 1.0), 0.0), 1e6) AS orig_bytes_per_pkt,
    least(greatest(resp_bytes / (resp_pkts + 1.0), 0.0), 1e6) AS resp_bytes_per_pkt
  FROM (SELECT row_id, ts, scenario, coalesce(nullif(proto, '-'), 'unknown') AS proto, coalesce(nullif(service, '-'), 'unknown') AS service,
      coalesce(nullif(conn_state, '-'), 'unknown') AS conn_state, {_numeric},
      coalesce(lower(trim(nullif(label, '-'))), 'unknown') AS label, coalesce(lower(trim(nullif(detailed_label, '-'))), 'unknown') AS detailed_label
    FROM flows_raw) a) b
""")


def preds(spark: SparkSession, sf: str) -> DataFrame:
    """Scored predictions; ``score_milli`` is a whole number, so thresholds compare exactly."""
    benign = F.col("label") == "benign"
    milli = (F.col("row_id") * 7919) % 1000 + F.when(benign, 0).otherwise(400)
    out = flows_raw(spark, sf).select("row_id", "scenario", "ts", F.when(benign, 0).otherwise(1).alias("y_true"), milli.alias("score_milli"))
    return out.withColumns({"y_pred": (F.col("score_milli") >= 700).cast("int"), "y_score": F.col("score_milli") / 1400.0})


table("preds", """
SELECT *, CASE WHEN score_milli >= 700 THEN 1 ELSE 0 END AS y_pred, score_milli / 1400.0::DOUBLE AS y_score
FROM (SELECT row_id, scenario, ts, CASE WHEN label = 'benign' THEN 0 ELSE 1 END AS y_true,
    ((row_id * 7919) % 1000) + CASE WHEN label = 'benign' THEN 0 ELSE 400 END AS score_milli FROM flows_raw) p
""")
table("fractions", "SELECT * FROM (VALUES (0.1::DOUBLE), (0.2::DOUBLE), (0.5::DOUBLE), (1.0::DOUBLE)) t(fraction)")
table("positions", """
SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY ts, row_id) AS pos, count(*) OVER (PARTITION BY scenario) AS n_group FROM preds
""")
# One row per prediction and fraction whose prefix holds it.
table("prefixes", """
SELECT p.*, fraction, greatest(1, floor(n_group * fraction))::BIGINT AS rows_seen FROM positions p CROSS JOIN fractions
WHERE pos <= greatest(1, floor(n_group * fraction))
""")


def unsw_like(spark: SparkSession, sf: str) -> DataFrame:
    """Second domain: one flow per order that has lines, ordered by id.  Lines are aggregated before the joins."""
    lines = read(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.min("l_discount").alias("dur"), F.count(F.lit(1)).alias("spkts"), F.max("l_linenumber").cast("long").alias("dpkts"),
        F.max("l_extendedprice").alias("sbytes"), F.min("l_extendedprice").alias("dbytes"),
        F.max("l_quantity").alias("smean"), F.min("l_quantity").alias("dmean"),
    )
    orders = read(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    customer = read(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    p = F.col("o_orderpriority")
    cat = F.when(p == "5-LOW", "Normal").when(p == "1-URGENT", "DoS").when(p == "2-HIGH", "Exploits").when(p == "3-MEDIUM", "Generic").otherwise("Fuzzers")
    return (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .select(
            F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("proto"), F.col("c_mktsegment").alias("service"),
            "dur", "spkts", "dpkts", "sbytes", "dbytes", "smean", "dmean", cat.alias("attack_cat"), (p != "5-LOW").cast("int").alias("label"),
        )
    )


table("unsw_like", """
SELECT o_orderkey AS id, o_orderstatus AS proto, c_mktsegment AS service,
  min(l_discount) AS dur, count(*) AS spkts, CAST(max(l_linenumber) AS BIGINT) AS dpkts,
  max(l_extendedprice) AS sbytes, min(l_extendedprice) AS dbytes, max(l_quantity) AS smean, min(l_quantity) AS dmean,
  CASE o_orderpriority WHEN '5-LOW' THEN 'Normal' WHEN '1-URGENT' THEN 'DoS' WHEN '2-HIGH' THEN 'Exploits' WHEN '3-MEDIUM' THEN 'Generic' ELSE 'Fuzzers' END AS attack_cat,
  CASE WHEN o_orderpriority = '5-LOW' THEN 0 ELSE 1 END AS label
FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey
GROUP BY o_orderkey, o_orderstatus, c_mktsegment, o_orderpriority
""")


def importances(spark: SparkSession, sf: str) -> DataFrame:
    """Fold importances: (fold_name, feature, importance)."""
    part = read(spark, sf, "part")
    return part.groupBy(F.col("p_brand").alias("fold_name"), F.col("p_type").alias("feature")).agg(F.sum("p_size").cast("double").alias("importance"))


table("importances", "SELECT p_brand AS fold_name, p_type AS feature, CAST(sum(p_size) AS DOUBLE) AS importance FROM part GROUP BY p_brand, p_type")


def importances_b(spark: SparkSession, sf: str) -> DataFrame:
    """A second model's fold importances; one feature is left out on purpose, as a model leaves out what it never uses."""
    cents = F.sum(F.round(F.col("p_retailprice")).cast("long")).cast("double")
    part = read(spark, sf, "part").where(F.col("p_type") != "ECONOMY")
    return part.groupBy(F.col("p_brand").alias("fold_name"), F.col("p_type").alias("feature")).agg(cents.alias("importance"))


table("importances_b", """
SELECT p_brand AS fold_name, p_type AS feature, CAST(sum(CAST(round(p_retailprice) AS BIGINT)) AS DOUBLE) AS importance
FROM part WHERE p_type <> 'ECONOMY' GROUP BY p_brand, p_type
""")


def zeek_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Raw labelled log text with comment lines and short rows."""
    i = F.col("row_id")
    tab = "\t"
    full = F.concat_ws(
        tab, i.cast("string"), F.concat(F.lit("C"), i.cast("string")), F.lit("10.0.0.1"), F.lit("1"), F.lit("10.0.0.2"), F.lit("2"),
        "proto", "service", "duration", "orig_bytes", "resp_bytes", "conn_state", F.lit("-"), F.lit("-"), "missed_bytes", F.lit("S"),
        "orig_pkts", "orig_ip_bytes", "resp_pkts", "resp_ip_bytes",
        F.concat(F.lit("(empty)   "), F.col("label"), F.lit("   "), F.col("detailed_label")),
    )
    line = F.when(i % 211 == 0, "#comment").when(i % 199 == 0, f"short{tab}row").otherwise(full)
    return flows_raw(spark, sf).select("row_id", "scenario", line.alias("value"))


table("zeek_lines", """
SELECT row_id, scenario, CASE WHEN row_id % 211 = 0 THEN '#comment' WHEN row_id % 199 = 0 THEN concat('short', chr(9), 'row')
  ELSE concat_ws(chr(9), CAST(row_id AS VARCHAR), concat('C', CAST(row_id AS VARCHAR)), '10.0.0.1', '1', '10.0.0.2', '2', proto, service, duration, orig_bytes, resp_bytes, conn_state, '-', '-', missed_bytes, 'S', orig_pkts, orig_ip_bytes, resp_pkts, resp_ip_bytes, concat('(empty)   ', label, '   ', detailed_label)) END AS value
FROM flows_raw
""")


def run_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Confusion counts of repeated runs: every model and seed, over every prefix of every scenario.

    All runs are counted side by side in one pass over the predictions.
    """
    scored = preds(spark, sf).select(
        "row_id", "scenario", "ts", "y_true", "score_milli", F.when(F.col("row_id") % 2 == 0, "a_to_b").otherwise("b_to_a").alias("direction")
    )
    counts = []
    for model, cut in MODELS.items():
        for seed in SEEDS:
            alarm = F.col("score_milli") + (F.col("row_id") * seed) % 97 >= cut
            for cell, test in {"tp": alarm & (F.col("y_true") == 1), "fp": alarm & (F.col("y_true") == 0)}.items():
                counts.append(F.count_if(test).alias(f"{cell}_{model}_{seed}"))
    totals = [F.count_if(F.col("y_true") == 1).alias("pos"), F.count_if(F.col("y_true") == 0).alias("neg")]
    cells = prefix_cells(scored, FRACTIONS, ["scenario"], ["ts", "row_id"], totals + counts, extra=["direction"])
    runs_ = [
        F.struct(
            F.lit(m).alias("model"), F.lit(s).alias("seed"), F.col(f"tp_{m}_{s}").alias("tp"), F.col(f"fp_{m}_{s}").alias("fp"),
            (F.col("pos") - F.col(f"tp_{m}_{s}")).alias("fn"), (F.col("neg") - F.col(f"fp_{m}_{s}")).alias("tn"),
        )
        for m in MODELS for s in SEEDS
    ]
    # One row per direction, scenario, fraction, model and seed: fixed once, so that the tables below plan over it cheaply.
    return settle(cells.select("direction", "scenario", "fraction", F.inline(F.array(*runs_))))


table("run_cells", """
SELECT direction, scenario, fraction, model, seed,
  count(*) FILTER (WHERE y_true = 1 AND alarm) AS tp, count(*) FILTER (WHERE y_true = 0 AND alarm) AS fp,
  count(*) FILTER (WHERE y_true = 1 AND NOT alarm) AS fn, count(*) FILTER (WHERE y_true = 0 AND NOT alarm) AS tn
FROM (SELECT CASE WHEN row_id % 2 = 0 THEN 'a_to_b' ELSE 'b_to_a' END AS direction, scenario, fraction, model, seed, y_true,
    score_milli + (row_id * seed) % 97 >= cut AS alarm
  FROM prefixes CROSS JOIN (VALUES ('rf', 800), ('mlp', 900)) m(model, cut) CROSS JOIN (VALUES (1), (2), (3), (4), (5)) s(seed)) x
GROUP BY direction, scenario, fraction, model, seed
""")


def sql_metrics(source: str, mode: str = "present") -> str:
    """Metric columns over a source with tp, fp, fn, tn."""
    b, a = ("1", "1") if mode == "fixed" else ("(tn + fp + fn > 0)::INT", "(tp + fp + fn > 0)::INT")
    bal = "2" if mode == "fixed" else "nullif((tn + fp > 0)::INT + (tp + fn > 0)::INT, 0)"
    macro = ", ".join(f"coalesce(({b} * {m}_benign + {a} * {m}_attack) / nullif({b} + {a}, 0), 0) AS {m}_macro" for m in ("precision", "recall", "f1"))
    weighted = ", ".join(
        f"coalesce(({m}_benign * support_benign + {m}_attack * support_attack) / nullif(n_rows, 0), 0) AS {m}_weighted" for m in ("precision", "recall", "f1")
    )
    return f"""SELECT *, {macro}, {weighted}, coalesce((recall_benign + recall_attack) / {bal}, 0) AS balanced_accuracy
FROM (SELECT *, coalesce(2.0 * precision_benign * recall_benign / nullif(precision_benign + recall_benign, 0), 0)::DOUBLE AS f1_benign,
    coalesce(2.0 * precision_attack * recall_attack / nullif(precision_attack + recall_attack, 0), 0)::DOUBLE AS f1_attack
  FROM (SELECT *, tn + fp + fn + tp AS n_rows, tn + fp AS support_benign, fn + tp AS support_attack,
      coalesce((tn + tp)::DOUBLE / nullif(tn + fp + fn + tp, 0), 0) AS accuracy,
      coalesce(tn::DOUBLE / nullif(tn + fn, 0), 0) AS precision_benign, coalesce(tn::DOUBLE / nullif(tn + fp, 0), 0) AS recall_benign,
      coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) AS precision_attack, coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) AS recall_attack
    FROM ({source}) c0) c1) c2"""


RUN_KEYS = ["direction", "model", "seed", "fraction"]


def runs(spark: SparkSession, sf: str) -> DataFrame:
    """Run metrics per direction, model, seed and fraction."""
    cells = run_cells(spark, sf).groupBy(*RUN_KEYS).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")])
    return metrics_present(cells).select(*RUN_KEYS, "tp", "fp", "fn", "tn", F.col("n_rows").alias("rows_evaluated"), *METRICS)


table("runs", f"""
SELECT {', '.join(RUN_KEYS)}, tp, fp, fn, tn, n_rows AS rows_evaluated, {', '.join(METRICS)}
FROM ({sql_metrics("SELECT direction, model, seed, fraction, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, sum(tn)::BIGINT AS tn FROM run_cells GROUP BY ALL")}) m
""")

PAIR_KEYS = ["pair_id", "pair_family", "source_domain_id", "target_test_domain_id", "seed"]


def pair_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Transfer runs per (source, target scenario) pair: three conditions over target fractions."""
    cells = metrics_present(run_cells(spark, sf))
    condition = F.when(F.col("model") == "rf", "target_only_updated").otherwise("transfer_learning_updated")
    base = [
        F.concat("direction", F.lit("__"), "scenario").alias("pair_id"), F.col("direction").alias("pair_family"),
        F.concat(F.lit("src_"), "direction").alias("source_domain_id"), F.col("scenario").alias("target_test_domain_id"), "seed",
    ]
    adapted = cells.select(*base, condition.alias("condition"), F.col("fraction").alias("target_fraction"), *METRICS)
    source = cells.where("model = 'rf' and fraction = 0.1D").select(
        *base, F.lit("source_only").alias("condition"), F.lit(None).cast("double").alias("target_fraction"), *METRICS
    )
    return adapted.unionByName(source)


_pair_base = "concat(direction, '__', scenario) AS pair_id, direction AS pair_family, concat('src_', direction) AS source_domain_id, scenario AS target_test_domain_id, seed"
table("pair_runs", f"""
SELECT {_pair_base}, CASE model WHEN 'rf' THEN 'target_only_updated' ELSE 'transfer_learning_updated' END AS condition, fraction AS target_fraction, {', '.join(METRICS)}
FROM ({sql_metrics("SELECT * FROM run_cells")}) m
UNION ALL
SELECT {_pair_base}, 'source_only' AS condition, CAST(NULL AS DOUBLE) AS target_fraction, {', '.join(METRICS)}
FROM ({sql_metrics("SELECT * FROM run_cells")}) m WHERE model = 'rf' AND fraction = 0.1::DOUBLE
""")


def pairs_meta(spark: SparkSession, sf: str) -> DataFrame:
    """Attack rates of both sides of each pair."""
    labelled = preds(spark, sf).select("scenario", "y_true", F.when(F.col("row_id") % 2 == 0, "a_to_b").otherwise("b_to_a").alias("direction"))
    cells = labelled.groupBy("direction", "scenario").agg(F.count(F.lit(1)).alias("n"), F.sum("y_true").alias("a"))
    source = cells.groupBy("direction").agg((F.sum("a") / F.sum("n")).alias("source_attack_rate"))
    return cells.join(source, "direction").select(
        F.concat("direction", F.lit("__"), "scenario").alias("pair_id"), F.col("direction").alias("pair_family"),
        F.concat(F.lit("src_"), "direction").alias("source_domain_id"), F.col("scenario").alias("target_test_domain_id"),
        "source_attack_rate", (F.col("a") / F.col("n")).alias("target_attack_rate"),
    )


table("pairs_meta", """
SELECT concat(direction, '__', scenario) AS pair_id, direction AS pair_family, concat('src_', direction) AS source_domain_id, scenario AS target_test_domain_id,
  (sum(a) OVER (PARTITION BY direction))::DOUBLE / (sum(n) OVER (PARTITION BY direction))::DOUBLE AS source_attack_rate, a::DOUBLE / n AS target_attack_rate
FROM (SELECT CASE WHEN row_id % 2 = 0 THEN 'a_to_b' ELSE 'b_to_a' END AS direction, scenario, count(*) AS n, sum(y_true)::BIGINT AS a FROM preds GROUP BY ALL) c
""")


def all_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, tests)
