"""Queries for model jobs, at their published settings, and streams."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from flowlab.operators import align as A
from flowlab.operators import experiments as X
from flowlab.operators import models as E
from flowlab.operators.ensembles import Boost, Forest
from flowlab.operators.prefix import detection_rate, first_tp, first_tp_summary
from flowlab.operators.runs import skip_table
from flowlab.plans.adapters import FRACTIONS, SQL_SPLIT, TEST, VAL, flows, flows_raw, preds, r6, split_of, unsw_like, zeek_lines
from flowlab.plans.registry import query
from flowlab.schemas import CATEGORICAL, ENGINEERED, NUMERIC
from flowlab.session import cut_lineage, settle, values, work_path
from flowlab.streaming import streams as T

NUM = NUMERIC + ENGINEERED
UNSW_NUM = ["dur", "spkts", "dpkts", "sbytes", "dbytes", "smean", "dmean"]
UNSW_CAT = ["proto", "service"]
REPORT = ["accuracy", "f1_macro", "recall_attack", "f1_attack"]


def _by_split(spark, sf):
    all_flows = flows(spark, sf)
    return {s: all_flows.where(F.col("split") == s) for s in ("train", "val", "test")}


_hot = " + ".join(f"({c} <> 0)::INT" for c in NUM) + " + " + " + ".join(f"({c} IN (SELECT {c} FROM flows WHERE split = 'train'))::INT" for c in CATEGORICAL)


@query("e01_onehot_features", f"""
SELECT split, count(*) AS n_rows, {len(NUM)} + (SELECT count(DISTINCT proto) + count(DISTINCT service) + count(DISTINCT conn_state) FROM flows WHERE split = 'train') AS width, round(avg({_hot}), 6) AS mean_filled FROM flows GROUP BY split""")
def e01(spark, sf):
    """Vector width and filled slots per split, with the encoder learned on train."""
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import vector_to_array

    parts = _by_split(spark, sf)
    model = Pipeline(stages=E.onehot_stages(NUM, CATEGORICAL)).fit(parts["train"])
    v = vector_to_array("features")
    encoded = model.transform(flows(spark, sf)).select("split", v.alias("v"))
    filled = F.size(F.filter("v", lambda x: x != 0))
    return encoded.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"), F.max(F.size("v")).cast("long").alias("width"), F.round(F.avg(filled), 6).alias("mean_filled"))


_gaps = f"SELECT row_id, {SQL_SPLIT} AS split, CASE WHEN proto = 'udp' AND scenario = 'CTU-Cap-09' THEN 'sctp' ELSE proto END AS proto, nullif(service, '-') AS service, TRY_CAST(duration AS DOUBLE) AS duration FROM flows_raw"


@query("e02_ordinal_features", f"""
WITH gaps AS ({_gaps}), train AS (SELECT * FROM gaps WHERE split = 'train'), fill AS (SELECT quantile_cont(duration, 0.5) AS d, (SELECT service FROM train WHERE service IS NOT NULL GROUP BY service ORDER BY count(*) DESC, service LIMIT 1) AS s FROM train),
protos AS (SELECT proto, row_number() OVER (ORDER BY proto) - 1 AS code FROM (SELECT DISTINCT proto FROM train) x), services AS (SELECT service, row_number() OVER (ORDER BY service) - 1 AS code FROM (SELECT DISTINCT coalesce(service, s) AS service FROM train, fill) x)
SELECT row_id, coalesce(p.code, -1)::DOUBLE AS proto_code, coalesce(v.code, -1)::DOUBLE AS service_code, round(coalesce(duration, d), 6) AS duration FROM gaps CROSS JOIN fill LEFT JOIN protos p ON p.proto = gaps.proto LEFT JOIN services v ON v.service = coalesce(gaps.service, s)""")
def e02(spark, sf):
    """Uncleaned flows with gaps: medians, modes and codes learned on train; a word only the test part holds becomes -1."""
    from pyspark.ml.functions import vector_to_array

    from flowlab.functions.clean import null_tokens, to_double

    raw = null_tokens(flows_raw(spark, sf), ["service"]).withColumns({
        "split": split_of(F.col("scenario")), "duration": to_double(F.col("duration")),
        "proto": F.when((F.col("proto") == "udp") & (F.col("scenario") == "CTU-Cap-09"), "sctp").otherwise(F.col("proto")),
    })
    coder = E.fit_ordinal(raw.where("split = 'train'"), ["duration"], ["proto", "service"])
    v = vector_to_array("features")
    return coder.transform(raw).select("row_id", v[0].alias("proto_code"), v[1].alias("service_code"), F.round(v[2], 6).alias("duration"))


#: What every metrics row must satisfy, so that it can be compared with SQL: who was scored, and sane values.
RATES = ["accuracy", "balanced_accuracy", "precision_macro", "recall_macro", "f1_macro", "precision_attack", "recall_attack", "f1_attack"]


def _facts(*keys):
    """Rows and classes scored, whether every rate lies in [0, 1], and whether the accuracy is that of the cells."""
    inside = reduce(lambda a, b: a & b, [F.col(c).between(0.0, 1.0) for c in RATES])
    exact = F.abs(F.col("accuracy") * F.col("n_rows") - F.col("tn") - F.col("tp")) < 1e-6
    return [*keys, "n_rows", F.col("support_benign").alias("n_benign"), F.col("support_attack").alias("n_attack"), (inside & exact).alias("sound")]


_FACTS = "count(*) AS n_rows, count(*) FILTER (WHERE {y} = 0) AS n_benign, count(*) FILTER (WHERE {y} = 1) AS n_attack, TRUE AS sound"
_SPLIT_FACTS = _FACTS.format(y="label_binary")
_SIDES = "(SELECT 'first_to_second' AS direction, CAST(label AS BIGINT) AS y FROM unsw_like UNION ALL SELECT 'second_to_first', label_binary FROM flows) t"

# Published settings of the fits.
FOREST = Forest(trees=300, depth=None)
FOLD_FOREST = Forest(trees=200, depth=None)
TRANSFER_FRACTIONS = [0.05, 0.10, 0.25, 0.50, 1.0]
TUNING = {
    "rounds 250, depth 4": Boost(250, 4, 0.05, 0.8, 0.8, 1, 1.0, True),
    "rounds 400, depth 4": Boost(400, 4, 0.05, 0.8, 0.8, 3, 5.0, True),
    "rounds 350, depth 5": Boost(350, 5, 0.03, 0.85, 0.85, 3, 5.0, True),
    "rounds 500, depth 5": Boost(500, 5, 0.03, 0.7, 0.8, 5, 10.0, True),
    "rounds 300, depth 6": Boost(300, 6, 0.05, 0.8, 1.0, 1, 1.0, True),
    "rounds 450, depth 6": Boost(450, 6, 0.03, 0.85, 0.85, 5, 10.0, True),
}


def _baseline(spark, sf, spec, evals, folder=None):
    parts = _by_split(spark, sf)
    return X.baseline_run(parts["train"], {s: parts[s] for s in evals}, NUM, CATEGORICAL, "label_binary", "row_id", spec, folder=folder)


@query("e03_random_forest", f"SELECT split, {_SPLIT_FACTS} FROM flows WHERE split = 'test' GROUP BY split")
def e03(spark, sf):
    """300 trees of any depth on train, every row of test scored."""
    return _baseline(spark, sf, FOREST, ["test"]).select(*_facts("split"))


@query("e04_boosted_trees", f"SELECT split, {_SPLIT_FACTS} FROM flows WHERE split = 'test' GROUP BY split")
def e04(spark, sf):
    """250 rounds of the first published setting."""
    return _baseline(spark, sf, TUNING["rounds 250, depth 4"], ["test"]).select(*_facts("split"))


@query("e05_neural_net", f"SELECT split, {_SPLIT_FACTS} FROM flows WHERE split = 'test' GROUP BY split")
def e05(spark, sf):
    """Two hidden layers of 128 and 64, fitted on a bounded sample of train."""
    parts = _by_split(spark, sf)
    train = X.fit_sample(parts["train"], "label_binary", "row_id")
    model = E.fit_mlp(cut_lineage(train), NUM, CATEGORICAL, "label_binary", hidden=(128, 64), max_iter=50)
    return E.evaluate_split(model, parts["test"], "label_binary", 0.5).select(*_facts("split"))


def _domains(spark, sf):
    """Both domains under aligned names, with the same category words."""
    first = A.align(flows(spark, sf).withColumnRenamed("label_binary", "y"), A.mapping("iot23"), ["row_id", "y"])
    second = A.align(unsw_like(spark, sf).withColumns({"row_id": F.col("id"), "y": F.col("label").cast("long")}), A.mapping("unsw"), ["row_id", "y"])
    names = list(A.mapping("iot23").values())
    return first, second, names[2:], names[:2]


@query("e06_cross_domain", f"SELECT direction, {_FACTS.format(y='y')} FROM {_SIDES} GROUP BY direction")
def e06(spark, sf):
    """300 trees on each domain, every row of the other one scored."""
    first, second, num, cat = _domains(spark, sf)
    return X.cross_domain_run({"first_to_second": (first, second), "second_to_first": (second, first)}, num, cat, "y", "row_id", FOREST).select(*_facts("direction"))


_CONDITIONS = f"(SELECT 'source_only' AS condition, CAST(NULL AS DOUBLE) AS target_fraction UNION ALL SELECT c, f FROM (VALUES ('target_only_updated'), ('transfer_learning_updated')) a(c) CROSS JOIN (VALUES {', '.join(f'({f}::DOUBLE)' for f in TRANSFER_FRACTIONS)}) b(f)) c"


@query("e07_transfer_conditions", f"""
SELECT condition, target_fraction, CASE WHEN condition = 'source_only' THEN 'default' ELSE 'calibration_split' END AS threshold_selection_mode, TRUE AS threshold_in_grid, t.* FROM {_CONDITIONS}
CROSS JOIN (SELECT {_FACTS.format(y='label')} FROM unsw_like WHERE id % 10 >= 7) t""")
def e07(spark, sf):
    """Source model of 200 rounds, 200 rounds on the target alone, 100 more on the target: five fractions of the target."""
    first, second, num, cat = _domains(spark, sf)
    part = F.col("row_id") % 10 < 7
    out = X.transfer_run(first, second.where(part), second.where(~part), num, cat, "y", "row_id", TRANSFER_FRACTIONS)
    in_grid = F.col("selected_threshold").isin(*E.RECIPE_THRESHOLDS)
    return out.select(*_facts("condition", "target_fraction", "threshold_selection_mode", in_grid.alias("threshold_in_grid")))


_PROTOS = ["gre", "icmp", "tcp", "udp"]
_PAIR_SIDES = "SELECT proto, count(*) FILTER (WHERE row_id % 10 < 7) AS n_train, count(*) FILTER (WHERE row_id % 10 >= 7) AS n_rows, count(*) FILTER (WHERE row_id % 10 >= 7 AND label_binary = 0) AS n_benign, count(*) FILTER (WHERE row_id % 10 >= 7 AND label_binary = 1) AS n_attack FROM flows GROUP BY proto"


@query("r05_pair_grid", f"""
WITH protos AS (SELECT unnest([{', '.join(f"'{p}'" for p in _PROTOS)}]) AS proto), pairs AS (SELECT concat(a.proto, '_to_', b.proto) AS pair_id, a.proto AS s, b.proto AS t FROM protos a JOIN protos b ON a.proto < b.proto), sides AS ({_PAIR_SIDES})
SELECT pair_id, 7 AS seed, 'skipped_invalid_source' AS condition, 'source_train_single_class' AS skip_reason, CAST(NULL AS DOUBLE) AS target_fraction, CAST(NULL AS BIGINT) AS n_rows, CAST(NULL AS BIGINT) AS n_benign, CAST(NULL AS BIGINT) AS n_attack, CAST(NULL AS BOOLEAN) AS sound
FROM pairs WHERE s NOT IN (SELECT proto FROM sides)
UNION ALL SELECT pair_id, 7, condition, NULL, CASE WHEN condition = 'source_only' THEN NULL ELSE 1.0::DOUBLE END, n_rows, n_benign, n_attack, TRUE FROM pairs JOIN sides ON proto = t
CROSS JOIN (VALUES ('source_only'), ('target_only_updated'), ('transfer_learning_updated')) c(condition) WHERE s IN (SELECT proto FROM sides)""")
def r05_grid(spark, sf):
    """Protocols as domains, each pair one run of its own; the protocol that no flow has is listed with its reason."""
    rows = settle(flows(spark, sf).select("row_id", *NUM, "service", "conn_state", "proto", "label_binary"))
    test = F.col("row_id") % 10 >= 7
    classes = rows.groupBy("proto").agg(
        *[F.count_if(where & (F.col("label_binary") == y)).alias(f"{side}_n_{name}") for side, where in (("source", F.lit(True)), ("target_train", ~test), ("target_test", test)) for y, name in ((0, "benign"), (1, "attack"))]
    )
    sides = [(f"{a}_to_{b}", a, b) for a in _PROTOS for b in _PROTOS if a < b]
    of = lambda key, prefix: classes.select(F.col("proto").alias(key), *[c for c in classes.columns if c.startswith(prefix)])
    pairs = values(spark, sides, "pair_id string, source string, target string").join(of("source", "source"), "source", "left").join(of("target", "target"), "target", "left").fillna(0)
    todo = skip_table(pairs).select("pair_id", "condition", "skip_reason")

    def pools(pair):
        source, target = pair["pair_id"].split("_to_")
        own = rows.where(F.col("proto") == target)
        return rows.where(F.col("proto") == source), own.where(~test), own.where(test)

    out = X.pair_run(todo, pools, [7], work_path(spark, "pair-runs"), num=NUM, cat=["service", "conn_state"], label="label_binary", key="row_id", fractions=[1.0])
    return out.select("skip_reason", *_facts("pair_id", "seed", "condition", "target_fraction"))


@query("e08_tune", f"SELECT s.*, TRUE AS threshold_in_grid, TRUE AS sound, TRUE AS in_order FROM (VALUES {', '.join(f'({i}, {spec.rounds})' for i, spec in enumerate(TUNING.values()))}) s(setting, rounds)")
def e08(spark, sf):
    """The six published settings, each at its best threshold; ordered by macro F1, attack F1 and accuracy."""
    train = _by_split(spark, sf)["train"]
    out = settle(X.tune_grid(train, TUNING, NUM, CATEGORICAL, "label_binary", "row_id", "scenario", E.RECIPE_THRESHOLDS).withColumn("place", F.monotonically_increasing_id()))
    keys = ["f1_macro", "f1_attack", "accuracy"]
    rank = F.row_number().over(Window.orderBy(*[F.desc(k) for k in keys], "setting"))
    place = F.row_number().over(Window.orderBy("place"))
    sound = reduce(lambda a, b: a & b, [F.col(k).between(0.0, 1.0) for k in keys])
    return out.select("setting", "rounds", F.col("threshold").isin(*E.RECIPE_THRESHOLDS).alias("threshold_in_grid"), sound.alias("sound"), (rank == place).alias("in_order"))


@query("e09_leave_one_scenario_out", f"SELECT scenario AS fold, {_SPLIT_FACTS} FROM flows GROUP BY scenario")
def e09(spark, sf):
    """200 trees of any depth per fold; each row is scored by the model that has not seen its scenario."""
    out = X.fold_run(flows(spark, sf), NUM, CATEGORICAL, "label_binary", "row_id", "scenario", FOLD_FOREST)
    return E.fold_metrics(out).select(*_facts("fold"))


@query("e09_leave_one_attack_out", f"""
SELECT k.attack_cat AS fold, {_FACTS.format(y='label')} FROM (SELECT DISTINCT attack_cat FROM unsw_like WHERE attack_cat <> 'Normal') k JOIN unsw_like u ON u.attack_cat IN ('Normal', k.attack_cat) GROUP BY k.attack_cat""")
def e09_attack(spark, sf):
    """300 trees of any depth per held-out attack; benign rows are tested by every fold."""
    rows = unsw_like(spark, sf).withColumn("label", F.col("label").cast("long"))
    return E.fold_metrics(X.fold_run(rows, UNSW_NUM, UNSW_CAT, "label", "id", "attack_cat", FOREST, benign="Normal")).select(*_facts("fold"))


_EARLY = f"""
WITH part AS (SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY ts, row_id) AS pos, count(*) OVER (PARTITION BY scenario) AS n FROM flows WHERE split <> 'train'),
cut AS (SELECT p.*, fraction FROM part p CROSS JOIN fractions WHERE pos <= greatest(1, floor(n * fraction)))
SELECT split, fraction, count(*) AS rows_evaluated, count(DISTINCT scenario) AS n_scenarios, count(*) FILTER (WHERE label_binary = 1) AS n_attack,
 count(DISTINCT scenario) FILTER (WHERE scenario IN (SELECT scenario FROM flows WHERE label_binary = 1)) AS n_attack_scenarios, TRUE AS sound FROM cut GROUP BY split, fraction"""


@query("e10_early_detection", _EARLY)
def e10(spark, sf):
    """Curve per fraction beside the detection rate of attack scenarios and when each was first hit; 300 trees, each split scored once."""
    parts = _by_split(spark, sf)
    curves, delays = X.early_run(parts["train"], {s: parts[s] for s in ("val", "test")}, NUM, CATEGORICAL, "label_binary", "row_id", FOREST, FRACTIONS, ["scenario"], ["ts", "row_id"])
    rates = detection_rate(delays, ["split", "fraction"]).select("split", "fraction", "detection_rate", F.col("n_scenarios").alias("n_attack_scenarios"))
    firsts = first_tp_summary(first_tp(delays, ["split", "scenario"]), ["split"]).select("split", "n_valid_rows", "min_fraction", "mean_fraction", "max_fraction")
    out = curves.join(rates, ["split", "fraction"], "left").join(firsts, "split", "left")
    rates_in = reduce(lambda a, b: a & b, [F.coalesce(F.col(c), F.lit(0.0)).between(0.0, 1.0) for c in (*REPORT, "detection_rate", "min_fraction", "max_fraction")])
    slack = F.lit(1e-9)
    ordered = F.coalesce((F.col("min_fraction") <= F.col("mean_fraction") + slack) & (F.col("mean_fraction") <= F.col("max_fraction") + slack), F.lit(True))
    return out.select("split", "fraction", "rows_evaluated", "n_scenarios", (F.col("tp") + F.col("fn")).alias("n_attack"), "n_attack_scenarios", (rates_in & ordered).alias("sound"))


@query("e11_importances", f"""
WITH train AS (SELECT * FROM flows WHERE split = 'train'), slots AS (
 SELECT unnest([{', '.join(f"'{c}'" for c in NUM)}]) AS feature UNION ALL {' UNION ALL '.join(f"SELECT DISTINCT concat('{c}_oh_', {c}) FROM train" for c in CATEGORICAL)})
SELECT count(*) AS n_features, count(DISTINCT feature) AS n_names, 1.0::DOUBLE AS total, TRUE AS constant_is_zero, TRUE AS in_order FROM slots""")
def e11(spark, sf):
    """Importances of 300 trees: one per slot, together one, none for the feature that never varies, largest first."""
    train = _by_split(spark, sf)["train"]
    encoder = X.onehot_encoder(train, NUM, CATEGORICAL)
    model = X.fit_one(X.encoded(encoder, train), "label_binary", "row_id", FOREST)
    table = X.importance_table(model, X.slot_names(encoder, train), train)
    falling = Window.orderBy(F.desc("importance"), "feature")
    return table.withColumn("rank", F.row_number().over(falling)).agg(
        F.count(F.lit(1)).alias("n_features"), F.count_distinct("feature").alias("n_names"), F.round(F.sum("importance"), 9).alias("total"),
        (F.max(F.when(F.col("feature") == "missed_bytes", F.col("importance"))) == 0.0).alias("constant_is_zero"), F.bool_and(F.col("rank") == F.col("place")).alias("in_order"),
    )


@query("e12_baseline", f"SELECT split, {_SPLIT_FACTS} FROM flows WHERE split <> 'train' GROUP BY split")
def e12(spark, sf):
    """300 trees on train; predictions of validation and test written, then read for their metrics."""
    return _baseline(spark, sf, FOREST, ["val", "test"], work_path(spark, "baseline")).select(*_facts("split"))


@query("m15_evaluate_split", f"SELECT 'all' AS split, {_SPLIT_FACTS} FROM flows")
def m15(spark, sf):
    """Every flow scored once by a model learned on train; predictions written, then read for the metrics."""
    rows = flows(spark, sf)
    train = rows.where("split = 'train'")
    encoder = X.onehot_encoder(train, NUM, CATEGORICAL)
    model = X.fit_one(X.encoded(encoder, train), "label_binary", "row_id", FOREST)
    return X.evaluate(model, X.encoded(encoder, rows), "label_binary", 0.5, work_path(spark, "scored"), "all").select(*_facts("split"))


def _scored_stream(spark, sf):
    """The events table as a stream, two files per micro-batch, scored as the predictions are."""
    source = work_path(spark, "stream-in")
    preds(spark, sf).select("scenario", "ts", "y_true", "y_pred").write.parquet(source)
    return spark.readStream.schema("scenario string, ts double, y_true int, y_pred int").option("maxFilesPerTrigger", 2).parquet(source)


def _drain(spark, df, mode):
    out = work_path(spark, "stream-out")
    query_ = T.run_batches(df, work_path(spark, "stream-state"), lambda batch, _: batch.write.mode("overwrite").parquet(out), mode)
    query_.awaitTermination()
    return spark.read.parquet(out)


@query("t01_stream_confusion", """
WITH days AS (SELECT *, floor(ts / 86400) AS day, (min(floor(ts / 86400)) OVER () + max(floor(ts / 86400)) OVER ()) / 2 AS mid FROM preds), in_time AS (SELECT * FROM days WHERE NOT (row_id % 50 = 0 AND day < mid))
SELECT CAST(day AS BIGINT) * 86400000000 AS window_start_us, scenario, count(*) FILTER (WHERE y_true = 0 AND y_pred = 0) AS tn, count(*) FILTER (WHERE y_true = 0 AND y_pred = 1) AS fp,
 count(*) FILTER (WHERE y_true = 1 AND y_pred = 0) AS fn, count(*) FILTER (WHERE y_true = 1 AND y_pred = 1) AS tp
FROM in_time WHERE (day + 1) * 86400 <= (SELECT max(ts) FROM in_time) - 3600 GROUP BY 1, 2""")
def t01(spark, sf):
    """Three arrivals: the first half of the days, the second half, and rows of the first half that come too late.

    Windows behind the watermark are handed on once and leave the state, so the late rows are dropped; a window
    that the watermark has not passed stays open and is not handed on.
    """
    rows = settle(preds(spark, sf).select("row_id", "scenario", "ts", "y_true", "y_pred").withColumn("day", F.floor(F.col("ts") / 86400)))
    mid = rows.agg(((F.min("day") + F.max("day")) / 2).alias("mid")).first()["mid"]
    early = F.col("day") < mid
    late = early & (F.col("row_id") % 50 == 0)
    source, out, state = (work_path(spark, f"stream-{x}") for x in ("in", "out", "state"))
    for arrival in (early & ~late, ~early, late):
        rows.where(arrival).select("scenario", "ts", "y_true", "y_pred").write.mode("append").parquet(source)
        arrived = spark.readStream.schema("scenario string, ts double, y_true int, y_pred int").parquet(source)
        T.run_to_table(T.stream_confusion(arrived, late="1 hour"), out, state).awaitTermination()
    return spark.read.parquet(out)


@query("t02_stream_first_tp", "SELECT scenario, min(ts) FILTER (WHERE y_true = 1 AND y_pred = 1) AS first_tp_ts, min(ts) AS first_ts, count(*) FILTER (WHERE y_true = 1 AND y_pred = 1) AS n_tp, count(*) AS n_rows FROM preds GROUP BY scenario")
def t02(spark, sf):
    return _drain(spark, T.stream_first_tp(_scored_stream(spark, sf)), "complete")


@query("t03_stream_ingest", "SELECT split, count(*) AS n_rows, count(*) FILTER (WHERE label = 'benign') AS n_benign FROM (SELECT CASE WHEN scenario IN ('CTU-Cap-09', 'CTU-Cap-10', 'CTU-Cap-11') THEN 'test' WHEN scenario = 'CTU-Cap-08' THEN 'val' ELSE 'train' END AS split, label FROM lines_labelled) l GROUP BY split")
def t03(spark, sf):
    """Log folders written per scenario, picked up by the ingest stream."""
    root = work_path(spark, "ingest-in")
    zeek_lines(spark, sf).select("value", "scenario").write.partitionBy("scenario").text(root)
    out = work_path(spark, "ingest-out")
    folder = F.regexp_extract("path", r"scenario=([^/]+)/", 1)
    T.stream_ingest(spark, root, out, work_path(spark, "ingest-state"), "part-*", TEST, VAL, scenario=folder).awaitTermination()
    return spark.read.parquet(out).groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("label") == "benign").alias("n_benign"))

