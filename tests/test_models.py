"""Preprocessing rules, boosting that continues, experiment tables."""

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from flowlab.operators import models as E
from flowlab.operators.metrics import confusion


@pytest.fixture(scope="module")
def toy(spark):
    rng = np.random.default_rng(5)
    x, z = rng.random(600), rng.random(600)
    y = ((x > 0.5) ^ (rng.random(600) < 0.05)).astype(int)
    data = [(i, f"s{i % 4}", float(a), float(b), "tcp" if b > 0.5 else "udp", int(c), float(i)) for i, (a, b, c) in enumerate(zip(x, z, y))]
    return spark.createDataFrame(data, "row_id long, scenario string, x double, z double, proto string, y int, ts double")


def test_unseen_category_is_all_zeros(rows):
    train = rows([(1.0, "a"), (2.0, "b")], "x double, c string")
    model = Pipeline(stages=E.onehot_stages(["x"], ["c"])).fit(train)
    got = [r[0] for r in model.transform(rows([(1.0, "b"), (3.0, "new")], "x double, c string")).select(vector_to_array("features")).collect()]
    assert got == [[1.0, 0.0, 1.0], [3.0, 0.0, 0.0]]


def test_ordinal_coder_fills_and_marks_unseen(rows):
    train = rows([(1.0, "b"), (2.0, "a"), (3.0, "b"), (10.0, None)], "x double, c string")
    coder = E.fit_ordinal(train, ["x"], ["c"])
    assert coder.numeric["x"] == 2.5 and coder.modes["c"] == "b"
    got = [r[0] for r in coder.transform(rows([(None, None), (1.0, "zz"), (1.0, "a")], "x double, c string")).select(vector_to_array("features")).collect()]
    assert got == [[1.0, 2.5], [-1.0, 1.0], [0.0, 1.0]]


def test_class_weights(toy):
    n = {r["y"]: r["n"] for r in toy.groupBy("y").agg(F.count("*").alias("n")).collect()}
    w = {r["y"]: r["weight"] for r in E.balanced_weight(toy, "y").select("y", "weight").distinct().collect()}
    assert w == pytest.approx({k: 600 / (2 * v) for k, v in n.items()})
    w = {r["y"]: r["weight"] for r in E.imbalance_weight(toy, "y").select("y", "weight").distinct().collect()}
    assert w == pytest.approx({0: 1.0, 1: n[0] / n[1]})


def loss(booster, df):
    s = booster.score(df, ["y"])
    p = F.least(F.greatest("y_score", F.lit(1e-9)), F.lit(1 - 1e-9))
    return s.agg(F.avg(-F.when(F.col("y") == 1, F.log(p)).otherwise(F.log(1 - p)))).first()[0]


def test_boosting_continues_from_the_source_trees(toy):
    df = E.fit_ordinal(toy, ["x", "z"], ["proto"]).transform(toy)
    first = E.boost(df, "y", 2, rate=0.3, depth=2)
    more = E.boost(df, "y", 3, start=first, depth=2, cut_every=2)
    assert len(more.trees) == 5 and more.trees[:2] == first.trees
    assert loss(more, df) < loss(first, df) < np.log(2)
    share = {r["feature"]: r["importance"] for r in more.importances(df, ["proto", "x", "z"]).collect()}
    assert share["x"] > 0.5 and sum(share.values()) == pytest.approx(1.0)


def test_forest_scores_folds_and_importances(toy):
    fit = lambda t: E.fit_rf(t, ["x", "z"], ["proto"], "y", trees=4, depth=3)
    out = E.fold_metrics(E.run_folds(toy, ["s0", "s1"], fit, "y")).collect()
    assert {r["fold"]: r["n_rows"] for r in out} == {"s0": 150, "s1": 150} and all(r["accuracy"] > 0.8 for r in out)
    names = [r["feature"] for r in E.importances(fit(toy), toy).collect()]
    assert names[0] == "x" and {"proto_oh_tcp", "proto_oh_udp", "z"} <= set(names)


def test_split_evaluation_writes_what_it_scores(spark, toy, tmp_path):
    model = E.fit_rf(toy, ["x", "z"], ["proto"], "y", trees=3, depth=3)
    row = E.evaluate_split(model, toy, "y", 0.5, str(tmp_path / "p")).first()
    written = spark.read.parquet(str(tmp_path / "p"))
    assert written.dtypes == [("scenario", "string"), ("label_binary", "tinyint"), ("y_pred", "tinyint"), ("y_score", "float")]
    assert confusion(written.withColumnRenamed("label_binary", "y_true")).first()["tp"] == row["tp"]


def test_early_detection_tables(toy):
    fit = lambda t: E.fit_rf(t, ["x"], ["proto"], "y", trees=2, depth=2)
    curves, delays = E.early_detection(toy, {"test": toy}, fit, "y", [0.1, 1.0], ["scenario"], ["ts", "row_id"])
    assert {r["fraction"]: r["rows_evaluated"] for r in curves.collect()} == {0.1: 60, 1.0: 600}
    assert delays.count() == 8


def test_transfer_grid_rows_and_skip_without_calibration(rows, toy):
    train = toy.where("row_id < 300")
    out = E.transfer_grid(toy, train, toy.where("row_id >= 300"), ["x", "z"], ["proto"], "y", "row_id", [0.5], pretrain=2, adapt=1, alone=2, depth=2).collect()
    assert [(r["condition"], r["target_fraction"]) for r in out] == [("source_only", None), ("target_only_updated", 0.5), ("transfer_learning_updated", 0.5)]
    assert out[1]["threshold_selection_mode"] == "calibration_split" and all(r["n_rows"] == 300 for r in out)
    empty = toy.where("row_id < 0")
    assert E.choose_threshold(None, empty, "y", [0.5]) == (0.5, "default_no_calibration")


def test_pairwise_lists_skipped_pairs(rows, toy):
    pairs = rows([("p1", "valid", None), ("p2", "skipped_invalid_source", "source_train_single_class")], "pair_id string, condition string, skip_reason string")
    grid = {"num": ["x"], "cat": ["proto"], "label": "y", "key": "row_id", "fractions": [1.0], "pretrain": 1, "adapt": 1, "alone": 1, "depth": 2}
    out = E.pairwise(pairs, lambda pair: (toy, toy, toy), [1], **grid).select("pair_id", "condition", "skip_reason").collect()
    assert {(r["pair_id"], r["condition"]) for r in out} == {("p2", "skipped_invalid_source"), ("p1", "source_only"), ("p1", "target_only_updated"), ("p1", "transfer_learning_updated")}
