"""Fits read every row: one attack among 82,000 rows is known to the model, though a sample in proportion would hold none."""

import pytest
from pyspark.sql import functions as F

from flowlab.operators import experiments as X
from flowlab.operators import ensembles as N

MANY = 82_000
FOREST = N.Forest(trees=60)


@pytest.fixture(scope="module")
def rare(spark):
    """Row 0 is the attack; ``x`` and ``proto`` both give it away."""
    hit = F.col("row_id") == 0
    rows = spark.range(MANY).withColumnRenamed("id", "row_id").withColumns({
        "y": hit.cast("int"), "x": hit.cast("double"), "proto": F.when(hit, "odd").otherwise("tcp"), "scenario": F.lit("s0"), "ts": F.col("row_id").cast("double"),
        "kind": F.when(hit, "a0").otherwise("none"),
    })
    return rows.cache()


@pytest.fixture(scope="module")
def few(rare):
    return rare.where("row_id < 40").withColumn("scenario", F.lit("s1")).cache()


def test_baseline_knows_the_rare_row(rare, few):
    row = X.baseline_run(rare, {"test": few, "val": few}, ["x"], ["proto"], "y", "row_id", FOREST).collect()
    assert {r["split"]: (r["n_rows"], r["tp"], r["fp"]) for r in row} == {"test": (40, 1, 0), "val": (40, 1, 0)}
    boost = X.baseline_run(rare, {"test": few}, ["x"], ["proto"], "y", "row_id", N.Boost(rounds=40, depth=2, min_child=0.0, imbalance=True)).first()
    assert (boost["tp"], boost["fp"]) == (1, 0)


def test_each_domain_knows_the_rare_row(rare, few):
    rows = X.cross_domain_run({"there": (rare, few), "back": (few, rare)}, ["x"], ["proto"], "y", "row_id", FOREST).collect()
    assert {r["direction"]: (r["n_rows"], r["tp"], r["fp"]) for r in rows} == {"there": (40, 1, 0), "back": (MANY, 1, 0)}


def test_folds_know_the_rare_row(rare, few):
    out = X.fold_run(rare.unionByName(few), ["x"], ["proto"], "y", "row_id", "scenario", FOREST)
    cells = {(r["fold"], r["y_true"], r["y_pred"]): r["count"] for r in out.groupBy("fold", "y_true", "y_pred").count().collect()}
    assert cells == {("s0", 0, 0): MANY - 1, ("s0", 1, 1): 1, ("s1", 0, 0): 39, ("s1", 1, 1): 1}


def test_early_curve_knows_the_rare_row(rare, few):
    curves, delays = X.early_run(rare, {"test": few}, ["x"], ["proto"], "y", "row_id", FOREST, [0.5, 1.0], ["scenario"], ["ts", "row_id"])
    assert {r["fraction"]: (r["rows_evaluated"], r["tp"], r["fn"]) for r in curves.collect()} == {0.5: (20, 1, 0), 1.0: (40, 1, 0)}
    assert delays.count() == 2


def test_transfer_source_knows_the_rare_row(rare, few):
    spec = N.Boost(depth=2, min_child=0.0, imbalance=True)
    grid = {"pretrain": 40, "adapt": 2, "alone": 40, "spec": spec}
    rows = X.transfer_run(rare, rare, few, ["x"], ["proto"], "y", "row_id", [1.0], balance_ratio=None, **grid).collect()
    assert {r["condition"]: (r["n_rows"], r["tp"], r["fp"]) for r in rows}["source_only"] == (40, 1, 0)
    assert len(rows) == 3


def test_a_missing_kind_is_a_fold_of_its_own(spark):
    rows = spark.createDataFrame([(i, None if i % 3 == 0 else f"s{i % 3}", float(i % 2), i % 2) for i in range(90)], "row_id long, scenario string, x double, y int")
    out = X.fold_run(rows.withColumn("proto", F.lit("tcp")), ["x"], ["proto"], "y", "row_id", "scenario", FOREST)
    assert {r["fold"]: r["count"] for r in out.where("y_true = y_pred").groupBy("fold").count().collect()} == {None: 30, "s1": 30, "s2": 30}


def test_rows_without_a_label_are_scored_but_not_learned(spark):
    rows = spark.createDataFrame([(i, "tcp", float(i % 2), None if i > 90 else i % 2) for i in range(100)], "row_id long, proto string, x double, y int")
    scored = X.fit_and_score(*[X.encoded(X.onehot_encoder(rows, ["x"], ["proto"]), rows)] * 2, "y", FOREST, ["row_id", "x"])
    assert scored.count() == 100 and scored.where("y_pred = x").count() == 100
