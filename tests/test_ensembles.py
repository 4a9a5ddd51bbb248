"""Trees, forests and boosting against plain rules; experiments on tables with a known signal."""

import pickle

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlab.operators import ensembles as N
from flowlab.operators import experiments as X
from flowlab.operators.metrics import confusion, metrics_present


def best_cut(codes, g, h, lam):
    """Exhaustive search over features and cuts."""
    best = (0.0, None, None)
    score = lambda m: g[m].sum() ** 2 / (h[m].sum() + lam) if m.any() else 0.0
    for f in range(codes.shape[1]):
        for c in range(codes[:, f].max() if len(codes) else 0):
            low = codes[:, f] <= c
            gain = score(low) + score(~low) - score(np.ones(len(g), bool))
            if low.any() and (~low).any() and gain > best[0] + 1e-9:
                best = (gain, f, c)
    return best


def grow_plainly(codes, g, h, depth, lam, rows, out):
    gain, f, c = best_cut(codes[rows], g[rows], h[rows], lam) if depth else (0.0, None, None)
    if f is None:
        out[rows] = g[rows].sum() / (h[rows].sum() + lam)
        return
    low = codes[rows, f] <= c
    grow_plainly(codes, g, h, depth - 1, lam, rows[low], out)
    grow_plainly(codes, g, h, depth - 1, lam, rows[~low], out)


@pytest.mark.parametrize("sparse", [0.0, 1e9])
@pytest.mark.parametrize("lam", [0.0, 2.0])
def test_tree_equals_exhaustive_search(lam, sparse, monkeypatch):
    monkeypatch.setattr(N, "SPARSE", sparse)
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 9, (120, 4)).astype(np.uint8)
    g, h = rng.normal(size=120), rng.random(120) + 0.1
    tree = N.grow(codes, g, h, 3, np.arange(4), lam)
    want = np.zeros(120)
    grow_plainly(codes, g, h, 3, lam, np.arange(120), want)
    assert tree.walk(codes) == pytest.approx(want)


def test_cells_in_blocks_give_the_same_tree(monkeypatch):
    rng = np.random.default_rng(2)
    codes = rng.integers(0, 20, (400, 5)).astype(np.uint8)
    y = (codes[:, 0] * codes[:, 1] > 60).astype(float)
    whole = N.grow(codes, y, np.ones(400), None, np.arange(5))
    monkeypatch.setattr(N, "CELLS", 700)
    assert N.grow(codes, y, np.ones(400), None, np.arange(5)).walk(codes) == pytest.approx(whole.walk(codes))
    assert whole.walk(codes) == pytest.approx(y)  # grown to the end, a tree knows every row


def test_bins_keep_order_and_missing_values_come_last():
    x = np.array([[1.0, 5.0], [2.0, float("nan")], [2.0, 7.0], [900.0, 5.0]])
    edges = N.bin_edges(x)
    assert N.quantised(x, edges).tolist() == [[0, 0], [1, 1], [1, 1], [2, 0]]
    many = N.bin_edges(np.arange(10_000.0)[:, None])
    assert len(many[0]) <= N.BINS - 1 and N.quantised(np.arange(10_000.0)[:, None], many).max() == len(many[0])


@pytest.fixture(scope="module")
def toy(spark):
    rng = np.random.default_rng(5)
    x, z = rng.random(900), rng.random(900)
    y = ((x > 0.5) ^ (rng.random(900) < 0.03)).astype(int)
    data = [(i, f"s{i % 4}", "none" if not c else f"a{i % 2}", float(a), float(b), "tcp" if b > 0.5 else "udp", int(c), float(i)) for i, (a, b, c) in enumerate(zip(x, z, y))]
    return spark.createDataFrame(data, "row_id long, scenario string, kind string, x double, z double, proto string, y int, ts double").cache()


def halves(toy):
    return toy.where("row_id < 600"), toy.where("row_id >= 600")


@pytest.mark.parametrize("spec", [N.Forest(trees=25), N.Boost(rounds=25, depth=3)])
def test_models_find_the_signal(toy, spec):
    train, test = halves(toy)
    row = X.baseline_run(train, {"test": test}, ["x", "z"], ["proto"], "y", "row_id", spec).first()
    assert row["n_rows"] == 300 and row["f1_macro"] > 0.9
    encoder = X.onehot_encoder(train, ["x", "z"], ["proto"])
    model = X.fit_one(X.encoded(encoder, train), "y", "row_id", spec)
    table = X.importance_table(model, X.slot_names(encoder, train), train).orderBy("place").collect()
    assert table[0]["feature"] == "x" and sum(r["importance"] for r in table) == pytest.approx(1.0)
    assert {r["feature"] for r in table} == {"x", "z", "proto_oh_tcp", "proto_oh_udp"}


def test_fit_does_not_depend_on_partitions(toy):
    train, test = halves(toy)
    a, b = (X.baseline_run(t, {"test": test}, ["x", "z"], ["proto"], "y", "row_id", N.Forest(trees=12, depth=4)).first() for t in (train, train.repartition(7)))
    assert a == b


def test_fit_reads_a_bounded_sample(toy):
    assert X.fit_sample(toy, "y", "row_id", 100).count() == 100


def test_folds_are_scored_by_the_model_that_left_them_out(toy):
    out = X.fold_run(toy, ["x", "z"], ["proto"], "y", "row_id", "scenario", N.Forest(trees=10, depth=4))
    rows = metrics_present(confusion(out, ["fold"])).collect()
    assert {r["fold"]: r["n_rows"] for r in rows} == {f"s{k}": 225 for k in range(4)} and all(r["accuracy"] > 0.85 for r in rows)
    attacks = X.fold_run(toy, ["x", "z"], ["proto"], "y", "row_id", "kind", N.Forest(trees=10, depth=4), benign="none")
    benign = toy.where("kind = 'none'").count()
    want = {r["kind"]: r["count"] + benign for r in toy.where("kind <> 'none'").groupBy("kind").count().collect()}
    assert {r["fold"]: r["count"] for r in attacks.groupBy("fold").count().collect()} == want


def test_leaking_feature_is_not_known_to_its_fold(spark):
    """Each scenario has a category of its own that gives its label away; a fold that leaves it out can only guess."""
    rows = [(i, f"s{i % 2}", f"s{i % 2}:{i // 2 % 2}", 1.0, i // 2 % 2) for i in range(200)]
    df = spark.createDataFrame(rows, "row_id long, scenario string, proto string, x double, y int")
    out = X.fold_run(df, ["x"], ["proto"], "y", "row_id", "scenario", N.Forest(trees=5))
    assert out.select("fold", "y_pred").distinct().count() == 2  # one answer per fold


def test_tuning_orders_settings(toy):
    grid = {"weak": N.Boost(rounds=1, depth=1, rate=0.01, columns=0.3), "good": N.Boost(rounds=20, depth=3)}
    out = X.tune_grid(toy, grid, ["x", "z"], ["proto"], "y", "row_id", "scenario", [0.3, 0.5, 0.7]).collect()
    assert out[0]["name"] == "good" and out[0]["f1_macro"] > 0.9 and {r["name"] for r in out} == set(grid)


def test_transfer_conditions_and_continued_trees(toy):
    source, target = halves(toy)
    train, test = target.where("row_id < 800"), target.where("row_id >= 800")
    grid = {"pretrain": 15, "adapt": 5, "alone": 15, "spec": N.Boost(depth=3)}
    out = {(r["condition"], r["target_fraction"]): r for r in X.transfer_run(source, train, test, ["x", "z"], ["proto"], "y", "row_id", [0.2, 1.0], **grid).collect()}
    assert set(out) == {("source_only", None), *((c, f) for c in ("target_only_updated", "transfer_learning_updated") for f in (0.2, 1.0))}
    assert all(r["n_rows"] == 100 for r in out.values()) and out["transfer_learning_updated", 0.2]["f1_macro"] > 0.85
    assert out["source_only", None]["threshold_selection_mode"] == "default" and out["target_only_updated", 1.0]["threshold_selection_mode"] == "calibration_split"


def test_continuing_keeps_the_first_trees(spark, toy):
    coder = X.onehot_encoder(toy, ["x", "z"], ["proto"])
    rows = X.encoded(coder, toy).withColumn("data", F.lit("d"))
    first = N.fit_all(N.pack_samples(rows, "data", "features", "y"), {"a": ("d", N.Boost(rounds=4, depth=2))})["a"]
    more = N.fit_all(N.pack_samples(rows, "data", "features", "y", first.edges), {"b": ("d", N.Boost(rounds=6, depth=2, seed=9))}, {"b": first})["b"]
    x = np.array([r[0] for r in rows.orderBy("row_id").select("features").collect()])
    y = np.array([r[0] for r in rows.orderBy("row_id").select("y").collect()])
    loss = lambda m: -np.log(np.where(y == 1, m.predict(x), 1 - m.predict(x))).mean()
    assert len(more.trees) == 10 and all((a.value == b.value).all() for a, b in zip(first.trees, more.trees[:4]))
    assert loss(more) < loss(first) < np.log(2)


def test_pair_run_is_continued(spark, toy, tmp_path):
    source, target = halves(toy)
    pairs = spark.createDataFrame([("p1", "valid", None), ("p2", "skipped_invalid_source", "source_train_single_class")], "pair_id string, condition string, skip_reason string")
    asked = []

    def pools(pair):
        asked.append((pair["pair_id"], pair["seed"]))
        return source, target, target

    grid = {"num": ["x"], "cat": ["proto"], "label": "y", "key": "row_id", "fractions": [1.0], "pretrain": 2, "adapt": 1, "alone": 2}
    first = X.pair_run(pairs, pools, [1], str(tmp_path / "runs"), **grid)
    assert first.count() == 4 and asked == [("p1", 1)]
    again = X.pair_run(pairs, pools, [1, 2], str(tmp_path / "runs"), **grid)
    assert asked == [("p1", 1), ("p1", 2)]  # the first seed was there already
    assert again.where("skip_reason is null").groupBy("seed").count().orderBy("seed").collect() == [(1, 3), (2, 3)]


def test_scoring_travels_small_and_gives_the_same_values():
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(3000, 5)), rng.integers(0, 2, 3000).astype(float)
    edges = N.bin_edges(x)
    codes = N.quantised(x, edges)
    trees = N.forest_trees(codes, y, N.Forest(), range(6))
    model = N.Ensemble("forest", edges, trees)

    def leaf(tree, row):
        node = 0
        while tree.left[node] >= 0:
            node = tree.left[node] + int(row[tree.feature[node]] > tree.cut[node])
        return tree.value[node]

    want = np.sum([[leaf(t, row) for row in codes[:200]] for t in trees], axis=0) / len(trees)
    assert model.predict(x[:200]) == pytest.approx(want, abs=1e-12)
    assert len(model.squeezed()) * 3 < len(pickle.dumps(model))
    held = N.Scorers({"a": model, "b": model}, 1)
    assert held["a"].predict(x[:9]).tolist() == held["b"].predict(x[:9]).tolist() and list(held.ready) == ["b"]


def test_rows_to_score_are_dealt_to_many_tasks(spark, toy):
    cores = spark.sparkContext.defaultParallelism
    assert N.spread(toy).rdd.getNumPartitions() == 3 * cores
    out = X.fold_run(toy, ["x", "z"], ["proto"], "y", "row_id", "scenario", N.Forest(trees=3, depth=3))
    tasks = out.select("fold", F.spark_partition_id().alias("task")).distinct().groupBy("task").count()
    assert tasks.count() > cores and tasks.agg(F.max("count")).first()[0] <= 2
    assert out.count() == toy.count()
