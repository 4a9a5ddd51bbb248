"""Ordered selection against brute force, on groups far larger than the allowed size."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from flowlab.operators import order as O
from flowlab.operators import prefix as X
from flowlab.operators import ranking as R
from flowlab.operators import sampling as H


@pytest.fixture(scope="module")
def skewed(spark):
    """One group holds most rows, a third of them at one time; some times are missing."""
    rng = np.random.default_rng(7)
    n = 3000
    pdf = pd.DataFrame({"g": rng.choice(["hot", "hot", "hot", "b", "c"], n), "ts": rng.integers(0, 400, n) / 4, "row_id": np.arange(n)})
    pdf.loc[rng.random(n) < 0.33, "ts"] = 17.0
    pdf.loc[rng.random(n) < 0.02, "ts"] = None
    pdf["y_true"] = (rng.random(n) < 0.4).astype(int)
    pdf["y_pred"] = (rng.random(n) < 0.5).astype(int)
    df = spark.createDataFrame(pdf).withColumn("ts", F.when(~F.isnan("ts"), F.col("ts"))).withColumn("t", F.col("ts"))
    return pdf, df


def brute_first(pdf, k):
    ordered = pdf.sort_values(["ts", "row_id"], na_position="last")
    return {g: set(d.row_id.head(k[g])) for g, d in ordered.groupby("g") if g in k}


def test_first_rows_by_histogram_equals_sorting(spark, skewed, monkeypatch):
    pdf, df = skewed
    monkeypatch.setattr(O, "SLICES", 16)
    k = {"hot": 987, "b": 3, "c": 10_000}
    quota = spark.createDataFrame(list(k.items()), "g string, k long")
    for limit in (None, 20):
        got = O.first_rows(df, ["g"], ["t", "row_id"], quota, limit).toPandas()
        assert {g: set(d.row_id) for g, d in got.groupby("g")} == brute_first(pdf, k)


def test_groups_without_quota_or_with_zero_give_nothing(spark, skewed):
    _, df = skewed
    quota = spark.createDataFrame([("b", 0)], "g string, k long")
    for limit in (None, 20):
        assert O.first_rows(df, ["g"], ["t", "row_id"], quota, limit).count() == 0


def test_quantiles_by_rank_search_equal_linear_interpolation(skewed, monkeypatch):
    pdf, df = skewed
    monkeypatch.setattr(O, "SLICES", 16)
    probs = [0.0, 0.1, 0.25, 0.5, 0.95, 0.99, 1.0]
    want = {(g, p): v for g, d in pdf.groupby("g") for p, v in zip(probs, d.ts.dropna().quantile(probs))}
    for limit in (None, 25):
        got = {(r["g"], r["prob"]): r["quantile"] for r in O.exact_quantiles(df, ["g"], "ts", probs, limit).collect()}
        assert got == pytest.approx(want)


def test_column_quantiles_same_both_ways(skewed):
    _, df = skewed
    names = {"q25": 0.25, "median": 0.5}
    a = O.column_quantiles(df, ["g"], ["ts", "row_id"], names).orderBy("g", "feature").collect()
    b = O.column_quantiles(df, ["g"], ["ts", "row_id"], names, 25).orderBy("g", "feature").collect()
    assert a == b and len(a) == 6


@pytest.mark.parametrize("descending", [False, True])
def test_running_sums_in_slices(skewed, descending):
    _, df = skewed
    counts = df.where("ts is not null").groupBy("g", "ts").agg(F.count("*").alias("n"))
    a = O.running_sums(counts, ["g"], "ts", ["n"], descending).orderBy("g", "ts").collect()
    b = O.running_sums(counts, ["g"], "ts", ["n"], descending, 10).orderBy("g", "ts").collect()
    assert a == b


def test_prefix_cells_and_latency_same_both_ways(skewed, monkeypatch):
    _, df = skewed
    monkeypatch.setattr(O, "SLICES", 16)
    order, fractions = ["t", "row_id"], [0.02, 0.29, 0.5, 1.0]
    for fn in (X.prefix_metrics, X.latency):
        keys = ["fraction"] if fn is X.prefix_metrics else ["g", "fraction"]
        a = fn(df, fractions, ["g"], order).orderBy(*keys).collect()
        b = fn(df, fractions, ["g"], order, group_limit=20).orderBy(*keys).collect()
        assert a == b


def test_prefix_metrics_against_loops(skewed):
    pdf, df = skewed
    ordered = pdf.sort_values(["ts", "row_id"], na_position="last")
    got = {r["fraction"]: r for r in X.prefix_metrics(df, [0.1, 0.5], ["g"], ["t", "row_id"]).collect()}
    for f in (0.1, 0.5):
        seen = pd.concat([d.head(max(1, int(len(d) * f))) for _, d in ordered.groupby("g")])
        assert got[f]["rows_evaluated"] == len(seen)
        assert got[f]["tp"] == ((seen.y_true == 1) & (seen.y_pred == 1)).sum()
        assert got[f]["accuracy"] == pytest.approx((seen.y_true == seen.y_pred).mean())


def test_spearman_ranks_by_slices(skewed):
    pdf, df = skewed
    known = pdf.dropna()
    want = {g: d.ts.rank().corr(d.y_true.rank()) for g, d in known.groupby("g")}
    for limit in (None, 10):
        got = {r["g"]: r["spearman"] for r in R.spearman(df, "ts", "y_true", ["g"], limit).collect()}
        assert got == pytest.approx(want)


def test_samples_do_not_depend_on_the_way_they_are_found(skewed, monkeypatch):
    _, df = skewed
    monkeypatch.setattr(O, "SLICES", 16)
    for fn in (
        lambda limit: H.stratified_sample(df, ["g"], 0.1, "row_id", 3, group_limit=limit),
        lambda limit: H.cap_random(df, 111, "row_id", 3, limit),
        lambda limit: H.label_preserving_sample(df, ["g"], "y_true", 50, "row_id", 3, limit),
        lambda limit: H.holdout(df, 0.2, "y_true", "row_id", 3, group_limit=limit).where("role = 'holdout'"),
        lambda limit: H.balance(df, "y_true", "row_id", 3, group_limit=limit),
    ):
        a = sorted(r["row_id"] for r in fn(None).collect())
        b = sorted(r["row_id"] for r in fn(20).collect())
        assert a == b and a


@pytest.fixture(scope="module")
def odd_times(spark):
    """Missing, NaN and infinite times and values, and text keys with long ties."""
    rng = np.random.default_rng(3)
    n = 400
    special = [None, float("nan"), float("inf"), float("-inf"), 1.7e308, -1.7e308, 5e-324]
    rows = [("g" if i % 5 else "h", special[i % 7] if i % 3 == 0 else float(rng.integers(0, 5)), f"Csame-prefix-{i:04d}", int(rng.random() < 0.4), int(rng.random() < 0.5)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "g string, ts double, uid string, y_true int, y_pred int")


def place(row):
    ts = row[1]
    return (1, 0.0, row[2]) if ts is None or ts != ts else (0, ts, row[2])


@pytest.mark.parametrize("limit", [None, 20])
def test_missing_nan_and_infinite_times(odd_times, limit, monkeypatch):
    rows, df = odd_times
    monkeypatch.setattr(O, "SLICES", 8)
    for fraction in (0.1, 0.5):
        want = set()
        for g in "gh":
            own = sorted((r for r in rows if r[0] == g), key=place)
            want |= {r[2] for r in own[: max(1, int(len(own) * fraction))]}
        assert {r["uid"] for r in X.prefix(df, fraction, ["g"], ["ts", "uid"], limit).collect()} == want
    assert {r["uid"] for r in X.cap_earliest(df, [], ["ts", "uid"], 15, limit).collect()} == {r[2] for r in sorted(rows, key=place)[:15]}
    seen = {r["fraction"]: r["rows_evaluated"] for r in X.prefix_metrics(df, [0.1, 0.5], ["g"], ["ts", "uid"], group_limit=limit).collect()}
    assert seen == {0.1: 40, 0.5: 200}


def test_paths_agree_on_infinite_values(odd_times, monkeypatch):
    _, df = odd_times
    monkeypatch.setattr(O, "SLICES", 8)
    a, b = (O.exact_quantiles(df, ["g"], "ts", [0.0, 0.05, 0.5, 0.9, 1.0], limit).orderBy("g", "prob").collect() for limit in (None, 20))
    assert [(r["g"], r["prob"], str(r["quantile"])) for r in a] == [(r["g"], r["prob"], str(r["quantile"])) for r in b]


def test_ranks_of_a_hot_group(rows):
    """A third of all rows in one group, many of them tied: the same ranks by window and by range slices."""
    data = [(f"g{i % 40}" if i % 3 else "hot", f"n{i:05d}", None if i % 97 == 0 else float(i % 11)) for i in range(3000)]
    df = rows(data, "g string, name string, v double")
    order = [F.col("v").desc(), F.col("name").asc()]
    a = O.row_ranks(df, ["g"], order, "rank").orderBy("g", "name").collect()
    b = O.row_ranks(df, ["g"], order, "rank", 50).orderBy("g", "name").collect()
    assert a == b and max(r["rank"] for r in a if r["g"] == "hot") == 1000


def test_running_sums_of_a_hot_group(rows):
    data = [("hot" if i % 3 == 0 else f"g{i % 7}", float(i), i % 5) for i in range(2000)]
    df = rows(data, "g string, v double, n long")
    for descending in (False, True):
        a, b = (O.running_sums(df, ["g"], "v", ["n"], descending, limit).orderBy("g", "v").collect() for limit in (None, 40))
        assert a == b
