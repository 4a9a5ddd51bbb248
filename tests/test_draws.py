"""Column-form draws and pair sums against plain Python."""

import math
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlab.operators import drift as D
from flowlab.operators import metrics as M
from flowlab.operators import sampling as S


def exact_quantile(n, p, u):
    """Smallest k whose cumulated binomial probability reaches u."""
    total, k = 0.0, -1
    while total < u and k < n:
        k += 1
        total += math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log(1 - p))
    return k


def test_binomial_draw_is_within_one_of_the_exact_quantile(rows):
    cases = [(n, hits, 1000, z) for n in (1, 7, 40, 300, 2000) for hits in (20, 150, 500, 930) for z in (-2.3, -1.1, -0.2, 0.4, 1.3, 2.4)]
    drawn = rows(cases, "n long, hits long, of long, z double").withColumn("x", M.binomial_draw(F.col("n"), F.col("hits"), F.col("of"), F.col("z"))).collect()
    for r in drawn:
        u = 0.5 * (1 + math.erf(r["z"] / 2**0.5))
        assert abs(r["x"] - exact_quantile(r["n"], r["hits"] / r["of"], u)) <= 1, r
    edge = rows([(5, 0, 10, 1.0), (5, 10, 10, -3.0), (0, 3, 10, 0.5)], "n long, hits long, of long, z double")
    assert [r[0] for r in edge.select(M.binomial_draw(F.col("n"), F.col("hits"), F.col("of"), F.col("z"))).collect()] == [0, 5, 0]


def test_redraws_have_the_moments_of_a_multinomial(rows):
    cm = rows([("a", 500, 120, 60, 320), ("b", 3, 0, 1, 2)], "g string, tn long, fp long, fn long, tp long")
    got = M.redrawn_cells(cm, ["g"], 4000, 1).toPandas()
    assert ((got[M.CELLS].sum(axis=1) == 1000) == (got["g"] == "a")).all() and (got[M.CELLS] >= 0).all().all() and (got[got.g == "b"]["fp"] == 0).all()
    a = got[got.g == "a"][M.CELLS].to_numpy(float)
    p = np.array([500, 120, 60, 320]) / 1000
    assert a.mean(axis=0) == pytest.approx(1000 * p, abs=1.0)
    assert np.cov(a.T) == pytest.approx(1000 * (np.diag(p) - np.outer(p, p)), abs=15)


def test_bootstrap_interval_matches_numpy(rows):
    rng = np.random.default_rng(3)
    data = [(int(t), int(t if rng.random() < 0.8 else 1 - t)) for t in rng.integers(0, 2, 600)]
    got = {r["metric"]: r for r in M.bootstrap_ci(rows(data, "y_true int, y_pred int"), [], 3000).collect()}
    hit = np.array([t == p for t, p in data])
    want = np.percentile([hit[rng.integers(0, 600, 600)].mean() for _ in range(3000)], [2.5, 97.5])
    assert got["accuracy"]["ci_low"] == pytest.approx(want[0], abs=0.008) and got["accuracy"]["ci_high"] == pytest.approx(want[1], abs=0.008)
    assert got["accuracy"]["mean"] == pytest.approx(hit.mean(), abs=0.003)


def test_mean_divergence_equals_all_pairs(rows):
    rng = np.random.default_rng(4)
    shares = [rng.dirichlet(np.ones(4)) for _ in range(6)] + [np.array([0.5, 0.5, 0, 0])] * 4 + [np.array([0, 0, 0, 1.0])] * 2
    df = rows([(f"s{i}", f"l{k}", float(v)) for i, s in enumerate(shares) for k, v in enumerate(s)], "scenario string, label string, ratio double")

    def js(p, q):
        m = (p + q) / 2
        part = lambda a: sum(x * math.log2(x / y) for x, y in zip(a, m) if x > 0)
        return (part(p) + part(q)) / 2

    want = np.mean([js(p, q) for p, q in combinations(shares, 2)])
    assert D.mean_js(df).first()["mean_pairwise_js_divergence"] == pytest.approx(want, abs=1e-12)


def test_large_groups_are_drawn_by_their_hash_band(spark, monkeypatch):
    """The band finds the rows that a window finds; no row is sorted for it but those of the band."""
    df = spark.range(6000).selectExpr("id", "if(id % 3 = 0, 'a', 'b') AS g")
    quota = spark.createDataFrame([("a", 17), ("b", 3100)], "g string, k long")
    ids = lambda limit: sorted(r["id"] for r in S.draw(df, ["g"], quota, "id", 5, limit).collect())
    want = ids(None)
    assert len(want) == 3117

    def none(*_):
        raise AssertionError("the search over all rows is not needed")

    monkeypatch.setattr(S, "mark_first", none)
    assert ids(100) == want


def test_rows_without_key_are_drawn_last(spark):
    df = spark.range(300).selectExpr("if(id < 200, id, null) AS id", "'a' AS g")
    quota = spark.createDataFrame([("a", 250)], "g string, k long")
    assert S.draw(df, ["g"], quota, "id", 5, 10).where("id IS NOT NULL").count() == 200
