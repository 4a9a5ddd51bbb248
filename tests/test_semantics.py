"""Rules of cleaning, labels, metrics and prefixes on hand-sized tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlab.functions import clean as C
from flowlab.functions import labels as L
from flowlab.operators import align as A
from flowlab.operators import checks as V
from flowlab.operators import domains as K
from flowlab.operators import drift as D
from flowlab.operators import joins as J
from flowlab.operators import metrics as M
from flowlab.operators import prefix as X
from flowlab.operators import profile as P
from flowlab.operators import ranking as R
from flowlab.operators import runs as B
from flowlab.operators import sampling as H
from flowlab.operators import seeds as S
from flowlab.operators import splits as T


def one(df):
    return df.first().asDict()


def test_unknown_label_counts_as_malicious_and_unknown_phase_stays(rows):
    df = rows([(None, None), ("Benign ", "-"), ("benign", "benign"), ("x", "Okiru"), ("x", "strange")], "label string, detailed_label string")
    got = L.assign_labels(C.null_tokens(df)).collect()
    assert [r["label_binary"] for r in got] == [1, 0, 0, 1, 1]
    assert [r["label_phase"] for r in got] == ["unknown", "unknown", "benign", "scanning", "other_malicious"]


def test_null_tokens_are_whole_cells(rows):
    got = [r[0] for r in C.null_tokens(rows([("-",), ("a-b",), ("(empty)",), (" -",)], "x string")).collect()]
    assert got == [None, "a-b", None, " -"]


def test_coercion_maps_bad_text_nan_and_infinity(rows):
    df = rows([("1.5",), ("bad",), ("nan",), ("inf",), (None,)], "x string")
    assert [r[0] for r in df.select(C.to_double(F.col("x"), finite=True)).collect()] == [1.5, None, None, None, None]
    assert df.select(C.to_double(F.col("x"))).collect()[3][0] == math.inf


def test_clip_keeps_null(rows):
    got = [r[0] for r in rows([(-1.0,), (None,), (5.0,), (0.5,)], "x double").select(C.clip(F.col("x"), 0.0, 1.0)).collect()]
    assert got == [0.0, None, 1.0, 0.5]


def test_clean_flows_fills_and_engineers(rows):
    cols = "ts string, scenario string, proto string, service string, conn_state string, duration string, orig_bytes string, resp_bytes string, missed_bytes string, orig_pkts string, orig_ip_bytes string, resp_pkts string, resp_ip_bytes string, label string, detailed_label string"
    got = one(C.clean_flows(rows([("x", "s", "tcp", "-", None, "-", "10", "4", "0", "1", "0", "0", "0", "benign", "-")], cols)))
    assert (got["ts"], got["service"], got["conn_state"], got["duration"]) == (None, "unknown", "unknown", 0.0)
    assert (got["bytes_ratio"], got["pkts_ratio"], got["orig_bytes_per_pkt"], got["resp_bytes_per_pkt"]) == (2.0, 1.0, 5.0, 4.0)


def test_vocabularies(rows):
    df = rows([(" Normal",), ("anomaly",), ("weird",)], "w string")
    assert [r[0] for r in df.select(L.binary_vocab(F.col("w"), strict=False)).collect()] == [0, 1, 0]
    with pytest.raises(Exception, match="unknown label"):
        df.select(L.binary_vocab(F.col("w"))).collect()
    assert [r["word"] for r in L.unknown_words(df, "w").collect()] == ["weird"]


def test_attack_family_first_match_wins(rows):
    words = ["Benign", "C&C-PartOfAHorizontalPortScan", "DDoS", "xdosx", "portscan", "filedownload", "attack", "torii", ""]
    got = [r[0] for r in rows([(w,) for w in words], "w string").select(L.attack_family(F.col("w"))).collect()]
    assert got == ["benign", "c&c", "ddos", "ddos", "scanning", "filedownload", "attack", "torii", "unknown"]


def test_slugs(rows):
    got = rows([("  A--B c! ", 0.05), ("!!", 1.0)], "w string, f double").select(C.slugify(F.col("w")), C.slugify(F.col("w"), 3), C.fraction_slug(F.col("f"))).collect()
    assert [tuple(r) for r in got] == [("a_b_c", "a_b", "0p05"), ("missing", "missing", "1p0")]


def test_split_lists_must_not_overlap():
    with pytest.raises(ValueError):
        L.assign_split(F.col("x"), ["a"], ["a"])


def test_one_class_group_present_and_fixed_averages_differ(rows):
    cm = M.confusion(rows([(1, 1), (1, 1)], "y_true int, y_pred int"))
    assert (one(cm)["tn"], one(cm)["tp"]) == (0, 2)
    assert one(M.metrics_fixed(cm))["f1_macro"] == 0.5
    assert one(M.metrics_present(cm))["f1_macro"] == 1.0
    assert one(M.metrics_fixed(cm))["balanced_accuracy"] == 0.5
    assert one(M.metrics_present(cm))["balanced_accuracy"] == 1.0


def brute_auc(y, s):
    pos, neg = s[y == 1], s[y == 0]
    return np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])


def brute_ap(y, s):
    total, seen, ap, prev = y.sum(), 0, 0.0, 0.0
    for t in sorted(set(s), reverse=True):
        up = s >= t
        recall, precision = y[up].sum() / total, y[up].mean()
        ap, prev = ap + (recall - prev) * precision, recall
    return ap


def test_auc_and_average_precision_with_ties(spark):
    rng = np.random.default_rng(3)
    y, s = rng.integers(0, 2, 300), rng.integers(0, 25, 300) / 25
    df = spark.createDataFrame([("g", int(a), float(b)) for a, b in zip(y, s)], "g string, y_true int, y_score double")
    for limit in (None, 5):
        assert one(M.roc_auc(df, ["g"], group_limit=limit))["roc_auc"] == pytest.approx(brute_auc(y, s))
        assert one(M.average_precision(df, ["g"], group_limit=limit))["pr_auc"] == pytest.approx(brute_ap(y, s))


def test_auc_of_tied_scores_and_one_class(rows):
    tied = rows([("a", 0, 0.5), ("a", 1, 0.5), ("b", 1, 0.1), ("b", 1, 0.9)], "g string, y_true int, y_score double")
    got = {r["g"]: r["roc_auc"] for r in M.roc_auc(tied, ["g"]).collect()}
    assert got == {"a": 0.5, "b": None}


def test_sweep_recall_is_monotone_and_ties_choose_as_documented(rows):
    df = rows([(0, 0.1), (1, 0.9), (0, 0.2), (1, 0.8)], "y_true int, y_score double")
    sweep = M.threshold_sweep(df, [0.3, 0.5, 0.7, 0.85]).orderBy("threshold")
    recalls = [r["recall_attack"] for r in sweep.collect()]
    assert recalls == sorted(recalls, reverse=True)
    assert one(M.best_threshold(sweep))["threshold"] == 0.3
    assert {r["criterion"]: r["threshold"] for r in M.best_thresholds(sweep).collect()}["f1_macro"] == 0.7


def test_bootstrap_interval_matches_resampling_rows(spark):
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 400)
    p = np.where(rng.random(400) < 0.8, y, 1 - y)
    df = spark.createDataFrame([(int(a), int(b)) for a, b in zip(y, p)], "y_true int, y_pred int")
    got = {r["metric"]: r for r in M.bootstrap_ci(df, [], 1000).collect()}["accuracy"]
    draws = [np.mean((y == p)[rng.integers(0, 400, 400)]) for _ in range(2000)]
    assert got["mean"] == pytest.approx(np.mean(draws), abs=0.005)
    assert (got["ci_low"], got["ci_high"]) == pytest.approx(tuple(np.percentile(draws, [2.5, 97.5])), abs=0.01)


def test_prefix_size_truncates_and_keeps_one_row(rows):
    got = [r[0] for r in rows([(100, 0.29), (1, 0.01), (10, 0.3)], "n long, f double").select(X.prefix_size(F.col("n"), F.col("f"))).collect()]
    assert got == [int(100 * 0.29), 1, int(10 * 0.3)] == [28, 1, 3]


def test_prefix_is_monotone_and_missing_times_come_last(rows):
    df = rows([("s", None, 1), ("s", 5.0, 2), ("s", 1.0, 3), ("t", 2.0, 4)], "scenario string, ts double, row_id long")
    seen = [set(r["row_id"] for r in X.prefix(df, f, ["scenario"], ["ts", "row_id"]).collect()) for f in (0.1, 0.7, 1.0)]
    assert seen[0] == {3, 4} and seen[1] == {2, 3, 4} and seen[2] == {1, 2, 3, 4}


def test_stratified_sizes_round_half_to_even(rows):
    df = rows([("a", i) for i in range(5)] + [("b", 10 + i) for i in range(7)] + [("c", 99)], "c string, id long")
    got = {r["c"]: r["n"] for r in H.stratified_sample(df, ["c"], 0.5, "id", 1).groupBy("c").agg(F.count("*").alias("n")).collect()}
    assert got == {"a": 2, "b": 4, "c": 1}
    up = H.stratified_sample(df, ["c"], 0.5, "id", 1, "ceil").groupBy("c").agg(F.count("*").alias("n")).collect()
    assert {r["c"]: r["n"] for r in up} == {"a": 3, "b": 4, "c": 1}


def brute_quotas(counts, n):
    """Proportional quotas of at least one, trimmed from the largest; then the rows left to fill."""
    total = sum(counts.values())
    if n >= total:
        return dict(counts), 0
    q = {k: min(max(1, round(c / total * n)), c) for k, c in counts.items()}
    over = sum(q.values()) - n
    for k in sorted(sorted(q), key=lambda x: -q[x]):
        while over > 0 and q[k] > 1:
            q[k], over = q[k] - 1, over - 1
    return q, max(0, n - sum(q.values()))


@pytest.mark.parametrize("counts,n", [
    ({"a": 90, "b": 5, "c": 5}, 10), ({"a": 50, "b": 1, "c": 1, "d": 1}, 4), ({"a": 50, "b": 50, "c": 1, "d": 1, "e": 1}, 3), ({"a": 33, "b": 33, "c": 34}, 10), ({"a": 2, "b": 3}, 10),
])
def test_label_quotas_against_the_plain_rule(rows, counts, n):
    df = rows([("s", k, c) for k, c in counts.items()], "scenario string, label string, n_group long")
    got = H.label_quotas(df, ["scenario"], "label", n).collect()
    q, top = brute_quotas(counts, n)
    assert {r["label"]: r["k"] for r in got} == q and {r["top_up"] for r in got} == {top}


def test_label_preserving_sample_keeps_every_label_and_fills_up(rows):
    df = rows([("s", "a", i) for i in range(33)] + [("s", "b", 100 + i) for i in range(33)] + [("s", "c", 200 + i) for i in range(34)], "scenario string, label string, id long")
    out = H.label_preserving_sample(df, ["scenario"], "label", 10, "id", 5)
    assert out.count() == 10 and out.select("label").distinct().count() == 3
    assert H.sample_manifest(df, out, ["scenario"], "label").where("lost").count() == 0


def test_caps_sum_to_the_total_and_cover_edge_cases(rows):
    df = rows([("p", "a", 10, 7), ("p", "b", 10, 7), ("p", "c", 10, 7), ("z", "a", 0, 5), ("z", "b", 0, 5), ("one", "a", 3, 9), ("none", "a", 3, 0), ("none", "b", 4, 0)], "pool string, domain_id string, n_rows long, cap int")
    got = {}
    for r in H.allocate_caps(df, ["pool"], "n_rows", "cap").collect():
        got.setdefault(r["pool"], {})[r["domain_id"]] = r["allocated"]
    assert sum(got["p"].values()) == 7 and got["p"]["c"] == 3
    assert got["z"] == {"a": 3, "b": 2} and got["one"] == {"a": 9} and got["none"] == {"a": 0, "b": 0}


def test_holdout_modes(rows):
    df = rows([(0, i) for i in range(10)] + [(1, 100)], "label int, id long")
    assert H.holdout(df, 0.2, "label", "id", 1).where("role = 'holdout'").count() == 0
    assert H.holdout(df, 0.2, "label", "id", 1, "clamp").where("role = 'holdout' and label = 0").count() == 2
    with pytest.raises(ValueError):
        H.holdout(df, 0.2, "label", "id", 1, "raise")


def test_group_split_needs_three_groups(rows):
    df = rows([("a",), ("b",)], "g string")
    with pytest.raises(ValueError):
        H.group_split(df, "g", 0.5, 1)
    roles = H.group_split(rows([("a",), ("a",), ("b",), ("c",)], "g string"), "g", 0.2, 1).select("g", "role").distinct().collect()
    assert sum(r["role"] == "val" for r in roles) == 1 and len(roles) == 3


def test_folds_partition_the_groups(rows):
    df = rows([("a", 1), ("a", 0), ("b", 1), ("c", 0)], "scenario string, label_binary int")
    for f in T.loso_folds(df).collect():
        train, test = T.loso_split(df, f["test_group"])
        assert (train.count(), test.count()) == (f["n_train"], f["n_test"])
    kinds = rows([("Normal", 1), ("x", 2), ("y", 3), ("y", 4)], "attack_cat string, id int")
    for f in T.loao_folds(kinds).collect():
        train, test = T.loao_split(kinds, f["held_out_attack"])
        assert (train.count(), test.count()) == (f["n_train"], f["n_test"])


def brute_js(p, q):
    p, q = np.maximum(p, 1e-12), np.maximum(q, 1e-12)
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    return 0.5 * np.sum(p * np.log2(p / m)) + 0.5 * np.sum(q * np.log2(q / m))


def test_mean_js_against_dense_pairs(rows):
    dense = np.array([[0.5, 0.5, 0, 0], [0, 0, 1, 0], [0.25, 0.25, 0.25, 0.25], [0, 0, 0.3, 0.7]])
    data = [(f"s{i}", f"l{j}", float(v)) for i, row in enumerate(dense) for j, v in enumerate(row) if v > 0]
    got = one(D.mean_js(rows(data, "scenario string, label string, ratio double")))
    want = np.mean([brute_js(dense[i], dense[j]) for i in range(4) for j in range(i + 1, 4)])
    assert got["mean_pairwise_js_divergence"] == pytest.approx(want, abs=1e-8) and 0 <= want <= 1
    assert one(D.mean_js(rows([("s", "l", 1.0)], "scenario string, label string, ratio double")))["mean_pairwise_js_divergence"] == 0.0


def test_cosine_of_a_zero_profile_is_zero(rows):
    long = rows([("a", "x", 0.0), ("a", "y", 0.0), ("b", "x", 3.0), ("b", "y", 4.0)], "scenario string, feature string, value double")
    got = {(r["a"], r["b"]): r["cosine"] for r in D.cosine_matrix(long).collect()}
    assert got[("a", "b")] == 0.0 and got[("a", "a")] == 0.0 and got[("b", "b")] == pytest.approx(1.0)


def test_label_absent_in_one_scenario_counts_as_zero(rows):
    df = rows([("a", "x"), ("a", "y"), ("b", "x")], "scenario string, kind string")
    got = {r["label"]: r for r in P.label_shift(df, "kind").collect()}
    assert got["y"]["mean_ratio_across_scenarios"] == 0.25 and got["y"]["std_ratio_across_scenarios"] == 0.25 and got["y"]["min_ratio"] == 0.0
    assert got["x"]["mean_ratio_across_scenarios"] == 0.75 and got["x"]["std_ratio_across_scenarios"] == 0.25


def test_constant_column_has_no_correlation(rows):
    df = rows([(1.0, 2.0), (1.0, 3.0), (1.0, 4.0)], "x double, y double")
    assert one(R.spearman(df, "x", "y", []))["spearman"] is None
    assert df.agg(R.pearson(F.col("x"), F.col("y"))).first()[0] is None


def test_sign_test_against_binomial_sums(rows):
    cases = [(0, 0), (1, 0), (5, 0), (3, 7), (10, 10), (0, 20), (30, 12)]
    got = rows(cases, "p long, n long").select(S.sign_test(F.col("p"), F.col("n"))).collect()
    for (p, n), r in zip(cases, got):
        want = 1.0 if p + n == 0 else min(1.0, 2 * sum(math.comb(p + n, k) for k in range(min(p, n) + 1)) / 2 ** (p + n))
        assert r[0] == pytest.approx(want)


def test_seed_interval_of_one_seed_has_no_width_and_uses_t_values(rows):
    df = rows([("a", 0.5), ("b", 0.1), ("b", 0.3)], "k string, m double")
    got = {r["k"]: r for r in S.seed_ci(df, ["k"], ["m"]).collect()}
    assert got["a"]["ci95_low"] == got["a"]["ci95_high"] == 0.5
    assert got["b"]["ci95_high"] == pytest.approx(0.2 + 12.706 * np.std([0.1, 0.3], ddof=1) / math.sqrt(2))


def test_curve_area_of_one_point_is_the_value(rows):
    df = rows([("a", 0.1, 2.0), ("a", 0.5, 4.0), ("b", 1.0, 7.0)], "k string, fraction double, m double")
    got = {r["k"]: r for r in R.curve_auc(df, ["k"], ["m"]).collect()}
    assert got["a"]["auc_m"] == pytest.approx(1.2) and got["a"]["auc_m_normalized"] == pytest.approx(3.0)
    assert got["b"]["auc_m"] == 0.0 and got["b"]["auc_m_normalized"] == 7.0


def test_missing_alignment_column_raises(rows):
    with pytest.raises(ValueError):
        A.align(rows([(1,)], "a int"), {"b": "x"})


def test_alignment_counts(spark):
    assert {r["kind"]: r["n_features"] for r in A.status_summary(A.alignment_table(spark)).collect()} == {"accepted": 9, "review": 1, "rejected": 5}
    assert len(A.mapping("unsw")) == 9 and len(A.mapping("unsw", include_review=True)) == 10


def test_filter_spec_round_trip(spark, rows):
    df = rows([("a", 1), ("b", 2), ("c", 3)], "scenario string, x int")
    lit = [F.lit(v) for v in ("d", "p", "scenario")]
    spec = spark.range(1).select(K.to_filter_json_in(*lit, F.array(F.lit("a"), F.lit("c")))).first()[0]
    assert sorted(r["scenario"] for r in K.apply_filter(df, spec).collect()) == ["a", "c"]
    spec = spark.range(1).select(K.to_filter_json(*lit, F.lit("b"))).first()[0]
    assert [r["scenario"] for r in K.apply_filter(df, spec).collect()] == ["b"]


def test_gain_table_matches_missing_fractions(rows):
    data = [("p", "f", "s", "t", 1, c, f, v) for c, f, v in [("target_only_updated", None, 0.5), ("transfer_learning_updated", None, 0.7), ("source_only", 0.1, 0.2)]]
    got = J.gain_table(rows(data, "pair_id string, pair_family string, source_domain_id string, target_test_domain_id string, seed int, condition string, target_fraction double, m double"), ["m"]).collect()
    assert len(got) == 1 and got[0]["gain_m"] == pytest.approx(0.2) and got[0]["delta_vs_source_m"] == pytest.approx(0.5)


def test_matched_comparison_refuses_other_fractions(rows):
    base = rows([("d", "rf", 1, 0.1)], "direction string, model string, seed int, fraction double")
    sens = rows([("s", "d", "rf", 1, 0.2)], "study string, direction string, model string, seed int, fraction double")
    with pytest.raises(Exception, match="fraction mismatch"):
        J.matched_comparison(base, sens).collect()


def test_contract_reports_each_violation(rows):
    df = rows([("a", 1), ("a", 1), (None, 2)], "k string, v int")
    assert {r["violation"]: r["n_rows"] for r in V.check_contract(df, ["k", "v"], ["k", "v"], ["k"]).collect()} == {"null_k": 1, "repeated_key": 2}
    assert [r["violation"] for r in V.check_contract(df.where("v > 9"), ["k"], ["k"], ["k"]).collect()] == ["empty_table"]
    with pytest.raises(ValueError):
        V.check_contract(df, ["missing"], [], ["k"])


def test_best_runs_share_the_grid_and_later_wins_ties(rows):
    def run(model, exp, fractions, f1, cap=10):
        return [("d", model, f"{model}{exp}", exp, f, f1, cap) for f in fractions]

    data = run("rf", 1, [0.1, 0.5, 1.0], 0.9) + run("rf", 2, [0.5, 1.0], 0.99) + run("mlp", 1, [0.1, 0.5, 1.0], 0.8) + run("mlp", 2, [0.1, 0.5, 1.0], 0.8)
    df = rows(data, "dataset string, model string, run string, exp int, fraction double, f1_attack double, cap int")
    got = {r["model"]: r["run"] for r in B.select_best_runs(df, "dataset", "model", "run", ["cap"]).collect()}
    assert got == {"rf": "rf1", "mlp": "mlp2"}


def test_quality_report_counts_null_as_a_category(rows):
    cols = "scenario string, proto string, service string, conn_state string, ts double, duration double, label string, detailed_label string, label_phase string, orig_bytes double, resp_bytes double, orig_pkts double, resp_pkts double"
    got = one(P.quality_report(rows([("s", "tcp", None, "SF", None, 0.0, "unknown", "unknown", "unknown", 0.0, 0.0, 0.0, 0.0), ("s", "udp", "dns", "SF", 1.0, 4.0, "x", "y", "ddos", 1.0, 0.0, 0.0, 0.0)], cols)))
    assert (got["cardinality_proto"], got["cardinality_service"], got["cardinality_conn_state"]) == (2, 2, 1)
    assert (got["n_missing_ts"], got["n_all_zero_traffic_rows"], got["p50"], got["p100"]) == (1, 1, 2.0, 4.0)
