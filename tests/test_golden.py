"""Published result tables, typed in as fixed values: the gains and findings must follow from the scores."""

import pytest
from pyspark.sql import functions as F

from flowlab.operators import joins as J
from flowlab.operators import reports as R
from flowlab.operators import stability as T

# Fixed values: (direction, target fraction, accuracy, attack F1, macro F1, attack recall) for target-only and for adapted runs.
FIRST, SECOND = "IoT-23 -> UNSW-NB15", "UNSW-NB15 -> IoT-23"
TARGET_ONLY = [
    (FIRST, 0.05, 0.8814, 0.896755847019906, 0.8787170260238538, 0.9428275062541948),
    (FIRST, 0.1, 0.9077333333333332, 0.9159939301972686, 0.9068324549322756, 0.9208005369455122),
    (FIRST, 0.25, 0.9066666666666666, 0.9155609167671894, 0.9056195045832968, 0.9262310086033316),
    (FIRST, 0.5, 0.9033666666666668, 0.9131541895090022, 0.9021235089699112, 0.9299530172676796),
    (FIRST, 1.0, 0.9075333333333332, 0.916324806949807, 0.9065011996608392, 0.9267801574226616),
    (SECOND, 0.05, 0.69672, 0.821250913548813, 0.4106913937386686, 0.999913887134738),
    (SECOND, 0.1, 0.69676, 0.8212702753677857, 0.4108329224940194, 0.999913887134738),
    (SECOND, 0.25, 0.69678, 0.8212799566196319, 0.4109036740049837, 0.999913887134738),
    (SECOND, 0.5, 0.69676, 0.8212702753677857, 0.4108329224940194, 0.999913887134738),
    (SECOND, 1.0, 0.6959, 0.8206682628233102, 0.4105970644294688, 0.9986508984442276),
]
ADAPTED = [
    (FIRST, 0.05, 0.9004, 0.9093391589295466, 0.8994221865204645, 0.914332784184514),
    (FIRST, 0.1, 0.9106333333333332, 0.9186417018177404, 0.90975897713359, 0.9235462810421624),
    (FIRST, 0.25, 0.9025666666666666, 0.9120558413815928, 0.901418945613264, 0.9248276282872658),
    (FIRST, 0.5, 0.9067, 0.9161298055314177, 0.9055054706103778, 0.9327597778998108),
    (FIRST, 1.0, 0.9080333333333334, 0.9166087350763186, 0.907050419925304, 0.9251937275001524),
    (SECOND, 0.05, 0.69674, 0.8212605943441821, 0.4107621624058222, 0.999913887134738),
    (SECOND, 0.1, 0.69676, 0.8212702753677857, 0.4108329224940194, 0.999913887134738),
    (SECOND, 0.25, 0.69678, 0.8212799566196319, 0.4109036740049837, 0.999913887134738),
    (SECOND, 0.5, 0.69676, 0.8212702753677857, 0.4108329224940194, 0.999913887134738),
    (SECOND, 1.0, 0.6959, 0.8206682628233102, 0.4105970644294688, 0.9986508984442276),
]
# Published macro F1 gains.
MACRO_GAINS = {
    (FIRST, 0.05): 0.02070516049661064, (FIRST, 0.1): 0.0029265222013143966, (FIRST, 0.25): -0.004200558970032797, (FIRST, 0.5): 0.0033819616404665576, (FIRST, 1.0): 0.0005492202644648003,
    (SECOND, 0.05): 7.076866715360897e-05, (SECOND, 0.1): 0.0, (SECOND, 0.25): 0.0, (SECOND, 0.5): 0.0, (SECOND, 1.0): 0.0,
}


@pytest.fixture(scope="module")
def results(spark):
    rows = [(c, *r) for c, table in (("target_only_updated", TARGET_ONLY), ("transfer_learning_updated", ADAPTED)) for r in table]
    return spark.createDataFrame(rows, "condition string, direction string, target_fraction double, accuracy double, f1_attack double, f1_macro double, recall_attack double")


def test_gains_follow_from_scores(results):
    got = {(r["direction"], r["target_fraction"]): r["macro_f1_gain_vs_target_only"] for r in J.gain_vs_target(results).collect()}
    assert got == pytest.approx(MACRO_GAINS, abs=1e-15)


def test_key_findings(results):
    got = {r["direction"]: r for r in R.key_findings(results).collect()}
    assert got[FIRST]["best_target_only_macro_f1"] == 0.9068324549322756
    assert got[FIRST]["best_transfer_macro_f1"] == 0.90975897713359
    assert got[FIRST]["best_macro_f1_gain_vs_target_only"] == pytest.approx(0.02070516049661064)
    assert got[FIRST]["target_fractions_with_positive_macro_f1_gain"] == "0.05"
    assert got[SECOND]["target_fractions_with_positive_macro_f1_gain"] == "none"
    assert got[SECOND]["overall_interpretation"] == "transfer does not meaningfully improve target-only"


def test_wide_table(results):
    wide = R.pivot_metrics(results, ["direction", "target_fraction"], "condition", ["target_only_updated", "transfer_learning_updated"], ["f1_macro", "accuracy"])
    row = wide.where((F.col("direction") == FIRST) & (F.col("target_fraction") == 0.25)).first()
    assert (row["f1_macro_target_only_updated"], row["accuracy_transfer_learning_updated"]) == (0.9056195045832968, 0.9025666666666666)


# Importances before and after adaptation at two fractions (the three that moved most), and one that did not move.
BEFORE = {"flow_duration": 0.44758436, "protocol": 0.2293342, "destination_to_source_packets": 0.016133165, "source_to_destination_packets": 0.2624976}
AFTER = {
    0.05: {"flow_duration": 0.24567157, "protocol": 0.32641324, "destination_to_source_packets": 0.06307042, "source_to_destination_packets": 0.2624976},
    0.1: {"flow_duration": 0.26739046, "protocol": 0.29827407, "destination_to_source_packets": 0.016133165, "source_to_destination_packets": 0.17254904},
}
TOP3 = {
    0.05: [("flow_duration", 0.20191279), ("protocol", 0.09707904), ("destination_to_source_packets", 0.046937255)],
    0.1: [("flow_duration", 0.1801939), ("source_to_destination_packets", 0.08994856), ("protocol", 0.06893987)],
}


def test_largest_importance_shifts(spark):
    schema = "run double, feature string, importance double"
    before = spark.createDataFrame([(f, n, v) for f in AFTER for n, v in BEFORE.items()], schema)
    after = spark.createDataFrame([(f, n, v) for f, t in AFTER.items() for n, v in t.items()], schema)
    got = T.importance_shift(before, after, ["run"]).orderBy("run", F.desc("absolute_shift")).collect()
    assert [(r["run"], r["feature"]) for r in got] == [(f, n) for f in TOP3 for n, _ in TOP3[f]]
    assert [r["absolute_shift"] for r in got] == pytest.approx([v for f in TOP3 for _, v in TOP3[f]], abs=1e-8)


def test_feature_set_comparison_counts(spark):
    """2 shared, 13 and 40 own columns of the two published feature lists."""
    from flowlab.operators.align import compare_sets
    from flowlab.schemas import FEATURES, CATEGORICAL, UNSW_COLUMNS

    first = spark.createDataFrame([(c,) for c in [*CATEGORICAL, *FEATURES]], "c string")
    second = spark.createDataFrame([(c,) for c in [c for c, _ in UNSW_COLUMNS if c not in ("id", "attack_cat", "label")]], "c string")
    got = {r["found_in"]: r["n"] for r in compare_sets(first, second, "c").groupBy("found_in").agg(F.count("*").alias("n")).collect()}
    assert got == {"both": 2, "only_a": 13, "only_b": 40}
