"""Column expressions for labels, vocabularies and categories."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlab.session import lit_map

# Detailed label -> phase.
PHASES = {
    "benign": "benign",
    "c&c": "c2c",
    "c&c-filedownload": "c2c",
    "c&c-heartbeat": "c2c",
    "c&c-heartbeat-attack": "c2c",
    "c&c-heartbeat-filedownload": "c2c",
    "c&c-mirai": "c2c",
    "c&c-partofahorizontalportscan": "c2c",
    "c&c-torii": "c2c",
    "filedownload": "filedownload",
    "heartbeat": "c2c",
    "ddos": "ddos",
    "attack": "attack",
    "okiru": "scanning",
    "okiru-attack": "attack",
    "partofahorizontalportscan": "scanning",
    "partofahorizontalportscan-attack": "attack",
    "mirai": "scanning",
}
ALLOWED_PHASES = sorted({*PHASES.values(), "other_malicious", "unknown"})
# Binary vocabulary and the words that mean benign.
BINARY_WORDS = {"0": 0, "1": 1, "benign": 0, "normal": 0, "background": 0, "malicious": 1, "attack": 1, "anomaly": 1}
BENIGN_WORDS = ["benign", "normal", "background", "legitimate", "clean", "0", "false"]
# Scenarios held out for test and validation.
TEST_SCENARIOS = [
    "CTU-IoT-Malware-Capture-34-1", "CTU-IoT-Malware-Capture-43-1", "CTU-IoT-Malware-Capture-44-1",
    "CTU-Honeypot-Capture-4-1", "CTU-Honeypot-Capture-5-1", "CTU-Honeypot-Capture-7-1",
]
VAL_SCENARIOS = ["CTU-IoT-Malware-Capture-49-1", "CTU-IoT-Malware-Capture-52-1", "CTU-IoT-Malware-Capture-20-1"]


def norm_label(col: Column) -> Column:
    return F.coalesce(F.trim(F.lower(col)), F.lit("unknown"))


def label_binary(label: Column) -> Column:
    """Everything but benign counts as malicious, unknown included."""
    return F.when(label == "benign", F.lit(0)).otherwise(F.lit(1)).cast("long")


def label_phase(detailed: Column) -> Column:
    other = F.when(detailed.isin("benign", "unknown"), detailed).otherwise(F.lit("other_malicious"))
    return F.coalesce(F.try_element_at(lit_map(PHASES), detailed), other)


def assign_labels(df: DataFrame) -> DataFrame:
    named = df.withColumns({"label": norm_label(F.col("label")), "detailed_label": norm_label(F.col("detailed_label"))})
    return named.withColumns({"label_binary": label_binary(F.col("label")), "label_phase": label_phase(F.col("detailed_label"))})


def binary_vocab(col: Column, strict: bool = True) -> Column:
    """Word to 0/1.  Strict mode fails the job on an unknown word, lenient mode reads it as 0."""
    word = F.lower(F.trim(col.cast("string")))
    code = F.try_element_at(lit_map(BINARY_WORDS), word)
    if not strict:
        return F.coalesce(code, F.lit(0))
    return F.coalesce(code, F.raise_error(F.concat(F.lit("unknown label: "), F.coalesce(word, F.lit("null")))).cast("int"))


def unknown_words(df: DataFrame, col: str) -> DataFrame:
    word = F.lower(F.trim(F.col(col).cast("string")))
    bad = df.select(word.alias("word")).where(F.col("word").isNull() | ~F.col("word").isin(*BINARY_WORDS))
    return bad.groupBy("word").agg(F.count(F.lit(1)).alias("n_rows"))


def is_benign(col: Column) -> Column:
    return F.lower(F.trim(F.coalesce(col, F.lit("unknown")))).isin(*BENIGN_WORDS)


# Attack families in the order in which they are tried, each with the words that mark it.
FAMILY_WORDS = [
    ("c&c", ["c&c", "cnc", "command"]),
    ("ddos", ["dos"]),
    ("scanning", ["scan"]),
    ("filedownload", ["download"]),
    ("attack", ["attack"]),
]

# Fold quality words and the macro F1 from which they hold, best first; below the last one a fold
# is trivial from this accuracy on with at most so many attacks, and a failure otherwise.
FOLD_WORDS = [("excellent", 0.90), ("strong", 0.75), ("unstable", 0.55)]
TRIVIAL_ACCURACY, TRIVIAL_ATTACKS = 0.95, 1


def first_match(tests: list[tuple[Column, str]], otherwise: Column) -> Column:
    """The word of the first test that holds."""
    out = otherwise
    for test, word in reversed(tests):
        out = F.when(test, word).otherwise(out)
    return out


def attack_family(col: Column) -> Column:
    """First family any of whose words the label contains; an unmatched label is its own family."""
    label = F.coalesce(F.nullif(F.lower(F.trim(col)), F.lit("")), F.lit("unknown"))
    marked = [(reduce(lambda a, b: a | b, [label.contains(w) for w in words]), family) for family, words in FAMILY_WORDS]
    return first_match([(label == "benign", "benign"), *marked], label)


def scenario_family(col: Column) -> Column:
    s = F.lower(col)
    return F.when(s.contains("honeypot"), "honeypot_benign").when(s.contains("malware"), "iot_malware").otherwise("other")


def fold_category(df: DataFrame) -> DataFrame:
    """Fold quality words plus attack ratio, miss and false alarm rates."""
    score = F.col("f1_macro")
    trivial = (F.col("accuracy") >= TRIVIAL_ACCURACY) & (F.col("n_attack") <= TRIVIAL_ATTACKS)
    word = first_match([(score.isNull(), "unknown"), *[(score >= least, name) for name, least in FOLD_WORDS], (trivial, "trivial_or_single_class")], F.lit("failure"))
    ratio = F.try_divide(F.col("n_attack").cast("double"), F.col("n_rows").cast("double"))
    return df.withColumns({
        "attack_ratio": ratio,
        "fnr_attack": 1.0 - F.col("recall_attack"),
        "fpr_benign": 1.0 - F.col("recall_benign"),
        "single_class_test": (F.col("n_benign") == 0) | (F.col("n_attack") == 0),
        "dominant_class": F.when(ratio > 0.5, "attack").otherwise("benign"),
        "category": word,
    })


def transfer_label(gain: Column, margin: float = 0.0) -> Column:
    return F.when(gain > margin, "positive").when(gain < -margin, "negative").otherwise("neutral")


def assign_split(scenario: Column, test: list[str] | None = None, val: list[str] | None = None) -> Column:
    test, val = test or TEST_SCENARIOS, val or VAL_SCENARIOS
    if set(test) & set(val):
        raise ValueError("a scenario is in both the test and the validation list")
    return F.when(scenario.isin(*test), "test").when(scenario.isin(*val), "val").otherwise("train")
