"""Quality rules: text statistics and a learned, ordered list of threshold rules.

The list is learned by sequential covering: a rule is grown condition by
condition for information gain on one part of a bounded labelled sample, pruned
on the other part, kept if it is precise there, and the rows it covers are set
aside before the next rule is grown. The list is then one Spark conditional
expression, whose branches stand in the order in which they were learned.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlab.llm.common import SPACE, add_columns, labelled_ids, map_rows, unpacked, with_sample

SYMBOLS = b"#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: Labelled rows that the rules are learned from, at most.
SAMPLE_ROWS = 20_000

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_capitals", "n_exclaims", "n_digits", "n_pipes", "n_ends", "top_count", "longest")
STATS_SCHEMA = ", ".join(f"{c} long" for c in COUNTS)

#: Rates that the rules test, from the counts; each is 0 where its base is 0.
RATES = {
    "word_length": ("word_chars", "n_words"),
    "symbol_rate": ("n_symbols", "word_chars"),
    "dup_line_rate": ("n_dup_lines", "n_lines"),
    "repeat_rate": ("n_repeat_words", "n_words"),
    "distinct_rate": ("n_distinct", "n_words"),
    "capital_rate": ("n_capitals", "word_chars"),
    "exclaim_rate": ("n_exclaims", "n_words"),
    "digit_rate": ("n_digits", "word_chars"),
    "pipe_rate": ("n_pipes", "n_words"),
    "end_rate": ("n_ends", "n_words"),
    "top_word_rate": ("top_count", "n_words"),
}
FEATURES = ["n_words", "longest", *RATES]


def _ranks(codes: np.ndarray) -> np.ndarray:
    return pd.factorize(codes)[0].astype(np.int64)


def repeated_words(codes: np.ndarray, width: int = WINDOW) -> int:
    """Words inside windows of ``width`` words that occur twice or more, the first included.

    Windows are compared exactly: ids of shorter windows are paired into ids of longer ones.
    """
    n = len(codes) - width + 1
    if n < 2:
        return 0
    ids, length = codes, 1
    while length < width:
        step = min(length, width - length)
        count = len(codes) - length - step + 1
        ids = _ranks(ids[:count] * (int(ids.max()) + 1) + ids[step : step + count])
        length += step
    twice = np.bincount(ids)[ids] > 1
    marks = np.zeros(len(codes) + 1, np.int64)
    marks[:n] += twice
    marks[width : width + n] -= twice
    return int((np.cumsum(marks[:-1]) > 0).sum())


def text_counts(data: bytes | None) -> tuple[int, ...]:
    """The counts of one text; a missing text has none."""
    if not data:
        return (0,) * len(COUNTS)
    words = data.split()
    seen: dict[bytes, int] = {}
    codes = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    letters = data.translate(None, SPACE)
    points = len(letters) if letters.isascii() else len(letters.decode("utf-8", "surrogatepass"))
    lines = data.split(b"\n")
    full = [x for x in lines if x.strip(SPACE)]
    return (
        len(words), points, len(data) - len(data.translate(None, SYMBOLS)), len(full) - len(set(full)), repeated_words(codes), len(lines), len(seen),
        len(letters) - len(letters.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")), data.count(b"!"), len(letters) - len(letters.translate(None, b"0123456789")), data.count(b"|"),
        data.count(b".") + data.count(b"?") + data.count(b"!"), int(np.bincount(codes).max()) if words else 0, max(map(len, words), default=0),
    )


def text_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the counts of every whole text, one row per row of ``docs``.

    A missing text counts as an empty one; repeated rows give repeated results;
    other columns are not read.
    """

    def make(batches):
        for b in batches:
            columns = zip(*map(text_counts, b["text"])) if b["text"] else [[]] * len(COUNTS)
            yield {"doc_id": b["doc_id"]} | dict(zip(COUNTS, map(list, columns)))

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_rows(docs.select("doc_id", "text"), make, f"doc_id {kind}, {STATS_SCHEMA}")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def feature(name: str) -> Column:
    if name not in RATES:
        return F.col(name).cast("double")
    over, under = RATES[name]
    return F.when(F.col(under) > 0, F.col(over) / F.col(under)).otherwise(F.lit(0.0))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] > self.threshold if self.above else x[self.feature] <= self.threshold

    def column(self) -> Column:
        return feature(self.feature) > F.lit(self.threshold) if self.above else feature(self.feature) <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def _covered(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    hit = np.ones(n, bool)
    for c in rule:
        hit &= c.holds(x)
    return hit


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, max_conditions: int, cuts: int) -> Rule:
    """Conditions added for the largest gain until no good row is covered."""
    rule: list[Condition] = []
    inside = np.ones(len(bad), bool)
    while len(rule) < max_conditions:
        p, n = int((inside & bad).sum()), int((inside & ~bad).sum())
        if not p or not n:
            break
        before = np.log2(p / (p + n))
        best, gain = None, 1e-9
        for name, values in x.items():
            own = values[inside]
            label = bad[inside]
            order = np.argsort(own, kind="stable")
            own, label = own[order], label[order]
            ends = np.flatnonzero(np.diff(own) > 0)
            if not len(ends):
                continue
            if len(ends) > cuts:
                ends = np.unique(ends[np.linspace(0, len(ends) - 1, cuts).astype(int)])
            low_p = np.cumsum(label)[ends].astype(float)
            low_n = (ends + 1) - low_p
            for above in (False, True):
                pp, nn = (p - low_p, n - low_n) if above else (low_p, low_n)
                with np.errstate(divide="ignore", invalid="ignore"):
                    gains = np.where(pp > 0, pp * (np.log2(pp / (pp + nn)) - before), -1.0)
                k = int(np.argmax(gains))
                if gains[k] > gain:
                    best, gain = Condition(name, above, float((own[ends[k]] + own[ends[k] + 1]) / 2)), gains[k]
        if best is None:
            break
        rule.append(best)
        inside &= best.holds(x)
    return tuple(rule)


def learn_rules(sample: pd.DataFrame, min_precision: float = 0.95, min_cover: int = 8, max_rules: int = 24, max_conditions: int = 4, cuts: int = 128) -> list[Rule]:
    """Ordered rules that reject a text, from rows with ``label`` (1: good), FEATURES and ``prune`` (which part).

    A rule must cover ``min_cover`` bad rows and be right on ``min_precision`` of
    what it covers, in the pruning part and over both. No labelled bad rows give no rules.
    """
    rules: list[Rule] = []
    rest = sample.reset_index(drop=True)
    while len(rules) < max_rules:
        bad = rest["label"].to_numpy() == 0
        if bad.sum() < min_cover:
            break
        part = rest["prune"].to_numpy(bool)
        x = {f: rest[f].to_numpy(float) for f in FEATURES}
        grown = _grow({f: v[~part] for f, v in x.items()}, bad[~part], max_conditions, cuts)
        if not grown:
            break
        held = {f: v[part] for f, v in x.items()}

        def worth(rule: Rule) -> float:
            hit = _covered(rule, held, int(part.sum()))
            p, n = int((hit & bad[part]).sum()), int((hit & ~bad[part]).sum())
            return (p - n) / (p + n) if p + n else -1.0

        rule = max((grown[:k] for k in range(len(grown), 0, -1)), key=worth)
        hit = _covered(rule, x, len(rest))
        right = (hit & bad).sum()
        if right < min_cover or right < min_precision * hit.sum() or worth(rule) < 2 * min_precision - 1:
            break
        rules.append(rule)
        rest = rest[~hit].reset_index(drop=True)
    return rules


def rule_number(rules: list[Rule]) -> Column:
    """The number of the first rule that holds (from 1), 0 where none does."""
    chain = None
    for k, rule in enumerate(rules, 1):
        test = rule[0].column()
        for c in rule[1:]:
            test = test & c.column()
        chain = F.when(test, F.lit(k)) if chain is None else chain.when(test, F.lit(k))
    return F.lit(0) if chain is None else chain.otherwise(F.lit(0))


def fit_rules(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Rules learned from at most ``sample_rows`` labelled documents that pass the base test."""
    sample = labelled_ids(labels, "quality", sample_rows)
    stats = text_statistics(with_sample(docs.select("doc_id", "text"), sample).select("doc_id", "text"))
    one = stats.where(~base_failed()).groupBy("doc_id").agg(F.min(F.struct(*COUNTS)).alias("s")).select("doc_id", "s.*")
    rows = one.join(sample, "doc_id").select("label", (F.pmod(F.xxhash64(F.lit("part"), "doc_id"), F.lit(3)) == 0).alias("prune"), *[feature(f).alias(f) for f in FEATURES])
    return learn_rules(rows.toPandas().sort_values(FEATURES, ignore_index=True))


def judge(stats: DataFrame, rules: list[Rule]) -> DataFrame:
    """Adds base_failed, rule and kept."""
    judged = stats.withColumns({"base_failed": base_failed(), "rule": rule_number(rules)})
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def quality_report(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Counts and verdict of every row of ``docs``."""
    rules = fit_rules(docs, labels, sample_rows)
    return judge(text_statistics(docs), rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def keep_quality(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""
    rules = fit_rules(docs, labels, sample_rows)
    counted = add_columns(docs, ["text"], text_counts, STATS_SCHEMA)
    return unpacked(judge(counted, rules).where("kept"), docs.columns)
