"""Toxicity: boosted trees over a dozen dense features, calibrated by isotonic regression.

Labelled documents outside the held-out fold, a bounded number of them, are dealt
into three parts by a hash of their id: one shows which words and word beginnings
toxic texts prefer (beside a fixed list), one trains the trees on the features,
one calibrates their probabilities. All texts are then scored in whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlab.llm.common import fold_is, labelled_ids, with_sample
from flowlab.session import cut_lineage

HELD_OUT_MOD = 5
#: Labelled documents that lexicon, trees and calibration are fitted on, at most.
SAMPLE_ROWS = 20_000
LEXICON_TERMS = 600
#: A learned term is in this many toxic documents at least, and in this share of them; labels err and texts have copies.
MIN_TOXIC_DOCS, MIN_TOXIC_SHARE, MIN_LOG_ODDS = 5, 0.01, 2.0
TREES, DEPTH, STEP = 20, 3, 0.3
NEAR = 4

#: Insults, threats and second-person words of four languages.
INSULTS = frozenset(
    "idiot idiots moron morons stupid dumb fool loser losers pathetic worthless trash garbage scum clown disgusting jerk creep freak ugly filthy liar coward imbecile dumbass bastard"
    " idiotin dumm dummkopf blöd trottel arschloch abschaum versager müll widerlich ekelhaft"
    " imbécile crétin débile connard ordure nul minable dégoûtant abruti"
    " idiota imbécil estúpido tonto basura escoria patético asqueroso inútil".split()
)
THREATS = frozenset("kill die hurt destroy punch hate hang shoot burn töten sterben hass verrecke tuer crever mourir haine matar morir odio".split())
SECOND_PERSON = frozenset("you your yours yourself u ur ya du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos tú ti tuyo usted ustedes vosotros".split())
LEET = str.maketrans("013457@$!|", "oieastasil")

FEATURES = ["n_words", "insults", "insult_density", "learned", "learned_density", "learned_weight", "threat_density", "second_person", "insult_near_you", "capitals", "shouted", "punctuation", "exclaims", "obfuscated", "obfuscated_insults"]

EDGE = re.compile(r"^\W+|\W+$")
INNER = re.compile(r"[A-Za-zÀ-ɏ][0-9@$!*|]+[A-Za-zÀ-ɏ]|^[0-9@$]+[A-Za-z]{2,}")
INSULT, LEARNED, THREAT, YOU, SHOUT, MIXED, HIDDEN = (1 << k for k in range(7))


def terms(word: str) -> list[str]:
    """What the lexicon may know of a word: itself, and its beginnings of 4 to 6 letters with a star."""
    return [word, *(word[:k] + "*" for k in (4, 5, 6) if len(word) > k)]


class Marker:
    """Marks of words, kept per distinct word: which lists know it, and the learned weight."""

    def __init__(self, lexicon: dict[str, float], limit: int = 400_000):
        self.lexicon, self.limit = lexicon, limit
        self.known: dict[bytes, int] = {}
        self.kinds: list[tuple[int, float]] = [(0, 0.0)]
        self.number = {(0, 0.0): 0}

    def mark(self, raw: bytes) -> int:
        text = raw.decode("utf-8", "replace")
        plain = EDGE.sub("", text)
        low = plain.lower()
        flags = (INSULT if low in INSULTS else 0) | (THREAT if low in THREATS else 0) | (YOU if low in SECOND_PERSON else 0)
        flags |= SHOUT if len(plain) > 1 and plain.isupper() else 0
        if INNER.search(text):
            bare = EDGE.sub("", low.translate(LEET))
            flags |= MIXED | (HIDDEN if bare in INSULTS or _star(low) else 0)
        weight = max((self.lexicon.get(t, 0.0) for t in terms(low)), default=0.0) if low else 0.0
        if weight:
            flags |= LEARNED
        kind = (flags, weight)
        if kind not in self.number:
            self.number[kind] = len(self.kinds)
            self.kinds.append(kind)
        return self.number[kind]

    def marks(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        try:
            return np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        except KeyError:
            if len(known) >= self.limit:
                known.clear()
            for w in set(words):
                if w not in known:
                    known[w] = self.mark(w)
            return np.fromiter(map(known.__getitem__, words), np.int64, len(words))

    def features(self, data: bytes | None) -> tuple[float, ...]:
        """The features of a whole text; those of an empty or missing text are zero."""
        words = data.split() if data else []
        n = len(words)
        if not n:
            return (0.0,) * len(FEATURES)
        marks = self.marks(words)
        at = np.flatnonzero(marks)
        kinds = [self.kinds[k] for k in marks[at].tolist()]
        flags = np.array([f for f, _ in kinds], np.int64)
        weight = sum(w for _, w in kinds)

        def count(bit: int) -> int:
            return int((flags & bit > 0).sum())

        hits, you = at[flags & (INSULT | LEARNED | HIDDEN) > 0], at[flags & YOU > 0]
        near = 0
        if len(hits) and len(you):
            right = np.searchsorted(you, hits)
            gap = np.minimum(np.abs(you[np.minimum(right, len(you) - 1)] - hits), np.abs(hits - you[np.maximum(right - 1, 0)]))
            near = int((gap <= NEAR).sum())
        letters = len(data) - data.count(b" ")
        capitals = len(data) - len(data.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
        marks_out = len(data) - len(data.translate(None, b"!?.,;:*#$%&@"))
        insults, learned = count(INSULT), count(LEARNED)
        return (
            math.log1p(n), float(insults), insults / n, float(learned), learned / n, weight / n, count(THREAT) / n, len(you) / n, near / n, capitals / letters, count(SHOUT) / n,
            marks_out / letters, (data.count(b"!") + data.count(b"?")) / n, count(MIXED) / n, float(count(HIDDEN)),
        )


def _star(word: str) -> bool:
    """Whether an insult fits a word with letters starred out."""
    if "*" not in word:
        return False
    fits = re.compile("".join("\\w" if c == "*" else re.escape(c) for c in EDGE.sub("", word)))
    return any(fits.fullmatch(x) for x in INSULTS)


def term_counts(sample: DataFrame) -> DataFrame:
    """(term, toxic, clean): documents of each label that hold a term. Summed in each task before the shuffle."""

    def run(batches):
        toxic, clean = Counter(), Counter()
        for b in batches:
            for data, label in zip(b.column("text").cast(pa.binary()).to_pylist(), b.column("label").to_pylist()):
                found = {t for w in set((data or b"").split()) for t in terms(EDGE.sub("", w.decode("utf-8", "replace")).lower()) if len(t) > 2}
                (toxic if label else clean).update(found)
        names = [t for t in toxic]
        if names:
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([toxic[t] for t in names]), pa.array([clean[t] for t in names])], names=["term", "toxic", "clean"])
        rest = [t for t in clean if t not in toxic]
        if rest:
            yield pa.RecordBatch.from_arrays([pa.array(rest), pa.array([0] * len(rest)), pa.array([clean[t] for t in rest])], names=["term", "toxic", "clean"])

    return sample.select("text", "label").mapInArrow(run, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def learn_lexicon(sample: DataFrame, limit: int = LEXICON_TERMS) -> dict[str, float]:
    """At most ``limit`` terms that toxic texts prefer, with their log odds."""
    sizes = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    odds = F.log((F.col("toxic") + 0.5) / (sizes.get(1, 0) + 1)) - F.log((F.col("clean") + 0.5) / (sizes.get(0, 0) + 1))
    found = term_counts(sample).where(F.col("toxic") >= max(MIN_TOXIC_DOCS, MIN_TOXIC_SHARE * sizes.get(1, 0))).withColumn("odds", odds).where(F.col("odds") >= MIN_LOG_ODDS)
    rows = found.orderBy((F.col("odds") * F.col("toxic")).desc(), "term").limit(limit).collect()
    return {r["term"]: float(r["odds"]) for r in rows}


def with_features(docs: DataFrame, lexicon: dict[str, float]) -> DataFrame:
    """doc_id, FEATURES and, where it is there, label of every row."""
    carried = [c for c in ("doc_id", "label") if c in docs.columns]
    schema = ", ".join([*(f"{c} {docs.schema[c].dataType.simpleString()}" for c in carried), *(f"{f} double" for f in FEATURES)])

    def run(batches):
        marker = Marker(lexicon)
        for b in batches:
            if b.num_rows:
                made = np.array([marker.features(t) for t in b.column("text").cast(pa.binary()).to_pylist()])
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in carried), *(pa.array(made[:, k]) for k in range(len(FEATURES)))], names=[*carried, *FEATURES])

    return docs.select(*carried, "text").mapInArrow(run, schema)


class Scorer:
    """Lexicon, trees and calibration; ``constant`` is the score of all where the labels give nothing to learn."""

    def __init__(self, lexicon, trees=None, calibration=None, constant: float = 0.0):
        self.lexicon, self.trees, self.calibration, self.constant = lexicon, trees, calibration, constant

    def score(self, docs: DataFrame) -> DataFrame:
        if self.trees is None:
            return docs.select("doc_id", F.lit(self.constant).alias("score"))
        vectors = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(with_features(docs.select("doc_id", "text"), self.lexicon))
        raw = self.trees.transform(vectors).select("doc_id", vector_to_array("probability")[1].alias("raw"))
        if self.calibration is not None:
            raw = self.calibration.transform(raw)
            return raw.select("doc_id", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("score"))).alias("score"))
        return raw.select("doc_id", F.col("raw").alias("score"))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Scorer:
    """A scorer from labelled rows outside the held-out fold; labels, language, source and id are no features."""
    training = labels.where(~fold_is(HELD_OUT_MOD, 0))
    ids = labelled_ids(training, "toxic", sample_rows).withColumn("part", F.pmod(F.xxhash64(F.lit("toxic part"), "doc_id"), F.lit(100)).cast("int"))
    sample = with_sample(docs.select("doc_id", "text"), ids)
    lexicon = learn_lexicon(sample.where("part < 50"))
    rows = with_features(sample.where("part >= 50").select("doc_id", "text", "label"), lexicon).groupBy("doc_id", "label").agg(*[F.min(f).alias(f) for f in FEATURES])
    fitted = cut_lineage(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows.withColumn("label", F.col("label").cast("double"))).withColumn("part", F.pmod(F.xxhash64(F.lit("toxic part"), "doc_id"), F.lit(100)).cast("int")).select("part", "label", "features").coalesce(4))
    counts = {(r["late"], r["label"]): r["n"] for r in fitted.groupBy((F.col("part") >= 85).alias("late"), "label").agg(F.count("*").alias("n")).collect()}
    positive, total = sum(n for (_, y), n in counts.items() if y == 1), sum(counts.values())
    if not counts.get((False, 1.0)) or not counts.get((False, 0.0)):
        return Scorer(lexicon, constant=positive / total if total else 0.0)
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, seed=17, maxBins=64).fit(fitted.where("part < 85"))
    late = trees.transform(fitted.where("part >= 85")).select("label", vector_to_array("probability")[1].alias("raw"))
    calibration = None
    if counts.get((True, 1.0)) and counts.get((True, 0.0)):
        calibration = IsotonicRegression(featuresCol="raw", predictionCol="score").fit(late)
    return Scorer(lexicon, trees, calibration)


def toxicity_report(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``.

    A missing text is empty; empty texts have zero features and the score those
    give. Repeated rows give repeated results. Without labelled rows of both kinds
    every score is the share of toxic ones among them, 0 without any.
    """
    scored = fit(docs, labels, sample_rows).score(docs)
    return scored.select("doc_id", fold_is(HELD_OUT_MOD, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
