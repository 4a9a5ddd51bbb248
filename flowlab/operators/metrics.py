"""Classification metrics: one algebraic count per cell, then column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlab.functions.clean import f1, safe_div
from flowlab.operators.order import distinct_sizes, running_sums
from flowlab.operators.profile import one_row

CELLS = ["tn", "fp", "fn", "tp"]


def cell_counts(y_true: str = "y_true", y_pred: str = "y_pred") -> list[Column]:
    t, p = F.col(y_true), F.col(y_pred)
    tests = {"tn": (t == 0) & (p == 0), "fp": (t == 0) & (p == 1), "fn": (t == 1) & (p == 0), "tp": (t == 1) & (p == 1)}
    return [F.count_if(tests[c]).alias(c) for c in CELLS]


def confusion(df: DataFrame, by: list[str] = (), y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """Always the full 2x2 table, also on one-class groups."""
    return df.groupBy(*by).agg(*cell_counts(y_true, y_pred))


def _rates(cm: DataFrame) -> DataFrame:
    tn, fp, fn, tp = (F.col(c) for c in CELLS)
    cm = cm.withColumns({
        "n_rows": tn + fp + fn + tp,
        "support_benign": tn + fp,
        "support_attack": fn + tp,
        "precision_benign": safe_div(tn, tn + fn),
        "recall_benign": safe_div(tn, tn + fp),
        "precision_attack": safe_div(tp, tp + fp),
        "recall_attack": safe_div(tp, tp + fn),
    })
    return cm.withColumns({
        "accuracy": safe_div(tn + tp, F.col("n_rows")),
        "f1_benign": f1(F.col("precision_benign"), F.col("recall_benign")),
        "f1_attack": f1(F.col("precision_attack"), F.col("recall_attack")),
    })


def _average(cm: DataFrame, benign_in: Column, attack_in: Column, balanced: Column) -> DataFrame:
    def macro(name: str) -> Column:
        total = F.when(benign_in, F.col(f"{name}_benign")).otherwise(0.0) + F.when(attack_in, F.col(f"{name}_attack")).otherwise(0.0)
        return safe_div(total, benign_in.cast("int") + attack_in.cast("int"))

    def weighted(name: str) -> Column:
        total = F.col(f"{name}_benign") * F.col("support_benign") + F.col(f"{name}_attack") * F.col("support_attack")
        return safe_div(total, F.col("n_rows"))

    out = {f"{m}_macro": macro(m) for m in ("precision", "recall", "f1")}
    out |= {f"{m}_weighted": weighted(m) for m in ("precision", "recall", "f1")}
    return cm.withColumns(out | {"balanced_accuracy": balanced})


def metrics_fixed(cm: DataFrame) -> DataFrame:
    """Macro averages over both classes, present or not."""
    cm = _rates(cm)
    both = F.lit(True)
    return _average(cm, both, both, (F.col("recall_benign") + F.col("recall_attack")) / 2.0)


def metrics_present(cm: DataFrame) -> DataFrame:
    """Macro averages over the labels seen in truth or prediction; balanced accuracy over those in truth."""
    cm = _rates(cm)
    benign_in = F.col("tn") + F.col("fp") + F.col("fn") > 0
    attack_in = F.col("tp") + F.col("fp") + F.col("fn") > 0
    in_truth = (F.col("support_benign") > 0).cast("int") + (F.col("support_attack") > 0).cast("int")
    return _average(cm, benign_in, attack_in, safe_div(F.col("recall_benign") + F.col("recall_attack"), in_truth))


def per_class(df: DataFrame, by: list[str] = (), y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """Precision, recall, F1 and support of every class of a multiclass prediction table."""
    pairs = df.groupBy(*by, y_true, y_pred).agg(F.count(F.lit(1)).alias("n"))
    hit = F.when(F.col(y_true) == F.col(y_pred), F.col("n")).otherwise(0)
    sides = pairs.select(
        *by,
        F.explode(F.array(
            F.struct(F.col(y_true).alias("cls"), hit.alias("tp"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted")),
            F.struct(F.col(y_pred).alias("cls"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted")),
        )).alias("s"),
    ).select(*by, "s.*")
    cells = sides.groupBy(*by, "cls").agg(*[F.sum(c).alias(c) for c in ("tp", "support", "predicted")])
    cells = cells.withColumns({"precision": safe_div(F.col("tp"), F.col("predicted")), "recall": safe_div(F.col("tp"), F.col("support"))})
    return cells.withColumn("f1", f1(F.col("precision"), F.col("recall")))


def multiclass_summary(classes: DataFrame, by: list[str] = ()) -> DataFrame:
    n = F.sum("support")
    seen = F.col("support") > 0
    out = [n.alias("n_rows"), safe_div(F.sum("tp"), n).alias("accuracy"), F.avg(F.when(seen, F.col("recall"))).alias("balanced_accuracy")]
    for m in ("precision", "recall", "f1"):
        out += [F.avg(m).alias(f"{m}_macro"), safe_div(F.sum(F.col(m) * F.col("support")), n).alias(f"{m}_weighted")]
    return classes.groupBy(*by).agg(*out)


def class_report(classes: DataFrame) -> DataFrame:
    """Per-class rows followed by accuracy, macro and weighted average rows."""
    cls = classes.select(F.col("cls").cast("string").alias("row"), "precision", "recall", "f1", "support")
    total = multiclass_summary(classes)
    acc = F.col("accuracy")
    rows = F.array(
        F.struct(F.lit("accuracy").alias("row"), acc.alias("precision"), acc.alias("recall"), acc.alias("f1"), F.col("n_rows").alias("support")),
        *[
            F.struct(F.lit(f"{k} avg").alias("row"), *[F.col(f"{m}_{k}").alias(m) for m in ("precision", "recall", "f1")], F.col("n_rows").alias("support"))
            for k in ("macro", "weighted")
        ],
    )
    return cls.unionByName(total.select(F.inline(rows)))


def _score_counts(df: DataFrame, by: list[str], y_true: str, score: str) -> DataFrame:
    return df.groupBy(*by, score).agg(F.count_if(F.col(y_true) == 1).alias("pos"), F.count_if(F.col(y_true) == 0).alias("neg"))


def roc_auc(df: DataFrame, by: list[str], y_true: str = "y_true", score: str = "y_score", group_limit: int | None = None) -> DataFrame:
    """Mann-Whitney form over distinct scores; ties count one half; null on one-class groups."""
    sizes = distinct_sizes(df, by, score)
    run = running_sums(_score_counts(df, by, y_true, score), by, score, ["neg"], group_limit=group_limit, sizes=sizes)
    wins = F.sum(F.col("pos") * (F.col("run_neg") - F.col("neg") / 2.0))
    return run.groupBy(*by).agg(F.try_divide(wins, F.sum("pos").cast("double") * F.sum("neg")).alias("roc_auc"))


def average_precision(df: DataFrame, by: list[str], y_true: str = "y_true", score: str = "y_score", group_limit: int | None = None) -> DataFrame:
    """Sum of recall steps times precision, scores falling; null without positives."""
    sizes = distinct_sizes(df, by, score)
    run = running_sums(_score_counts(df, by, y_true, score), by, score, ["pos", "neg"], descending=True, group_limit=group_limit, sizes=sizes)
    step = F.col("pos") * safe_div(F.col("run_pos"), F.col("run_pos") + F.col("run_neg"))
    return run.groupBy(*by).agg(F.try_divide(F.sum(step), F.sum("pos").cast("double")).alias("pr_auc"))


def metrics_by(df: DataFrame, by: list[str], order: str, y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """Metrics of each group with its attack rate and first and last order value, in one aggregate."""
    cm = df.groupBy(*by).agg(
        *cell_counts(y_true, y_pred), F.avg(F.col(y_true).cast("double")).alias("attack_rate"),
        F.min(order).alias(f"first_{order}"), F.max(order).alias(f"last_{order}"),
    )
    return metrics_present(cm)


BOOTSTRAP_METRICS = ["accuracy", "precision_attack", "recall_attack", "f1_attack", "f1_macro"]


def hash_unit(*parts: Column) -> Column:
    """A number in (0, 1) from the digest of its parts; the same in every engine that has md5."""
    digest = F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def binomial_draw(n: Column, hits: Column, of: Column, z: Column) -> Column:
    """Quantile of Binomial(n, hits/of) at the normal deviate ``z``, by the second-order Cornish-Fisher expansion.

    Within one of the exact quantile; exact where the share is nought or one.
    """
    p = hits / of
    x = F.floor(n * p + F.sqrt(n * p * (1 - p)) * z + (1 - 2 * p) * (z * z - 1) / 6 + 0.5)
    return F.when((n <= 0) | (hits <= 0), 0).when(hits >= of, n).otherwise(F.greatest(F.lit(0), F.least(n, x))).cast("long")


def redrawn_cells(cm: DataFrame, by: list[str], resamples: int, seed: int) -> DataFrame:
    """Multinomial redraws of the four cells: each takes its binomial share of what the cells before it have left."""
    draws = cm.select(*by, *[F.col(c).alias(f"_{c}") for c in CELLS], F.explode(F.sequence(F.lit(1), F.lit(resamples))).alias("resample"))
    name = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in by]
    left, mass = sum((F.col(f"_{c}") for c in CELLS[1:]), F.col(f"_{CELLS[0]}")), sum((F.col(f"_{c}") for c in CELLS[1:]), F.col(f"_{CELLS[0]}"))
    draws = draws.withColumns({"_left": left, "_mass": mass})
    for c in CELLS[:-1]:
        u, v = (hash_unit(F.lit(seed), *name, F.col("resample"), F.lit(c), F.lit(k)) for k in (1, 2))
        deviate = F.sqrt(-2 * F.log(u)) * F.cos(v * 2 * F.pi())
        draws = draws.withColumn(c, binomial_draw(F.col("_left"), F.col(f"_{c}"), F.col("_mass"), deviate))
        draws = draws.withColumns({"_left": F.col("_left") - F.col(c), "_mass": F.col("_mass") - F.col(f"_{c}")})
    return draws.select(*by, "resample", *CELLS[:-1], F.col("_left").alias(CELLS[-1]))


def bootstrap_ci(df: DataFrame, by: list[str], resamples: int = 1000, seed: int = 42, y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """Mean and 95% percentile interval of the confusion metrics over bootstrap resamples.

    Resampling rows with replacement makes the four cells a multinomial draw, so the table
    is read once and the cost of the draws does not depend on it.  Draws come from digests
    of group, resample and cell: they repeat, and are made in column expressions alone.
    """
    scored = metrics_present(redrawn_cells(confusion(df, by, y_true, y_pred), list(by), resamples, seed)).select(*by, *BOOTSTRAP_METRICS)
    long = scored.unpivot(list(by), BOOTSTRAP_METRICS, "metric", "value")
    return long.groupBy(*by, "metric").agg(
        F.avg("value").alias("mean"), F.percentile("value", 0.025).alias("ci_low"), F.percentile("value", 0.975).alias("ci_high"),
        F.count(F.lit(1)).alias("n_resamples"),
    )


def threshold_sweep(df: DataFrame, thresholds: list[float], by: list[str] = (), y_true: str = "y_true", score: str = "y_score") -> DataFrame:
    """Fixed-class metrics at every threshold from one pass.

    A row only tells how many thresholds its score reaches; counts per such
    level are summed upwards afterwards, so rows are never multiplied.
    """
    by, cuts = list(by), sorted(set(thresholds))
    level = sum(((F.col(score) >= t).cast("int") for t in cuts), F.lit(0))
    counted = df.groupBy(*by, level.alias("level")).agg(F.count_if(F.col(y_true) == 1).alias("pos"), F.count_if(F.col(y_true) == 0).alias("neg"))
    grid = F.explode(F.array(*[F.struct(F.lit(i + 1).alias("at"), F.lit(float(t)).alias("threshold")) for i, t in enumerate(cuts)]))
    reached = F.col("level") >= F.col("g.at")

    def total(name: str, test: Column) -> Column:
        return F.coalesce(F.sum(F.when(test, F.col(name))), F.lit(0)).alias({("pos", True): "tp", ("pos", False): "fn", ("neg", True): "fp", ("neg", False): "tn"}[name, test is reached])

    missed = ~reached
    cm = counted.withColumn("g", grid).groupBy(*by, F.col("g.threshold").alias("threshold")).agg(
        total("pos", reached), total("pos", missed), total("neg", reached), total("neg", missed)
    )
    return metrics_fixed(cm)


def best_threshold(sweep: DataFrame, by: list[str] = (), rule: str = "macro") -> DataFrame:
    """The chosen row: highest macro F1, lowest threshold on ties; ``rule='recipe'`` breaks ties by attack F1 and accuracy first."""
    tops = {"macro": ["f1_macro"], "recipe": ["f1_macro", "f1_attack", "accuracy"]}[rule]
    order = [F.col(c).desc() for c in tops] + [F.col("threshold").asc()]
    if not by:
        return sweep.orderBy(*order).limit(1)
    return sweep.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_rn = 1").drop("_rn")


CRITERIA = ["f1_macro", "f1_attack", "balanced_accuracy", "recall_attack"]


def best_thresholds(sweep: DataFrame, by: list[str] = ()) -> DataFrame:
    """Best threshold per criterion, highest threshold on ties."""
    picks = [F.max(F.struct(F.col(c).alias("value"), F.col("threshold"))).alias(c) for c in CRITERIA]
    rows = F.array(*[F.struct(F.lit(c).alias("criterion"), F.col(f"{c}.threshold"), F.col(f"{c}.value")) for c in CRITERIA])
    return sweep.groupBy(*by).agg(*picks).select(*by, F.inline(rows))


def histogram(df: DataFrame, col: str, bins: int, by: list[str] = (), low: float | None = None, high: float | None = None) -> DataFrame:
    """Equal-width counts between the column's bounds; the top bound falls into the last bin."""
    if low is None or high is None:
        low, high = one_row(df.agg(F.min(col).cast("double").alias("low"), F.max(col).cast("double").alias("high")), ["low", "high"]).values()
    else:
        low, high = F.lit(float(low)), F.lit(float(high))
    width = F.when(high > low, (high - low) / bins).otherwise(1.0)
    bin_ = F.least(F.lit(bins - 1), F.floor((F.col(col) - low) / width)).cast("int")
    return df.where(F.col(col).isNotNull()).groupBy(*by, bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n_rows")).withColumn(
        "bin_low", low + F.col("bin") * width
    )
