"""Model jobs on Spark MLlib: preprocessing, fits, experiments.

Every fit and every scoring pass is a distributed MLlib job; the driver only
loops over settings, folds and boosting rounds.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlab.operators.metrics import best_threshold, cell_counts, confusion, metrics_fixed, metrics_present, threshold_sweep
from flowlab.operators.order import WHOLE, column_quantiles, whole
from flowlab.operators.prefix import latency_of_cells, metrics_of_cells, prefix_cells
from flowlab.operators.profile import class_counts, top_categories
from flowlab.operators.sampling import balance, group_split, holdout, stratified_sample
from flowlab.operators.splits import loao_split, loso_split
from flowlab.session import cut_lineage, settle, values
from flowlab.sources.tables import prediction_columns, union_all

# Default decision thresholds of the adaptation recipe.
RECIPE_THRESHOLDS = [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]


# Preprocessing

def onehot_stages(num: list[str], cat: list[str]) -> list:
    """One-hot categories and raw numbers in one vector; an unseen category becomes all zeros.

    The bucket for unseen values comes last and is the one the encoder drops.
    """
    index = StringIndexer(inputCols=cat, outputCols=[f"{c}_ix" for c in cat], handleInvalid="keep", stringOrderType="alphabetAsc")
    onehot = OneHotEncoder(inputCols=[f"{c}_ix" for c in cat], outputCols=[f"{c}_oh" for c in cat], dropLast=True)
    return [index, onehot, VectorAssembler(inputCols=[*num, *[f"{c}_oh" for c in cat]], outputCol="features")]


@dataclass(frozen=True)
class OrdinalCoder:
    """Medians, modes and sorted category codes learned on one table."""

    numeric: dict[str, float]
    modes: dict[str, str]
    index: StringIndexerModel | None

    @property
    def names(self) -> list[str]:
        return [*self.modes, *self.numeric]

    def transform(self, df: DataFrame) -> DataFrame:
        filled = df.fillna({**self.modes, **self.numeric})
        if self.index is not None:
            filled = self.index.transform(filled)
            known = {c: len(labels) for c, labels in zip(self.modes, self.index.labelsArray)}
            filled = filled.withColumns({f"{c}_code": F.when(F.col(f"{c}_ix") == n, -1.0).otherwise(F.col(f"{c}_ix")) for c, n in known.items()})
        inputs = [*[f"{c}_code" for c in self.modes], *self.numeric]
        out = VectorAssembler(inputCols=inputs, outputCol="features").transform(filled)
        return out.drop(*[f"{c}_{s}" for c in self.modes for s in ("ix", "code")])


def fit_ordinal(df: DataFrame, num: list[str], cat: list[str]) -> OrdinalCoder:
    """True medians (interpolated), most frequent category (ties by name), codes in sorted order, -1 for unseen."""
    medians = {r["feature"]: r["median"] for r in column_quantiles(whole(df), ["_all"], num, {"median": 0.5}).collect()}
    modes = {r["feature"]: r["value"] for r in top_categories(df.select(*cat).dropna(), cat, 1).collect()} if cat else {}
    index = None
    if cat:
        filled = df.fillna(modes)
        index = StringIndexer(inputCols=cat, outputCols=[f"{c}_ix" for c in cat], handleInvalid="keep", stringOrderType="alphabetAsc").fit(filled)
    return OrdinalCoder({c: medians.get(c) or 0.0 for c in num}, {c: modes[c] for c in cat}, index)


def balanced_weight(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """n / (2 * n_c) per class."""
    sizes = class_counts(df, label=label).first()
    n = sizes["n_benign"] + sizes["n_attack"]
    w = F.when(F.col(label) == 0, n / (2.0 * max(sizes["n_benign"], 1))).otherwise(n / (2.0 * max(sizes["n_attack"], 1)))
    return df.withColumn(out, w)


def imbalance_weight(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """n_neg/n_pos on attack rows, 1 on benign rows."""
    scale = class_counts(df, label=label).first()["scale_pos_weight"]
    return df.withColumn(out, F.when(F.col(label) == 1, F.lit(float(scale))).otherwise(1.0))


# Fits

def rf_stage(label: str, trees: int = 100, depth: int = 20, seed: int = 42, **params) -> RandomForestClassifier:
    """MLlib trees stop at depth 30; a deeper setting raises an error."""
    if depth > 30:
        raise ValueError("trees deeper than 30 levels are not supported")
    return RandomForestClassifier(labelCol=label, featuresCol="features", weightCol="weight", numTrees=trees, maxDepth=depth, seed=seed, **params)


def gbt_stage(label: str, trees: int = 100, depth: int = 5, rate: float = 0.1, subsample: float = 0.9, seed: int = 42, **params) -> GBTClassifier:
    return GBTClassifier(
        labelCol=label, featuresCol="features", weightCol="weight", maxIter=trees, maxDepth=depth, stepSize=rate, subsamplingRate=subsample, seed=seed, **params
    )


def fit_rf(train: DataFrame, num: list[str], cat: list[str], label: str, **params) -> PipelineModel:
    return Pipeline(stages=[*onehot_stages(num, cat), rf_stage(label, **params)]).fit(balanced_weight(train, label))


def fit_gbt(train: DataFrame, num: list[str], cat: list[str], label: str, **params) -> PipelineModel:
    return Pipeline(stages=[*onehot_stages(num, cat), gbt_stage(label, **params)]).fit(imbalance_weight(train, label))


def fit_mlp(train: DataFrame, num: list[str], cat: list[str], label: str, hidden: tuple[int, ...] = (128, 64), max_iter: int = 100, block: int = 256, seed: int = 42) -> PipelineModel:
    """Scaled inputs into a multilayer perceptron (sigmoid layers, L-BFGS)."""
    stages = onehot_stages(num, cat)
    stages[-1] = stages[-1].setOutputCol("raw_features")
    scaler = StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True)
    prepared = Pipeline(stages=[*stages, scaler]).fit(train)
    width = prepared.transform(train.limit(1)).schema["raw_features"].metadata["ml_attr"]["num_attrs"]
    net = MultilayerPerceptronClassifier(labelCol=label, featuresCol="features", layers=[width, *hidden, 2], maxIter=max_iter, blockSize=block, seed=seed)
    return PipelineModel([*prepared.stages, net.fit(prepared.transform(train))])


def score(model, df: DataFrame, keep: list[str], threshold: float = 0.5) -> DataFrame:
    """Attack probability and decision beside the kept columns."""
    p = vector_to_array("probability")[1]
    return model.transform(df).select(*keep, p.alias("y_score")).withColumn("y_pred", (F.col("y_score") >= threshold).cast("int"))


def save_model(model: PipelineModel, path: str) -> None:
    """Keeps a fitted pipeline in a folder that all executors reach."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def importances(model: PipelineModel, data: DataFrame) -> DataFrame:
    """(feature, importance), largest first; slot names come from the assembled vector's metadata."""
    spark = data.sparkSession
    forest = model.stages[-1]
    attrs = model.transform(data.limit(1)).schema["features"].metadata.get("ml_attr", {}).get("attrs", {})
    names = {a["idx"]: a["name"] for group in attrs.values() for a in group}
    rows = [(names.get(i, f"slot_{i}"), float(v)) for i, v in enumerate(forest.featureImportances.toArray())]
    return values(spark, rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")


# Evaluation

def evaluate_split(model, df: DataFrame, label: str, threshold: float, path: str | None = None, name: str = "test") -> DataFrame:
    """Score a split once, optionally write its predictions, and return its metrics row."""
    scored = score(model, df, ["scenario", F.col(label).alias("y_true")], threshold)
    if path:
        prediction_columns(scored).write.mode("overwrite").parquet(path)
        scored = df.sparkSession.read.parquet(path).withColumnRenamed("label_binary", "y_true")
    return metrics_fixed(confusion(scored)).withColumn("split", F.lit(name))


def baseline(train: DataFrame, evals: dict[str, DataFrame], fit: Callable[[DataFrame], PipelineModel], label: str, threshold: float = 0.5, folder: str | None = None) -> DataFrame:
    """Fit on train, one metrics row per evaluation split."""
    model = fit(train)
    return union_all(*[evaluate_split(model, df, label, threshold, f"{folder}/{name}" if folder else None, name) for name, df in evals.items()])


def cross_domain(pairs: dict[str, tuple[DataFrame, DataFrame]], fit: Callable[[DataFrame], PipelineModel], label: str) -> DataFrame:
    """Fit on each direction's source, score its target."""
    rows = []
    for direction, (source, target) in pairs.items():
        scored = score(fit(source), target, [F.col(label).alias("y_true")])
        rows.append(metrics_present(confusion(scored)).withColumn("direction", F.lit(direction)))
    return union_all(*rows)


def run_folds(df: DataFrame, folds: list[str], fit: Callable[[DataFrame], PipelineModel], label: str, kind: str = "scenario", benign: str | None = None) -> DataFrame:
    """Pooled predictions of leave-one-out folds: by group, or by attack type when ``benign`` names the shared class."""
    parts = []
    for held_out in folds:
        train, test = loso_split(df, held_out, kind) if benign is None else loao_split(df, held_out, kind, benign)
        parts.append(score(fit(train), test, [F.lit(held_out).alias("fold"), F.col(label).alias("y_true")]))
    return union_all(*parts)


def fold_metrics(predictions: DataFrame) -> DataFrame:
    return metrics_present(confusion(predictions, ["fold"]))


def early_detection(train: DataFrame, evals: dict[str, DataFrame], fit: Callable[[DataFrame], PipelineModel], label: str, fractions: list[float], by: list[str], order: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """Fit, score and fix each split once, count its prefixes once, and read both tables from those counts: (metrics, latency)."""
    model = fit(train)
    curves, delays = [], []
    for name, df in evals.items():
        scored = cut_lineage(score(model, df, [*by, *order, F.col(label).alias("y_true")]))
        groups = by or [WHOLE]
        cells = prefix_cells(scored if by else whole(scored), sorted({*fractions, 1.0}), groups, order, cell_counts())
        wanted = cells.where(F.col("fraction").isin(*map(float, fractions)))
        curves.append(metrics_of_cells(wanted, groups).withColumn("split", F.lit(name)))
        if by:
            delays.append(latency_of_cells(cells, groups).where(F.col("fraction").isin(*map(float, fractions))).withColumn("split", F.lit(name)))
    return union_all(*curves), union_all(*delays) if delays else None


def tune(df: DataFrame, grid: list[dict], fit: Callable[..., PipelineModel], label: str, group: str, thresholds: list[float], fraction: float = 0.2, seed: int = 42) -> DataFrame:
    """Settings ordered by macro F1, attack F1 and accuracy at each one's best threshold on an inner group split."""
    roles = group_split(df, group, fraction, seed)
    train, val = roles.where("role = 'train'").drop("role"), roles.where("role = 'val'").drop("role")
    rows = []
    for i, params in enumerate(grid):
        scored = score(fit(train, **params), val, [F.col(label).alias("y_true")])
        best = best_threshold(threshold_sweep(scored, thresholds), rule="macro")
        rows.append(best.select(F.lit(i).alias("setting"), F.lit(str(params)).alias("params"), "threshold", "f1_macro", "f1_attack", "accuracy"))
    return union_all(*rows).orderBy(F.desc("f1_macro"), F.desc("f1_attack"), F.desc("accuracy"), "setting")


# Boosting that can be continued on another table

@dataclass(frozen=True)
class Booster:
    """Regression trees whose scaled sum is the log-odds margin."""

    trees: tuple
    rate: float

    def margin(self, df: DataFrame) -> DataFrame:
        out = df.withColumn("margin", F.lit(0.0))
        for tree in self.trees:
            out = add_tree(out, tree, self.rate)
        return out

    def score(self, df: DataFrame, keep: list[str]) -> DataFrame:
        return self.margin(df).select(*keep, sigmoid(F.col("margin")).alias("y_score"))

    def importances(self, df: DataFrame, names: list[str]) -> DataFrame:
        total = reduce(lambda a, b: a + b, [t.featureImportances.toArray() for t in self.trees])
        share = total / max(total.sum(), 1e-12)
        return values(df.sparkSession, [(n, float(v)) for n, v in zip(names, share)], "feature string, importance double")


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def add_tree(df: DataFrame, tree, rate: float) -> DataFrame:
    return tree.transform(df).withColumn("margin", F.col("margin") + rate * F.col("prediction")).drop("prediction")


def boost(df: DataFrame, label: str, rounds: int, start: Booster | None = None, rate: float = 0.1, depth: int = 4, subsample: float = 0.9, seed: int = 42, cut_every: int = 5) -> Booster:
    """Newton boosting of the logistic loss, continued from ``start`` when one is given.

    Each round fits one tree to (y-p)/h with weight h = p(1-p), which makes a
    leaf's value the Newton step.  Margins are checkpointed every few rounds in
    the shared folder: the plan stays short and survives lost executors.
    """
    trees = list(start.trees) if start else []
    rate = start.rate if start else rate
    rows = (start.margin(df) if start else df.withColumn("margin", F.lit(0.0))).select("features", F.col(label).cast("double").alias("y"), "margin")
    rows = cut_lineage(rows)
    p = sigmoid(F.col("margin"))
    for i in range(rounds):
        h = F.greatest(p * (1.0 - p), F.lit(1e-6))
        target = rows.withColumns({"h": h, "z": (F.col("y") - p) / h})
        tree = RandomForestRegressor(
            labelCol="z", featuresCol="features", weightCol="h", numTrees=1, maxDepth=depth, bootstrap=False, subsamplingRate=subsample, featureSubsetStrategy=str(subsample), seed=seed + i
        ).fit(target)
        trees.append(tree)
        rows = add_tree(rows, tree, rate)
        if (i + 1) % cut_every == 0 and i + 1 < rounds:
            rows = cut_lineage(rows)
    return Booster(tuple(trees), rate)


def choose_threshold(booster: Booster, calibration: DataFrame, label: str, thresholds: list[float]) -> tuple[float, str]:
    """Best threshold on the calibration rows, 0.5 without any."""
    if calibration.isEmpty():
        return 0.5, "default_no_calibration"
    sweep = threshold_sweep(booster.score(calibration, [F.col(label).alias("y_true")]), thresholds)
    return best_threshold(sweep, rule="recipe").first()["threshold"], "calibration_split"


def _transfer_row(booster: Booster, test: DataFrame, label: str, threshold: float, info: dict) -> DataFrame:
    scored = booster.score(test, [F.col(label).alias("y_true")]).withColumn("y_pred", (F.col("y_score") >= threshold).cast("int"))
    row = metrics_present(scored.agg(*cell_counts()))
    return row.withColumns({k: F.lit(v).cast("double") if k == "target_fraction" else F.lit(v) for k, v in (info | {"selected_threshold": threshold}).items()})


def transfer_grid(
    source: DataFrame, target_train: DataFrame, target_test: DataFrame, num: list[str], cat: list[str], label: str, key: str, fractions: list[float],
    pretrain: int = 200, adapt: int = 100, alone: int = 200, calibration: float = 0.2, balance_ratio: float | None = 1.0, thresholds: list[float] = RECIPE_THRESHOLDS,
    rate: float = 0.1, depth: int = 6, seed: int = 42,
) -> DataFrame:
    """source_only, and per target fraction target_only and adapted (source booster continued on target rows)."""
    coder = fit_ordinal(source, num, cat)
    pretrained = boost(coder.transform(source), label, pretrain, rate=rate, depth=depth, seed=seed)
    rows = [_transfer_row(pretrained, coder.transform(target_test), label, 0.5, {"condition": "source_only", "target_fraction": None, "threshold_selection_mode": "default"})]
    for fraction in fractions:
        part = stratified_sample(target_train, [label], fraction, key, seed)
        if balance_ratio is not None:
            part = balance(part, label, key, seed, balance_ratio)
        roles = holdout(part, calibration, label, key, seed)
        fit_part, calib = roles.where("role = 'fit'"), roles.where("role = 'holdout'")
        own = fit_ordinal(fit_part, num, cat)
        setups = {
            "target_only_updated": (own, boost(own.transform(fit_part), label, alone, rate=rate, depth=depth, seed=seed)),
            "transfer_learning_updated": (coder, boost(coder.transform(fit_part), label, adapt, start=pretrained, depth=depth, seed=seed + 1000)),
        }
        for condition, (code, booster) in setups.items():
            threshold, mode = choose_threshold(booster, code.transform(calib), label, thresholds)
            rows.append(_transfer_row(booster, code.transform(target_test), label, threshold, {"condition": condition, "target_fraction": fraction, "threshold_selection_mode": mode}))
    return union_all(*rows)


def pairwise(pairs: DataFrame, pools: Callable[[dict], tuple[DataFrame, DataFrame, DataFrame]], seeds: list[int], **grid) -> DataFrame:
    """The transfer grid of every valid pair and seed beside the skipped pairs; ``pools`` gives a pair's three tables."""
    todo = settle(pairs)
    parts = [todo.where("skip_reason is not null").select("pair_id", "condition", "skip_reason")]
    for pair in todo.where("skip_reason is null").toLocalIterator():
        for seed in seeds:
            source, train, test = pools(pair.asDict())
            run = transfer_grid(source, train, test, seed=seed, **grid)
            parts.append(run.withColumns({"pair_id": F.lit(pair["pair_id"]), "seed": F.lit(seed)}))
    return union_all(*parts)
