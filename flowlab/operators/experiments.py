"""Published experiments as Spark jobs over the ensembles.

Features are encoded once and every evaluation scores all rows of its split in one pass.
Baselines, domains, folds, early curves and transfer conditions fit on every row of their
training tables (``wholefits``); ``fit_one`` and ``tune_grid`` read bounded samples.  A grid, a set of
folds or a table of transfer conditions is one job of many fits, not a loop of fits.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlab.operators.ensembles import FIT_ROWS, SCORE_ROWS, Boost, Ensemble, Forest, fit_all, pack_samples, score_all, score_one, spread
from flowlab.operators.metrics import best_threshold, cell_counts, confusion, metrics_fixed, metrics_present, threshold_sweep
from flowlab.operators.models import RECIPE_THRESHOLDS, fit_ordinal, onehot_stages
from flowlab.operators.order import WHOLE, whole
from flowlab.operators.prefix import latency_of_cells, metrics_of_cells, prefix_cells
from flowlab.operators.sampling import balance, cap_stratified, group_split, holdout, stratified_sample
from flowlab.operators.wholefits import Bins, Fit, code_rows, code_table, edges_of, fit_models, fit_scores, scored_rows
from flowlab.session import settle, values
from flowlab.sources.tables import prediction_columns, union_all


# Encoding and fitting

def onehot_encoder(train: DataFrame, num: list[str], cat: list[str]) -> PipelineModel:
    return Pipeline(stages=onehot_stages(num, cat)).fit(train)


def encoded(encoder, df: DataFrame) -> DataFrame:
    """Adds ``features`` as a plain array; any earlier column of that name goes."""
    v = encoder.transform(df.drop("features"))
    return v.withColumn("features", vector_to_array("features"))


def slot_names(encoder, df: DataFrame) -> list[str]:
    """Names of the slots of ``features``, in order."""
    attrs = encoder.transform(df.drop("features").limit(1)).schema["features"].metadata.get("ml_attr", {}).get("attrs", {})
    return [a["name"] for a in sorted((a for group in attrs.values() for a in group), key=lambda a: a["idx"])]


def fit_sample(df: DataFrame, label: str, key: str, n: int = FIT_ROWS, seed: int = 42) -> DataFrame:
    """At most ``n`` rows, both classes in proportion: what one fit reads."""
    return cap_stratified(df, n, label, key, seed)


def fit_one(rows: DataFrame, label: str, key: str, spec: Forest | Boost, n: int = FIT_ROWS) -> Ensemble:
    """A model on a bounded sample of rows with ``features``."""
    sample = fit_sample(rows.select("features", label, key), label, key, n, spec.seed)
    return fit_all(pack_samples(sample.withColumn("data", F.lit("all")), "data", "features", label), {"model": ("all", spec)})["model"]


def side_by_side(work: Callable, items: list, workers: int = 5) -> None:
    """Submits the small jobs of several items at a time; the first error is raised."""
    with ThreadPoolExecutor(workers) as pool:
        for run in [pool.submit(work, x) for x in items]:
            run.result()


# Evaluation

def evaluate(model: Ensemble, df: DataFrame, label: str, threshold: float = 0.5, path: str | None = None, name: str = "test") -> DataFrame:
    """Scores a split once, optionally writes its predictions and reads them back, and returns its metrics row."""
    return judged(score_one(model, df, ["scenario", F.col(label).alias("y_true")] if path else [F.col(label).alias("y_true")], threshold), path, name)


def judged(scored: DataFrame, path: str | None = None, name: str = "test") -> DataFrame:
    """The metrics row of a scored split, from its written predictions where a path is given."""
    if path:
        prediction_columns(scored).write.mode("overwrite").parquet(path)
        scored = scored.sparkSession.read.parquet(path).withColumnRenamed("label_binary", "y_true")
    return metrics_fixed(confusion(scored)).withColumn("split", F.lit(name))


def fit_and_score(train: DataFrame, tests: DataFrame, label: str, spec: Forest | Boost, keep: list, threshold: float = 0.5) -> DataFrame:
    """A model on all rows of ``train``; every row of ``tests`` scored beside the kept columns.  Both have ``features``."""
    table = code_table(train, label)
    tested = code_rows(tests, label, table.bins, keep, ordered=False)
    return scored_rows(settle(fit_scores(table, tested, {"model": Fit(spec)})), tested, threshold)


def baseline_run(train: DataFrame, evals: dict[str, DataFrame], num: list[str], cat: list[str], label: str, key: str, spec: Forest | Boost, threshold: float = 0.5, folder: str | None = None) -> DataFrame:
    """Fit on all rows of train, one metrics row per evaluation split; ``key`` is not read."""
    columns = [*num, *cat, label, *(["scenario"] if folder else [])]
    train = settle(train.select(*num, *cat, label))
    encoder = onehot_encoder(train, num, cat)
    tests = spread(settle(union_all(*[df.select(*columns, F.lit(name).alias("split")) for name, df in evals.items()])))
    keep = ["split", *(["scenario"] if folder else []), F.col(label).alias("y_true")]
    scored = settle(fit_and_score(encoded(encoder, train), encoded(encoder, tests), label, spec, keep, threshold))
    return union_all(*[judged(scored.where(F.col("split") == name).drop("split"), f"{folder}/{name}" if folder else None, name) for name in evals])


def cross_domain_run(pairs: dict[str, tuple[DataFrame, DataFrame]], num: list[str], cat: list[str], label: str, key: str, spec: Forest | Boost) -> DataFrame:
    """Fit on all rows of each direction's source, score its target; the fits of all directions run side by side.  ``key`` is not read."""
    tables = {id(side): settle(side.select(*num, *cat, label)) for pair in pairs.values() for side in pair}
    tested, scores = {}, []
    for direction, (source, target) in pairs.items():
        source, target = tables[id(source)], tables[id(target)]
        coder = fit_ordinal(source, num, cat)
        table = code_table(encoded(coder, source), label)
        tested[direction] = code_rows(encoded(coder, spread(target)), label, table.bins, [F.col(label).alias("y_true")], ordered=False)
        scores.append(fit_scores(table, tested[direction], {direction: Fit(spec)}))
    scores = settle(union_all(*scores))
    return union_all(*[metrics_present(confusion(scored_rows(scores.where(F.col("name") == d), tested[d]))).withColumn("direction", F.lit(d)) for d in pairs])


def importance_table(model: Ensemble, names: list[str], df: DataFrame) -> DataFrame:
    """(place, feature, importance), largest first, ties by name."""
    found = sorted(zip(names, model.importances().tolist()), key=lambda r: (-r[1], r[0]))
    return values(df.sparkSession, [(k + 1, n, v) for k, (n, v) in enumerate(found)], "place int, feature string, importance double")


def early_run(train: DataFrame, evals: dict[str, DataFrame], num: list[str], cat: list[str], label: str, key: str, spec: Forest | Boost, fractions: list[float], by: list[str], order: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """Fit on all rows of train, score and fix each split once, count its prefixes once, and read both tables from those counts: (metrics, latency).

    ``key`` is not read.
    """
    train = settle(train.select(*num, *cat, label))
    encoder = onehot_encoder(train, num, cat)
    columns = [*dict.fromkeys([*num, *cat, label, *by, *order])]
    tests = spread(settle(union_all(*[df.select(*columns, F.lit(name).alias("_split")) for name, df in evals.items()])))
    every = settle(fit_and_score(encoded(encoder, train), encoded(encoder, tests), label, spec, [*by, *order, "_split", F.col(label).alias("y_true")]))
    curves, delays = [], []
    wanted = F.col("fraction").isin(*map(float, fractions))
    for name in evals:
        scored = every.where(F.col("_split") == name).drop("_split")
        groups = by or [WHOLE]
        cells = settle(prefix_cells(scored if by else whole(scored), sorted({*fractions, 1.0}), groups, order, cell_counts()))
        curves.append(metrics_of_cells(cells.where(wanted), groups).withColumn("split", F.lit(name)))
        if by:
            delays.append(latency_of_cells(cells, groups).where(wanted).withColumn("split", F.lit(name)))
    return union_all(*curves), union_all(*delays) if delays else None


# Grids and folds

def tune_grid(df: DataFrame, grid: dict[str, Boost], num: list[str], cat: list[str], label: str, key: str, group: str, thresholds: list[float], fraction: float = 0.2, seed: int = 42, n: int = FIT_ROWS) -> DataFrame:
    """Settings ordered by macro F1, attack F1 and accuracy at each one's best threshold on an inner group split.

    All settings read one packed sample and run side by side; the validation side is scored once.
    """
    roles = settle(group_split(df, group, fraction, seed))
    train, val = roles.where("role = 'train'").drop("role"), roles.where("role = 'val'").drop("role")
    encoder = onehot_encoder(train, num, cat)
    sample = encoded(encoder, fit_sample(train, label, key, n, seed)).withColumn("data", F.lit("all"))
    models = fit_all(pack_samples(sample, "data", "features", label), {name: ("all", spec) for name, spec in grid.items()})
    scored = settle(score_all(models, encoded(encoder, val), [F.col(label).alias("y_true")]))
    rows = []
    for i, (name, spec) in enumerate(grid.items()):
        best = best_threshold(threshold_sweep(scored.select("y_true", F.col("scores")[i].alias("y_score")), thresholds), rule="macro")
        rows.append(best.select(F.lit(i).alias("setting"), F.lit(name).alias("name"), F.lit(spec.rounds).alias("rounds"), "threshold", "f1_macro", "f1_attack", "accuracy", F.lit(val.count()).alias("n_val")))
    return union_all(*rows).orderBy(F.desc("f1_macro"), F.desc("f1_attack"), F.desc("accuracy"), "setting")


def fold_run(df: DataFrame, num: list[str], cat: list[str], label: str, key: str, kind: str, spec: Forest | Boost, benign: str | None = None) -> DataFrame:
    """Pooled predictions (fold, y_true, y_score, y_pred) of leave-one-out folds by ``kind``, each fitted on all rows that it does not hold out.

    The table is read for its encoding and for its codes, not once per fold: bin edges are
    those of a fold's own training rows, and the task that grows a fold's trees scores its
    held-out rows.  With ``benign`` the folds leave out one attack type each, and benign
    rows, which every fold tests, are scored by all models; rows of no kind are left out.  A category
    that only held-out rows have is a column of zeros in training and is never split on.  ``key`` is not read.
    """
    df = df if benign is None else df.where(F.col(kind).isNotNull())
    df = settle(df.select(*dict.fromkeys([*num, *cat, label, kind])))
    encoder = onehot_encoder(df, num, cat)
    names = [r[0] for r in settle(df.select(kind).distinct()).where(F.col(kind) != F.lit(benign) if benign else F.lit(True)).orderBy(kind).toLocalIterator()]
    place = F.coalesce(*[F.when(F.col(kind).eqNullSafe(F.lit(name)), k) for k, name in enumerate(names)], F.lit(len(names)))
    rows = encoded(encoder, df).withColumn("fold", place)
    edges = edges_of(rows.where(F.col(label).isin(0, 1)).select("features", "fold"), [*range(len(names))])
    table = code_rows(rows, label, Bins(edges), [F.col(label).alias("y_true")], F.col("fold"))
    shared = None if benign is None else len(names)
    scores = settle(fit_scores(table, None, {str(k): Fit(spec, k) for k in range(len(names))}, shared))
    number, fold = F.col("name").cast("int"), F.coalesce(*[F.when(F.col("name") == str(k), F.lit(name)) for k, name in enumerate(names)], F.lit(None).cast(df.schema[kind].dataType))
    tested = F.filter("rows", lambda r: (r["_fold"] == number) | (r["_fold"] == F.lit(shared)) if benign else r["_fold"] == number)
    zipped = scores.join(table.chunks.select("part", "rows"), "part").select("part", fold.alias("fold"), F.posexplode(F.arrays_zip(tested.alias("rows"), F.col("scores").alias("scores"))).alias("pos", "z"))
    out = settle(zipped.select("fold", "part", "pos", F.col("z.rows.y_true").alias("y_true"), F.col("z.scores").alias("y_score")))
    parts = max(3 * df.sparkSession.sparkContext.defaultParallelism, -(-out.count() // SCORE_ROWS))
    dealt = out.repartitionByRange(parts, "fold", F.xxhash64("part", "pos")).sortWithinPartitions("fold")
    return dealt.select("fold", "y_true", "y_score", (F.col("y_score") >= 0.5).cast("int").alias("y_pred"))


# Transfer conditions

SOURCE_ONLY, ALONE, ADAPTED = "source_only", "target_only_updated", "transfer_learning_updated"


def transfer_run(
    source: DataFrame, target_train: DataFrame, target_test: DataFrame, num: list[str], cat: list[str], label: str, key: str, fractions: list[float],
    pretrain: int = 200, adapt: int = 100, alone: int = 200, calibration: float = 0.2, balance_ratio: float | None = 1.0, thresholds: list[float] = RECIPE_THRESHOLDS,
    spec: Boost = Boost(), seed: int = 42,
) -> DataFrame:
    """source_only, and per target fraction target_only and adapted (source model continued on target rows).

    Every fit reads all rows of the source, or of the fraction's draw less its calibration rows.

    Draw, balance and holdout of a fraction are fixed once, the fractions side by side.  The
    source model and all target_only models fit in one job, all adapted models in a second
    one, and the test table is scored once by all models that share a coder.
    """
    spec = replace(spec, seed=seed)
    columns = [*num, *cat, label, key]
    source, target_train, target_test = (settle(t.select(*columns)) for t in (source, target_train, target_test))
    coders = {SOURCE_ONLY: fit_ordinal(source, num, cat)}
    parts: dict[float, DataFrame] = {}
    held: dict[float, DataFrame] = {}

    def prepare(f: float) -> None:
        part = settle(stratified_sample(target_train, [label], f, key, seed))
        part = part if balance_ratio is None else settle(balance(part, label, key, seed, balance_ratio))
        roles = settle(holdout(part, calibration, label, key, seed))
        parts[f], held[f] = roles.where("role = 'fit'"), roles.where("role = 'holdout'")
        coders[f] = fit_ordinal(parts[f], num, cat)

    side_by_side(prepare, fractions)
    fits = {SOURCE_ONLY: (code_table(encoded(coders[SOURCE_ONLY], source), label), replace(spec, rounds=pretrain))}
    fits |= {f"{ALONE}:{f}": (code_table(encoded(coders[f], parts[f]), label), replace(spec, rounds=alone)) for f in fractions}
    models = fit_models(fits)
    start = models[SOURCE_ONLY]
    second = {f"{ADAPTED}:{f}": (code_table(encoded(coders[SOURCE_ONLY], parts[f]), label, start.edges), replace(spec, rounds=adapt, seed=seed + 1000)) for f in fractions}
    models |= fit_models(second, {name: start for name in second})

    def counted(df: DataFrame, coder, names: list[str], cuts: dict[str, list[float]]) -> DataFrame:
        """Confusion cells per model and threshold, from one scoring pass."""
        scored = score_all({m: models[m] for m in names}, encoded(coder, spread(df)), [F.col(label).alias("y_true")])
        asked = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(float(t)).alias("threshold"), F.col("scores")[i].alias("y_score")) for i, m in enumerate(names) for t in cuts[m]])
        flat = scored.select("y_true", F.explode(asked).alias("z")).select("z.model", "z.threshold", "y_true", (F.col("z.y_score") >= F.col("z.threshold")).cast("int").alias("y_pred"))
        return settle(flat.groupBy("model", "threshold").agg(*cell_counts()))

    chosen: dict[str, tuple[float, str]] = {SOURCE_ONLY: (0.5, "default")}
    cells: list[DataFrame] = []

    def finish(f: float) -> None:
        names = [f"{ALONE}:{f}", f"{ADAPTED}:{f}"]
        sweeps = [counted(held[f], coder, [name], {name: thresholds}) for coder, name in zip((coders[f], coders[SOURCE_ONLY]), names)]
        best = {r["model"]: r["threshold"] for r in best_threshold(metrics_fixed(union_all(*sweeps)), ["model"], rule="recipe").toLocalIterator()}
        for name in names:
            chosen[name] = (best[name], "calibration_split") if name in best else (0.5, "default_no_calibration")
        cells.append(counted(target_test, coders[f], names[:1], {names[0]: [chosen[names[0]][0]]}))

    side_by_side(finish, fractions)
    shared = [SOURCE_ONLY, *second]
    cells.append(counted(target_test, coders[SOURCE_ONLY], shared, {m: [chosen[m][0]] for m in shared}))
    cells = union_all(*cells)
    info = values(source.sparkSession, [(m, m.split(":")[0], float(m.split(":")[1]) if ":" in m else None, t, mode) for m, (t, mode) in chosen.items()], "model string, condition string, target_fraction double, selected_threshold double, threshold_selection_mode string")
    return metrics_present(cells.drop("threshold")).join(info, "model").drop("model")



def pair_run(
    pairs: DataFrame, pools: Callable[[dict], tuple[DataFrame, DataFrame, DataFrame]], seeds: list[int], table: str, workers: int = 4, **grid,
) -> DataFrame:
    """The transfer conditions of every valid pair and seed, beside the skipped pairs; a run that was stopped is continued.

    ``pairs`` is (pair_id, condition, skip_reason) and ``pools`` gives a pair's source, target-train
    and target-test tables.  Each pair and seed writes its rows to a folder of ``table`` of
    its own; what is there already is not fitted again.  ``workers`` pairs run at a time,
    so that the small jobs of one fill the gaps of another.
    """
    spark = pairs.sparkSession
    todo = settle(pairs.withColumn("seed", F.explode(F.array(*map(F.lit, seeds)))))
    valid = todo.where("skip_reason is null")

    def finished() -> DataFrame | None:
        try:
            return spark.read.option("basePath", table).parquet(f"{table}/*/*/")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return None

    done = finished()
    if done is not None:
        valid = valid.join(done.select(F.col("pair_id").cast("string").alias("pair_id"), F.col("seed").cast("int").alias("seed")).distinct(), ["pair_id", "seed"], "left_anti")

    def one(pair: dict) -> None:
        source, train, test = pools(pair)
        transfer_run(source, train, test, seed=pair["seed"], **grid).write.mode("overwrite").parquet(f"{table}/pair_id={pair['pair_id']}/seed={pair['seed']}")

    side_by_side(one, [r.asDict() for r in valid.orderBy("pair_id", "seed").toLocalIterator()], workers)
    skipped = todo.where("skip_reason is not null").select("pair_id", "seed", "condition", "skip_reason")
    done = finished()
    if done is None:
        return skipped
    fitted = done.withColumn("pair_id", F.col("pair_id").cast("string")).join(todo.select("pair_id", "seed"), ["pair_id", "seed"], "left_semi")
    return fitted.unionByName(skipped, allowMissingColumns=True)
