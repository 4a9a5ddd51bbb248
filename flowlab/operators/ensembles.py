"""Forests and boosted trees fitted as many small Spark tasks.

Fits here use a bounded sample of labelled rows (``FIT_ROWS``, a parameter as the published
caps are), those on whole tables are in ``wholefits``; scoring covers every row.  A sample's features are quantised once and kept as one
byte each, so a fit's data is a few megabytes and travels as one packed row to the
tasks that need it: forests grow in batches of trees, boosted models one per task,
all fits of a grid, of a set of folds or of a table of conditions side by side in one
job.  The number of jobs depends neither on trees, rounds, settings nor folds.

One split rule serves both: with targets g and weights h a split gains
GL^2/(HL+l) + GR^2/(HR+l) - G^2/(H+l).  For g = w*y and h = w this is the Gini gain and a
leaf holds the share of attacks; for the gradient and curvature of the logistic loss it
is the Newton gain and a leaf holds the step.  Trees are tables of nodes, walked for a
batch of rows at a time, level by level.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from flowlab.session import settle, values

#: Labelled rows that one fit reads at most.
FIT_ROWS = 20_000
BINS = 64
#: Trees of a forest that one task grows, and histogram cells that it holds at a time.
TREE_BATCH, CELLS = 10, 4_000_000
#: Rows that one task scores.
SCORE_ROWS = 100_000
#: Histograms are kept whole while nodes have BINS * SPARSE rows or more on average.
SPARSE = 1.0


@dataclass(frozen=True)
class Forest:
    """Bagged trees of any depth, each node split on the best of sqrt(width) features, classes weighted n/(2*n_c)."""

    trees: int = 300
    depth: int | None = None
    seed: int = 42


@dataclass(frozen=True)
class Boost:
    """Newton boosting of the logistic loss; attack rows weigh n_neg/n_pos where ``imbalance`` is set."""

    rounds: int = 200
    depth: int = 6
    rate: float = 0.1
    subsample: float = 0.9
    columns: float = 0.9
    min_child: float = 1.0
    reg_lambda: float = 1.0
    imbalance: bool = False
    seed: int = 42


@dataclass(frozen=True)
class Tree:
    """Nodes as arrays: a row whose ``feature`` has a code above ``cut`` goes to ``left + 1``, else to ``left``; -1 is a leaf."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    def packed(self) -> np.ndarray:
        """One number per node: the left child, the feature and the cut; a leaf leads to itself by a cut that no code is above."""
        inner = self.left >= 0
        left, feature = np.where(inner, self.left, np.arange(len(inner))).astype(np.int64), np.where(inner, self.feature, 0).astype(np.int64)
        return left << 24 | feature << 8 | np.where(inner, self.cut, LEAF)

    def walk(self, codes: np.ndarray) -> np.ndarray:
        return walked(self.packed(), self.value, codes)


#: The cut of a leaf, and the levels that rows go down before those that have arrived are set aside.
LEAF, FIRST_LEVELS, LEVELS = 255, 6, 4


def walked(nodes: np.ndarray, value: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The value of the leaf that each row of ``codes`` reaches in a tree of ``Tree.packed`` nodes."""
    flat, base, rows = codes.ravel(), np.arange(len(codes)) * codes.shape[1], np.arange(len(codes))
    at, out, levels = np.full(len(codes), nodes[0]), np.zeros(len(codes), np.int64), FIRST_LEVELS
    while len(rows):
        for _ in range(levels):
            spot = at >> 8
            spot &= 0xFFFF
            spot += base
            above = flat.take(spot) > (at & 255)
            at >>= 24
            at += above
            at = nodes.take(at)
        out[rows] = at >> 24
        live = np.flatnonzero((at & 255) != LEAF)
        rows, at, base, levels = rows[live], at[live], base[live], LEVELS
    return value.take(out)


@dataclass(frozen=True)
class Ensemble:
    """A fitted model: bin edges per feature, and trees whose values are averaged (forest) or summed (margin)."""

    kind: str
    edges: list[np.ndarray]
    trees: list[Tree] = field(repr=False)

    def codes(self, rows: np.ndarray) -> np.ndarray:
        return quantised(rows, self.edges)

    def margin(self, codes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(codes))
        for tree in self.trees:
            out += tree.walk(codes)
        return out

    def predict(self, rows: np.ndarray) -> np.ndarray:
        return Scorer(self.squeezed()).predict(rows)

    def squeezed(self) -> bytes:
        """What scoring needs, compressed: a model travels and waits as a few megabytes."""
        trees = [(np.packbits(t.left >= 0), len(t.left), t.left[t.left >= 0], t.feature[t.left >= 0], t.cut[t.left >= 0], t.value[t.left < 0]) for t in self.trees]
        return pa.Codec("zstd").compress(data := pickle.dumps((self.kind, self.edges, trees), 5), asbytes=True) + len(data).to_bytes(8, "little")

    def importances(self) -> np.ndarray:
        """Share of the gain that each feature brought; zeros where nothing was split."""
        out = np.zeros(len(self.edges))
        for t in self.trees:
            inner = t.left >= 0
            out += np.bincount(t.feature[inner], t.gain[inner], len(out)) / (t.gain[inner].sum() or 1.0)
        return out / (out.sum() or 1.0)


class Scorer:
    """A model of ``Ensemble.squeezed``, laid out for walks: 16 bytes a node."""

    def __init__(self, data: bytes):
        self.kind, self.edges, trees = pickle.loads(pa.decompress(data[:-8], int.from_bytes(data[-8:], "little"), "zstd"))
        self.trees = []
        for bits, n, left, feature, cut, leaves in trees:
            inner = np.unpackbits(bits, count=n).astype(bool)
            nodes, value = np.arange(n) << 24 | LEAF, np.zeros(n)
            nodes[inner] = left.astype(np.int64) << 24 | feature.astype(np.int64) << 8 | cut
            value[~inner] = leaves
            self.trees.append((nodes, value))

    def predict(self, rows: np.ndarray) -> np.ndarray:
        codes, total = quantised(rows, self.edges), np.zeros(len(rows))
        for nodes, value in self.trees:
            total += walked(nodes, value, codes)
        return total / max(1, len(self.trees)) if self.kind == "forest" else 1.0 / (1.0 + np.exp(-total))


class Scorers:
    """Squeezed models by name; a task lays out those that it meets, and keeps the last ``held`` of them."""

    def __init__(self, models: dict[str, Ensemble], held: int | None = None):
        self.data, self.held, self.ready = {name: m.squeezed() for name, m in models.items()}, held, {}

    def __getitem__(self, name: str) -> Scorer:
        found = self.ready.pop(name, None)
        while self.held and len(self.ready) >= self.held:
            del self.ready[next(iter(self.ready))]
        self.ready[name] = found or Scorer(self.data[name])
        return self.ready[name]


def bin_edges(rows: np.ndarray, bins: int = BINS) -> list[np.ndarray]:
    """Per feature the cuts between its values: all of them, or ``bins - 1`` quantiles of a feature with more."""
    out = []
    for column in rows.T:
        seen = np.unique(column[np.isfinite(column)])
        if len(seen) > bins:
            seen = np.unique(np.quantile(column[np.isfinite(column)], np.linspace(0, 1, bins), method="lower"))
        out.append((seen[1:] + seen[:-1]) / 2)
    return out


def quantised(rows: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """One byte per feature: how many of its edges lie below the value; missing values come last."""
    out = np.zeros(rows.shape, np.uint8)
    for k, cuts in enumerate(edges):
        out[:, k] = np.searchsorted(cuts, rows[:, k])
    return out


def grow(codes: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int | None, choose, reg_lambda: float = 0.0, min_child: float = 0.0) -> Tree:
    """One tree, level by level; ``choose(n)`` gives the features that each of n nodes may split on, ``choose`` as an array those of all nodes."""
    shared = choose if isinstance(choose, np.ndarray) else None
    base = codes[:, shared].astype(np.int64) + BINS * np.arange(len(shared)) if shared is not None else None
    feature, cut, left, value, gain = ([np.zeros(1, t)] for t in (np.int16, np.uint8, np.int32, float, float))
    left[0][:] = -1
    value[0][0] = g.sum() / max(h.sum() + reg_lambda, 1e-12)
    rows, place, nodes, total, level = np.arange(len(codes)), np.zeros(len(codes), np.int64), np.zeros(1, np.int64), 1, 0
    while len(nodes) and (depth is None or level < depth):
        picks = choose(len(nodes)) if shared is None else np.broadcast_to(shared, (len(nodes), len(shared)))
        best = _best_splits(codes, g, h, rows, place, picks, base, reg_lambda, min_child)
        split = np.nonzero(best["gain"] > 1e-9)[0]
        if not len(split):
            break
        new = np.full(len(nodes), -1, np.int64)
        new[split] = total + 2 * np.arange(len(split))
        for parts, name in ((feature, "feature"), (cut, "cut"), (gain, "gain")):
            parts[-1][nodes[split] - (total - len(parts[-1]))] = best[name][split]
        left[-1][nodes[split] - (total - len(left[-1]))] = new[split]
        pairs = np.stack([best["low"][split], best["high"][split]], axis=1).ravel()
        for parts, fresh in ((feature, np.zeros(2 * len(split), np.int16)), (cut, np.zeros(2 * len(split), np.uint8)), (left, np.full(2 * len(split), -1, np.int32)), (value, pairs), (gain, np.zeros(2 * len(split)))):
            parts.append(fresh)
        keep = new[place] >= 0
        rows, place = rows[keep], place[keep]
        child = new[place] + (codes[rows, best["feature"][place]] > best["cut"][place])
        nodes, place, total, level = np.arange(total, total + 2 * len(split)), child - total, total + 2 * len(split), level + 1
    return Tree(*(np.concatenate(x) for x in (feature, cut, left, value, gain)))


def _best_splits(codes, g, h, rows, place, picks, base, reg_lambda, min_child) -> dict[str, np.ndarray]:
    """The best split of every node: histograms of g and h per node, feature and code, a bounded number of nodes at a time."""
    n, m = picks.shape
    out = {k: np.zeros(n, t) for k, t in (("feature", np.int64), ("cut", np.int64), ("gain", float), ("low", float), ("high", float))}
    order = np.argsort(place, kind="stable")
    step = max(1, CELLS // (m * BINS))
    bounds = np.searchsorted(place[order], np.arange(0, n + step, step))
    for k, first in enumerate(range(0, n, step)):
        own = order[bounds[k] : bounds[k + 1]]
        count = min(step, n - first)
        local, r = place[own] - first, rows[own]
        if base is None:
            key = ((local[:, None] * m + np.arange(m)) * BINS + codes[r[:, None], picks[place[own]]]).ravel()
        else:
            key = (base[r] + (local * (m * BINS))[:, None]).ravel()
        part = slice(first, first + count)
        if SPARSE * count * BINS > len(own):
            _sparse_splits(key, np.repeat(g[r], m), np.repeat(h[r], m), m, picks[part], reg_lambda, min_child, {k: v[part] for k, v in out.items()})
            continue
        sums = [np.bincount(key, np.repeat(x[r], m), count * m * BINS).reshape(count, m, BINS).cumsum(axis=2) for x in (g, h)]
        (gl, hl), (gt, ht) = (s[:, :, :-1] for s in sums), (s[:, :, -1:] for s in sums)
        gr, hr = gt - gl, ht - hl
        tiny = 1e-12 + reg_lambda
        gains = gl * gl / (hl + tiny) + gr * gr / (np.maximum(hr, 0.0) + tiny) - gt * gt / (ht + tiny)
        gains[(np.minimum(hl, hr) < max(min_child, 1e-9))] = -1.0
        at = gains.reshape(count, -1).argmax(axis=1)
        f, c, node = at // (BINS - 1), at % (BINS - 1), np.arange(count)
        out["feature"][part], out["cut"][part], out["gain"][part] = picks[part][node, f], c, gains[node, f, c]
        out["low"][part] = gl[node, f, c] / np.maximum(hl[node, f, c] + reg_lambda, 1e-12)
        out["high"][part] = gr[node, f, c] / np.maximum(hr[node, f, c] + reg_lambda, 1e-12)
    return out


def _sparse_splits(key, g, h, m, picks, reg_lambda, min_child, out) -> None:
    """The same for nodes of few rows: only codes that occur are looked at, in running sums over the sorted keys."""
    seen, inverse = np.unique(key, return_inverse=True)
    gs, hs = np.bincount(inverse, g), np.bincount(inverse, h)
    segment = seen // BINS
    starts = np.flatnonzero(np.diff(segment, prepend=-1))
    lengths = np.diff(np.append(starts, len(seen)))
    gt, ht = (np.repeat(np.add.reduceat(x, starts), lengths) for x in (gs, hs))
    gl, hl = (x.cumsum() - np.repeat(x.cumsum()[starts] - x[starts], lengths) for x in (gs, hs))
    gr, hr, tiny = gt - gl, ht - hl, 1e-12 + reg_lambda
    gains = gl * gl / (hl + tiny) + gr * gr / (np.maximum(hr, 0.0) + tiny) - gt * gt / (ht + tiny)
    gains[np.minimum(hl, hr) < max(min_child, 1e-9)] = -1.0
    gains[starts + lengths - 1] = -1.0  # nothing lies above a feature's last code
    node = segment // m
    begins = np.flatnonzero(np.diff(node, prepend=-1))
    top = np.repeat(np.maximum.reduceat(gains, begins), np.diff(np.append(begins, len(seen))))
    hits = np.flatnonzero(gains == top)
    at = hits[np.unique(node[hits], return_index=True)[1]]
    own = node[at]
    out["feature"][own], out["cut"][own], out["gain"][own] = picks[own, segment[at] % m], seen[at] % BINS, gains[at]
    out["low"][own] = gl[at] / np.maximum(hl[at] + reg_lambda, 1e-12)
    out["high"][own] = gr[at] / np.maximum(hr[at] + reg_lambda, 1e-12)


def forest_trees(codes: np.ndarray, y: np.ndarray, spec: Forest, numbers: range) -> list[Tree]:
    """The trees of a forest that carry these numbers; each has its own generator, so any task can grow it."""
    n, width = codes.shape
    attacks = max(1, int(y.sum()))
    weight = np.where(y == 1, n / (2.0 * attacks), n / (2.0 * max(1, n - int(y.sum()))))
    some = max(1, int(width**0.5))
    out = []
    for number in numbers:
        rng = np.random.default_rng((spec.seed, number))
        drawn = np.bincount(rng.integers(0, n, n), minlength=n)
        own = drawn > 0
        h = weight[own] * drawn[own]
        out.append(grow(codes[own], h * y[own], h, spec.depth, lambda k: rng.random((k, width)).argsort(axis=1)[:, :some]))
    return out


def boosted_trees(codes: np.ndarray, y: np.ndarray, spec: Boost, margin: np.ndarray | None = None) -> list[Tree]:
    """Rounds of boosting, from ``margin`` where a model is continued."""
    n, width = codes.shape
    margin = np.zeros(n) if margin is None else margin.copy()
    weight = np.where(y == 1, (n - y.sum()) / max(1, y.sum()), 1.0) if spec.imbalance else np.ones(n)
    some = max(1, round(spec.columns * width))
    out = []
    for number in range(spec.rounds):
        rng = np.random.default_rng((spec.seed, number))
        p = 1.0 / (1.0 + np.exp(-margin))
        own = rng.random(n) < spec.subsample if spec.subsample < 1 else np.ones(n, bool)
        columns = rng.permutation(width)[:some]
        tree = grow(codes[own], ((y - p) * weight)[own], np.maximum(p * (1 - p), 1e-6)[own] * weight[own], spec.depth, columns, spec.reg_lambda, spec.min_child)
        tree = Tree(tree.feature, tree.cut, tree.left, spec.rate * tree.value, tree.gain)
        out.append(tree)
        margin += tree.walk(codes)
    return out


# Fits as Spark jobs

def pack_samples(rows: DataFrame, data: str, features: str, label: str, edges: list[np.ndarray] | None = None) -> DataFrame:
    """One row per fit sample: (data, n, edges, codes, y), features quantised to bytes.

    ``rows`` holds at most ``FIT_ROWS`` rows per value of ``data``; the caller has drawn them.
    A model that is to be continued gives its ``edges``, else each sample has its own.
    """
    given = edges

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        x = np.array(part["features"].tolist(), float).reshape(len(part), -1)
        order = np.lexsort((part["y"].to_numpy(), *x.T))  # the sample's order must not depend on the shuffle
        x, y = x[order], part["y"].to_numpy(np.uint8)[order]
        edges = bin_edges(x) if given is None else given
        return pd.DataFrame([(part["data"].iloc[0], len(part), pickle.dumps(edges), quantised(x, edges).tobytes(), y.tobytes())], columns=["data", "n", "edges", "codes", "y"])

    picked = rows.select(F.col(data).cast("string").alias("data"), F.col(features).alias("features"), F.col(label).cast("int").alias("y"))
    return settle(picked.groupBy("data").applyInPandas(pack, "data string, n bigint, edges binary, codes binary, y binary"))


def fit_all(packed: DataFrame, fits: dict[str, tuple[str, Forest | Boost]], starts: dict[str, Ensemble] | None = None) -> dict[str, Ensemble]:
    """Fits every entry of ``fits`` (name: sample, settings) side by side; a missing sample gives a model without trees.

    ``starts`` continues a boosted model, whose trees come first; its sample is packed with the model's edges.
    """
    spark, starts = packed.sparkSession, starts or {}
    tasks = []
    for name, (sample, spec) in fits.items():
        trees = spec.trees if isinstance(spec, Forest) else 1
        size = TREE_BATCH if isinstance(spec, Forest) else 1
        tasks += [(name, sample, first, min(first + size, trees)) for first in range(0, trees, size)]
    table = values(spark, tasks, "name string, data string, first int, last int").join(packed, "data").repartition(max(1, len(tasks)), "name", "first")
    schema = pa.schema([("name", pa.string()), ("first", pa.int32()), ("model", pa.binary())])

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                spec, edges = fits[r["name"]][1], pickle.loads(r["edges"])
                codes, y = np.frombuffer(r["codes"], np.uint8).reshape(r["n"], -1), np.frombuffer(r["y"], np.uint8).astype(float)
                start = starts.get(r["name"])
                if isinstance(spec, Forest):
                    trees = forest_trees(codes, y, spec, range(r["first"], r["last"]))
                elif start is None:
                    trees = boosted_trees(codes, y, spec)
                else:
                    trees = boosted_trees(codes, y, spec, start.margin(codes))
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip([r["name"], r["first"], pickle.dumps((edges, trees))], schema)], schema=schema)

    grown = settle(table.mapInArrow(run, "name string, first int, model binary"))
    parts: dict[str, list[tuple]] = {}
    for r in grown.orderBy("name", "first").toLocalIterator():
        parts.setdefault(r["name"], []).append(pickle.loads(bytes(r["model"])))
    out = {}
    for name, (_, spec) in fits.items():
        found, start = parts.get(name, []), starts.get(name)
        edges = start.edges if start else found[0][0] if found else []
        out[name] = Ensemble("forest" if isinstance(spec, Forest) else "boosted", edges, [*(start.trees if start else []), *[t for _, trees in found for t in trees]])
    return out


def spread(df: DataFrame, by: str | None = None) -> DataFrame:
    """A settled table dealt to about SCORE_ROWS rows a task, at least three tasks a core, for work that costs far more than reading; with ``by``, rows of one value stand together."""
    parts = max(3 * df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // SCORE_ROWS))
    return df.repartition(parts) if by is None else df.repartitionByRange(parts, F.col(by), F.xxhash64(*df.columns)).sortWithinPartitions(by)


def score_all(models: dict[str, Ensemble], df: DataFrame, keep: list, features: str = "features", out: str = "scores") -> DataFrame:
    """Every row scored by every model in one pass: ``keep`` and an array of scores in the order of ``models``."""
    kept = df.select(*keep)
    schema = StructType([*kept.schema.fields, StructField(out, ArrayType(DoubleType()))])
    names, held = list(models), Scorers(models)
    return _scored(df, keep, features, schema, lambda x: [np.stack([held[n].predict(x) for n in names], axis=1).tolist() if len(x) else []], 0)


def score_one(model: Ensemble, df: DataFrame, keep: list, threshold: float = 0.5, features: str = "features") -> DataFrame:
    """Attack probability ``y_score`` and decision ``y_pred`` of every row beside the kept columns."""
    schema = StructType([*df.select(*keep).schema.fields, StructField("y_score", DoubleType())])
    held = Scorers({"model": model})
    scored = _scored(df, keep, features, schema, lambda x: [held["model"].predict(x)], 0)
    return scored.withColumn("y_pred", (F.col("y_score") >= threshold).cast("int"))


def score_by(models: dict[str, Ensemble], df: DataFrame, by: str, keep: list, threshold: float = 0.5, features: str = "features") -> DataFrame:
    """Every row scored by the model named in its column ``by``, as the rows of a fold are by that fold's model.

    A task lays out one model at a time: rows that stand together by name (``spread``) need each model once.
    """
    schema = StructType([*df.select(*keep).schema.fields, StructField("y_score", DoubleType())])
    held = Scorers(models, 1)

    def each(x, names):
        score = np.zeros(len(x))
        for name in np.unique(names):
            own = names == name
            score[own] = held[str(name)].predict(x[own])
        return [score]

    return _scored(df, [*keep], features, schema, each, 1, F.col(by).cast("string").alias("_by")).withColumn("y_pred", (F.col("y_score") >= threshold).cast("int"))


def _scored(df: DataFrame, keep: list, features: str, schema: StructType, score, extra: int, *more) -> DataFrame:
    arrow = to_arrow_schema(schema)

    def run(batches):
        for b in batches:
            if b.num_rows:
                lists = b.column(b.num_columns - 1)
                x = lists.flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                last = b.num_columns - 1 - extra
                given = [np.array(b.column(last).to_pylist())] if extra else []
                made = [pa.array(c, f.type) for c, f in zip(score(x, *given), list(arrow)[last:])]
                yield pa.RecordBatch.from_arrays([*[b.column(k).cast(arrow.field(k).type) for k in range(last)], *made], schema=arrow)

    return df.select(*keep, *more, F.col(features).alias("_features")).mapInArrow(run, schema)
