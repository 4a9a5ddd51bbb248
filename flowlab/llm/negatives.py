"""Hard negatives by exact search in a GNAT-style multiway hyperplane tree.

Vectors x get one more coordinate, sqrt(M - |x|^2) with M the largest squared length,
and an anchor a gets zero there.  Then |a - x|^2 = |a|^2 + M - 2 a.x, so a window of
scores is an annulus around the anchor.  A node holds split points; a row goes to the
nearest of them.  Each split point stores the range of its distances to every sibling
subtree, over all rows.  A child is left out when, for some split point, the range
does not meet the distances that the annulus allows (triangle inequality).  What is left
is compared row by row, in whole numbers.

The split points come from at most ``SAMPLE`` vectors, so the tree has a bounded size and
goes to every task; all rows are routed, and the ranges cover all of them.  Rows lie
in packs of at most ``PACK`` rows of one leaf; big leaves (a mass of copies, say) have
many packs, dealt by a salt.  Anchors travel to the packs, in blocks of ``BLOCK``: they
are a hundredth of the rows, and rows move once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlab.llm.common import smallest_hashes
from flowlab.session import lit_map, settle

#: Vectors from which split points are taken; most children of a node; rows per leaf to aim at.
SAMPLE, ARITY, LEAF_ROWS = 16_384, 16, 512
#: Rows of a pack, anchors of a block, packs of a leaf that share a salt.
PACK, BLOCK, PACKS_PER_SALT = 2048, 256, 8
#: Results that a task keeps before it hands them on.
KEPT = 200_000
EVERY, POSITIVES, NEGATIVES = 100, 5, 5
#: A missing vec_id: comes after all others.
NO_ID = (1 << 63) - 1
LOW, HIGH = -(1 << 62), 1 << 62


class Tree:
    """``nodes``: (split points, for each the child node, or -1 - leaf)."""

    def __init__(self, sample: np.ndarray, leaves: int, seed: int = 12):
        self.nodes: list[tuple[np.ndarray, list[int]]] = []
        self.leaves = 0
        rng = np.random.default_rng(seed)
        points = sample.astype(np.float64)
        self.width = points.shape[1]
        self.root = self._grow(points, np.arange(len(points)), leaves, rng)
        self.paths = [p for _, p in sorted(self._paths(self.root, []))]

    def _grow(self, points: np.ndarray, own: np.ndarray, leaves: int, rng) -> int:
        chosen = self._spread(points, own, min(ARITY, leaves), rng) if leaves > 1 and len(own) > 1 else []
        if len(chosen) < 2:
            self.leaves += 1
            return -self.leaves
        node = len(self.nodes)
        splits = points[chosen]
        self.nodes.append((splits, []))
        side = nearest(points[own], splits)
        self.nodes[node][1].extend([self._grow(points, own[side == c], round(leaves * (side == c).mean()), rng) for c in range(len(splits))])
        return node

    def _spread(self, points: np.ndarray, own: np.ndarray, count: int, rng) -> list[int]:
        """Split points far apart: of a few candidates, again and again the one farthest from those chosen."""
        few = own if len(own) <= 4 * count else rng.choice(own, 4 * count, replace=False)
        chosen = [few[0]]
        gap = ((points[few] - points[few[0]]) ** 2).sum(axis=1)
        while len(chosen) < count and gap.max() > 0:
            chosen.append(few[int(gap.argmax())])
            gap = np.minimum(gap, ((points[few] - points[chosen[-1]]) ** 2).sum(axis=1))
        return chosen

    def _paths(self, node: int, path: list[tuple[int, int]]):
        """(leaf, [(node, child), ...]) of every leaf."""
        if node < 0:
            yield -1 - node, path
            return
        for c, child in enumerate(self.nodes[node][1]):
            yield from self._paths(child, [*path, (node, c)])

    def route(self, rows: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        rows = fitted(rows, self.width)
        out = np.zeros(len(rows), np.int64)
        waiting = [(self.root, np.arange(len(rows)))]
        while waiting:
            node, own = waiting.pop()
            if node < 0:
                out[own] = -1 - node
            elif len(own):
                side = nearest(rows[own], self.nodes[node][0])
                waiting += [(child, own[side == c]) for c, child in enumerate(self.nodes[node][1])]
        return out


def nearest(rows: np.ndarray, points: np.ndarray) -> np.ndarray:
    return ((points**2).sum(axis=1) - 2 * (rows @ points.T)).argmin(axis=1)


def fitted(rows: np.ndarray, width: int) -> np.ndarray:
    """Rows cut or filled with zeros to ``width``."""
    out = np.zeros((len(rows), width))
    out[:, : rows.shape[1]] = rows[:, :width]
    return out


class Index:
    """The tree with the ranges of distances from each split point to each sibling subtree."""

    def __init__(self, tree: Tree, largest: int, width: int, exact: bool):
        self.tree, self.largest, self.width, self.exact = tree, float(largest), width, exact
        self.points = [fitted(p, width) for p, _ in tree.nodes]
        self.slack = 1e-6 * (1.0 + self.largest**0.5)
        self.ranges: list[np.ndarray] = []

    def distances(self, node: int, rows: np.ndarray) -> np.ndarray:
        """From every row to every split point of a node, in the longer space."""
        p = self.points[node]
        rest = np.sqrt(np.maximum(0.0, self.largest - (p**2).sum(axis=1)))
        own = np.sqrt(np.maximum(0.0, self.largest - (rows**2).sum(axis=1)))
        return np.sqrt(np.maximum(0.0, 2 * self.largest - 2 * (rows @ p.T) - 2 * np.outer(own, rest)))

    def set_ranges(self, found: list[tuple[int, int, float, float]]) -> None:
        """From (leaf, position, least, most): positions run through the split points along the leaf's path."""
        self.ranges = [np.stack([np.full((len(p), len(p)), np.inf), np.full((len(p), len(p)), -np.inf)]) for p in self.points]
        steps = {leaf: [(node, child, j) for node, child in path for j in range(len(self.points[node]))] for leaf, path in enumerate(self.tree.paths)}
        for leaf, position, least, most in found:
            node, child, j = steps[leaf][position]
            self.ranges[node][0, j, child] = min(self.ranges[node][0, j, child], least)
            self.ranges[node][1, j, child] = max(self.ranges[node][1, j, child], most)

    def leaves(self, anchor: np.ndarray, windows: list[tuple[int, int]]) -> list[int]:
        """Leaves that may hold a row whose score with the anchor lies in one of the windows."""
        base = float(anchor @ anchor) + self.largest
        inner = np.array([max(0.0, base - 2.0 * min(hi, HIGH)) ** 0.5 for _, hi in windows])[:, None, None] - self.slack
        outer = np.array([max(0.0, base - 2.0 * lo) ** 0.5 for lo, _ in windows])[:, None, None] + self.slack
        found, waiting = [], [self.tree.root]
        while waiting:
            node = waiting.pop()
            if node < 0:
                found.append(-1 - node)
                continue
            own = np.sqrt(np.maximum(0.0, base - 2.0 * (self.points[node] @ anchor)))[None, :, None]
            least, most = self.ranges[node]
            meets = (most >= np.maximum(own - outer, inner - own)) & (least <= own + outer)
            waiting += [self.tree.nodes[node][1][c] for c in np.nonzero(meets.all(axis=1).any(axis=0))[0]]
        return found

    def scores(self, anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Whole-number products: in doubles where all sums stay below 2^53, else in 64 bits."""
        if self.exact:
            return (anchors.astype(np.float64) @ rows.astype(np.float64).T).astype(np.int64)
        return anchors.astype(np.int64) @ rows.astype(np.int64).T


def unpacked_rows(column: pa.Array, width: int | None = None) -> np.ndarray:
    """Lists of equal or unequal length as one matrix of 64-bit numbers, filled with zeros."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    width = int(lengths.max(initial=0)) if width is None else width
    out = np.zeros((len(lengths), width), np.int64)
    at = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[np.repeat(np.arange(len(lengths)), lengths), at] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def whole_rows(vectors: DataFrame, scale: int, shift_every: int, classes: int) -> DataFrame:
    """vec_id, label and floor(scale * x) of the rows that take part."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    moved = F.when(F.col("vec_id") % shift_every == 0, (F.col("label").cast("long") + 1) % classes).otherwise(F.col("label").cast("long"))
    taking = vectors.where(F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(finite)
    return taking.select(
        F.col("vec_id").cast("long").alias("vec_id"), moved.alias("label"), F.transform("embedding", lambda x: F.floor(scale * x.cast("double"))).alias("q")
    )


def routed(rows: DataFrame, tree: Tree) -> DataFrame:
    """Every row with its leaf, squared length and largest component."""
    schema = pa.schema([("leaf", pa.int32()), ("vec_id", pa.int64()), ("label", pa.int64()), ("q", pa.list_(pa.int64())), ("norm", pa.int64()), ("size", pa.int32()), ("most", pa.float64())])

    def run(batches):
        for b in batches:
            if b.num_rows:
                q = unpacked_rows(b.column(2))
                real = q.astype(np.float64)
                most = np.abs(real).max(axis=1) if q.shape[1] else np.zeros(len(q))
                norm, size = (q**2).sum(axis=1), b.column(2).value_lengths()
                made = [pa.array(tree.route(real), pa.int32()), b.column(0), b.column(1), b.column(2).cast(pa.list_(pa.int64())), pa.array(norm), size.cast(pa.int32()), pa.array(most)]
                yield pa.RecordBatch.from_arrays(made, schema=schema)

    return rows.mapInArrow(run, "leaf int, vec_id bigint, label bigint, q array<bigint>, norm bigint, size int, most double")


def packed(rows: DataFrame, index: Index, salts: dict[int, int], parts: int) -> DataFrame:
    """Packs of at most ``PACK`` rows of a leaf, with the distances of their rows to the split points along its path."""
    schema = pa.schema([("leaf", pa.int32()), ("salt", pa.int32()), ("ids", pa.binary()), ("labels", pa.binary()), ("rows", pa.binary()), ("least", pa.list_(pa.float64())), ("most", pa.list_(pa.float64()))])
    big = {leaf: count for leaf, count in salts.items() if count > 1}
    many = F.coalesce(F.element_at(lit_map(big), F.col("leaf")), F.lit(1)) if big else F.lit(1)
    salted = rows.select("leaf", "vec_id", "label", "q").withColumn("salt", F.pmod(F.monotonically_increasing_id(), many).cast("int"))

    def cut(held):
        leaf, salt, ids, labels, q = held
        distances = [index.distances(node, q.astype(np.float64)) for node, _ in index.tree.paths[leaf]]
        far = np.concatenate(distances, axis=1) if distances else np.zeros((len(ids), 0))
        body = [ids.astype("<i8").tobytes(), labels.astype("<i8").tobytes(), q.astype("<i4").tobytes()]
        return [leaf, salt, *body, far.min(axis=0).tolist(), far.max(axis=0).tolist()]

    def run(batches):
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            leaf, salt = b.column(0).to_numpy(), b.column(4).to_numpy()
            ids, labels = b.column(1).fill_null(NO_ID).to_numpy(), b.column(2).to_numpy()
            q = unpacked_rows(b.column(3), index.width)
            edges = [0, *(np.nonzero((np.diff(leaf) != 0) | (np.diff(salt) != 0))[0] + 1), len(leaf)]
            out = []
            for lo, hi in zip(edges[:-1], edges[1:]):
                part = [leaf[lo], salt[lo], ids[lo:hi], labels[lo:hi], q[lo:hi]]
                if held is not None and (held[0], held[1]) == (part[0], part[1]):
                    part[2:] = [np.concatenate([x, y]) for x, y in zip(held[2:], part[2:])]
                elif held is not None:
                    out.append(cut(held))
                while len(part[2]) > PACK:
                    out.append(cut([*part[:2], *[x[:PACK] for x in part[2:]]]))
                    part[2:] = [x[PACK:] for x in part[2:]]
                held = part
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(cut(held), schema)], schema=schema)

    sorted_rows = salted.repartition(parts, "leaf", "salt").sortWithinPartitions("leaf", "salt")
    return sorted_rows.mapInArrow(run, "leaf int, salt int, ids binary, labels binary, rows binary, least array<double>, most array<double>")


def visits(asks: DataFrame, index: Index, salts: dict[int, int], home: bool) -> DataFrame:
    """Of anchors with windows of scores (uid, leaf, label, q, los, his): blocks of anchors for the leaves they must see: their own leaf, or all others that their windows reach."""
    schema = pa.schema([("leaf", pa.int32()), ("salt", pa.int32()), ("uids", pa.list_(pa.int64())), ("labels", pa.list_(pa.int64())), ("anchors", pa.binary()), ("counts", pa.list_(pa.int32())), ("los", pa.list_(pa.int64())), ("his", pa.list_(pa.int64()))])

    def run(batches):
        wanted: dict[int, list[tuple]] = {}
        size = 0

        def blocks(wanted):
            for leaf, asked in wanted.items():
                for k in range(0, len(asked), BLOCK):
                    part = asked[k : k + BLOCK]
                    body = [[x[0] for x in part], [x[1] for x in part], b"".join(x[2] for x in part), [len(x[3]) for x in part], [v for x in part for v in x[3]], [v for x in part for v in x[4]]]
                    for salt in range(salts.get(leaf, 1)):
                        yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip([leaf, salt, *body], schema)], schema=schema)

        for b in batches:
            if not b.num_rows:
                continue
            q = unpacked_rows(b.column(3), index.width)
            for row, uid, leaf, label, los, his in zip(q, *(b.column(k).to_pylist() for k in (0, 1, 2, 4, 5))):
                windows = [(lo, hi) for lo, hi in zip(los, his) if lo <= hi]
                if windows:
                    seen = [leaf] if home else [x for x in index.leaves(row.astype(np.float64), windows) if x != leaf]
                    for x in seen:
                        wanted.setdefault(x, []).append((uid, label, row.astype("<i4").tobytes(), los, his))
                    size += len(seen)
            if size > KEPT:
                yield from blocks(wanted)
                wanted, size = {}, 0
        yield from blocks(wanted)

    return asks.mapInArrow(run, "leaf int, salt int, uids array<bigint>, labels array<bigint>, anchors binary, counts array<int>, los array<bigint>, his array<bigint>")


def compared(packs: DataFrame, visiting: DataFrame, index: Index, parts: int, same: bool, top: int) -> DataFrame:
    """(uid, window, vec_id, score): each task's best ``top`` rows of every window."""
    schema = pa.schema([("uid", pa.int64()), ("window", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())])
    joined = packs.select("leaf", "salt", "ids", F.col("labels").alias("row_labels"), "rows").join(visiting.repartition(parts, "leaf", "salt"), ["leaf", "salt"])

    def batch(best):
        rows = [(uid, w, i, s) for (uid, w), (ids, scores) in best.items() for i, s in zip(ids.tolist(), scores.tolist())]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)

    def run(batches):
        best: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            for r in range(b.num_rows):
                ids, labels, rows, uids, own, anchors, counts, los, his = (b.column(k)[r].as_py() for k in range(9))
                ids, labels = np.frombuffer(ids, "<i8"), np.frombuffer(labels, "<i8")
                scores = index.scores(np.frombuffer(anchors, "<i4").reshape(len(uids), index.width), np.frombuffer(rows, "<i4").reshape(len(ids), index.width))
                at = 0
                for k, uid in enumerate(uids):
                    mask, row = (labels == own[k]) == same, scores[k]
                    for w in range(counts[k]):
                        lo, hi = los[at], his[at]
                        at += 1
                        before = best.get((uid, w))
                        if before is not None and len(before[0]) == top:
                            lo = max(lo, int(before[1][-1]))
                        hit = np.nonzero(mask & (row >= lo) & (row <= hi))[0]
                        if len(hit) > 4 * top:
                            hit = hit[row[hit] >= np.partition(row[hit], len(hit) - top)[len(hit) - top]]
                        if not len(hit):
                            continue
                        found, value = ids[hit], row[hit]
                        if before is not None:
                            found, value = np.concatenate([before[0], found]), np.concatenate([before[1], value])
                        order = np.lexsort((found, -value))[:top]
                        best[uid, w] = found[order], value[order]
                if len(best) * top > KEPT:
                    yield batch(best)
                    best = {}
        yield batch(best)

    cols = ["ids", "row_labels", "rows", "uids", "labels", "anchors", "counts", "los", "his"]
    return joined.select(*cols).mapInArrow(run, "uid bigint, window int, vec_id bigint, score bigint")


def best_of(found: DataFrame, top: int) -> DataFrame:
    """The ``top`` rows of every (uid, window), with their rank."""
    over = Window.partitionBy("uid", "window").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(over)).where(F.col("rank") <= top)


def floors(best: DataFrame, top: int) -> DataFrame:
    """The score of the ``top``-th row where a window has so many: nothing below it can matter."""
    return best.where(F.col("rank") == top).select("uid", "window", F.col("score").alias("floor"))


def hard_negatives(
    vectors: DataFrame, low: int = 80, every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES, scale: int = 256, shift_every: int = 7, classes: int = 10,
    leaf_rows: int = LEAF_ROWS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose vec_id is divisible by ``every``.  A negative's score is
    between ``low`` percent of the positive's and the positive's own.  Rows without label or
    vector, or with a missing or non-finite component, take no part; an empty vector is
    all zeros, and a shorter vector is filled with zeros.  A missing vec_id is no anchor,
    comes last among equal scores and is returned as null.  Rows that repeat a vec_id are
    rows of their own: each is an anchor and may be the other's positive.  Empty tables
    give no rows; other columns are not read, whatever their names.  Scores beyond 64
    bits raise an ArithmeticError, as sums do in Spark.
    """
    spark = vectors.sparkSession
    rows = whole_rows(vectors, scale, shift_every, classes)
    size = rows.count()
    sample = smallest_hashes(rows.where("vec_id is not null").select("vec_id", "q"), "vec_id", SAMPLE, size).select("q").toPandas()["q"]
    wide = max((len(v) for v in sample), default=0)
    points = np.zeros((len(sample), wide))
    for k, v in enumerate(sample):
        points[k, : len(v)] = v
    tree = Tree(points, min(max(1, size // leaf_rows), SAMPLE // ARITY))
    placed = settle(routed(rows, tree))
    facts = placed.agg(F.max("norm").alias("norm"), F.max("size").alias("width"), F.max("most").alias("most")).first()
    width, most = facts["width"] or 0, facts["most"] or 0.0
    if most >= 1 << 31 or width * most**2 >= 1 << 63:
        raise ArithmeticError("the scores of these vectors do not fit into 64 bits")
    index = Index(tree, facts["norm"] or 0.0, width, width * most**2 < 1 << 53)
    salts = {r["leaf"]: -(-r["count"] // (PACK * PACKS_PER_SALT)) for r in placed.groupBy("leaf").count().toLocalIterator()}
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), sum(salts.values()) // 4)
    packs = settle(packed(placed, index, salts, parts))
    ranged = packs.select("leaf", F.posexplode(F.arrays_zip("least", "most"))).groupBy("leaf", "pos").agg(F.min("col.least").alias("least"), F.max("col.most").alias("most"))
    index.set_ranges([tuple(r) for r in ranged.toLocalIterator()])
    dealt = packs.repartition(parts, "leaf", "salt")

    def search(asks: DataFrame, home: bool, same: bool, top: int) -> DataFrame:
        return compared(dealt, visits(asks, index, salts, home), index, parts, same, top)

    def twice(asks: DataFrame, same: bool, top: int) -> DataFrame:
        """Own leaf first; what it has raises the lower ends of the windows for all other leaves."""
        near = settle(best_of(search(asks, True, same, top), top))
        raised = floors(near, top).groupBy("uid").agg(F.map_from_entries(F.collect_list(F.struct("window", "floor"))).alias("floors"))
        higher = F.transform("los", lambda lo, w: F.greatest(lo, F.coalesce(F.element_at("floors", w), lo)))
        narrowed = asks.join(raised, "uid", "left").select("uid", "leaf", "label", "q", higher.alias("los"), "his")
        far = search(narrowed, False, same, top)
        return best_of(near.drop("rank").unionByName(far), top)

    anchors = settle(placed.where(F.col("vec_id") % every == 0).withColumn("uid", F.monotonically_increasing_id()))
    one = F.array(F.lit(LOW).cast("long")), F.array(F.lit(HIGH).cast("long"))
    kin = twice(anchors.select("uid", "leaf", "label", "q", one[0].alias("los"), one[1].alias("his")), True, positives + 1)
    listed = kin.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("kin"))
    listed = settle(anchors.join(listed, "uid").withColumn("kin", _without_self(positives)))
    # Rounded up where the score is not negative; above the score, an empty window, where it is.
    least = F.expr(f"transform(kin, p -> ({low} * p.score + 99) div 100)")
    asks = listed.select("uid", "leaf", "label", "q", least.alias("los"), F.transform("kin", lambda p: p["score"]).alias("his"))
    hard = twice(asks, False, negatives)
    pairs = listed.select("uid", F.col("vec_id").alias("anchor_id"), F.posexplode("kin").alias("window", "p"))
    known = lambda c: F.when(c != NO_ID, c)
    return hard.join(pairs, ["uid", "window"]).select(
        "anchor_id", known(F.col("p.vec_id")).alias("positive_id"), F.col("rank").cast("int").alias("rank"), known(F.col("vec_id")).alias("negative_id"),
        F.col("p.score").alias("positive_score"), F.col("score").alias("negative_score"),
    )


def _without_self(positives: int) -> Column:
    """The first others: an anchor's own row is the one with its id and its squared length as score."""
    own = F.filter("kin", lambda p: (p["vec_id"] == F.col("vec_id")) & (p["score"] == F.col("norm")))
    place = F.coalesce(F.get(own, 0)["rank"], F.lit(-1))
    return F.slice(F.filter("kin", lambda p: p["rank"] != place), 1, positives)


ORACLE = """
WITH rows_ AS (
  SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, a.label AS own, b.vec_id AS other_id, b.label, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score FROM rows_ a JOIN rows_ b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) AS r FROM scored WHERE label = own) p WHERE r <= 5
), negatives AS (
  SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id) AS r, other_id AS negative_id, positive_score, score AS negative_score
  FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND s.label <> s.own AND 80 * positive_score <= 100 * score AND score <= positive_score
)
SELECT anchor_id, positive_id, CAST(r AS INT) AS rank, negative_id, positive_score, negative_score FROM negatives WHERE r <= 5"""
