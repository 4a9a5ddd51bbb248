"""SimHash near-duplicates by the generalised pigeonhole principle.

The 64 fingerprint bits are put into partitions of bits that vary together. If
two fingerprints differ in at most ``distance`` bits, and partition i has the
threshold T(i) with sum(T(i) + 1) = distance + 1, then in some partition they
differ in at most T(i) bits. The number of partitions and the thresholds are
those with the least estimated work, found by dynamic programming on candidate
counts estimated from a bounded sample; any choice gives the same links.

A fingerprint is filed under its bits in partition i and, up to T(i) of its set
bits cleared, under the bits that remain: two that differ in T(i) bits there meet
where each has cleared what only it had set. Fingerprints under one key are
compared, and what hangs together is emitted as a star to its smallest member,
never as all pairs. Keys with many fingerprints are first split by the same
principle over the bits outside their partition. Equal fingerprints count once.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlab.llm.common import ASCII_LOWER, map_rows, smallest_hashes
from flowlab.session import cut_lineage

SHINGLE = 4
DISTANCE = 4
SEED = 42
#: Fingerprints that the partitions and thresholds are planned from, at most; they decide cost, not results.
PLAN_SAMPLE = 1_500
#: Relative cost of filing a fingerprint under one more key, and of comparing two fingerprints.
KEY_COST, PAIR_COST = 1.0, 0.004
#: A key with more fingerprints is split over the bits outside its partition.
HOT_KEY = 4_096
MATRIX = 1_024


def fingerprint(data: bytes | None) -> int:
    """SimHash of the word shingles, as an unsigned 64-bit number; 0 without words."""
    words = data.translate(ASCII_LOWER).split() if data else []
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < SHINGLE:
        return xxhash.xxh64_intdigest(joined, SEED)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - SHINGLE + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :].tolist())), np.uint64, len(starts))
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 16_384):
        block = hashes[at : at + 16_384].astype("<u8")
        counts += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return sum(1 << int(b) for b in np.flatnonzero(2 * counts > len(hashes)))


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fingerprints(docs: DataFrame, *more: str) -> DataFrame:
    """(doc_id, fp) and the columns ``more`` of every whole text, one row per row of ``docs``; fp is the signed form of the 64 bits."""

    def make(batches):
        for b in batches:
            yield {"doc_id": b["doc_id"], "fp": [signed(fingerprint(t)) for t in b["text"]]} | {c: b[c] for c in more}

    kinds = "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in more)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_rows(docs.select("doc_id", "text", *more), make, f"doc_id {kind}, fp long{kinds}")


def group_bits(bits: np.ndarray, parts: int) -> list[list[int]]:
    """The 64 bit positions in ``parts`` groups; each takes the bits most correlated with those it has."""
    bits = bits if len(bits) else np.zeros((1, 64))
    spread = bits.std(axis=0)
    scaled = np.where(spread > 0, (bits - bits.mean(axis=0)) / np.where(spread > 0, spread, 1), 0)
    related = np.abs(scaled.T @ scaled / max(1, len(bits)))
    left, groups = list(range(64)), []
    for k in range(parts):
        size = (64 - sum(map(len, groups))) // (parts - k)
        group = [left.pop(0)]
        while len(group) < size:
            nearest = max(left, key=lambda b: (related[group, b].sum(), -b))
            left.remove(nearest)
            group.append(nearest)
        groups.append(sorted(group))
    return groups


def close_share(bits: np.ndarray, group: list[int], reach: int) -> float:
    """Estimated share of pairs that differ in at most ``reach`` bits of the group."""
    own = bits[:, group].astype(np.int32)
    apart = own.sum(1)[:, None] + own.sum(1)[None, :] - 2 * own @ own.T
    close = np.triu(apart <= reach, 1).sum()
    pairs = len(bits) * (len(bits) - 1) // 2
    if pairs and close >= 20:
        return float(close / pairs)
    ones = bits[:, group].mean(axis=0) if len(bits) else np.full(len(group), 0.5)
    odds = np.zeros(reach + 1)
    odds[0] = 1.0
    for differ in 2 * ones * (1 - ones):
        odds[1:] = odds[1:] * (1 - differ) + odds[:-1] * differ
        odds[0] *= 1 - differ
    return float(odds.sum())


def plan(sample: np.ndarray, count: int, distance: int = DISTANCE) -> list[tuple[list[int], int]]:
    """Partitions with their thresholds; a partition that gets the threshold -1 is left out."""
    bits = np.unpackbits(sample.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(float)
    best: tuple[float, list[tuple[list[int], int]]] = (float("inf"), [])
    for parts in range(2, distance + 2):
        groups = group_bits(bits, parts)
        costs = []
        for g in groups:
            row = [0.0]
            for t in range(3):
                keys = sum(comb((len(g) + 1) // 2, j) for j in range(t + 1))
                row.append(count * keys * KEY_COST + count * count / 2 * close_share(bits, g, t) * PAIR_COST)
            costs.append(row)
        # table[s]: least cost of the partitions so far when their T + 1 add up to s
        table: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for row in costs:
            new: dict[int, tuple[float, list[int]]] = {}
            for s, (cost, chosen) in table.items():
                for a, own in enumerate(row):
                    if s + a <= distance + 1 and cost + own < new.get(s + a, (float("inf"), []))[0]:
                        new[s + a] = (cost + own, [*chosen, a])
            table = new
        if distance + 1 in table and table[distance + 1][0] < best[0]:
            best = (table[distance + 1][0], [(g, a - 1) for g, a in zip(groups, table[distance + 1][1]) if a])
    return best[1]


def _mixed(values: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (values ^ np.uint64((salt * 0x9E3779B97F4A7C15) % 2**64)) * np.uint64(0xFF51AFD7ED558CCD)
        return (x ^ (x >> np.uint64(32))) * np.uint64(0xC4CEB9FE1A85EC53)


def _table(key: np.ndarray, fp: np.ndarray, **more: np.ndarray) -> pa.RecordBatch:
    columns = {"key": key.view(np.int64), "fp": fp.view(np.int64)} | more
    return pa.RecordBatch.from_arrays([pa.array(v) for v in columns.values()], names=list(columns))


def _mask(group: list[int]) -> np.uint64:
    return np.uint64(sum(1 << b for b in group))


def filed(nodes: DataFrame, parts: list[tuple[list[int], int]]) -> DataFrame:
    """(key, fp, part): every fingerprint under all its keys."""

    def run(batches):
        for b in batches:
            fp = b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for i, (group, t) in enumerate(parts):
                own = fp & _mask(group)
                for cleared in range(t + 1):
                    for bits in combinations(group, cleared):
                        gone = _mask(list(bits))
                        has = (own & gone) == gone
                        if has.any():
                            yield _table(_mixed(own[has] ^ gone, i + 1), fp[has], part=np.full(int(has.sum()), i, np.int32))

    return nodes.select("fp").mapInArrow(run, "key long, fp long, part int")


def split_keys(hot: DataFrame, parts: list[tuple[list[int], int]], distance: int) -> DataFrame:
    """Files the fingerprints of hot keys under the key and one of distance + 1 pieces of the bits outside its partition."""

    def run(batches):
        for b in batches:
            key, fp, part = (b.column(c).to_numpy(zero_copy_only=False) for c in ("key", "fp", "part"))
            fp, key = fp.view(np.uint64), key.view(np.uint64)
            for i, (group, _) in enumerate(parts):
                rows = part == i
                outside = [x for x in range(64) if x not in group]
                for j in range(distance + 1):
                    piece = fp[rows] & _mask(outside[j :: distance + 1])
                    yield _table(_mixed(_mixed(piece, j + 101) ^ key[rows], 99), fp[rows])

    return hot.select("key", "fp", "part").mapInArrow(run, "key long, fp long")


def stars(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """(root, member) for what hangs together among distinct fingerprints; root is the smallest of its component."""
    if len(fps) <= MATRIX:
        linked = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= distance
        fps = fps[linked.sum(axis=1) > 1]
    found = []
    rest = fps
    while len(rest) > 1:
        frontier, component = [rest[0]], [int(rest[0])]
        rest = rest[1:]
        while frontier and len(rest):
            near = np.bitwise_count(rest ^ frontier.pop()) <= distance
            if near.any():
                frontier.extend(rest[near])
                component.extend(rest[near].tolist())
                rest = rest[~near]
        root = min(component)
        found.extend((root, x) for x in component if x != root)
    return found


def linked(keyed: DataFrame, distance: int) -> DataFrame:
    """(u, v) stars of the fingerprints under each key. Rows come sorted by key, so a task holds one key at a time."""

    def run(batches):
        last_key, held = None, []

        def flush():
            if held:
                fps = np.unique(np.concatenate(held))
                if len(fps) > 1:
                    return stars(fps, distance)
            return []

        for b in batches:
            key = b.column("key").to_numpy(zero_copy_only=False)
            fp = b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            if not len(key):
                continue
            found = []
            cuts = np.flatnonzero(np.diff(key)) + 1
            edges = np.concatenate([[0], cuts, [len(key)]])
            sizes = np.diff(edges)
            # Groups that begin and end inside the batch with one row have no pair.
            for g in range(len(sizes)):
                inner = 0 < g < len(sizes) - 1
                if inner and sizes[g] == 1:
                    continue
                own = fp[edges[g] : edges[g + 1]]
                if key[edges[g]] == last_key:
                    held.append(own)
                    continue
                found += flush()
                last_key, held = key[edges[g]], [own]
            if found:
                yield _edges(found)
        found = flush()
        if found:
            yield _edges(found)

    return keyed.select("key", "fp").repartition("key").sortWithinPartitions("key").mapInArrow(run, "u long, v long")


def _edges(found: list[tuple[int, int]]) -> pa.RecordBatch:
    both = np.array(found, np.uint64)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0].view(np.int64)), pa.array(both[:, 1].view(np.int64))], names=["u", "v"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of all nodes with an edge; root is the smallest node of the component.

    Alternates large stars and small stars until no edge changes. Only minima
    are aggregated; the neighbours of a node are never gathered.
    """
    edges = cut_lineage(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_least, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        edges = cut_lineage(small)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state


def near_duplicates(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row of ``docs``.

    A text without words (missing, empty or white space) has the fingerprint
    zero. Fingerprints that differ in at most ``distance`` bits are linked; a
    component's id is its smallest doc_id. Repeated rows give repeated results;
    rows without doc_id are linked like any other, and a component that has only
    such rows has no id. Other columns are not read.
    """
    printed = cut_lineage(fingerprints(docs))
    roots = rooted(printed, distance)
    ids = roots.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = roots.join(ids, "root").select("fp", "component_id")
    return printed.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def rooted(printed: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(fp, first_id, root) of every distinct fingerprint: its smallest doc_id and the smallest fingerprint of its component."""
    nodes = cut_lineage(printed.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    found = components(links(nodes, distance)).withColumnRenamed("node", "fp")
    return nodes.join(found, "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))


def links(nodes: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Stars (u, v) that connect all fingerprints of ``nodes`` whose links of at most ``distance`` bits connect them."""
    count = nodes.count()
    sample = smallest_hashes(nodes.select("fp"), "fp", PLAN_SAMPLE, count).toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    parts = plan(sample, count, distance)
    keyed = filed(nodes, parts)
    hot = cut_lineage(keyed.groupBy("key").count().where(F.col("count") > HOT_KEY).select("key"))
    if hot.isEmpty():
        return linked(keyed, distance).distinct()
    rest = keyed.join(hot, "key", "left_anti").select("key", "fp")
    parted = split_keys(keyed.join(hot, "key"), parts, distance)
    return linked(rest.unionByName(parted), distance).distinct()


def keep_one(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """One row of every component, with all its columns: that with the smallest doc_id.

    Rows are told apart by doc_id and the digest of their text, so rows without doc_id
    and different texts under one doc_id are decided each in its own component. A row
    without doc_id stays only if no row of its component has one; of rows that have
    the smallest doc_id in common, the one with the smallest digest stays.
    """
    digest = F.unhex(F.md5("text"))
    printed = cut_lineage(fingerprints(docs.select("doc_id", "text", digest.alias("digest")), "digest"))
    own = printed.join(rooted(printed, distance).select("fp", "root"), "fp")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("bare"), "doc_id", "digest")).alias("first")
    kept = own.groupBy("root").agg(first).select(F.col("first.doc_id").alias("kept_id"), F.col("first.digest").alias("kept_digest"))
    rows = docs.select(F.col("doc_id").alias("row_id"), digest.alias("row_digest"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    joined = rows.join(kept, F.col("row_id").eqNullSafe(F.col("kept_id")) & F.col("row_digest").eqNullSafe(F.col("kept_digest")), "left_semi")
    return joined.dropDuplicates(["row_id", "row_digest"]).select("row.*")
