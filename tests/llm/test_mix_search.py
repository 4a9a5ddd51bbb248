"""Mixing, hard negatives and ranked search against plain Python."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlab.llm import lexical, mixing, negatives

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
TERMS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


# Mixing


def test_targets_stop_at_the_limit_and_share_the_rest():
    assert mixing.targets([100, 100, 100]) == pytest.approx([187.5, 75.0, 37.5])
    assert mixing.targets([10, 100, 1000]) == pytest.approx([30, 300, 780])
    assert mixing.targets([]) == [] and mixing.targets([0, 0]) == [0.0, 0.0] and mixing.targets([0, 8]) == pytest.approx([0, 8])
    sizes = [1, 5, 900, 40, 40, 3]
    found = mixing.targets(sizes)
    assert sum(found) == pytest.approx(sum(sizes)) and all(t <= 3 * s + 1e-9 for t, s in zip(found, sizes))


def test_permutations_and_draws():
    for size in (1, 2, 3, 17, 1000):
        for turn in range(3):
            assert sorted(mixing.permuted(np.arange(size), size, (5, 2, 0, turn))) == list(range(size))
    assert list(mixing.permuted(np.arange(1000), 1000, (5, 2, 0, 0))) != list(mixing.permuted(np.arange(1000), 1000, (5, 2, 0, 1)))
    totals = np.array([1000, 0, 37, 400, 3])
    shards = -(-int(totals.sum()) // 64)
    counts, before = np.zeros(5, np.int64), np.zeros(5, np.int64)
    for k in range(shards):
        start, here = mixing.shard_counts(totals, shards, k, 64, 1)
        assert (start == before).all() and here.sum() == min(64, totals.sum() - 64 * k)
        counts, before = counts + here, before + here
    assert (counts == totals).all()
    large = np.array([9 * 10**11, 10**11, 5])
    half = mixing.halved(large, int(large.sum()) // 2, np.random.default_rng(1))
    assert half.sum() == large.sum() // 2 and (half <= large).all() and abs(half[0] / 4.5e11 - 1) < 1e-4


def _mix_by_hand(docs, mix):
    """Packs every source again in plain Python and follows the slots."""
    starts = defaultdict(list)
    for r in mix.places.collect():
        starts[r["source_no"]].append((r["start"], r["size"], r["doc_id"]))
    used = Counter()
    times = Counter((r["source_no"], r["block"]) for r in mix.slots.collect())
    for source, rows in starts.items():
        at = 0
        for start, size, doc_id in sorted((r for r in rows if r[1]), key=lambda r: r[0]):
            assert start == at  # no gap, no overlap
            at += size
            used[doc_id, size] += sum(times[source, word // mix.block_words] for word in range(start, start + size))
    return used


def test_mix_against_plain_python(spark, documents):
    mix = mixing.plan_mix(documents, block_words=16, shard_slots=128, bucket_rows=20)
    used = _mix_by_hand(documents, mix)
    taken = mix.taken().collect()
    sizes = Counter()
    for r in documents.collect():
        sizes[r["doc_id"], len(WORDS.findall(r["text"] or ""))] += 1
    assert Counter((r["doc_id"], r["size"]) for r in taken) == sizes
    assert {(r["doc_id"], r["size"]): r["taken"] for r in taken} == {k: used[k] for k in sizes}
    assert all(r["taken"] <= 3 * r["size"] for r in taken)
    per_source = {r["source_no"]: r for r in mix.sources.collect()}
    for r in mix.taken().groupBy("source_no").agg(F.sum("taken").alias("taken"), F.sum("size").alias("size")).collect():
        s = per_source[r["source_no"]]
        assert r["size"] == s["source_size"] and abs(r["taken"] - s["target"]) <= 40
    slots = mix.slots.groupBy("source_no").agg(F.count("*").alias("n"), F.countDistinct("block", "pass_no").alias("d")).collect()
    assert all(r["n"] == r["d"] for r in slots)


def test_mix_does_not_depend_on_partitions(documents):
    a, b = (mixing.mix_report(d).collect() for d in (documents, documents.repartition(7)))
    assert sorted(a) == sorted(b)


def test_mix_texts_are_the_blocks(spark):
    docs = spark.createDataFrame([(i, "s", f"  a{i} b{i}\tc{i}\n d{i} ") for i in range(9)] + [(None, None, "x y z")], "doc_id long, source string, text string")
    mix = mixing.plan_mix(docs, block_words=5, shard_slots=4)
    order = {s: sorted(mix.places.where(F.col("source_no") == s).collect(), key=lambda r: r["start"]) for s in (0, 1)}
    words = {s: [w for r in rows for w in ("x y z".split() if s else [f"{c}{r['doc_id']}" for c in "abcd"])] for s, rows in order.items()}
    found = mix.texts().collect()
    assert len(found) == mix.slots.count()
    for r in found:
        assert r["text"].split(" ") == words[r["source_no"]][5 * r["block"] : 5 * r["block"] + 5]


def test_mix_of_odd_rows(odd, nothing):
    rows = mixing.mix_report(odd).collect()
    assert len(rows) == odd.count() and sum(r["taken"] for r in rows) == pytest.approx(rows[0]["target"], abs=200)
    assert all(r["taken"] == 0 for r in rows if r["size"] == 0) and len({r["source_size"] for r in rows}) == 1
    assert mixing.mix_report(nothing).count() == 0
    many = odd.where("doc_id = 6").limit(1).crossJoin(odd.sparkSession.range(25_000)).select("doc_id", "source", "text")
    mass = mixing.mix_report(many)
    assert mass.count() == 25_000 and mass.agg(F.max("taken")).first()[0] <= 36


# Hard negatives


def _hard_by_hand(rows):
    kept = []
    for i, v, label in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept.append((i, [math.floor(256 * float(x)) for x in v], (label + 1) % 10 if i is not None and i % 7 == 0 else label))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    last = 1 << 63
    for a, (i, v, label) in enumerate(kept):
        if i is None or i % 100:
            continue
        order = sorted((-dot(v, w), last if j is None else j, m) for b, (j, w, m) in enumerate(kept) if b != a)
        for s, j, _ in [x for x in order if x[2] == label][:5]:
            found = [x for x in order if x[2] != label and 80 * -s <= 100 * -x[0] <= 100 * -s][:5]
            out += [(i, None if j == last else j, k + 1, None if x[1] == last else x[1], -s, -x[0]) for k, x in enumerate(found)]
    return Counter(out)


def _hard(df, **options):
    return Counter((r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in negatives.hard_negatives(df, **options).collect())


def test_hard_negatives_against_plain_python(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 8))
    rows = [(int(i), [float(np.float32(x)) for x in centres[i % 6] + rng.normal(size=8) * 0.4], int(rng.integers(0, 3))) for i in range(700)]
    rows += [(1000, rows[0][1], 1), (1000, rows[0][1], 1), (1001, [float("nan")] * 8, 1), (1002, [None, *rows[1][1][1:]], 1), (1003, None, 1), (1004, rows[2][1], None), (None, rows[0][1], 1), (None, rows[0][1], 2)]
    rows += [(1100, [], 1), (1200, [0.5, 0.25], 2), (2000, [0.0] * 8, 0), (-300, rows[5][1], 0)] + [(3000 + i, rows[3][1], i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    want = _hard_by_hand(rows)
    assert len(want) > 50
    assert _hard(df, leaf_rows=20) == want
    assert _hard(df.withColumn("uid", F.lit(1)).withColumn("leaf", F.lit("x")), leaf_rows=100_000) == want


def test_hard_negatives_with_small_packs(spark, monkeypatch):
    monkeypatch.setattr(negatives, "PACK", 16)
    monkeypatch.setattr(negatives, "PACKS_PER_SALT", 2)
    rng = np.random.default_rng(5)
    rows = [(int(i), [float(np.float32(x)) for x in rng.normal(size=4)], int(i % 3)) for i in range(300)] + [(500 + i, [0.5, 0.5, 0.5, 0.25], i % 3) for i in range(150)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert _hard(df, leaf_rows=30) == _hard_by_hand(rows)


def test_no_vectors_and_huge_components(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert negatives.hard_negatives(empty).count() == 0
    assert negatives.hard_negatives(spark.createDataFrame([(100, [1.0], 1)], empty.schema)).count() == 0
    with pytest.raises(ArithmeticError):
        negatives.hard_negatives(spark.createDataFrame([(100, [1e30], 1), (101, [1e30], 1)], empty.schema))


def test_tree_leaves_out_what_no_window_reaches():
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(12, 16)) * 300
    rows = np.floor(centres[np.arange(3000) % 12] + rng.normal(size=(3000, 16)) * 20)
    tree = negatives.Tree(rows[:1000], 60)
    largest = int((rows**2).sum(axis=1).max())
    index = negatives.Index(tree, largest, 16, True)
    leaf = tree.route(rows)
    found = []
    for x in set(leaf.tolist()):
        far = np.concatenate([index.distances(node, rows[leaf == x]) for node, _ in tree.paths[x]], axis=1)
        found += [(x, k, lo, hi) for k, (lo, hi) in enumerate(zip(far.min(axis=0), far.max(axis=0)))]
    index.set_ranges(found)
    visited = 0
    for a in rows[:40]:
        scores = rows @ a
        top = np.sort(scores)[-5]
        seen = index.leaves(a, [(int(0.8 * top), int(top))])
        visited += np.isin(leaf, seen).sum()
        inside = (scores >= int(0.8 * top)) & (scores <= top)
        assert np.isin(leaf[inside], seen).all()
    assert visited < 0.5 * 40 * len(rows)


# Ranked search


def _ranked_by_hand(docs, items, top=50):
    terms = lambda t: TERMS.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n_docs, n_terms = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    wanted = defaultdict(set)
    for i, t in items:
        wanted[i] |= set(terms(t))
    out = Counter()
    for i, own in wanted.items():
        scored = []
        for d, c in held:
            m = 50 + 50 * sum(c.values()) * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in own if t in c)
            if s > 0:
                scored.append((-s, d is None, d))
        out.update((i, k + 1, d, -s) for k, (s, _, d) in enumerate(sorted(scored)[:top]))
    return out


def _ranked(found):
    return Counter((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in found.collect())


def test_ranked_search_against_plain_python(spark, documents, sf):
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    want = _ranked_by_hand([(r["doc_id"], r["text"]) for r in documents.collect()], [(r["item_id"], r["text"]) for r in items.collect()])
    assert _ranked(lexical.ranked_search(documents, items)) == want
    assert _ranked(lexical.ranked_search(documents, items, block_terms=200)) == want


def test_ranked_search_of_odd_rows(spark, odd, nothing):
    items = spark.createDataFrame(
        [(1, "Word A b, lorem"), (2, None), (3, "  "), (None, "東京 words"), (4, "cödé ÜNï ipsum"), (4, "same line"), (5, "nowhere to be seen q")], "item_id long, text string"
    ).withColumn("rank", F.lit("x"))
    want = _ranked_by_hand([(r["doc_id"], r["text"]) for r in odd.collect()], [(r["item_id"], r["text"]) for r in items.collect()])
    assert want and _ranked(lexical.ranked_search(odd, items)) == want
    assert lexical.ranked_search(nothing, items).count() == 0 and lexical.ranked_search(odd, items.where("false")).count() == 0
    twice = odd.unionByName(odd)
    want = _ranked_by_hand([(r["doc_id"], r["text"]) for r in twice.collect()], [(r["item_id"], r["text"]) for r in items.collect()], 3)
    assert _ranked(lexical.ranked_search(twice, items, top=3)) == want


def test_bounds_leave_out_pairs(spark):
    """Two vocabularies: no document of one is scored for an item of the other, and weak documents of the same are passed over."""
    rng = np.random.default_rng(7)
    words = [[f"{side}{k}" for k in range(300)] for side in "ab"]
    draw = lambda k, n: " ".join(rng.choice(words[k], n))
    items = [(i, draw(i % 2, 12)) for i in range(40)]
    docs = [(d, draw(d % 2, 60) + (" " + items[d % 40][1] if d < 800 else "")) for d in range(4000)]
    block = lexical.Items([(i, list(dict.fromkeys(t.encode().split()))) for i, t in items])
    rows = [Counter(block.vocabulary[t.encode()] for t in text.split() if t.encode() in block.vocabulary) for _, text in docs]
    df = np.zeros(len(block.vocabulary), np.int64)
    for c in rows:
        df[list(c)] += 1
    search = lexical.Searcher(block, lexical.term_weights(df, len(docs)), len(docs), sum(len(t.split()) for _, t in docs), 10)
    lengths = np.array([len(c) for c in rows])
    search.add([d for d, _ in docs], np.array([len(t.split()) for _, t in docs]), lengths, np.array([t for c in rows for t in c]), np.array([n for c in rows for n in c.values()]))
    want = _ranked_by_hand(docs, items, 10)
    found = Counter()
    for i, _ in items:
        found.update((i, k + 1, d, s) for k, (_, d, s) in enumerate(sorted((r for r in search.found() if r[0] == i), key=lambda r: (-r[2], r[1]))))
    assert found == want
    assert search.pairs == 160_000 and search.scored < 0.5 * search.pairs
