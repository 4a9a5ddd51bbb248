"""Ranked lexical search by two trees: one over items, one over the documents of a batch.

A document's coordinate for a term is what the term would add to a score; an item's
coordinate is one for each of its terms.  Nodes of both trees hold the largest value
of each coordinate below them, so the product of two nodes bounds every score between
them.  A pair of nodes is left out when its bound lies below the weakest ``top``-th
score that the items of the node have so far; equal bounds are followed, because equal
scores go by document id.  Nothing else is left out, so the ranking is exact.

Texts are read once per block of items: each document becomes the counts of the terms
that occur in the block.  Those rows are settled in the shared folder, since the weights
need counts over all documents first.  A block holds at most ``BLOCK_TERMS`` distinct
(item, term) pairs, whatever the benchmark's size, and only one block is in the driver
at a time; every task keeps its own best ``top`` documents per item.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

from flowlab.llm.common import map_rows
from flowlab.session import settle, work_path

TOP = 50
#: Distinct (item, term) pairs of a block of items; one item is never cut.
BLOCK_TERMS = 1_000_000
#: Documents and items of a leaf, and the children of an inner document node.
LEAF_DOCS, LEAF_ITEMS, FANOUT = 16, 8, 8
#: Nodes of the item tree by which the documents of a batch are put in order.
GROUPS = 16
#: Rounds in which a part of the item tree is settled.
ROUNDS = 8

#: A-Z to a-z; every other ASCII byte that is no letter or digit becomes a blank.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    """Maximal runs of letters, digits and non-ASCII characters; none in a missing text."""
    return text.translate(_TERMS).split() if text else []


class Items:
    """A block of items and its tree.  ``nodes``: (items, union of their terms, children)."""

    def __init__(self, items: list[tuple[object, list[bytes]]]):
        self.ids = [item_id for item_id, _ in items]
        self.vocabulary: dict[bytes, int] = {}
        self.terms = [np.array([self.vocabulary.setdefault(t, len(self.vocabulary)) for t in terms], np.int64) for _, terms in items]
        self.nodes: list[tuple[np.ndarray, np.ndarray, list[int]]] = []
        waiting = [(np.arange(len(items)), -1)]
        while waiting:
            own, parent = waiting.pop()
            node = len(self.nodes)
            union, held = np.unique(np.concatenate([self.terms[i] for i in own]), return_counts=True)
            self.nodes.append((own, union, []))
            if parent >= 0:
                self.nodes[parent][2].append(node)
            if len(own) > LEAF_ITEMS:
                waiting += [(part, node) for part in self._halves(own, union, held)]

    def _halves(self, own: np.ndarray, union: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two parts that share few terms: items with and without the term nearest to halving them, then each to the part whose terms it shares more."""
        lengths = np.array([len(self.terms[i]) for i in own])
        starts = np.cumsum(lengths) - lengths
        terms = np.searchsorted(union, np.concatenate([self.terms[i] for i in own]))
        left = np.maximum.reduceat(terms == np.argmin(np.abs(2 * held - len(own))), starts)
        if min(left.sum(), len(own) - left.sum()) == 0:
            left = np.arange(len(own)) * 2 < len(own)
        for _ in range(ROUNDS):
            side = np.repeat(left, lengths)
            share = np.bincount(terms[side], minlength=len(union)) / left.sum() - np.bincount(terms[~side], minlength=len(union)) / (~left).sum()
            lean = np.add.reduceat(share[terms], starts) / lengths
            new = lean > 0
            if min(new.sum(), len(own) - new.sum()) * 8 < len(own):
                new = np.argsort(np.argsort(-lean, kind="stable"), kind="stable") * 2 < len(own)
            if (new == left).all():
                break
            left = new
        return own[left], own[~left]

    def frontier(self, size: int) -> list[int]:
        """At most ``size`` nodes that hold all items, from the root downwards."""
        found = [0]
        while inner := [n for n in found if self.nodes[n][2]]:
            widest = max(inner, key=lambda n: len(self.nodes[n][0]))
            if len(found) - 1 + len(self.nodes[widest][2]) > size:
                break
            found.remove(widest)
            found += self.nodes[widest][2]
        return found


def item_blocks(items: DataFrame, limit: int = BLOCK_TERMS) -> Iterator[Items]:
    """Blocks of items in ascending item_id; rows that share an id are one item with the terms of all of them."""
    kind = items.schema["item_id"].dataType.simpleString()

    def make(batches):
        for b in batches:
            found = [(i, t) for i, text in zip(b["item_id"], b["text"]) for t in dict.fromkeys(terms_of(text))]
            yield {"item_id": [i for i, _ in found], "term": [t for _, t in found]}

    rows = map_rows(items.select("item_id", "text"), make, f"item_id {kind}, term binary").distinct().orderBy("item_id", "term")
    block: list[tuple[object, list[bytes]]] = []
    size = 0
    for item_id, term in rows.toLocalIterator():
        if not block or block[-1][0] != item_id:
            if size >= limit:
                yield Items(block)
                block, size = [], 0
            block.append((item_id, []))
        block[-1][1].append(bytes(term))
        size += 1
    if block:
        yield Items(block)


def term_rows(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """Per document: how many terms it has, and which terms of the vocabulary it holds how often."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def make(batches):
        for b in batches:
            out: dict[str, list] = {"doc_id": b["doc_id"], "n": [], "terms": [], "counts": []}
            for text in b["text"]:
                words = terms_of(text)
                known = sorted((k, c) for t, c in Counter(words).items() if (k := vocabulary.get(t)) is not None)
                out["n"].append(len(words))
                out["terms"].append([k for k, _ in known])
                out["counts"].append([c for _, c in known])
            yield out

    return map_rows(docs.select("doc_id", "text"), make, f"doc_id {kind}, n bigint, terms array<int>, counts array<int>")


def document_counts(rows: DataFrame, width: int) -> np.ndarray:
    """In how many documents each term of the block occurs; counted per task, then summed."""
    schema = pa.schema([("term", pa.int32()), ("df", pa.int64())])

    def run(batches):
        held = np.zeros(width, np.int64)
        for b in batches:
            held += np.bincount(b.column(0).flatten().to_numpy(), minlength=width)
        terms = np.nonzero(held)[0]
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.int32()), pa.array(held[terms])], schema=schema)

    out = np.zeros(width, np.int64)
    for r in rows.select("terms").mapInArrow(run, "term int, df bigint").groupBy("term").agg(F.sum("df").alias("df")).toLocalIterator():
        out[r["term"]] = r["df"]
    return out


class Searcher:
    """Best documents per item over the batches of a task."""

    def __init__(self, items: Items, weights: np.ndarray, n_docs: int, n_terms: int, top: int = TOP):
        self.items, self.weights, self.n_docs, self.n_terms, self.top = items, weights, n_docs, n_terms, top
        self.best: list[list[tuple]] = [[] for _ in items.ids]
        self.weakest = np.ones(len(items.ids), np.int64)  # a score of zero is no hit
        self.column = np.zeros(len(weights), np.int64)
        self.pairs = self.scored = 0
        self.leaf_items = {k: (own, np.concatenate([items.terms[i] for i in own]), np.cumsum([0, *[len(items.terms[i]) for i in own]])) for k, (own, _, below) in enumerate(items.nodes) if not below}
        self.group = []
        for n in items.frontier(GROUPS):
            inside = np.zeros(len(weights))
            inside[items.nodes[n][1]] = 1.0
            self.group.append(inside)

    def add(self, doc_ids: list, n: np.ndarray, lengths: np.ndarray, terms: np.ndarray, counts: np.ndarray) -> None:
        """A batch: ``lengths`` says how many of ``terms`` and ``counts`` each document owns."""
        if not len(terms):
            return
        m = np.array([50 + 50 * int(x) * self.n_docs // self.n_terms for x in n], np.int64)
        doc = np.repeat(np.arange(len(n)), lengths)
        tf = counts.astype(np.int64)
        value = self.weights[terms] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[doc]))
        kin = np.stack([np.bincount(doc, value * inside[terms], len(n)) for inside in self.group])
        order = np.lexsort((-kin.max(axis=0), kin.argmax(axis=0)))
        order = order[lengths[order] > 0]
        place = np.empty(len(n), np.int64)
        place[order] = np.arange(len(order))
        at = place[doc]
        by = np.lexsort((terms, at))
        self.doc_ids = [doc_ids[i] for i in order]
        self.at, self.terms, self.value = at[by], terms[by].astype(np.int64), value[by]
        self.levels = self._maxima()
        self.dense = np.zeros((len(self.levels), len(self.weights)), np.int64)
        self.pairs += len(order) * len(self.items.ids)
        self._visit(len(self.levels) - 1, 0, [0])

    def _maxima(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Per level, leaves first: where each node's entries begin, their terms, and the largest values."""
        width = len(self.weights)
        key, value, levels = self.at // LEAF_DOCS * width + self.terms, self.value, []
        while True:
            by = np.argsort(key, kind="stable")
            key, first = np.unique(key[by], return_index=True)
            value = np.maximum.reduceat(value[by], first)
            nodes = int(key[-1]) // width + 1
            levels.append((np.searchsorted(key, np.arange(nodes + 1) * width), key % width, value))
            if nodes == 1:
                return levels
            key = key // width // FANOUT * width + key % width

    def _visit(self, level: int, node: int, wanted: list[int]) -> None:
        """Follows the pairs of a document node with item nodes whose bound reaches their weakest score."""
        begin, terms, value = self.levels[level]
        own = slice(begin[node], begin[node + 1])
        dense, nodes, live = self.dense[level], self.items.nodes, []
        dense[terms[own]] = value[own]
        wanted = list(wanted)
        while wanted:
            i = wanted.pop()
            items, union, children = nodes[i]
            if dense[union].sum() < self.weakest[items].min():
                continue
            if level and children:
                live += children
            elif children:
                wanted += children
            else:
                live.append(i)
        dense[terms[own]] = 0
        if not live:
            return
        if not level:
            self._score(node, live, terms[own], value[own])
            return
        below = self.levels[level - 1]
        children = range(node * FANOUT, min((node + 1) * FANOUT, len(below[0]) - 1))
        for c in children:
            self._visit(level - 1, c, live)

    def _score(self, leaf: int, live: list[int], terms: np.ndarray, most: np.ndarray) -> None:
        """Exact scores of a leaf's documents for the items whose own bound still reaches their weakest score."""
        self.column[terms] = np.arange(1, len(terms) + 1)
        most = np.concatenate([[0], most])
        lo, hi = np.searchsorted(self.at, [leaf * LEAF_DOCS, (leaf + 1) * LEAF_DOCS])
        rows = min(LEAF_DOCS, len(self.doc_ids) - leaf * LEAF_DOCS)
        values = np.zeros((rows, len(terms) + 1), np.int64)
        values[self.at[lo:hi] - leaf * LEAF_DOCS, self.column[self.terms[lo:hi]]] = self.value[lo:hi]
        for node in live:
            items, columns, starts = self.leaf_items[node]
            columns = self.column[columns]
            near = np.nonzero(np.add.reduceat(most[columns], starts[:-1]) >= self.weakest[items])[0]
            if not len(near):
                continue
            if len(near) < len(items):
                lengths = starts[near + 1] - starts[near]
                columns = columns[np.repeat(starts[near], lengths) + np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)]
                items, starts = items[near], np.cumsum([0, *lengths])
            scores = np.add.reduceat(values[:, columns], starts[:-1], axis=1)
            self.scored += scores.size
            hit = scores >= self.weakest[items]
            for j in np.nonzero(hit.any(axis=0))[0]:
                i = items[j]
                found = [(-int(scores[r, j]), d is None, d) for r in np.nonzero(hit[:, j])[0] for d in [self.doc_ids[leaf * LEAF_DOCS + r]]]
                self.best[i] = heapq.nsmallest(self.top, self.best[i] + found)
                if len(self.best[i]) == self.top:
                    self.weakest[i] = max(1, -self.best[i][-1][0])
        self.column[terms] = 0

    def found(self) -> list[tuple[object, object, int]]:
        return [(self.items.ids[i], d, -s) for i, best in enumerate(self.best) for s, _, d in best]


def term_weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    """floor(1000 * ln((2N+2)/(2df+1))) in doubles."""
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)


def _search_block(docs: DataFrame, items: Items, out: StructType, top: int) -> DataFrame:
    rows = settle(term_rows(docs, items.vocabulary))
    total = rows.agg(F.count_if(F.col("n") > 0).alias("n_docs"), F.sum("n").alias("n_terms")).first()
    n_docs, n_terms = total["n_docs"], total["n_terms"] or 1
    weights = term_weights(document_counts(rows, len(items.vocabulary)), n_docs)
    arrow = to_arrow_schema(out)
    items.vocabulary = {}

    def run(batches):
        search = Searcher(items, weights, n_docs, n_terms, top)
        for b in batches:
            lists = b.column(2)
            search.add(b.column(0).to_pylist(), b.column(1).to_numpy(), lists.value_lengths().to_numpy(), lists.flatten().to_numpy(), b.column(3).flatten().to_numpy())
        found = search.found()
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], f.type) for k, f in enumerate(arrow)], schema=arrow)

    best = rows.mapInArrow(run, out)
    over = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return best.withColumn("rank", F.row_number().over(over)).where(F.col("rank") <= top)


def ranked_search(docs: DataFrame, items: DataFrame, top: int = TOP, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """Each item's ``top`` best documents: item_id, rank, doc_id, score.

    Missing and empty texts have no terms: such a document is never found and does not
    count, such an item has no rows.  Texts of any length are read whole.  Equal scores go
    by ascending doc_id, missing ids last; rows that repeat a doc_id are documents of their
    own, rows that repeat an item_id are one item.  Empty tables give no rows, and other
    columns are not read, whatever their names.
    """
    out = StructType([StructField("item_id", items.schema["item_id"].dataType), StructField("doc_id", docs.schema["doc_id"].dataType), StructField("score", LongType())])
    spark = docs.sparkSession
    path, empty = work_path(spark, "ranked"), True
    for block in item_blocks(items, block_terms):
        _search_block(docs, block, out, top).write.mode("append").parquet(path)
        empty = False
    found = spark.createDataFrame([], StructType([*out.fields, StructField("rank", LongType())])) if empty else spark.read.parquet(path)
    return found.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


ORACLE = r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
), tf AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY 1, 2),
docs AS (SELECT doc_id, count(*) AS n FROM words GROUP BY 1),
total AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM docs),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
items AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), scored AS (
  SELECT item_id, tf.doc_id, CAST(sum(CAST(floor(1000 * ln((2 * n_docs + 2) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM items JOIN df USING (term) JOIN tf USING (term) JOIN docs ON docs.doc_id = tf.doc_id CROSS JOIN total GROUP BY 1, 2
), ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50"""
