"""Benchmark decontamination: item-sized windows of documents near benchmark items in edit distance.

Words are compared without case and punctuation. The CGK walk embeds a word
sequence so that edit distance becomes Hamming distance: at every step it writes
the word it stands on, and a random bit of (step, word) tells whether it moves
on. Sequences few edits apart fall back into step. Tables of sampled steps
(bit-sampling LSH) over several walks propose (window, item) pairs; the number of
tables follows from the target recall and the agreement that edited items show.
Every proposed pair is verified by its exact edit distance.

Windows are only embedded around words where a match is possible at all: cut an
item into one piece more than its allowed edits, and any match holds one piece
unchanged. Which item, and where it starts, is left to the walk.
"""

from __future__ import annotations

import functools
import math
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from flowlab.llm.common import sha256_hex

#: Words of an item that may be edited, as a share, rounded down: similarity of 0.8 and more.
EDIT_SHARE = 0.2
#: Items of fewer words name nothing specific and are not searched.
MIN_ITEM_WORDS = 5
#: Of one window at the median agreement; a match has several windows near its start, which raise it.
TARGET_RECALL = 0.999
SAMPLED = 3
WALKS = 6
#: Bytes of benchmark text that are searched at once; more text is searched in blocks of items.
BLOCK_BYTES = 16 << 20
CACHED_WORDS = 400_000
GATE_BITS = 22
POLY = np.uint64(0x9E3779B97F4A7C15)

NOT_WORD = re.compile(r"[\W_]+")


class Words:
    """Codes of words: a 32-bit hash of the lower-cased letters and digits, 0 for words without any."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def code(self, word: bytes) -> int:
        plain = NOT_WORD.sub("", word.decode("utf-8", "replace").lower())
        return (xxhash.xxh32_intdigest(plain.encode()) | 1) if plain else 0

    def codes(self, data: bytes | None) -> np.ndarray:
        """The codes of all words, 0 where a word has no letter or digit."""
        words = data.split() if data else []
        known = self.known
        try:
            return np.fromiter(map(known.__getitem__, words), np.uint32, len(words))
        except KeyError:
            if len(known) >= CACHED_WORDS:
                known.clear()
            for w in set(words):
                if w not in known:
                    known[w] = self.code(w)
            return np.fromiter(map(known.__getitem__, words), np.uint32, len(words))


@functools.lru_cache(maxsize=1)
def worker_words() -> Words:
    return Words()


def allowed_edits(n: int) -> int:
    return int(n * EDIT_SHARE + 1e-9)


def semi_global(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Least edit distance of the whole item to a stretch of the text, and where the first best stretch ends."""
    row = np.zeros(len(text) + 1, np.int64)
    steps = np.arange(len(text) + 1)
    for i, c in enumerate(item, 1):
        new = np.empty_like(row)
        new[0] = i
        new[1:] = np.minimum(row[:-1] + (text != c), row[1:] + 1)
        row = np.minimum.accumulate(new - steps) + steps
    end = int(np.argmin(row))
    return int(row[end]), end


def best_stretch(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Edit distance, start and end of the best stretch of the text."""
    distance, end = semi_global(item, text)
    _, back = semi_global(item[::-1], text[:end][::-1])
    return distance, end - back, end


def walk_bits(codes: np.ndarray, step: int, seed: int) -> np.ndarray:
    x = codes * np.uint32((2 * (step * 7919 + seed * 104_729) + 0x9E3779B1) & 0xFFFFFFFF | 1)
    return ((x ^ (x >> np.uint32(15))) * np.uint32(0x85EBCA6B)) >> np.uint32(31)


def embed(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int, keep: list[int]) -> np.ndarray:
    """The walk's words at the steps ``keep`` (ascending), for windows from ``starts`` that end before ``ends``."""
    at = starts.copy()
    out = np.empty((len(keep), len(starts)), np.uint32)
    wanted = {s: k for k, s in enumerate(keep)}
    last = len(codes) - 1
    for step in range(keep[-1] + 1):
        own = np.where(at < ends, codes[np.minimum(at, last)], np.uint32(0))
        if step in wanted:
            out[wanted[step]] = own
        at += walk_bits(own, step, seed)
    return out


def table_keys(walked: np.ndarray, columns: list[int]) -> np.ndarray:
    key = np.zeros(walked.shape[1], np.uint64)
    for c in columns:
        key = key * POLY + walked[c]
    return key ^ (key >> np.uint64(29))


@dataclass
class SizeClass:
    """Items of about one size: the windows' size, and per walk its sampled steps and tables."""

    width: int
    items: np.ndarray
    walks: list[tuple[int, list[int], list[tuple[list[int], np.ndarray, np.ndarray]]]] = field(default_factory=list)


def tables_needed(agreement: float, sampled: int = SAMPLED, recall: float = TARGET_RECALL) -> int:
    """Tables of ``sampled`` steps that propose a pair with probability ``recall``, if a step agrees with probability ``agreement``."""
    hit = min(max(agreement, 0.1), 1 - 1e-9) ** sampled
    return math.ceil(math.log(1 - recall) / math.log(1 - hit))


def edited(item: np.ndarray, edits: int, rng: np.random.Generator) -> np.ndarray:
    out = item.tolist()
    for _ in range(edits):
        kind, at = rng.integers(3), int(rng.integers(max(1, len(out))))
        if kind == 0 and out:
            out[at] = int(rng.integers(1, 2**32))
        elif kind == 1:
            out.insert(at, int(rng.integers(1, 2**32)))
        elif out:
            out.pop(at)
    return np.array(out, np.uint32)


def agreement(items: list[np.ndarray], width: int, rng: np.random.Generator) -> float:
    """The share of steps that agree between items and copies with all allowed edits: the median over trials."""
    shares = []
    for trial in range(40):
        item = items[trial % len(items)]
        copy = edited(item, allowed_edits(len(item)), rng)
        if not len(copy):
            continue
        keep = list(range(2 * width))
        one, two = (embed(x, np.zeros(1, np.int64), np.array([len(x)]), 1 + trial, keep) for x in (item, copy))
        shares.append(float((one == two).mean()))
    return float(np.median(shares)) if shares else 1.0


class Index:
    """What a task needs to search its documents: the items' codes, the gate and the tables. Its size follows the benchmark block's."""

    def __init__(self, item_ids: list, texts: list[bytes | None]):
        words = Words()
        coded = [(i, c[c > 0]) for i, c in zip(item_ids, map(words.codes, texts)) if (c > 0).sum() >= MIN_ITEM_WORDS]
        self.ids = [i for i, _ in coded]
        self.items = [c for _, c in coded]
        rng = np.random.default_rng(7)
        self.gates: list[tuple[int, np.ndarray]] = self._gates()
        self.classes = [self._class(k, rng) for k in self._sizes()]

    def _gates(self) -> list[tuple[int, np.ndarray]]:
        pieces: dict[int, set[int]] = {}
        for item in self.items:
            count = allowed_edits(len(item)) + 1
            bounds = [len(item) * k // count for k in range(count + 1)]
            for a, b in zip(bounds, bounds[1:]):
                pieces.setdefault(b - a, set()).add(int(grams(item, b - a)[a]))
        return [(n, np.array(sorted(p), np.uint64)) for n, p in sorted(pieces.items())]

    def _sizes(self) -> list[list[int]]:
        order = sorted(range(len(self.items)), key=lambda k: len(self.items[k]))
        classes: list[list[int]] = []
        for k in order:
            if classes and len(self.items[k]) <= 1.2 * len(self.items[classes[-1][0]]):
                classes[-1].append(k)
            else:
                classes.append([k])
        return classes

    def _class(self, members: list[int], rng: np.random.Generator) -> SizeClass:
        width = len(self.items[members[0]])
        count = tables_needed(agreement([self.items[k] for k in members], width, rng))
        own = SizeClass(width, np.array(members))
        flat = np.concatenate([self.items[k] for k in members])
        ends = np.cumsum([len(self.items[k]) for k in members])
        starts = ends - [len(self.items[k]) for k in members]
        for seed in range(WALKS):
            mine = [sorted(rng.choice(2 * width, SAMPLED, replace=False).tolist()) for t in range(count) if t % WALKS == seed]
            if not mine:
                continue
            keep = sorted({s for steps in mine for s in steps})
            walked = embed(flat, starts, ends, seed, keep)
            tables = []
            for steps in mine:
                columns = [keep.index(s) for s in steps]
                keys = table_keys(walked, columns)
                order = np.argsort(keys, kind="stable")
                tables.append((columns, keys[order], own.items[order]))
            own.walks.append((seed, keep, tables))
        return own

    @functools.cached_property
    def bitmaps(self) -> list[np.ndarray]:
        made = []
        for _, hashes in self.gates:
            bits = np.zeros(1 << GATE_BITS, bool)
            bits[(hashes >> np.uint64(64 - GATE_BITS)).astype(np.int64)] = True
            made.append(bits)
        return made

    def possible(self, codes: np.ndarray) -> np.ndarray:
        """Positions at which a piece of some item begins."""
        spots = [np.empty(0, np.int64)]
        for (n, hashes), bits in zip(self.gates, self.bitmaps):
            own = grams(codes, n)
            at = np.flatnonzero(bits[(own >> np.uint64(64 - GATE_BITS)).astype(np.int64)])
            spots.append(at[np.isin(own[at], hashes)])
        return np.unique(np.concatenate(spots))

    def search(self, documents: list[np.ndarray]) -> list[tuple[int, int, int, int, int]]:
        """(document, item, distance, start, end) in words, the best stretch of every item that a document holds."""
        lengths = np.array([len(d) + 1 for d in documents], np.int64)
        ends = np.cumsum(lengths) - 1
        firsts = ends - (lengths - 1)
        codes = np.zeros(int(lengths.sum()), np.uint32)
        for first, d in zip(firsts.tolist(), documents):
            codes[first : first + len(d)] = d
        spots = self.possible(codes) if self.items else np.empty(0, np.int64)
        if not len(spots):
            return []
        pairs: dict[tuple[int, int], list[int]] = {}
        for c in self.classes:
            reach = int(1.2 * c.width) + allowed_edits(int(1.2 * c.width)) + 1
            starts = np.unique((spots[:, None] - np.arange(reach)[None, :]).ravel()) if len(spots) < 200_000 else _starts_near(spots, reach)
            starts = starts[starts >= 0]
            doc = np.searchsorted(ends, starts)
            inside = starts < ends[doc]
            starts, doc = starts[inside], doc[inside]
            for seed, keep, tables in c.walks:
                walked = embed(codes, starts, ends[doc], seed, keep)
                for columns, keys, members in tables:
                    own = table_keys(walked, columns)
                    low, high = np.searchsorted(keys, own, "left"), np.searchsorted(keys, own, "right")
                    for w in np.flatnonzero(high > low).tolist():
                        for k in members[low[w] : high[w]].tolist():
                            pairs.setdefault((int(doc[w]), k), []).append(int(starts[w]))
        return self._verified(pairs, codes, firsts, ends)

    def _verified(self, pairs, codes, firsts, ends) -> list[tuple[int, int, int, int, int]]:
        found = []
        for (doc, k), starts in pairs.items():
            item = self.items[k]
            edits, n = allowed_edits(len(item)), len(item)
            best = None
            covered = -1
            for s in sorted(set(starts)):
                if s <= covered:
                    continue
                a, b = max(int(firsts[doc]), s - edits), min(int(ends[doc]), s + 2 * n + edits)
                covered = s + n // 2
                distance, start, end = best_stretch(item, codes[a:b])
                if distance <= edits and (best is None or distance < best[0]):
                    best = (distance, a + start - int(firsts[doc]), a + end - int(firsts[doc]))
            if best:
                found.append((doc, k, *best))
        return sorted(found)


def _starts_near(spots: np.ndarray, reach: int) -> np.ndarray:
    """Every position up to ``reach`` before a spot, without the grid of both."""
    marks = np.zeros(int(spots[-1]) + 2, np.int64)
    np.add.at(marks, np.maximum(spots - reach + 1, 0), 1)
    np.add.at(marks, spots + 1, -1)
    return np.flatnonzero(np.cumsum(marks) > 0)


def grams(codes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n words from each position; the last ones read past the end as zeros."""
    padded = np.concatenate([codes.astype(np.uint64), np.zeros(n, np.uint64)])
    out = np.zeros(len(codes), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = (out + padded[k : k + len(codes)] + np.uint64(1)) * POLY
            out ^= out >> np.uint64(32)
        return out * POLY


def word_spans(data: bytes) -> list[tuple[int, int]]:
    """Code-point spans of the words that have a code."""
    text = data.decode("utf-8", "replace")
    return [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", text) if NOT_WORD.sub("", m.group())]


def blocks(benchmark: DataFrame) -> list[tuple[list, list]]:
    """The benchmark's items in blocks of about BLOCK_BYTES, which are searched one after the other."""
    items = benchmark.select("item_id", F.col("text").cast("binary").alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = int(size // BLOCK_BYTES) + 1
    found = []
    for k in range(count):
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(count)) == k).collect()
        rows.sort(key=lambda r: (r["item_id"] is not None, r["item_id"] or 0, bytes(r["text"] or b"")))
        found.append(([r["item_id"] for r in rows], [None if r["text"] is None else bytes(r["text"]) for r in rows]))
    return found


def batch_matches(index: Index, texts: list[bytes | None]):
    words = worker_words()
    coded = [words.codes(t) for t in texts]
    return index.search([c[c > 0] for c in coded])


def _indexed(spark, block: tuple[list, list]):
    """The block as a broadcast; every worker builds its index once, known by what is in the block."""
    held = spark.sparkContext.broadcast(block)
    name = sha256_hex(repr(block).encode("utf-8", "replace"))

    def index() -> Index:
        slot = _slot(name)
        if not slot:
            slot.append(Index(*held.value))
        return slot[0]

    return index


@functools.lru_cache(maxsize=2)
def _slot(name: str) -> list[Index]:
    return []


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, distance, item_words, start, stop) of every document and item it holds, documents in whole.

    ``distance`` is the edit distance in words of the best stretch, at most EDIT_SHARE of
    the item; start and stop are its code points in the text. Documents without a
    match have no row. Missing texts and items hold nothing; repeated rows give repeated
    results; several items with one text are all reported.
    """
    key, item_key = docs.schema["doc_id"].dataType, benchmark.schema["item_id"].dataType
    kind, item_kind = to_arrow_type(key), to_arrow_type(item_key)
    names = ["doc_id", "item_id", "distance", "item_words", "start", "stop"]
    found = None
    for block in blocks(benchmark):
        indexed = _indexed(docs.sparkSession, block)

        def run(batches, indexed=indexed):
            index = indexed()
            for b in batches:
                ids, texts = b.column("doc_id").to_pylist(), b.column("text").cast(pa.binary()).to_pylist()
                rows, spans = [], {}
                for doc, item, distance, start, end in batch_matches(index, texts):
                    own = spans.setdefault(doc, word_spans(texts[doc]) if doc not in spans else None)
                    rows.append((ids[doc], index.ids[item], distance, len(index.items[item]), own[start][0], own[end - 1][1]))
                if rows:
                    kinds = [kind, item_kind, pa.int32(), pa.int32(), pa.int64(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(list(v), t) for v, t in zip(zip(*rows), kinds)], names=names)

        own = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {key.simpleString()}, item_id {item_key.simpleString()}, distance int, item_words int, start long, stop long")
        found = own if found is None else found.unionByName(own)
    return found


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold no benchmark item."""
    names = docs.columns
    for block in blocks(benchmark):
        indexed = _indexed(docs.sparkSession, block)
        inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("text").alias("text"))

        def run(batches, indexed=indexed):
            index = indexed()
            for b in batches:
                hit = {m[0] for m in batch_matches(index, b.column("text").cast(pa.binary()).to_pylist())}
                left = [i for i in range(b.num_rows) if i not in hit]
                if left:
                    yield pa.RecordBatch.from_arrays([b.column("row").take(pa.array(left))], names=["row"])

        docs = inner.mapInArrow(run, inner.select("row").schema).select("row.*")
    return docs
