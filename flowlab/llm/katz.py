"""Katz backoff language model over whole documents.

Tasks cut documents into chunks and send each chunk's distinct words, then its
distinct word pairs, to tables that are partitioned by word and by context. A
table's task adds up what all chunks sent and answers every chunk with the global
counts of what it asked for; rows are packed arrays, so a chunk's words and pairs
cross the network once each way and nothing passes the driver but a dozen sums.
A context with many occurrences has its pairs spread over several partitions of
the table, and asks each of them.

Counts up to K are discounted by Good and Turing's estimate. A context's backoff
weight is what its discounts leave, divided by the lower-order probability of the
words not seen in it, so that the probabilities of all words and of one unknown
word add up to one in every context. A token's probability is looked up in the
pairs and, where its pair was not seen, recursively in the words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from flowlab.llm.bpe import opened, packed
from flowlab.llm.common import ASCII_LOWER, expand, fold_is, squeeze
from flowlab.session import work_path

HELD_OUT_MOD, HELD_OUT = 7, 2
#: Counts up to K are discounted.
K = 5
CHUNK_BYTES = 16 << 20
#: Partitions of the tables, at least, and the bytes of text for each; a task holds one, so it does not grow with the corpus.
BUCKETS, BUCKET_BYTES = 64, 32 << 20
#: The end of a text as a word; no word holds a blank.
END = b" "
WORDS, TEXTS, TOTALS = 0, 1, 2
ROW = "chunk string, kind int, bucket int, data binary"


def _row(chunk: str, kind: int, bucket: int, data: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([kind], pa.int32()), pa.array([bucket], pa.int32()), pa.array([data], pa.binary())], names=["chunk", "kind", "bucket", "data"])


def _rows(batches) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns))


def bucket_count(docs: DataFrame) -> int:
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    return max(BUCKETS, -(-size // BUCKET_BYTES))


def grouped(rows: DataFrame, key: str, make: Callable, schema: str) -> DataFrame:
    """``make(key, [(chunk, kind, bucket, data)])`` over the rows of each chunk or bucket, ordered by kind, bucket, chunk."""

    def run(batches):
        place = 0 if key == "chunk" else 2
        now, held = None, []
        for row in _rows(batches):
            if held and row[place] != now:
                yield from make(now, held)
                held = []
            now = row[place]
            held.append(row)
        if held:
            yield from make(now, held)

    return rows.select("chunk", "kind", "bucket", "data").repartition(key).sortWithinPartitions(key, "kind", "bucket", "chunk").mapInArrow(run, schema)


def chunked(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES, buckets: int = BUCKETS) -> DataFrame:
    """Per chunk: its words with their training counts by bucket, and its texts as word numbers.

    Word numbers follow the order of the words in the buckets; every text ends with END.
    """

    def run(batches):
        part, number = TaskContext.get().partitionId(), 0
        ids, train, codes, known, size = [], [], [], {END: 0}, 0

        def flush():
            words = list(known)
            dealt = np.fromiter((xxhash.xxh32_intdigest(w) % buckets for w in words), np.int64, len(words))
            order = np.argsort(dealt, kind="stable")
            new = np.empty(len(words), np.int64)
            new[order] = np.arange(len(words))
            lengths = np.array([len(c) for c in codes], np.int64)
            flat = new[np.concatenate(codes)]
            counts = np.bincount(flat, weights=np.repeat(np.array(train, np.int64), lengths), minlength=len(words)).astype(np.int64)
            bounds = np.searchsorted(dealt[order], np.arange(buckets + 1))
            listed = pa.array(words, pa.large_binary()).take(pa.array(order))
            name = f"{part}-{number}"
            for k in range(buckets):
                a, b = int(bounds[k]), int(bounds[k + 1])
                if a < b:
                    yield _row(name, WORDS, k, packed(word=listed.slice(a, b - a), count=counts[a:b]))
            yield _row(name, TEXTS, 0, packed(doc_id=pa.array(ids), train=pa.array(train, pa.int8()), length=lengths))
            yield _row(name, TEXTS, 1, squeeze(flat, np.array([new[0]])))

        for b in batches:
            for doc_id, text, learn in zip(b.column("doc_id").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), b.column("train").to_pylist()):
                own = []
                for w in (text or b"").translate(ASCII_LOWER).split():
                    code = known.get(w)
                    if code is None:
                        code = known[w] = len(known)
                    own.append(code)
                own.append(0)
                ids.append(doc_id)
                train.append(int(learn))
                codes.append(np.array(own, np.int64))
                size += len(text or b"") + 16
                if size >= chunk_bytes:
                    yield from flush()
                    number += 1
                    ids, train, codes, known, size = [], [], [], {END: 0}, 0
        if ids:
            yield from flush()

    return docs.select("doc_id", "text", (~fold_is(HELD_OUT_MOD, HELD_OUT)).alias("train")).mapInArrow(run, ROW)


def _counts_of_counts(counts: np.ndarray) -> np.ndarray:
    return np.bincount(np.minimum(counts, K + 2), minlength=K + 3)[: K + 2]


def word_table(chunks: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Answers each chunk's words with their global number and training count.

    Numbers are small for frequent words. A totals row per bucket has tokens, words and counts of counts.
    """

    def make(bucket, rows):
        total: dict[bytes, int] = {}
        for _, _, _, data in rows:
            own = opened(data)
            for w, c in zip(own.column("word").to_pylist(), own.column("count").to_pylist()):
                total[w] = total.get(w, 0) + c
        order = sorted(total, key=lambda w: (-total[w], w))
        number = {w: k * buckets + bucket for k, w in enumerate(order)}
        for chunk, _, _, data in rows:
            words = opened(data).column("word").to_pylist()
            yield _row(chunk, WORDS, bucket, squeeze(np.array([number[w] for w in words], np.int64), np.array([total[w] for w in words], np.int64)))
        counts = np.fromiter(total.values(), np.int64, len(total))
        yield _row("", TOTALS, bucket, squeeze(np.concatenate([[counts.sum(), (counts > 0).sum()], _counts_of_counts(counts)])))

    return grouped(chunks.where(F.col("kind") == WORDS), "bucket", make, ROW)


def totals(rows: DataFrame) -> np.ndarray:
    """The sum of the totals rows; there is one per bucket."""

    def run(batches):
        added = [expand(r[3])[0] for r in _rows(batches)]
        if added:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(added[0]))), pa.array(np.sum(added, axis=0))], names=["place", "n"])

    found = rows.where(F.col("kind") == TOTALS).select("chunk", "kind", "bucket", "data").mapInArrow(run, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(max((r["place"] for r in found), default=K + 3) + 1, np.int64)
    for r in found:
        out[r["place"]] = r["n"]
    return out


def discounts(n: np.ndarray) -> np.ndarray:
    """d[r] for counts r up to K from n[r] things of count r, r up to K + 1; d[0] is unused.

    Where copies in the corpus make Good and Turing's estimate give a factor that is not
    between 0 and 1, the n[r] are first smoothed by a line through their logarithms
    (simple Good-Turing); where no falling line fits, half a count is taken from each.
    """
    r = np.arange(1, K + 1)
    known = np.flatnonzero(n[1 : K + 2]) + 1
    tries = [n[1 : K + 2].astype(float)] if len(known) == K + 1 else []
    if len(known) > 1:
        slope, _ = np.polyfit(np.log(known), np.log(n[known]), 1)
        tries.append(np.arange(1, K + 2) ** float(slope))
    for sizes in tries:
        tail = (K + 1) * sizes[K] / sizes[0]
        found = ((r + 1) * sizes[1:] / (r * sizes[:-1]) - tail) / (1 - tail) if tail < 1 else np.zeros(K)
        if ((found > 0) & (found < 1)).all():
            return np.array([1.0, *found])
    return np.array([1.0, *((r - 0.5) / r)])


@dataclass(frozen=True)
class Unigrams:
    """Training tokens and words, discounts of word counts, the probability of the unknown word, the scale of the known ones."""

    tokens: int
    words: int
    discount: np.ndarray
    unknown: float
    scale: float

    @classmethod
    def of(cls, sums: np.ndarray) -> Unigrams:
        tokens, words, n = int(sums[0]), int(sums[1]), sums[2:]
        d = discounts(n)
        r = np.arange(1, K + 1)
        left = float(((1 - d[1:]) * r * n[1 : K + 1]).sum())
        if left > 0:
            return cls(tokens, words, d, left / tokens, 1.0)
        # No word of count K or less leaves anything: the unknown word has the share of one more token.
        return cls(tokens, words, d, 1 / (tokens + 1), tokens / (tokens + 1))

    def probability(self, counts: np.ndarray) -> np.ndarray:
        """Of words by their training count; those of count 0 are all the unknown word."""
        known = np.where(counts > K, 1.0, self.discount[np.minimum(counts, K)]) * counts / max(1, self.tokens)
        return np.where(counts > 0, self.scale * known, self.unknown)


class Pairs:
    """A chunk's distinct (context, word) pairs in the order in which they are asked for."""

    def __init__(self, texts: bytes, words: list[tuple[int, bytes]], tokens: int, buckets: int):
        self.codes, (end,) = expand(texts)
        known = [expand(d) for _, d in words]
        self.number = np.concatenate([k[0] for k in known])
        self.count = np.concatenate([k[1] for k in known])
        n = len(self.number)
        before = np.concatenate([[end], self.codes[:-1]])
        distinct, self.place = np.unique(before * n + self.codes, return_inverse=True)
        self.context, self.word = distinct // n, distinct % n
        # A context is spread over so many buckets that none gets more than a quarter of the mean load from it.
        parts = np.clip(4 * buckets * self.count // max(1, tokens), 1, buckets)
        first = (self.number * 0x9E3779B1 >> 7) % buckets
        own = parts[self.context]
        bucket = (first[self.context] + self.number[self.word] % own) % buckets
        hot = np.flatnonzero(parts > 1)
        hot = hot[np.isin(hot, self.context)]
        asked = [bucket * n + self.context, *((first[h] + np.arange(parts[h])) % buckets * n + h for h in hot.tolist())]
        #: (bucket, context) as asked; hot contexts ask all their buckets, so that each answers its share of the sums
        self.asked = np.unique(np.concatenate(asked))
        self.asked_bucket, self.asked_context = self.asked // n, self.asked % n
        self.order = np.lexsort((self.word, self.context, bucket))
        self.sizes = np.bincount(np.searchsorted(self.asked, (bucket * n + self.context)[self.order]), minlength=len(self.asked))
        self.bounds = np.searchsorted(self.asked_bucket, np.arange(buckets + 1))
        self.pair_bounds = np.concatenate([[0], np.cumsum(self.sizes)])[self.bounds]


def _by_kind(rows) -> tuple[bytes, bytes, list[tuple[int, bytes]], list[tuple[int, bytes]]]:
    texts = {bucket: data for _, kind, bucket, data in rows if kind == TEXTS}
    words = [(bucket, data) for _, kind, bucket, data in rows if kind == WORDS]
    pairs = [(bucket, data) for _, kind, bucket, data in rows if kind == 3]
    return texts[0], texts[1], words, pairs


def pair_requests(chunks: DataFrame, words: DataFrame, base: Unigrams, buckets: int = BUCKETS) -> DataFrame:
    """Each chunk's pairs by bucket: contexts with their number of pairs, then per pair word, training count and the word's count."""

    def make(chunk, rows):
        meta, texts, known, _ = _by_kind(rows)
        p = Pairs(texts, known, base.tokens, buckets)
        own = opened(meta)
        learn = np.repeat(own.column("train").to_numpy().astype(np.int64), own.column("length").to_numpy())
        counts = np.bincount(p.place, weights=learn, minlength=len(p.context)).astype(np.int64)[p.order]
        word = p.word[p.order]
        for b in range(buckets):
            i, j, a, z = p.bounds[b], p.bounds[b + 1], p.pair_bounds[b], p.pair_bounds[b + 1]
            if i < j:
                yield _row(chunk, 3, b, squeeze(p.number[p.asked_context[i:j]], p.sizes[i:j], p.number[word[a:z]], counts[a:z], p.count[word[a:z]]))

    texts = chunks.where(F.col("kind") == TEXTS)
    return grouped(texts.unionByName(words.where(F.col("kind") == WORDS)), "chunk", make, ROW)


def pair_table(requests: DataFrame, base: Unigrams) -> DataFrame:
    """Answers each chunk's pairs with their training counts, and its contexts with the numbers of seen pairs of count 1 to K and the words' summed probability."""

    def make(bucket, rows):
        asked = [expand(data) for _, _, _, data in rows]
        context = [np.repeat(a[0], a[1]) for a in asked]
        keys = [_joined(c, a[2]) for c, a in zip(context, asked)]
        distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
        counts = np.bincount(place, weights=np.concatenate([a[3] for a in asked]), minlength=len(distinct)).astype(np.int64)
        lower = np.zeros(len(distinct), np.int64)
        lower[place] = np.concatenate([a[4] for a in asked])
        own_context = np.zeros(len(distinct), np.int64)
        own_context[place] = np.concatenate(context)
        seen = counts > 0
        listed = np.unique(np.concatenate([a[0] for a in asked]))
        at = np.searchsorted(listed, own_context[seen])
        few = [np.bincount(at[counts[seen] == r], minlength=len(listed)) for r in range(1, K + 1)]
        mass = np.bincount(at, weights=base.probability(lower[seen]), minlength=len(listed))
        start = 0
        for (chunk, _, _, _), a, k in zip(rows, asked, keys):
            mine = np.searchsorted(listed, a[0])
            yield _row(chunk, 3, bucket, squeeze(counts[place[start : start + len(k)]], *(f[mine] for f in few), mass[mine].astype(float)))
            start += len(k)
        yield _row("", TOTALS, bucket, squeeze(_counts_of_counts(counts)))

    return grouped(requests, "bucket", make, ROW)


def _joined(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Both numbers as one; beyond 32 bits as a pair of numbers that sorts the same."""
    if (len(context) and max(int(context.max()), int(word.max())) >= 1 << 32) or context.dtype == object:
        raise ValueError("more than 2**32 word numbers: raise the number of buckets")
    return (context.astype(np.uint64) << np.uint64(32)) | word.astype(np.uint64)


def pair_log10(p: Pairs, answers: list[list[np.ndarray]], base: Unigrams, d: np.ndarray) -> np.ndarray:
    """log10 probability of each distinct pair of a chunk, in the order of ``p.context``."""
    counts = np.zeros(len(p.context), np.int64)
    counts[p.order] = np.concatenate([a[0] for a in answers])
    few = [np.bincount(p.asked_context, weights=np.concatenate([a[r] for a in answers]), minlength=len(p.number)) for r in range(1, K + 1)]
    mass = np.bincount(p.asked_context, weights=np.concatenate([a[K + 1] for a in answers]), minlength=len(p.number))
    r = np.arange(1, K + 1)
    left = sum((1 - d[k]) * k * few[k - 1] for k in r)
    times = p.count.astype(float)
    # A context of which no pair is discounted keeps the share of one more occurrence for unseen words.
    bare = (left <= 0) & (times > 0)
    left_share = np.where(bare, 1 / (times + 1), left / np.maximum(times, 1))
    scale = np.where(bare, times / (times + 1), 1.0)
    unseen = 1 - mass
    weight = np.where(times > 0, left_share / np.maximum(unseen, 1e-12), 1.0)
    c = p.context
    seen = scale[c] * np.where(counts > K, 1.0, d[np.minimum(counts, K)]) * counts / np.maximum(times[c], 1)
    backed = weight[c] * base.probability(p.count[p.word])
    return np.log10(np.where(counts > 0, seen, backed))


def scores(chunks: DataFrame, words: DataFrame, pairs: DataFrame, base: Unigrams, d: np.ndarray, key: str, kind: pa.DataType, buckets: int = BUCKETS) -> DataFrame:
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def make(chunk, rows):
        meta, texts, known, asked = _by_kind(rows)
        p = Pairs(texts, known, base.tokens, buckets)
        own = opened(meta)
        lengths = own.column("length").to_numpy()
        starts = np.cumsum(lengths) - lengths
        pair = pair_log10(p, [expand(data) for _, data in asked], base, d)
        flat = np.log10((p.count + 1) / (base.tokens + base.words + 1))
        columns = [
            own.column("doc_id").cast(kind), pa.array(own.column("train").to_numpy() == 0), pa.array(lengths), pa.array(np.add.reduceat((p.count > 0).astype(np.int64)[p.codes], starts)),
            pa.array(np.full(len(lengths), base.tokens)), pa.array(np.add.reduceat(flat[p.codes], starts)), pa.array(np.add.reduceat(pair[p.place], starts)),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = chunks.where(F.col("kind") == TEXTS).unionByName(words.where(F.col("kind") == WORDS)).unionByName(pairs.where(F.col("kind") == 3))
    return grouped(rows, "chunk", make, f"doc_id {key}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def language_scores(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES, buckets: int | None = None) -> DataFrame:
    """Scores of every whole text under the model learned from the training fold, one row per row of ``docs``.

    A missing text is empty: its one token is the end. Repeated rows give repeated
    results and count as often in training. Without training rows every word is
    unknown with probability one. Other columns are not read. Without ``buckets`` the
    number of the tables' partitions follows from the bytes of text. The tables are
    written to the shared folder; the input's partitions must come out the same
    when a lost task runs again, as those of files do.
    """
    spark = docs.sparkSession
    base_path = work_path(spark, "katz")
    buckets = buckets or bucket_count(docs)

    def stored(name: str, rows: DataFrame) -> DataFrame:
        rows.write.partitionBy("kind").parquet(f"{base_path}/{name}")
        return spark.read.schema(ROW).parquet(f"{base_path}/{name}")

    chunks = stored("chunks", chunked(docs, chunk_bytes, buckets))
    words = stored("words", word_table(chunks, buckets))
    base = Unigrams.of(totals(words))
    pairs = stored("pairs", pair_table(pair_requests(chunks, words, base, buckets), base))
    d = discounts(totals(pairs))
    key = docs.schema["doc_id"].dataType
    return scores(chunks, words, pairs, base, d, key.simpleString(), to_arrow_type(key), buckets)
