"""Mixing sources to target weights: packed blocks, drawn per output shard and joined by index.

Each source's words are packed, document after document, into blocks of fixed length.  A
shard of the mix has a fixed number of slots; how many of them each source fills is a
multinomial draw, given that the counts over all shards make up the sources' targets
(multinomial counts with known totals are hypergeometric).  The draw descends a binary
tree over the shards, halving the totals with a generator seeded by the node, so each
task finds its shard's counts, and the slots that earlier shards have used, by itself.
Slot j of a source takes block p(j mod n) of its n blocks, where p is a keyed permutation
of the block numbers, another one for each pass: passes differ, and no block is
used more than ceil(slots / n) times.  Slots then meet blocks by (source, index).

Sources are few beside documents, but are not trusted to be: up to ``MAX_SOURCES``
totals are taken to the driver, more raise an error.  A source that holds a third of all
words is no hot key, since words and blocks are dealt by number within the source, and
equal rows are one row with a count until their places are known.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlab.session import settle, values

#: Words of a block, and slots of a shard of the mix.
BLOCK_WORDS, SHARD_SLOTS = 128, 16_384
WEIGHTS, REPEATS = (5, 2, 1), 3
MAX_SOURCES = 1_000_000
#: Different rows that share a bucket when places are summed, and equal rows laid out by one task at a time.
BUCKET_ROWS, RUN_ROWS = 2_000, 10_000
#: Above this, numpy's exact hypergeometric draw is replaced by its normal limit.
EXACT_DRAW = 500_000_000

#: The six ASCII white-space characters.
SPACES = " \t\n\x0b\x0c\r"
_WORD, _GAP = r"[^ \t\n\x0B\f\r]+", r"[ \t\n\x0B\f\r]+"


def word_count(text: Column) -> Column:
    """Runs of characters other than ASCII white space; a missing text has none.  Each word becomes one mark, blanks go."""
    marks = F.translate(F.regexp_replace(F.coalesce(text, F.lit("")), _WORD, "x"), SPACES, "")
    return F.length(marks).cast("long")


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> list[float]:
    """Words that each source, in order, gives to a mix as large as all of them: by weight, up to ``repeats`` times its size.

    What a full source cannot take is shared by weight among the others, until none is above its limit.
    """
    share = [weights[i % len(weights)] for i in range(len(sizes))]
    out: list[float] = [0.0] * len(sizes)
    free, rest, weight = list(range(len(sizes))), float(sum(sizes)), sum(share)
    while free and rest > 0:
        full = [i for i in free if rest * share[i] / weight > repeats * sizes[i]]
        if not full:
            for i in free:
                out[i] = rest * share[i] / weight
            break
        for i in full:
            out[i] = float(repeats * sizes[i])
        rest, weight = rest - sum(out[i] for i in full), weight - sum(share[i] for i in full)
        taken = set(full)
        free = [i for i in free if i not in taken]
    return out


def halved(totals: np.ndarray, slots: int, rng: np.random.Generator) -> np.ndarray:
    """How many of each source's ``totals`` fall on ``slots`` slots drawn without return: multinomial counts given the totals."""
    out, left, rest = np.zeros(len(totals), np.int64), int(totals.sum()), slots
    for i, own in enumerate(totals.tolist()):
        other = left - own
        if own and rest:
            if left <= EXACT_DRAW:
                drawn = int(rng.hypergeometric(own, other, rest))
            else:
                share = rest / left
                spread = (own * share * (1 - share) * other / left) ** 0.5
                drawn = min(own, rest, max(0, rest - other, round(own * share + spread * rng.standard_normal())))
            out[i] = drawn
            rest -= drawn
        left = other
    return out


def permuted(slots: np.ndarray, size: int, key: tuple[int, ...]) -> np.ndarray:
    """A keyed permutation of range(size) at ``slots``: four Feistel rounds, walked on until inside the range."""
    half = max(1, (int(size - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = np.random.default_rng(key).integers(1, 1 << 63, (4, 2), dtype=np.uint64) | np.uint64(1)
    out = slots.astype(np.uint64)
    walk = np.arange(len(out))
    while len(walk):
        high, low = out[walk] >> np.uint64(half), out[walk] & mask
        for add, factor in keys:
            mixed = (low + add) * factor
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
            high, low = low, high ^ ((mixed >> np.uint64(35)) & mask)
        out[walk] = (high << np.uint64(half)) | low
        walk = walk[out[walk] >= size]
    return out.astype(np.int64)


@dataclass(frozen=True)
class Mixture:
    """A planned mix.

    ``sources``: source, source_no, source_size, target, n_blocks, n_slots.
    ``places``: doc_id, digest, size, source_no, start, one row per document; ``start`` is its first word within the source.
    ``slots``: shard, slot, source_no, block, pass_no.
    """

    docs: DataFrame
    sources: DataFrame
    places: DataFrame
    slots: DataFrame
    block_words: int

    @cached_property
    def pieces(self) -> DataFrame:
        """What each block holds of each document: source_no, block, start, doc_id, digest, skip, words."""
        size = F.lit(self.block_words)
        first, last = F.expr(f"start div {self.block_words}"), F.expr(f"(start + size - 1) div {self.block_words}")
        cut = self.places.where("size > 0").withColumn("block", F.explode(F.sequence(first, last)))
        skip = F.greatest(F.lit(0), F.col("block") * size - F.col("start"))
        words = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * size) - F.col("start") - skip
        return cut.select("source_no", "block", "start", "doc_id", "digest", "size", skip.alias("skip"), words.alias("words"))

    def taken(self) -> DataFrame:
        """Every document with the words that the mix takes from it: doc_id, source_no, size, taken."""
        times = self.slots.groupBy("source_no", "block").agg(F.count(F.lit(1)).alias("times"))
        used = self.pieces.join(times, ["source_no", "block"], "left").groupBy("source_no", "start", "doc_id", "size").agg(
            F.sum(F.col("words") * F.coalesce("times", F.lit(0))).alias("taken")
        )
        none = self.places.where("size = 0").select("doc_id", "source_no", "size", F.lit(0).cast("long").alias("taken"))
        return used.select("doc_id", "source_no", "size", "taken").unionByName(none)

    def texts(self) -> DataFrame:
        """The mix itself: shard, slot, source_no, block, text (the block's words, joined by one blank).

        Blocks are put together once and meet their slots by index.
        """
        text = F.regexp_replace(F.regexp_replace("text", f"^{_GAP}|{_GAP}$", ""), _GAP, " ")
        words = _with_digest(self.docs).select("doc_id", "digest", F.split(text, " ").alias("words_")).dropDuplicates(["doc_id", "digest"])
        cut = F.transform(
            F.sequence(F.expr(f"start div {self.block_words}"), F.expr(f"(start + size - 1) div {self.block_words}")),
            lambda b: F.struct(
                b.alias("block"),
                F.array_join(
                    F.slice(
                        "words_", (F.greatest(F.lit(0), b * self.block_words - F.col("start")) + 1).cast("int"),
                        (F.least(F.col("start") + F.col("size"), (b + 1) * self.block_words) - F.greatest(F.col("start"), b * self.block_words)).cast("int"),
                    ), " ",
                ).alias("text"),
            ),
        )
        own = self.places.where("size > 0").alias("p").join(words.alias("w"), F.expr("p.doc_id <=> w.doc_id AND p.digest = w.digest"))
        parts = own.select("source_no", "start", F.inline(cut))
        blocks = parts.groupBy("source_no", "block").agg(F.array_sort(F.collect_list(F.struct("start", "text"))).alias("parts"))
        texts = blocks.select("source_no", "block", F.array_join(F.transform("parts", lambda p: p["text"]), " ").alias("text"))
        return self.slots.join(texts, ["source_no", "block"]).select("shard", "slot", "source_no", "block", "text")


def _with_digest(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", "text", F.xxhash64(F.coalesce("text", F.lit("")).cast("binary")).alias("digest"))


def plan_mix(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = 11,
    bucket_rows: int = BUCKET_ROWS,
) -> Mixture:
    """Plans a mix of ``docs`` (doc_id, source, text) that is as large as all of them together.

    Missing and empty texts have no words and are not taken; a missing source is one of its
    own and comes last; a missing doc_id is an id like any other.  Texts of any length
    are cut at blocks.  Repeated rows are packed one after another, as often as they occur.
    An empty table gives an empty mix.  Other columns are not read, whatever their names.
    The plan depends on ids, texts, sources and ``seed`` alone, not on files or partitions.
    """
    spark = docs.sparkSession
    sized = _with_digest(docs).withColumn("size", word_count(F.col("text")))
    rows = settle(sized.groupBy("source", "doc_id", "digest", "size").agg(F.count(F.lit(1)).alias("copies")))
    found = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"))
    known = [(r["source"], r["source_size"]) for r in found.limit(MAX_SOURCES + 1).toLocalIterator()]
    if len(known) > MAX_SOURCES:
        raise ValueError(f"a mix takes at most {MAX_SOURCES} sources")
    known.sort(key=lambda s: (s[0] is None, s[0] or ""))
    wanted = targets([size for _, size in known], weights, repeats)
    blocks = [-(-size // block_words) for _, size in known]
    # Slots are counted in blocks as full as the source's are on average, so that a short last block costs no words.
    slots = [min(repeats * n, round(n * t / size)) if size else 0 for (_, size), t, n in zip(known, wanted, blocks)]
    table = [(source, i, size, t, n, k) for i, ((source, size), t, n, k) in enumerate(zip(known, wanted, blocks, slots))]
    sources = values(spark, table, "source string, source_no int, source_size bigint, target double, n_blocks bigint, n_slots bigint")
    places = settle(_placed(rows, sources, bucket_rows))
    return Mixture(docs, sources, places, settle(_slots(spark, np.array(blocks, np.int64), np.array(slots, np.int64), shard_slots, seed)), block_words)


def _placed(rows: DataFrame, sources: DataFrame, bucket_rows: int) -> DataFrame:
    """Where each document begins within its source, in order of bucket, doc_id and digest.

    Buckets are dealt by hash; places within them and the sums of whole buckets are two small steps.
    """
    buckets = max(1, rows.count() // bucket_rows)
    named = sources.select(F.col("source").alias("named"), "source_no")
    numbered = rows.join(named, F.col("source").eqNullSafe(F.col("named"))).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "digest"), F.lit(buckets)))
    length = F.col("size") * F.col("copies")
    inside = Window.partitionBy("source_no", "bucket").orderBy("doc_id", "digest", "size").rowsBetween(Window.unboundedPreceding, -1)
    near = numbered.withColumn("near", F.coalesce(F.sum(length).over(inside), F.lit(0)))
    earlier = Window.partitionBy("source_no").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = numbered.groupBy("source_no", "bucket").agg(F.sum(length).alias("words"))
    far = sums.select("source_no", "bucket", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("far"))
    first = near.join(far, ["source_no", "bucket"]).select("source_no", "doc_id", "digest", "size", "copies", (F.col("near") + F.col("far")).alias("start"))
    # A mass of equal rows is laid out in runs, which a second shuffle deals over the tasks.
    runs = first.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(copies - 1) div {RUN_ROWS}"))))
    copy = F.sequence(F.col("run") * RUN_ROWS, F.least((F.col("run") + 1) * RUN_ROWS, F.col("copies")) - 1)
    spread = runs.hint("rebalance").withColumn("copy", F.explode(copy))
    return spread.select("doc_id", "digest", "size", "source_no", (F.col("start") + F.col("copy") * F.col("size")).alias("start"))


def shard_counts(totals: np.ndarray, shards: int, shard: int, shard_slots: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Per source: slots used by earlier shards, and slots of this shard."""
    lo, hi, here, before = 0, shards, totals, np.zeros(len(totals), np.int64)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        left = halved(here, (mid - lo) * shard_slots, np.random.default_rng((seed, 1, lo, hi)))
        if shard < mid:
            hi, here = mid, left
        else:
            lo, here, before = mid, here - left, before + left
    return before, here


def _slots(spark, blocks: np.ndarray, totals: np.ndarray, shard_slots: int, seed: int) -> DataFrame:
    """Which block fills each slot; every shard is made by one task from its number alone."""
    schema = pa.schema([("shard", pa.int64()), ("slot", pa.int32()), ("source_no", pa.int32()), ("block", pa.int64()), ("pass_no", pa.int32())])
    shards = -(-int(totals.sum()) // shard_slots)

    def fill(shard: int) -> pa.RecordBatch:
        before, here = shard_counts(totals, shards, shard, shard_slots, seed)
        parts = []
        for s in np.nonzero(here)[0].tolist():
            at = np.arange(before[s], before[s] + here[s])
            turn, inside = at // blocks[s], at % blocks[s]
            for t in np.unique(turn).tolist():
                index = permuted(inside[turn == t], int(blocks[s]), (seed, 2, s, t))
                parts.append(np.stack([np.full(len(index), s), index, np.full(len(index), t)]))
        made = np.concatenate(parts, axis=1)[:, np.random.default_rng((seed, 3, shard)).permutation(int(here.sum()))]
        columns = [np.full(made.shape[1], shard), np.arange(made.shape[1]), *made]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    def run(batches):
        for b in batches:
            for shard in b.column(0).to_pylist():
                yield fill(shard)

    tasks = max(1, min(shards, 4 * spark.sparkContext.defaultParallelism))
    return spark.range(0, shards, 1, tasks).mapInArrow(run, "shard bigint, slot int, source_no int, block bigint, pass_no int")


def mix_report(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document; odd rows as in ``plan_mix``."""
    mix = plan_mix(docs)
    return mix.taken().join(mix.sources.select("source_no", "source_size", "target"), "source_no").select("doc_id", "size", "source_size", "target", "taken")
