"""Token ids as a file: fixed-width bit packing with random access.

Every id takes the fewest bits that the vocabulary needs. Documents stand in
ascending order of doc_id over all files; a row of the file is a segment of
whole documents: their ids and lengths, the packed ids, and the byte offset of
every block of BLOCK ids, from which a block is unpacked without the ones before
it. The file is a Parquet folder, so that Spark commits it and any store holds it.
"""

from __future__ import annotations

import functools
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from flowlab.llm.common import ASCII_LOWER, give_back, pieces
from flowlab.session import work_path

END_ID = 2
BLOCK = 4_096
#: Ids of a segment, at most, unless one document has more.
SEGMENT_IDS = 1 << 20
#: Words that a Python worker keeps with their ids, at most, unless one group of texts has more.
CACHED_WORDS = 420_000
#: Bytes of texts whose new words are learned together.
GROUP_BYTES = 1 << 19


def id_bits(vocabulary: int) -> int:
    """The fewest bits that hold the ids 0 to vocabulary - 1."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> tuple[bytes, np.ndarray]:
    """Packed ids, lowest bit first, and the byte offset of every block of BLOCK ids; each block starts at a byte."""
    offsets = np.arange(0, len(ids) + BLOCK - 1, BLOCK)[: -(-len(ids) // BLOCK)] * bits // 8
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes(), offsets
    shifts = np.arange(bits, dtype=np.uint32)
    parts = []
    for at in range(0, len(ids), 16 * BLOCK):
        own = ids[at : at + 16 * BLOCK].astype(np.uint32)
        parts.append(np.packbits(((own[:, None] >> shifts) & 1).astype(np.uint8).ravel(), bitorder="little").tobytes())
    return b"".join(parts), offsets


def unpack(packed: bytes, bits: int, count: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(packed, f"<u{bits // 8}", count).astype(np.uint32)
    flat = np.unpackbits(np.frombuffer(packed, np.uint8), bitorder="little", count=count * bits).reshape(count, bits)
    out = np.zeros(count, np.uint32)
    for k in range(bits):
        out |= flat[:, k].astype(np.uint32) << np.uint32(k)
    return out


def ids_between(packed: bytes, offsets, bits: int, total: int, start: int, stop: int) -> np.ndarray:
    """Ids start to stop of a segment; only the blocks that hold them are unpacked."""
    start, stop = max(0, start), min(total, stop)
    if start >= stop:
        return np.empty(0, np.uint32)
    first, last = start // BLOCK, (stop - 1) // BLOCK
    end = offsets[last + 1] if last + 1 < len(offsets) else len(packed)
    held = min(total, (last + 1) * BLOCK) - first * BLOCK
    return unpack(packed[offsets[first] : end], bits, held)[start - first * BLOCK : stop - first * BLOCK]


#: Words whose pieces do not depend on a Unicode version: letters of the first Latin blocks (without the one that lower-cases to two), ASCII digits and signs but "<".
PLAIN_WORD = re.compile(r"[!-;=-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+")
#: The pieces that the tokenizer splits a lower-cased word of such characters into.
PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u024f]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u024f]+")

#: A full stop or comma between a letter and white space is a piece of its own.
CLOSING = re.compile(rb"(?<=[a-z])([.,])(?=[\x20\x09-\x0D]|\Z)")


class WordEncoder:
    """Encodes texts word by word.

    The tokenizer drops white space and none of its steps reaches over it, so a
    text's ids are those of its words. New words go to the tokenizer in one text, are
    told apart by the tokens that end a piece, of which each word's number is known,
    and are kept for the worker's later tasks. Words with other than plain letters,
    digits and signs, or with a special token, are encoded alone. Texts without special
    tokens are lower-cased first, as the tokenizer would, and parted from closing
    stops and commas, which leaves fewer distinct words.
    """

    def __init__(self, path: str | None):
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path or public_tokenizers.path("word_bpe_49k.json"))
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if self.vocabulary <= 1 << 16 else "<u4")
        #: tokens that end a piece, by their mark in the vocabulary
        self.ends_piece = np.zeros(self.vocabulary, bool)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.ends_piece[i] = token.endswith("</w>")
        self.known: dict[bytes, bytes] = {}

    def learn(self, words: list[bytes]) -> None:
        texts = [w.decode("utf-8", "replace") for w in words]
        plain = [i for i, t in enumerate(texts) if PLAIN_WORD.fullmatch(t)]
        rest = set(range(len(words))).difference(plain)
        if plain:
            pieces = np.cumsum([1 if texts[i].isalpha() else len(PIECES.findall(texts[i].lower())) for i in plain])
            ids = np.array(self._encode([" ".join(texts[i] for i in plain)])[0].ids, self.dtype)
            ends = np.flatnonzero(self.ends_piece[ids]) + 1
            if len(ends) == pieces[-1]:
                bounds = [0, *ends[pieces - 1].tolist()]
                data, size = ids.tobytes(), self.dtype.itemsize
                for i, a, b in zip(plain, bounds, bounds[1:]):
                    self.known[words[i]] = data[a * size : b * size]
            else:
                rest.update(plain)
        alone = sorted(rest)
        for i, found in zip(alone, self._encode([texts[i] for i in alone])):
            self.known[words[i]] = np.array(found.ids, self.dtype).tobytes()

    def _encode(self, texts: list[str]):
        return self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)

    def words(self, data: bytes | None) -> list[bytes]:
        if data and b"<|" not in data:
            data = CLOSING.sub(rb" \1", data.translate(ASCII_LOWER))
        return data.split() if data else []

    def encode(self, data: bytes | None) -> bytes:
        """The ids of a whole text as little-endian numbers of ``dtype``."""
        return self.encode_all([data])[0]

    def encode_all(self, texts: list[bytes | None]) -> list[bytes]:
        """``encode`` of every text; the texts' new words are learned in one go."""
        split = list(map(self.words, texts))
        distinct = set().union(*split)
        new = [w for w in distinct if w not in self.known]
        if new and len(self.known) + len(new) > CACHED_WORDS:
            self.known.clear()
            new = list(distinct)
        if new:
            self.learn(new)
        return [b"".join(map(self.known.__getitem__, words)) for words in split]


@functools.lru_cache(maxsize=1)
def word_encoder(path: str | None) -> WordEncoder:
    return WordEncoder(path)


def shard_cuts(docs: DataFrame, shards: int) -> list[int]:
    """Ids at which the shards begin: at most shards - 1 numbers."""
    shares = [k / shards for k in range(1, shards)]
    found = docs.agg(F.percentile_approx("doc_id", shares, 20 * shards).alias("cuts")).first()["cuts"] if shares else None
    return sorted(set(found or []))


def encoded(docs: DataFrame, cuts: list[int], path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """(shard, doc_id, ids) of every row; rows without doc_id come first."""
    bounds = np.array(cuts, np.int64)

    def run(batches):
        encoder = word_encoder(path)
        end = np.array([end_id], encoder.dtype).tobytes()
        for b in (p for whole in batches for p in pieces(whole, GROUP_BYTES)):
            ids = [found + end for found in encoder.encode_all(b.column("text").cast(pa.binary()).to_pylist())]
            keys = b.column("doc_id").cast(pa.int64()).fill_null(-(2**63)).to_numpy(zero_copy_only=False)
            shard = np.searchsorted(bounds, keys, side="right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(shard), b.column("doc_id"), pa.array(ids, pa.binary())], names=["shard", "doc_id", "ids"])
        give_back()

    return docs.select("doc_id", "text").mapInArrow(run, f"shard int, doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids binary")


SEGMENT = "shard int, segment long, doc_ids array<{key}>, lengths array<long>, bits int, total long, offsets array<long>, packed binary"


def segments(ordered: DataFrame, path: str | None = None, segment_ids: int = SEGMENT_IDS) -> DataFrame:
    """Segments of rows that come by shard and doc_id; a task holds one segment."""
    key = ordered.schema["doc_id"].dataType
    kind = to_arrow_type(key)

    def run(batches):
        encoder = word_encoder(path)
        bits, size = id_bits(encoder.vocabulary), encoder.dtype.itemsize
        now, number = None, 0
        doc_ids, parts, held = [], [], 0

        def row():
            ids = np.frombuffer(b"".join(parts), encoder.dtype)
            packed, offsets = pack(ids, bits)
            values = [now, number, doc_ids, [len(p) // size for p in parts], bits, len(ids), offsets.tolist(), packed]
            kinds = [pa.int32(), pa.int64(), pa.list_(kind), pa.list_(pa.int64()), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds)], names=["shard", "segment", "doc_ids", "lengths", "bits", "total", "offsets", "packed"])

        for b in batches:
            for shard, doc_id, ids in zip(*(c.to_pylist() for c in b.columns)):
                if parts and (shard != now or held + len(ids) // size > segment_ids):
                    yield row()
                    number += 1
                    doc_ids, parts, held = [], [], 0
                if shard != now:
                    now, number = shard, 0
                doc_ids.append(doc_id)
                parts.append(ids)
                held += len(ids) // size
        if parts:
            yield row()

    return ordered.mapInArrow(run, SEGMENT.format(key=key.simpleString()))


def write_tokens(docs: DataFrame, target: str, path: str | None = None, shards: int | None = None, segment_ids: int = SEGMENT_IDS) -> None:
    """Writes the ids of all documents, in ascending order of doc_id, to the folder ``target``."""
    count = shards or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = encoded(docs, shard_cuts(docs, count), path)
    ordered = rows.repartition(count, "shard").sortWithinPartitions(F.col("shard"), F.col("doc_id").asc_nulls_first(), F.col("ids"))
    segments(ordered, path, segment_ids).write.parquet(target)


def read_documents(spark: SparkSession, target: str) -> DataFrame:
    """Per document of the file: doc_id, start, n_tokens, ids_crc32. Only numbers are shuffled, packed ids are not."""
    file = spark.read.parquet(target)
    key = file.schema["doc_ids"].dataType.elementType
    kind = to_arrow_type(key)

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                ids = unpack(r["packed"], r["bits"], r["total"]).astype("<u4")
                n = np.array(r["lengths"], np.int64)
                ends = np.cumsum(n)
                crcs = [zlib.crc32(ids[e - k : e].tobytes()) for e, k in zip(ends.tolist(), n.tolist())]
                count = len(n)
                arrays = [pa.array(np.full(count, r["shard"], np.int32)), pa.array(np.full(count, r["segment"], np.int64)), pa.array(r["doc_ids"], kind), pa.array(ends - n), pa.array(n), pa.array(crcs, pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, names=["shard", "segment", "doc_id", "inside", "n_tokens", "ids_crc32"])

    docs = file.select("shard", "segment", "doc_ids", "lengths", "bits", "total", "packed").mapInArrow(run, f"shard int, segment long, doc_id {key.simpleString()}, inside long, n_tokens long, ids_crc32 long")
    return docs.join(segment_starts(file), ["shard", "segment"]).select("doc_id", (F.col("first") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def segment_starts(file: DataFrame) -> DataFrame:
    """(shard, segment, first): the ids before each segment. Totals of shards are summed over all, of segments within their shard."""
    totals = file.select("shard", "segment", "total")
    shards = totals.groupBy("shard").agg(F.sum("total").alias("shard_total"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("shard").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    shard_first = shards.select("shard", F.coalesce(F.sum("shard_total").over(before), F.lit(0)).alias("shard_first"))
    own = totals.select("shard", "segment", F.coalesce(F.sum("total").over(inside), F.lit(0)).alias("own_first"))
    return own.join(shard_first, "shard").select("shard", "segment", (F.col("shard_first") + F.col("own_first")).alias("first"))


def token_file_report(docs: DataFrame, path: str | None = None, shards: int | None = None) -> DataFrame:
    """Writes the file in the shared folder and reports what reading it back gives.

    A missing text is empty and has the end id alone; rows without doc_id come
    first; rows with the same doc_id stand next to each other in the order of their
    ids. Other columns are not read. ``path`` is a tokenizer file, by default the
    public one of 49,408 ids.
    """
    spark = docs.sparkSession
    target = work_path(spark, "tokens")
    write_tokens(docs, target, path, shards)
    return read_documents(spark, target)
