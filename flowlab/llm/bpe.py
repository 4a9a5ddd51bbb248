"""Byte-level BPE by a global shuffle of distinct words.

A task cuts its documents into chunks of bounded size and each chunk into words
with their positions: a word is a piece of text between single blanks (with the
blank before it), where every match of the pattern lies inside one word. Per
chunk only the distinct words are shuffled, dealt by word, so that all chunks'
copies of a word meet in one task, which encodes it once. The ids go back to the
chunk, where they are put in the words' positions. Decoding takes each id's
bytes from the vocabulary's table and concatenates them.

Chunks are named by their partition and number: the input must give the same
rows in the same partitions when a lost task runs again, as files do.
"""

from __future__ import annotations

import base64
import functools
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from flowlab.llm.common import LEVEL, as_lists, expand, give_back, pieces, sha256_hex, squeeze

CHUNK_BYTES = 32 << 20
#: Pieces that a chunk's distinct words are dealt in.
BUCKETS = 64
#: Words that a task keeps with their ids, at most; the ids of others are computed again.
CACHED_WORDS = 1_000_000

#: Where words are cut: a blank between two characters that are no white space.
#: Python's white space holds that of the pattern, so no match spans a cut.
CUT = re.compile(r"(?<=\S) (?=\S)")
#: A text in which every blank is such a cut is split the fast way.
IRREGULAR = re.compile(r" \s|\s |\A | \Z")


def split_words(text: str) -> tuple[str, list[str]]:
    """The first word, and the others without the blank that each begins with."""
    parts = CUT.split(text) if IRREGULAR.search(text) else text.split(" ")
    return parts[0], parts[1:]


@functools.lru_cache(maxsize=2)
def encoding(path: str | None):
    import public_tokenizers
    import tiktoken

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@functools.lru_cache(maxsize=2)
def token_bytes(path: str | None) -> dict[int, bytes]:
    """The token-byte table: as large as the vocabulary."""
    own = encoding(path)
    return {i: own.decode_single_token_bytes(i) for i in own._mergeable_ranks.values()}


def packed(**columns) -> bytes:
    """Columns as one compressed Arrow stream."""
    batch = pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], names=list(columns))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=LEVEL))) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def opened(data: bytes) -> pa.RecordBatch:
    with pa.ipc.open_stream(data) as stream:
        return stream.read_next_batch()


CHUNK_SCHEMA = "chunk string, bucket int, data binary"


def _batch(chunk: list[str], bucket: list[int], data: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(chunk, pa.string()), pa.array(bucket, pa.int32()), pa.array(data, pa.binary())], names=["chunk", "bucket", "data"])


def _chunk_rows(name: str, ids: list, codes: list[np.ndarray], rest: dict[str, int], first: dict[str, int], buckets: int):
    """A row of words for every bucket that has some, a row with the documents' words, and one with the documents.

    Words are numbered by falling frequency in the chunk, and stand in their bucket in that order.
    """
    words, old = [" " + w for w in rest] + list(first), np.fromiter([*rest.values(), *first.values()], np.int64, len(rest) + len(first))
    flat, lengths = np.concatenate(codes), [len(c) for c in codes]
    codes.clear()
    by_code = np.empty(len(words), np.int64)
    by_code[old] = np.arange(len(words))
    order = np.argsort(-np.bincount(flat, minlength=len(words)), kind="stable")
    new = np.empty(len(words), np.int32)
    new[order] = np.arange(len(words))
    listed = [words[k] for k in by_code[order].tolist()]
    dealt = np.fromiter((xxhash.xxh32_intdigest(w.encode("utf-8", "surrogatepass")) % buckets for w in listed), np.int64, len(listed))
    column = pa.array(listed, pa.large_string())
    for k in np.unique(dealt).tolist():
        yield _batch([name], [k], [packed(word=column.take(pa.array(np.flatnonzero(dealt == k))))])
    yield _batch([name], [buckets], [squeeze(new[flat], dealt)])
    yield _batch([name], [buckets + 1], [packed(doc_id=pa.array(ids), length=lengths)])


def chunked(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES, buckets: int = BUCKETS) -> DataFrame:
    """(chunk, bucket, data): distinct words by bucket, then positions, then documents, of every chunk."""

    def run(batches):
        part, number = TaskContext.get().partitionId(), 0
        ids, codes, rest, first, size = [], [], {}, {}, 0
        for b in (p for whole in batches for p in pieces(whole)):
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                own = []
                if text:
                    head, tail = split_words(text)
                    count = len(rest) + len(first)
                    own.append(first.setdefault(head, count))
                    known = rest.get
                    for w in tail:
                        code = known(w)
                        if code is None:
                            code = rest[w] = len(rest) + len(first)
                        own.append(code)
                    size += len(text)
                ids.append(doc_id)
                codes.append(np.array(own, np.int32))
                size += 16
                if size >= chunk_bytes:
                    yield from _chunk_rows(f"{part}-{number}", ids, codes, rest, first, buckets)
                    number += 1
                    ids, codes, rest, first, size = [], [], {}, {}, 0
        if ids:
            yield from _chunk_rows(f"{part}-{number}", ids, codes, rest, first, buckets)
        ids, codes, rest, first = [], [], {}, {}
        give_back()

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, CHUNK_SCHEMA)


def encoded_words(chunks: DataFrame, path: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """The same rows with each word replaced by its ids; a word is encoded once in the task that has its bucket."""

    def run(batches):
        encode = encoding(path).encode_ordinary
        known: dict[str, np.ndarray] = {}
        for b in batches:
            for chunk, bucket, data in zip(*(c.to_pylist() for c in b.columns)):
                if bucket >= buckets:
                    yield _batch([chunk], [bucket], [data])
                    continue
                found = []
                for w in opened(data).column("word").to_pylist():
                    ids = known.get(w)
                    if ids is None:
                        if len(known) >= CACHED_WORDS:
                            known.clear()
                        ids = known[w] = encode(w)
                    found.append(ids)
                counts = np.fromiter(map(len, found), np.uint32, len(found))
                flat = np.fromiter((i for ids in found for i in ids), np.uint32, int(counts.sum()))
                yield _batch([chunk], [bucket], [squeeze(counts, flat)])
        known.clear()
        give_back()

    spread = F.when(F.col("bucket") < buckets, F.col("bucket").cast("string")).otherwise(F.col("chunk"))
    return chunks.repartition(spread).mapInArrow(run, CHUNK_SCHEMA)


def assembled(encoded: DataFrame, finish, schema: str, buckets: int = BUCKETS) -> DataFrame:
    """Rows that ``finish(doc_ids, arrays of ids)`` makes of each chunk's documents."""

    def run(batches):
        held, texts = [], None
        for b in batches:
            for chunk, bucket, data in zip(*(c.to_pylist() for c in b.columns)):
                if bucket < buckets:
                    held.append(expand(data))
                elif bucket == buckets:
                    texts = expand(data)
                else:
                    own = opened(data)
                    yield from finish(own.column("doc_id"), _documents(held, *texts, own.column("length").to_numpy()))
                    held, texts = [], None
        give_back()

    return encoded.repartition("chunk").sortWithinPartitions("chunk", "bucket").mapInArrow(run, schema)


def _documents(held: list[list[np.ndarray]], codes: np.ndarray, dealt: np.ndarray, lengths: np.ndarray):
    """The ids of each document of a chunk, in the order of its words."""
    order = np.argsort(dealt, kind="stable")
    counts, starts = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
    ids = np.concatenate([i for _, i in held]).astype(np.uint32) if held else np.empty(0, np.uint32)
    if held:
        own = np.concatenate([c for c, _ in held])
        counts[order], starts[order] = own, np.cumsum(own) - own
    ends = np.cumsum(lengths.astype(np.int64))
    for end, length in zip(ends.tolist(), lengths.tolist()):
        own = codes[end - length : end]
        n = counts[own]
        total = int(n.sum())
        at = np.repeat(starts[own] - (np.cumsum(n) - n), n) + np.arange(total)
        yield ids[at]


def tokenised(docs: DataFrame, path: str | None = None, chunk_bytes: int = CHUNK_BYTES, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, ids, n_tokens and the digests of ids and of decoded bytes, one row per row of ``docs``.

    A missing text is empty: no ids, the digests of nothing. Other columns are not
    read. ``path`` is a rank file, by default the public one of 50,256 tokens.
    """
    key = docs.schema["doc_id"].dataType
    kind = to_arrow_type(key)
    names = ["doc_id", "ids", "n_tokens", "ids_sha256", "decoded_sha256"]

    def finish(doc_ids, arrays):
        table = token_bytes(path).__getitem__
        kept, ids_hash, text_hash = [], [], []
        for ids in arrays:
            kept.append(ids.astype(np.int32))
            ids_hash.append(sha256_hex(ids.astype("<u4").tobytes()))
            text_hash.append(sha256_hex(b"".join(map(table, ids.tolist()))))
        lengths = np.array([len(k) for k in kept], np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(np.concatenate(kept) if kept else np.empty(0, np.int32)))
        yield pa.RecordBatch.from_arrays([doc_ids.cast(kind), lists, pa.array(lengths), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())], names=names)

    schema = f"doc_id {key.simpleString()}, ids array<int>, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return assembled(encoded_words(chunked(docs, chunk_bytes, buckets), path, buckets), finish, schema, buckets)


def round_trip(docs: DataFrame, path: str | None = None, chunk_bytes: int = CHUNK_BYTES, buckets: int = BUCKETS) -> DataFrame:
    """``tokenised`` without the ids themselves."""
    return tokenised(docs, path, chunk_bytes, buckets).drop("ids")


def decode(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and bytes of (doc_id, ids) rows; missing ids give missing bytes."""

    def run(batches):
        table = token_bytes(path).__getitem__
        for b in batches:
            lists = as_lists(b)
            out = [None if ids is None else b"".join(map(table, ids)) for ids in lists["ids"]]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.binary())], names=["doc_id", "bytes"])

    return tokens.select("doc_id", "ids").mapInArrow(run, f"doc_id {tokens.schema['doc_id'].dataType.simpleString()}, bytes binary")
