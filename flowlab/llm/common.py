"""Helpers shared by the document operators."""

from __future__ import annotations

import ctypes
import hashlib
import re
import struct
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: ASCII white space, the separators of words; ``bytes.split()`` splits on the same six bytes.
SPACE = b" \t\n\x0b\x0c\r"
#: Maps A-Z to a-z and leaves every other byte.
ASCII_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Bytes of a batch whose values are laid out as Python objects at once.
AT_ONCE = 4 << 20


def pieces(batch: pa.RecordBatch, size: int = AT_ONCE) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in slices of about ``size`` bytes, a row at least."""
    step = max(1, batch.num_rows * size // max(1, batch.nbytes))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def give_back() -> None:
    """Hands freed memory back to the machine: workers outlive their tasks, and what one has freed no other process can use."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def map_rows(df: DataFrame, make: Callable[[Iterator[dict[str, list]]], Iterable[dict[str, list]]], schema: str) -> DataFrame:
    """``make`` turns batches of columns (texts as bytes) into batches of columns of ``schema``.

    Batches stay within Spark's Arrow limits, so a task holds one batch and what
    ``make`` itself keeps.
    """
    out = StructType.fromDDL(schema)
    arrow = to_arrow_schema(out)

    def run(batches):
        for columns in make(as_lists(p) for b in batches for p in pieces(b)):
            if columns and len(next(iter(columns.values()))):
                yield pa.RecordBatch.from_arrays([_array(columns[f.name], f.type) for f in arrow], schema=arrow)
        give_back()

    return df.mapInArrow(run, out)


def add_columns(df: DataFrame, read: list[str], make: Callable[..., tuple], schema: str) -> DataFrame:
    """Adds to every row the columns of ``schema`` that ``make`` gives for its ``read`` columns.

    The row itself passes as the struct ``row``, so that no name of it clashes
    with an added one; ``unpacked`` lays it out again.
    """
    out = StructType.fromDDL(schema)
    arrow = to_arrow_schema(out)
    inner = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *[F.col(c).alias(f"read_{i}") for i, c in enumerate(read)])

    def run(batches):
        for b in (p for whole in batches for p in pieces(whole)):
            lists = as_lists(b.select([f"read_{i}" for i in range(len(read))]))
            made = zip(*(make(*values) for values in zip(*lists.values())))
            yield pa.RecordBatch.from_arrays([b.column(0), *[_array(list(v), f.type) for v, f in zip(made, arrow)]], names=["row", *arrow.names])
        give_back()

    return inner.mapInArrow(run, StructType([inner.schema["row"], *out.fields]))


def unpacked(df: DataFrame, names: list[str], **changed: Column) -> DataFrame:
    """The columns ``names`` of ``row``, some of them changed."""
    return df.select(*[changed.get(c, F.col("row").getField(c)).alias(c) for c in names])


def _array(values, kind: pa.DataType) -> pa.Array:
    return values if isinstance(values, pa.Array) else pa.array(values, kind)


def as_lists(batch: pa.RecordBatch) -> dict[str, list]:
    def listed(column):
        if pa.types.is_string(column.type):
            column = column.cast(pa.binary())
        elif pa.types.is_large_string(column.type):
            column = column.cast(pa.large_binary())
        return column.to_pylist()

    return {name: listed(batch.column(i)) for i, name in enumerate(batch.schema.names)}


#: Compression level of packed numbers and words.
LEVEL = 9


def squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers, byte plane by byte plane, compressed; whole numbers in as few bytes as they need."""
    out = [struct.pack("<I", len(arrays))]
    for a in arrays:
        real = a.dtype.kind == "f"
        if real:
            wide = a.astype("<f8").view("<u8")
        else:
            top = int(a.max()) if len(a) else 0
            wide = a.astype(f"<u{1 if top < 1 << 8 else 2 if top < 1 << 16 else 4 if top < 1 << 32 else 8}")
        planes = np.ascontiguousarray(wide.view(np.uint8).reshape(-1, wide.itemsize).T).tobytes()
        body = pa.Codec("zstd", compression_level=LEVEL).compress(planes, asbytes=True) if planes else b""
        out += [struct.pack("<?BQQ", real, wide.itemsize, len(a), len(body)), body]
    return b"".join(out)


def expand(data: bytes) -> list[np.ndarray]:
    (count,) = struct.unpack_from("<I", data)
    at, out = 4, []
    for _ in range(count):
        real, width, n, size = struct.unpack_from("<?BQQ", data, at)
        at += struct.calcsize("<?BQQ")
        planes = pa.decompress(data[at : at + size], decompressed_size=n * width, codec="zstd", asbytes=True) if n else b""
        at += size
        wide = np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(width, n).T).view(f"<u{width}").ravel()
        out.append(wide.view("<f8") if real else wide.astype(np.int64))
    return out


def doc_key(column: str = "doc_id") -> Column:
    """``crc32(doc_id as text)``; a missing id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def fold_is(mod: int, remainder: int, column: str = "doc_id") -> Column:
    return F.pmod(doc_key(column), F.lit(mod)) == remainder


def point_offsets(data: bytes, spots: list[int]) -> list[int]:
    """Code-point offsets of ascending byte offsets that lie on character bounds."""
    if data.isascii():
        return spots
    found, at, points = [], 0, 0
    for spot in spots:
        points += len(data[at:spot].decode("utf-8", "surrogatepass"))
        at = spot
        found.append(points)
    return found


def to_points(data: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, end, kind) with byte offsets, to code-point offsets, by start, then kind."""
    if not data.isascii():
        spots = sorted({x for s in spans for x in s[:2]})
        at = dict(zip(spots, point_offsets(data, spots)))
        spans = [(at[s], at[e], k) for s, e, k in spans]
    return sorted(spans, key=lambda s: (s[0], s[2], s[1]))


def free_of(candidates: Iterable[re.Match], taken: list[tuple[int, int, int]]) -> Iterator[re.Match]:
    """The candidates, in ascending order, that overlap none of the taken spans."""
    joined: list[list[int]] = []
    for start, end, _ in sorted(taken):
        if joined and start <= joined[-1][1]:
            joined[-1][1] = max(joined[-1][1], end)
        else:
            joined.append([start, end])
    k = 0
    for m in candidates:
        while k < len(joined) and joined[k][1] <= m.start():
            k += 1
        if k == len(joined) or joined[k][0] >= m.end():
            yield m


def span_text(spans: list[tuple[int, int, int]], kinds: list[str]) -> str:
    return ",".join(f"{kinds[k]}:{s}:{e}" for s, e, k in spans)


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def smallest_hashes(df: DataFrame, key: str, rows: int, size: int) -> DataFrame:
    """About ``rows`` rows, never more: those with the smallest hash of ``key``, of ``size`` rows with distinct keys.

    Rows far above the expected cut are filtered first, so that tasks hand few rows to the final ordering.
    """
    spread = 1 << 20
    place = F.pmod(F.xxhash64(F.lit("sample"), key), F.lit(spread))
    cut = spread if size <= rows else int(spread * min(1.0, (2 * rows + 100) / size)) + 1
    return df.where(place < cut).orderBy(place, key).limit(rows)


def labelled_ids(labels: DataFrame, column: str, rows: int) -> DataFrame:
    """At most ``rows`` labelled documents, (doc_id, label), chosen by a hash of their id.

    Rows without id or label are left out; of contradicting labels the smaller counts.
    """
    known = labels.select(F.col("doc_id").alias("doc_id"), F.col(column).cast("int").alias("label")).where("doc_id IS NOT NULL AND label IN (0, 1)")
    single = known.groupBy("doc_id").agg(F.min("label").alias("label"))
    return smallest_hashes(single, "doc_id", rows, single.count())


def with_sample(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """Documents of a bounded sample with their label; the sample is broadcast, its size is the sample's parameter."""
    return docs.join(F.broadcast(sample), "doc_id")
