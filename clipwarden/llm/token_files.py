"""Token ids as packed binary files.

File format (little endian).  A table of segments in Parquet: each row has its
part number, its place in the part, the documents in it and one ``payload``:

    magic "CWT1", uint32 ids, uint32 block size, uint32 blocks,
    uint64 start of each block's bytes (and of the end), then the blocks.

    block: uint32 minimum, uint8 width, uint16 exceptions, uint16 ids,
           the ids less the minimum, low ``width`` bits each, packed,
           exceptions: uint16 places, then uint32 high parts.

The width is the least that holds a percentile of the block's values; what is
wider goes to the exception list.  Blocks decode on their own, so a range of
ids needs only the blocks that the index names.  Documents lie in ascending id
order, or in that of a given column, over parts, segments and blocks; a document
never spans two segments.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .encoding import encoder
from .text import LAST_ID, plain_id, row_key, shared_folder, write

MAGIC = b"CWT1"
BLOCK = 1024
PERCENTILE = 90.0
SEGMENT = 1 << 18  # ids after which a segment ends with the current document

SEGMENTS = (
    "part int, segment int, payload binary, docs array<struct<id: bigint, n: bigint>>, ids bigint"
)


def pack_block(values: np.ndarray, percentile: float = PERCENTILE) -> bytes:
    low = int(values.min())
    rest = (values - np.uint32(low)).astype("<u4")
    at = math.ceil((len(rest) - 1) * percentile / 100)
    width = int(np.partition(rest, at)[at]).bit_length()
    wide = np.flatnonzero(rest >> np.uint32(width)) if width < 32 else np.empty(0, np.int64)
    bits = np.unpackbits(rest.view(np.uint8).reshape(-1, 4), axis=1, count=width, bitorder="little")
    return b"".join((
        struct.pack("<IBHH", low, width, len(wide), len(values)),
        np.packbits(bits.ravel(), bitorder="little").tobytes(),
        wide.astype("<u2").tobytes(),
        (rest[wide] >> np.uint32(width)).astype("<u4").tobytes(),
    ))


def unpack_block(data: memoryview) -> np.ndarray:
    low, width, wide, n = struct.unpack_from("<IBHH", data)
    at, size = 9, (n * width + 7) // 8
    bits = np.zeros((n, 32), np.uint8)
    bits[:, :width] = np.unpackbits(np.frombuffer(data, np.uint8, size, at), count=n * width, bitorder="little").reshape(n, width)
    values = np.packbits(bits, axis=1, bitorder="little").view("<u4").ravel()
    at += size
    if wide:
        places = np.frombuffer(data, "<u2", wide, at)
        values[places] |= np.frombuffer(data, "<u4", wide, at + 2 * wide).astype(np.uint32) << np.uint32(width)
    return values + np.uint32(low)


def pack(ids: np.ndarray, block: int = BLOCK, percentile: float = PERCENTILE) -> bytes:
    """One payload; ``block`` is at most 65,535."""
    blocks = [pack_block(ids[i : i + block], percentile) for i in range(0, len(ids), block)]
    head = struct.pack("<4sIII", MAGIC, len(ids), block, len(blocks))
    first = len(head) + 8 * (len(blocks) + 1)
    starts = first + np.cumsum([0, *map(len, blocks)], dtype=np.uint64)
    return b"".join((head, starts.astype("<u8").tobytes(), *blocks))


def unpack(payload: bytes, start: int = 0, count: int | None = None) -> np.ndarray:
    """Ids ``start`` to ``start + count`` of a payload, from the blocks that hold them."""
    magic, n, block, blocks = struct.unpack_from("<4sIII", payload)
    if magic != MAGIC:
        raise ValueError("not a payload of token ids")
    stop = n if count is None else min(n, start + count)
    if start >= stop:
        return np.empty(0, np.uint32)
    starts = np.frombuffer(payload, "<u8", blocks + 1, 16)
    view, first, last = memoryview(payload), start // block, (stop - 1) // block
    parts = [unpack_block(view[int(starts[b]) : int(starts[b + 1])]) for b in range(first, last + 1)]
    return np.concatenate(parts)[start - first * block : stop - first * block]


def write_token_files(
    docs: DataFrame,
    path: str,
    tokenizer_file: str,
    end_id: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    block: int = BLOCK,
    percentile: float = PERCENTILE,
    segment: int = SEGMENT,
    order_col: str | None = None,
) -> None:
    """Encodes every text, appends ``end_id`` and writes the files under ``path``.

    Null and empty texts consist of the end id alone.  Null document ids come
    last; rows with one id follow each other in the order of their texts' hash.
    With ``order_col`` that column comes before id and hash, its nulls first.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer_file)
        encode_texts = own.encode
        end, part, number = struct.pack("<I", end_id), TaskContext.get().partitionId(), 0
        ids, docs_in, size = [], [], 0

        def closed():
            return pa.RecordBatch.from_pydict(
                {
                    "part": pa.array([part], pa.int32()), "segment": pa.array([number], pa.int32()),
                    "payload": pa.array([pack(np.frombuffer(b"".join(ids), "<u4"), block, percentile)], pa.binary()),
                    "docs": pa.array([docs_in], pa.list_(pa.struct([("id", pa.int64()), ("n", pa.int64())]))),
                    "ids": pa.array([size], pa.int64()),
                }
            )

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                few = batch.slice(at, 64)
                for name, got in zip(few.column("id").to_pylist(), encode_texts(few.column("text").to_pylist())):
                    ids.extend((got, end))
                    docs_in.append({"id": name, "n": len(got) // 4 + 1})
                    size += len(got) // 4 + 1
                    if size >= segment:
                        yield closed()
                        number, ids, docs_in, size = number + 1, [], [], 0
        own.rest()
        if ids:
            yield closed()

    place = F.lit(0) if order_col is None else F.col(order_col)
    named = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("id"), row_key(id_col, text_col).alias("rk"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"), place.alias("place"),
    )
    keys = ["id", "rk"] if order_col is None else ["place", "id", "rk"]
    write(named.repartitionByRange(*keys).sortWithinPartitions(*keys).select("id", "text").mapInArrow(encode, SEGMENTS), path)


def segment_starts(spark: SparkSession, path: str) -> DataFrame:
    """The segments with ``start``, the number of ids in all segments before: a running sum by part, then inside."""
    segments = spark.read.schema(SEGMENTS).parquet(path)
    parts = segments.groupBy("part").agg(F.sum("ids").alias("_n"))
    before = parts.select(
        "part", (F.sum("_n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).alias("_before")
    )
    inside = segments.select("part", "segment", "ids").withColumn(
        "_inside", F.sum("ids").over(Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1))
    )
    zero = F.lit(0).cast("long")
    starts = inside.join(before, "part").select(
        "part", "segment", (F.coalesce("_before", zero) + F.coalesce("_inside", zero)).alias("start")
    )
    return segments.join(starts, ["part", "segment"])


def read_token_files(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """One row per document: doc_id, start, n_tokens and its ids (or, with ``digest``, their crc32)."""
    kind = "ids_crc32 bigint" if digest else "ids array<bigint>"

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                ids = unpack(one.column("payload")[0].as_py())
                listed = one.column("docs").flatten()
                sizes = np.asarray(listed.field("n"), dtype=np.int64)
                ends = np.cumsum(sizes)
                starts = ends - sizes
                if digest:
                    raw = memoryview(ids.astype("<u4").tobytes())
                    last = pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts, ends)], pa.int64())
                else:
                    last = pa.ListArray.from_arrays(pa.array(np.r_[starts, ends[-1:]], pa.int32()), pa.array(ids.astype(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [listed.field("id"), pa.array(starts + one.column("start")[0].as_py()), pa.array(sizes), last],
                    ["id", "start", "n_tokens", kind.split()[0]],
                )

    rows = segment_starts(spark, path).select("payload", "docs", "start").mapInArrow(
        decode, f"id bigint, start bigint, n_tokens bigint, {kind}"
    )
    return rows.select(plain_id().alias("doc_id"), "start", "n_tokens", kind.split()[0])


def token_file_digest(docs: DataFrame, tokenizer_file: str, end_id: int = 2, **options) -> DataFrame:
    """Writes the files to a new folder of the shared one and reads them back."""
    path = shared_folder(docs.sparkSession)
    write_token_files(docs, path, tokenizer_file, end_id, **options)
    return read_token_files(docs.sparkSession, path, digest=True)
