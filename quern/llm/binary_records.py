"""Token-id output as length-delimited binary records with masked checksums, and a separate offset index.

A shard is a raw file of frames:
    u64 length of payload | u32 masked crc of those 8 bytes | payload | u32 masked crc of payload | 0x0A
    payload: u8 flags (1: doc_id is null) | u8 bytes per id (2 or 4) | i64 doc_id | ids, little-endian
The crc is zlib's CRC-32, masked by rotating right by 15 bits and adding a constant, so that a checksum of data that holds
checksums stays sound. Frames end in 0x0A because Spark's text sink, which writes the bytes untouched to any store that Spark
knows, puts a separator after each row. The index (Parquet) has each record's shard, offset and length: readers that shuffle
records join on it and read just those.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_bytes, frugal, running_total, whole_text

#: Fixed value of the mask.
MASK_DELTA = 0xA282EAD8
_HEAD, _PAYLOAD = struct.Struct("<QI"), struct.Struct("<BBq")
FRAME_BYTES = _HEAD.size + 4 + 1  # around a payload


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK_DELTA) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: np.ndarray, width: int) -> bytes:
    """One record without its closing 0x0A."""
    payload = _PAYLOAD.pack(doc_id is None, width, doc_id or 0) + ids.astype(f"<u{width}").tobytes()
    length = len(payload).to_bytes(8, "little")
    return b"".join((length, masked_crc(length).to_bytes(4, "little"), payload, masked_crc(payload).to_bytes(4, "little")))


def parse(data: memoryview, at: int) -> tuple[int | None, np.ndarray, int]:
    """doc_id, ids and the offset after the record that begins at `at`. Raises ValueError where a checksum doesn't match."""
    length, crc = _HEAD.unpack_from(data, at)
    if masked_crc(data[at : at + 8]) != crc:
        raise ValueError(f"bad length checksum at {at}")
    payload = data[at + _HEAD.size : at + _HEAD.size + length]
    if len(payload) < length or masked_crc(payload) != int.from_bytes(data[at + _HEAD.size + length : at + _HEAD.size + length + 4], "little"):
        raise ValueError(f"bad payload checksum at {at}")
    null, width, doc_id = _PAYLOAD.unpack_from(payload)
    return None if null else doc_id, np.frombuffer(payload[_PAYLOAD.size :], f"<u{width}"), at + length + FRAME_BYTES


def write_records(docs: DataFrame, path: str, tokenizer: str, end_id: int) -> None:
    """Writes {path}/shards, a frame for each row of docs (doc_id, text) in ascending doc_id order over the shards in the order of
    their names (null ids first, equal ids by their texts' hashes), each with `end_id` appended, and {path}/index.

    Null text is empty. Texts are dealt out by doc_id range before they are encoded, so the sample that finds the ranges
    encodes nothing; shards have about the size that adaptive execution aims at for a partition.
    """

    @frugal
    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .tokens import encoder

        known = encoder(tokenizer)
        top = max(end_id, (known.library.get_vocab_size() if hasattr(known.library, "get_vocab_size") else known.library.get_piece_size()) - 1)
        width = 2 if top < 1 << 16 else 4
        for batch in by_bytes(batches, "text", 4 << 20):
            ids, offsets = known.encode(batch.column("text"))
            out = [frame(d, np.append(ids[offsets[i] : offsets[i + 1]], np.uint32(end_id)), width) for i, d in enumerate(batch.column("doc_id").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["frame"])

    rows = docs.select(F.col("doc_id").cast("long"), whole_text().alias("text"))
    # rows of one id, or without id, are many shards too: they stand by their texts' hashes
    ordered = rows.withColumn("_h", F.xxhash64("text")).repartitionByRange("doc_id", "_h").sortWithinPartitions("doc_id", "_h").drop("_h")
    ordered.mapInArrow(frames, "frame binary").select(F.col("frame").cast("string")).write.option("lineSep", "\n").text(f"{path}/shards")
    index_shards(docs.sparkSession, path).write.parquet(f"{path}/index")


def index_shards(spark: SparkSession, path: str) -> DataFrame:
    """Reads and verifies every shard: doc_id, shard (file name), offset, length (of the frame), start_in_shard (ids before it there),
    n_tokens, ids_crc32 (of the ids as unsigned 32-bit little-endian integers)."""
    schema = "doc_id bigint, shard string, offset bigint, length bigint, start_in_shard bigint, n_tokens bigint, ids_crc32 bigint"

    @frugal
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, content in zip(batch.column("shard").to_pylist(), batch.column("content"), strict=True):
                data, at, start, rows = memoryview(content.as_buffer()), 0, 0, []
                while at < len(data):
                    doc_id, ids, after = parse(data, at)
                    rows.append((doc_id, shard, at, after - at, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    at, start = after, start + len(ids)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x) if i != 0 else pa.array(x, pa.int64()) for i, x in enumerate(zip(*rows, strict=True))], schema.replace(",", "").split()[::2])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/shards")
    return files.select(F.element_at(F.split("path", "/"), -1).alias("shard"), "content").mapInArrow(scan, schema)


def record_starts(spark: SparkSession, path: str) -> DataFrame:
    """The index with `start`: the number of ids of all records before it, over all shards in order."""
    index = spark.read.parquet(f"{path}/index")
    part, file = F.regexp_extract("shard", r"part-(\d+)", 1).cast("long"), F.coalesce(F.regexp_extract("shard", r"-c(\d+)", 1).try_cast("long"), F.lit(0))
    shards = index.groupBy("shard").agg(F.sum("n_tokens").alias("_ids")).withColumn("_order", part * 1_000_000 + file)
    starts = running_total(shards, "_order", "_ids", "_before", block=1_000_000 * 1024).select("shard", "_before")
    return index.join(starts, "shard").withColumn("start", F.col("_before") + F.col("start_in_shard")).drop("_before")


def read_records(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """doc_id and ids of the index rows `wanted` (shard, offset), in any order: the shuffled read. One task reads a shard."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/shards")
    at = wanted.groupBy("shard").agg(F.sort_array(F.collect_list("offset")).alias("offsets"))  # bounded by a shard's records

    @frugal
    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for offsets, content in zip(batch.column("offsets").to_pylist(), batch.column("content"), strict=True):
                data = memoryview(content.as_buffer())
                found = [parse(data, x)[:2] for x in offsets]
                yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in found], pa.int64()), pa.array([i.astype(np.int64) for _, i in found], pa.list_(pa.int64()))], ["doc_id", "ids"])

    joined = files.select(F.element_at(F.split("path", "/"), -1).alias("shard"), "content").join(at, "shard")
    return joined.select("offsets", "content").mapInArrow(pick, "doc_id bigint, ids array<bigint>")
