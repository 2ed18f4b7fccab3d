"""Operator 1: token ids as length-delimited binary records with an offset index.

Layout of a shard (little-endian)::

    record  := length:u64  mask(crc32(length bytes)):u32  payload  mask(crc32(payload)):u32
    payload := doc_id:i64  flags:u8  ids        flags: 1 = null doc_id, 2 = two bytes per id (else four)
    index   := (doc_id:i64, null:u8, record offset:u64, n_ids:u64) per record, in file order

``mask`` rotates the checksum right by 15 bits and adds a constant, so that a checksum stored inside data that
is checksummed again does not cancel out. A reader finds any record through the index, which serves shuffled
reads; a sequential reader needs the data file only.

Shards hold disjoint ascending ranges of doc_id. Each task streams its sorted rows into a file of its own, named
with a fresh id, in the shared folder and reports it in one manifest row. The manifest is written by Spark, so
only files of successful attempts are listed; a retried task leaves an unlisted file, never a wrong one.

Edge cases: a null text is empty (its record holds the end id only); null doc_ids come first; equal doc_ids are
ordered by text; an empty table gives an empty manifest; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from styloscope.llm.common import materialise, prepare, scratch_path, shuffle_partitions, stream
from styloscope.llm.encode import encoder

MASK_DELTA = 0xA282EAD8
INDEX = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("offset", "<u8"), ("n_ids", "<u8")])
READ_BYTES = 8 << 20
_HEAD = struct.Struct("<qB")


class CorruptRecord(ValueError):
    """A length or payload does not match its checksum."""


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    """One record around ``payload``."""
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked_crc(length)), payload, struct.pack("<I", masked_crc(payload))))


def unframe(buffer: memoryview, at: int = 0) -> tuple[memoryview, int]:
    """The payload of the record at ``at`` and the position after it; both checksums are verified."""
    length = bytes(buffer[at:at + 8])
    if len(length) < 8 or struct.unpack_from("<I", buffer, at + 8)[0] != masked_crc(length):
        raise CorruptRecord(f"length at byte {at}")
    end = at + 12 + struct.unpack("<Q", length)[0]
    payload = buffer[at + 12:end]
    if len(buffer) < end + 4 or struct.unpack_from("<I", buffer, end)[0] != masked_crc(payload):
        raise CorruptRecord(f"payload at byte {at}")
    return payload, end + 4


def payload_of(doc_id: int | None, ids: np.ndarray) -> bytes:
    narrow = ids.dtype.itemsize == 2
    return _HEAD.pack(doc_id or 0, (doc_id is None) | (2 if narrow else 0)) + ids.tobytes()


def ids_of(payload: memoryview) -> tuple[int | None, np.ndarray]:
    doc_id, flags = _HEAD.unpack_from(payload)
    return None if flags & 1 else doc_id, np.frombuffer(payload, "<u2" if flags & 2 else "<u4", offset=_HEAD.size)


def open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


def write_records(docs: DataFrame, path: str, tokenizer: str, end_id: int, partitions: int | None = None) -> DataFrame:
    """Encode ``docs`` (doc_id, text) and write shards under ``path``; the manifest, one row per shard.

    ``partitions``: number of shards (default: ``spark.sql.shuffle.partitions``).
    """
    spark = docs.sparkSession
    prepare(spark)
    ordered = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
               .repartitionByRange(partitions or shuffle_partitions(spark), "doc_id")
               .sortWithinPartitions("doc_id", "text"))

    def write(batches) -> Iterator[tuple]:
        from pyspark import TaskContext

        enc = encoder(tokenizer)
        dtype = enc.dtype if end_id < 1 << 8 * enc.width else np.dtype("<u4")
        end = np.array([end_id], dtype)
        shard = TaskContext.get().partitionId()
        name = f"{path}/shard-{shard:06d}-{uuid.uuid4().hex}"
        store = sink = None
        index, at, n_ids, first, last = [], 0, 0, None, None
        for doc_ids, texts in batches:
            if sink is None:
                store, local = open_fs(name)
                store.create_dir(local.rsplit("/", 1)[0], recursive=True)
                sink = store.open_output_stream(local + ".rec")
            for doc_id, ids in zip(doc_ids, enc.encode(texts)):
                record = frame(payload_of(doc_id, np.concatenate((ids.astype(dtype, copy=False), end))))
                sink.write(record)
                index.append((doc_id or 0, doc_id is None, at, len(ids) + 1))
                at += len(record)
                n_ids += len(ids) + 1
                first, last = (doc_id if first is None else first), doc_id
        if sink is None:
            return
        sink.close()
        with store.open_output_stream(local + ".idx") as out:
            out.write(np.array(index, INDEX).tobytes())
        yield shard, name, len(index), n_ids, at, first, last

    manifest = stream(ordered, "shard int, path string, n_docs long, n_ids long, n_bytes long, first_doc long, "
                               "last_doc long", write)
    return materialise(manifest, "record-manifest")


def read_index(path: str) -> np.ndarray:
    store, local = open_fs(path)
    with store.open_input_file(local + ".idx") as f:
        return np.frombuffer(f.read(), INDEX)


def read_at(path: str, offset: int, length_hint: int = 1 << 16) -> tuple[int | None, np.ndarray]:
    """The record at ``offset`` of a shard: what a shuffled reader does with an index row."""
    store, local = open_fs(path)
    with store.open_input_file(local + ".rec") as f:
        head = f.read_at(12, offset)
        size = struct.unpack("<Q", head[:8])[0]
        return ids_of(unframe(memoryview(head + f.read_at(size + 4, offset + 12)))[0])


def scan(path: str) -> Iterator[tuple[int | None, np.ndarray]]:
    """Every record of a shard in file order, in reads of about READ_BYTES; the index must agree."""
    index = read_index(path)
    store, local = open_fs(path)
    with store.open_input_file(local + ".rec") as f:
        ends = np.append(index["offset"][1:], f.size()).astype(np.int64)
        starts = index["offset"].astype(np.int64)
        k = 0
        while k < len(index):
            stop = max(k + 1, int(np.searchsorted(ends, starts[k] + READ_BYTES, "right")))
            buffer, at = memoryview(f.read_at(int(ends[stop - 1] - starts[k]), int(starts[k]))), 0
            for row in index[k:stop]:
                payload, at = unframe(buffer, at)
                doc_id, ids = ids_of(payload)
                if len(ids) != row["n_ids"] or (doc_id or 0) != row["doc_id"]:
                    raise CorruptRecord(f"index row of {path}")
                yield doc_id, ids
            k = stop


def read_records(manifest: DataFrame) -> DataFrame:
    """Records of all shards: doc_id, start (ids before the document), n_tokens, ids_crc32, shard.

    Only the manifest (one row per shard) is summed in one task; shards are read one per task.
    """
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = manifest.select("shard", "path", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))

    def read(batches) -> Iterator[tuple]:
        for shard_ids, paths, bases in batches:
            for shard, path, start in zip(shard_ids, paths, bases):
                for doc_id, ids in scan(path):
                    yield doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), shard
                    start += len(ids)

    return stream(shards.repartition(shuffle_partitions(manifest.sparkSession)),
                  "doc_id long, start long, n_tokens long, ids_crc32 long, shard int", read)


def token_records(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Write ``docs`` as records in the session's shared folder and read them back."""
    spark: SparkSession = docs.sparkSession
    return read_records(write_records(docs, scratch_path(spark, "token-records"), tokenizer, end_id))
