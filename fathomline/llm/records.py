"""Token ids in length-delimited binary records with an offset index.

A record is: payload length (8 bytes), masked checksum of the length (4), payload, masked checksum of the payload (4); all
little-endian. The checksum is CRC-32, rotated right by 15 bits plus a constant, so that a record holding records does not
check itself. The payload is: 1 byte "has an id", 8 bytes id, 1 byte id width, then the ids.

A shard is one file of records in ascending document order; shards follow each other by number. The index is a Parquet table
beside them, one row a record: doc_id, shard, file, position (in the shard), offset, length (of the whole record), n_tokens,
shard_start (ids before it in its shard). Any subset of it in any order reads exactly those records.

Writing survives lost executors: each attempt writes files under names of its own, only the attempts whose index rows were
committed count, and files that no index row names are deleted.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSelector, FileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tokens import BYTE_BPE, END_ID, encoder, with_end

MASK = 0xA282EAD8            # fixed
INDEX = "index"
INDEX_TYPES = "doc_id long, shard int, file string, position long, offset long, length long, n_tokens long, shard_start long"
BUFFERED = 4 << 20


def masked_crc(data: bytes) -> int:
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    """One record."""
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked_crc(head)), payload, struct.pack("<I", masked_crc(payload))))


def unframe(record: bytes) -> bytes:
    """The payload of one record; a record that does not check is refused."""
    if len(record) < 16:
        raise ValueError("a record is cut short")
    size, = struct.unpack_from("<Q", record)
    if struct.unpack_from("<I", record, 8)[0] != masked_crc(record[:8]) or size != len(record) - 16:
        raise ValueError("the length of a record does not check")
    payload = record[12:-4]
    if struct.unpack("<I", record[-4:])[0] != masked_crc(payload):
        raise ValueError("the content of a record does not check")
    return payload


def payload_of(doc_id: int | None, ids: np.ndarray) -> bytes:
    return struct.pack("<BqB", doc_id is not None, doc_id or 0, ids.dtype.itemsize) + ids.tobytes()


def parsed(payload: bytes) -> tuple[int | None, np.ndarray]:
    has, doc_id, width = struct.unpack_from("<BqB", payload)
    return doc_id if has else None, np.frombuffer(payload, dtype=f"<u{width}", offset=10)


def _located(path: str) -> tuple[FileSystem, str]:
    return FileSystem.from_uri(path)


def write_records(docs: DataFrame, path: str, vocabulary: str = BYTE_BPE, end_id: int = END_ID) -> DataFrame:
    """Encode `docs` (doc_id, text; other columns are ignored), write shards and index under `path`, return the index.

    A null text is an empty one; an empty text is its end id alone. Null ids come first; rows with the same id follow each other
    ordered by a digest of their text; repeated rows are repeated records. An empty table writes an empty index. `path` is a
    folder that driver and executors share.
    """
    spark = docs.sparkSession
    fs, folder = _located(path)
    fs.create_dir(folder, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, coder = TaskContext.get().partitionId(), encoder(vocabulary)
        name, out, held, sizes = f"shard-{shard:06d}-{uuid.uuid4().hex}.rec", None, [], 0
        place = position = start = 0
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = with_end(coder.ids(text.as_py()), end_id)
                record = frame(payload_of(doc_id, ids))
                rows.append((doc_id, position, place, len(record), len(ids), start))
                held.append(record)
                place, position, start, sizes = place + len(record), position + 1, start + len(ids), sizes + len(record)
                if sizes >= BUFFERED:
                    out = out or _located(path)[0].open_output_stream(f"{_located(path)[1]}/{name}", compression=None)
                    out.write(b"".join(held))
                    held, sizes = [], 0
            if rows:
                ids_, pos, off, length, n, st = zip(*rows)
                whole = len(rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids_, pa.int64()), pa.array([shard] * whole, pa.int32()), pa.array([name] * whole), pa.array(pos, pa.int64()),
                     pa.array(off, pa.int64()), pa.array(length, pa.int64()), pa.array(n, pa.int64()), pa.array(st, pa.int64())],
                    names=["doc_id", "shard", "file", "position", "offset", "length", "n_tokens", "shard_start"])
        if held:
            out = out or _located(path)[0].open_output_stream(f"{_located(path)[1]}/{name}", compression=None)
            out.write(b"".join(held))
        if out:
            out.close()

    order = [F.col("doc_id").asc_nulls_first(), F.col("tie"), F.col("row")]
    (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                 F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("row"))
         .repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
         .mapInArrow(write, INDEX_TYPES).write.parquet(f"{path}/{INDEX}"))
    index = read_index(spark, path)
    written = {r.file for r in index.select("file").distinct().toLocalIterator()}      # one name a shard
    for f in fs.get_file_info(FileSelector(folder)):
        if f.base_name.endswith(".rec") and f.base_name not in written:
            fs.delete_file(f.path)
    return index


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INDEX_TYPES).parquet(f"{path}/{INDEX}")


def read_records(index: DataFrame, path: str, ids: bool = True) -> DataFrame:
    """The records that the rows of `index` name, in the order of those rows within a partition.

    Columns: doc_id (from the record), shard, position, shard_start (from the index), n_tokens, ids_crc32 (of the ids as 4-byte little-endian numbers) and, if
    `ids`, the ids as an array. Records that do not check stop the job. Neighbouring records are read in one go.
    """
    types = "doc_id long, shard int, position long, shard_start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if ids else "")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = _located(path)
        opened, handle, buffer, base = None, None, b"", 0
        for batch in batches:
            cols = {n: batch.column(n).to_pylist() for n in ("shard", "file", "position", "offset", "length", "shard_start")}
            rows: list[tuple] = []
            for k, (shard, file, position, offset, length, start) in enumerate(zip(*cols.values())):
                if file != opened:
                    opened, handle, buffer, base = file, fs.open_input_file(f"{folder}/{file}"), b"", 0
                if not base <= offset or offset + length > base + len(buffer):
                    end, j = offset + length, k + 1
                    while j < batch.num_rows and cols["file"][j] == file and cols["offset"][j] == end and end - offset < BUFFERED:
                        end, j = end + cols["length"][j], j + 1
                    handle.seek(offset)
                    buffer, base = handle.read(end - offset), offset
                doc_id, got = parsed(unframe(buffer[offset - base:offset - base + length]))
                rows.append((doc_id, shard, position, start, len(got), zlib.crc32(got.astype("<u4").tobytes()), got if ids else None))
            if not rows:
                continue
            a, b, c, s, d, e, g = zip(*rows)
            arrays = [pa.array(a, pa.int64()), pa.array(b, pa.int32()), pa.array(c, pa.int64()), pa.array(s, pa.int64()), pa.array(d, pa.int64()), pa.array(e, pa.int64())]
            if ids:
                arrays.append(pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(d)], pa.int32()), pa.array(np.concatenate(g).astype(np.int32))))
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "shard", "position", "shard_start", "n_tokens", "ids_crc32"] + ["ids"] * ids)

    return index.select("shard", "file", "position", "offset", "length", "shard_start").mapInArrow(read, types)


def starts(index: DataFrame) -> DataFrame:
    """Each shard's first id counted over all shards: one row a shard."""
    w = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return (index.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
            .select("shard", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("shard_base")))


def documents_of(index: DataFrame, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files; `start` counts over the shards in order."""
    return (read_records(index, path, ids=False).join(starts(index), "shard")
            .select("doc_id", (F.col("shard_base") + F.col("shard_start")).alias("start"), "n_tokens", "ids_crc32"))
