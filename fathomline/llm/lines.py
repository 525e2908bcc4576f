"""Line dedup: two Bloom filters find the suspects, only suspects are shuffled and confirmed, copies go but for the first.

1. Each partition keeps two Bloom filters of line hashes: seen once, seen twice. Sketches merge in levels: what is in the
   once-filters of both sides moves to the twice-filter. Every line held by two documents ends up in the twice-filter.
2. Lines that the twice-filter may hold go on as (digest, document) pairs; grouped by digest, partly before the shuffle, they tell
   which are held by two documents and which document is the first.
3. Each document meets the digests it must drop and is rewritten.

The filters' size follows the number of lines up to MOST_BITS; beyond that more lines are suspected and confirmed, none is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.functions.staging import staged

from .common import Powers, batch_slices, id_or_last, mixed, random_table

LEAST_CHARS = 10
BITS_PER_LINE = 12
PROBES = 4
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 29
SEGMENT = 1 << 17            # bytes
FAN_IN = 64
SKETCH_TYPES = "segment int, part int, once binary, twice binary"
_BYTES, _POWERS = random_table(5), Powers(0xD6E8FEB86659FD93)


def keys_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All lines of the texts as keys, and the text that each belongs to; null is one empty line."""
    lists = pc.split_pattern(pc.fill_null(texts.cast(pa.large_string()), ""), "\n")
    keys = pc.ascii_lower(pc.ascii_trim_whitespace(lists.flatten()))
    return keys, pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)


def hashes_of(keys: pa.Array) -> np.ndarray:
    """A 64-bit hash of each key's bytes."""
    n, (_, offsets, data) = len(keys), keys.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[keys.offset:keys.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8)[ends[0]:ends[-1]] if data is not None and len(ends) else np.zeros(0, dtype=np.uint8)
    at = ends - ends[0]
    with np.errstate(over="ignore"):
        return mixed(_POWERS.spans(_BYTES[raw], at[:-1], at[1:]) + np.diff(at).astype(np.uint64))


def _candidates(batch: pa.RecordBatch, column: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Keys long enough to count, each once per row, with their row and hash."""
    keys, owner = keys_of(batch.column(column))
    long = np.asarray(pc.greater_equal(pc.utf8_length(keys), LEAST_CHARS))
    keys, owner = keys.filter(pa.array(long)), owner[long]
    h = hashes_of(keys)
    with np.errstate(over="ignore"):
        _, first = np.unique(mixed(h + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)
    first.sort()
    return keys.take(pa.array(first)), owner[first], h[first]


class Filter:
    """A Bloom filter over 64-bit hashes; `bits` is a power of two."""

    def __init__(self, bits: int, data: bytes | None = None):
        self.bits = bits
        self.data = np.zeros(bits // 8, dtype=np.uint8) if data is None else np.frombuffer(data, dtype=np.uint8)

    def places(self, h: np.ndarray) -> np.ndarray:
        step = (mixed(h) | np.uint64(1))
        with np.errstate(over="ignore"):
            return np.stack([(h + np.uint64(k) * step) & np.uint64(self.bits - 1) for k in range(PROBES)]).astype(np.int64)

    def add(self, h: np.ndarray) -> None:
        p = self.places(h).ravel()
        np.bitwise_or.at(self.data, p >> 3, (1 << (p & 7)).astype(np.uint8))

    def may_hold(self, h: np.ndarray) -> np.ndarray:
        p = self.places(h)
        return ((self.data[p >> 3] >> (p & 7).astype(np.uint8)) & 1).all(axis=0) if len(h) else np.zeros(0, dtype=bool)


def _sketcher(bits: int):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = Filter(bits), Filter(bits)
        for batch in batches:
            for _, part in batch_slices(batch, 0):
                seen, n = np.unique(_candidates(part, 0)[2], return_counts=True)
                twice.add(seen[(n > 1) | once.may_hold(seen)])
                once.add(seen)
        pack, rows = zstandard.ZstdCompressor(level=1), []
        for k in range(0, bits // 8, SEGMENT):
            a, b = once.data[k:k + SEGMENT], twice.data[k:k + SEGMENT]
            if a.any():
                rows.append((k // SEGMENT, TaskContext.get().partitionId(), pack.compress(a.tobytes()), pack.compress(b.tobytes())))
        if rows:
            cols = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.binary())],
                                             names=["segment", "part", "once", "twice"])
    return sketch


def _merged(rows: pd.DataFrame) -> pd.DataFrame:
    """Two-filter sketches of one segment as one."""
    unpack, pack = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1)
    once = twice = None
    for a, b in zip(rows["once"], rows["twice"]):
        a, b = (np.frombuffer(unpack.decompress(x), dtype=np.uint8) for x in (a, b))
        once, twice = (a, b) if once is None else (once | a, twice | b | (once & a))
    return pd.DataFrame({"segment": rows["segment"].iloc[:1], "part": rows["part"].iloc[:1] // FAN_IN,
                         "once": [pack.compress(once.tobytes())], "twice": [pack.compress(twice.tobytes())]})


def twice_filter(docs: DataFrame) -> Filter:
    """The filter of all lines that two documents may hold; `docs` has the column text."""
    total = docs.agg(F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)).first()[0] or 0
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << int(total * BITS_PER_LINE - 1).bit_length() if total else 0))
    parts = docs.rdd.getNumPartitions()
    sketches = docs.select("text").mapInArrow(_sketcher(bits), SKETCH_TYPES)
    while True:
        sketches = (sketches.groupBy("segment", F.floor(F.col("part") / FAN_IN).cast("int").alias("p")).applyInPandas(_merged, SKETCH_TYPES))
        if parts <= FAN_IN:
            break
        parts = -(-parts // FAN_IN)
    data, unpack = bytearray(bits // 8), zstandard.ZstdDecompressor()
    for r in sketches.select("segment", "twice").toLocalIterator():         # at most MOST_BITS bits in all
        data[r.segment * SEGMENT:(r.segment + 1) * SEGMENT] = unpack.decompress(bytes(r.twice))
    return Filter(bits, bytes(data))


def repeated_lines(docs: DataFrame, twice: Filter) -> tuple[DataFrame, DataFrame]:
    """(digest, document) of the suspects, and (digest, first document) of the lines that two documents hold."""
    spark = docs.sparkSession
    bits, sent = twice.bits, spark.sparkContext.broadcast(twice.data.tobytes())

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Filter(bits, sent.value)
        for batch in batches:
            for _, part in batch_slices(batch, 1):
                keys, owner, h = _candidates(part, 1)
                hit = seen.may_hold(h)
                digests = [hashlib.sha256(k.encode()).digest() for k in keys.filter(pa.array(hit, pa.bool_())).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), part.column(0).take(pa.array(owner[hit]))], names=["digest", "doc"])

    pairs = staged(docs.select(id_or_last(F.col("doc_id")).alias("doc"), "text").mapInArrow(suspects, "digest binary, doc long"), "suspects")
    held = pairs.groupBy("digest").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last").select("digest", "first")
    return pairs, staged(held, "repeated")


def _rewritten(column: int, names: list[str]):
    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, drops = batch.column(column).to_pylist(), batch.column(batch.num_columns - 1)
            out, n_lines, n_dropped = [], [], []
            for text, drop in zip(texts, drops):
                lines = (text or "").split("\n")
                if drop.is_valid:
                    gone = set(drop.as_py())
                    keys = [x.encode().strip(b" \t\n\v\f\r").lower() for x in lines]
                    kept = [x for x, k in zip(lines, keys) if hashlib.sha256(k).digest() not in gone]
                    out.append("\n".join(kept))
                else:
                    kept = lines
                    out.append(text)
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(kept))
            cols = [pa.array(out, pa.string()) if k == column else batch.column(k) for k in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], names=[*names, "n_lines", "n_dropped"])
    return rewrite


def deduplicated(docs: DataFrame) -> DataFrame:
    """Every row of `docs` (doc_id, text; any other columns) with its text rewritten, n_lines and n_dropped.

    Lines with a key of at least LEAST_CHARS code points that rows of two different doc_ids hold stay only with the smallest
    doc_id. A null doc_id reads as the largest id. Rows with the same doc_id are one document. A null text is one empty line and
    stays null. Columns called n_lines or n_dropped are refused; one called n_chars is a column like any other.
    """
    if bad := [c for c in ("n_lines", "n_dropped") if c in docs.columns]:
        raise ValueError(f"the rows already have {bad}")
    texts = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"))
    pairs, held = repeated_lines(texts, twice_filter(texts))
    drops = staged(pairs.join(held, "digest").where(F.col("doc") > F.col("first")).groupBy("doc").agg(F.collect_set("digest").alias("drop")), "drops")
    return _applied(docs, drops)


def _applied(docs: DataFrame, drops: DataFrame) -> DataFrame:
    n, at = len(docs.columns), docs.columns.index("text")
    doc_id = F.col(f"c{docs.columns.index('doc_id')}")
    both = docs.toDF(*[f"c{k}" for k in range(n)]).join(drops, id_or_last(doc_id) == F.col("doc"), "left").select(*[f"c{k}" for k in range(n)], "drop")
    types = ", ".join([f"`{f.name}` {'string' if f.name == 'text' else f.dataType.simpleString()}" for f in docs.schema.fields] + ["n_lines long", "n_dropped long"])
    return both.mapInArrow(_rewritten(at, docs.columns), types)


def without_copies(docs: DataFrame) -> DataFrame:
    """The documents with their texts rewritten and the columns they had; n_chars, where there is one, follows the text."""
    out = deduplicated(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.drop("n_lines", "n_dropped")


def digest_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


ORACLE = f"""
WITH l AS (SELECT doc_id, k, line,
           translate(regexp_replace(regexp_replace(line, '^[\\x20\\x09-\\x0D]+', ''), '[\\x20\\x09-\\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
           FROM (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS k FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))),
r AS (SELECT key, min(doc_id) AS first FROM l WHERE length(key) >= {LEAST_CHARS} GROUP BY key HAVING count(DISTINCT doc_id) > 1),
m AS (SELECT l.*, r.first IS NOT NULL AND doc_id > r.first AS gone FROM l LEFT JOIN r USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
