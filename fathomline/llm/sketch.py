"""A count-min sketch whose counters stop at two, made per partition and merged: which keys may occur more than once.

A partition holds its keys, HELD at most at a time, not the counters. Rows of counters are cut into segments. A partition's segments are compressed; sketches merge segment by segment in levels of
FAN_IN. Only the places whose count reached two are sent on, a bit each. The width follows the number of keys up to MOST_WIDTH
(DEPTH x 2**27 counters, so at most 48 MB of bits); with more keys more are overestimated, none is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mixed

DEPTH = 3
LEAST_WIDTH, MOST_WIDTH = 1 << 20, 1 << 27
SEGMENT = 1 << 20
FAN_IN = 64
HELD = 2_000_000
TYPES = "segment int, part int, counts binary"
_SALTS = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)]


def width_for(keys: float) -> int:
    return int(min(MOST_WIDTH, max(LEAST_WIDTH, 1 << max(0, int(4 * keys) - 1).bit_length())))


def places(keys: np.ndarray, width: int) -> list[np.ndarray]:
    with np.errstate(over="ignore"):
        return [(mixed(keys + s) & np.uint64(width - 1)).astype(np.int64) for s in _SALTS]


def segments(keys: np.ndarray, width: int) -> Iterator[tuple[int, bytes]]:
    """The counters of `keys`, segment by segment where there is one above zero, compressed."""
    pack = zstandard.ZstdCompressor(level=1)
    for row, at in enumerate(places(keys, width)):
        at.sort()
        cuts = np.searchsorted(at, np.arange(0, width + SEGMENT, SEGMENT))
        for k in np.nonzero(np.diff(cuts))[0].tolist():
            cells, n = np.unique(at[cuts[k]:cuts[k + 1]] - k * SEGMENT, return_counts=True)
            counts = np.zeros(SEGMENT, dtype=np.uint8)
            counts[cells] = np.minimum(n, 2)
            yield row * (width // SEGMENT) + k, pack.compress(counts.tobytes())


class Repeats:
    """The merged sketch as bits: may a key have occurred twice?"""

    def __init__(self, width: int, data: bytes):
        self.width, self.rows = width, np.frombuffer(data, dtype=np.uint8).reshape(DEPTH, width // 8)

    def may_repeat(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), dtype=bool)
        for row, at in zip(self.rows, places(keys, self.width)):
            out &= (row[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
        return out


def _sketcher(width: int, keys_of: Callable[[pa.RecordBatch], Iterator[np.ndarray]]):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, size = TaskContext.get().partitionId(), [], 0

        def told() -> Iterator[pa.RecordBatch]:
            for segment, counts in segments(np.concatenate(held), width):
                yield pa.RecordBatch.from_arrays([pa.array([segment], pa.int32()), pa.array([part], pa.int32()), pa.array([counts], pa.binary())], names=["segment", "part", "counts"])

        for batch in batches:
            for keys in keys_of(batch):
                held.append(keys)
                size += len(keys)
                if size >= HELD:
                    yield from told()
                    held, size = [], 0
        if size:
            yield from told()
    return sketch


def _merged(rows: pd.DataFrame) -> pd.DataFrame:
    unpack, total = zstandard.ZstdDecompressor(), None
    for x in rows["counts"]:
        got = np.frombuffer(unpack.decompress(x), dtype=np.uint8)
        total = got if total is None else np.minimum(2, total + got)
    return pd.DataFrame({"segment": rows["segment"].iloc[:1], "part": rows["part"].iloc[:1] // FAN_IN,
                         "counts": [zstandard.ZstdCompressor(level=1).compress(total.tobytes())]})


def repeats(texts: DataFrame, keys_of: Callable[[pa.RecordBatch], Iterator[np.ndarray]], expected: float) -> Repeats:
    """The sketch of all keys that `keys_of` finds in the record batches of `texts`."""
    width, parts = width_for(expected), texts.rdd.getNumPartitions()
    sketches = texts.mapInArrow(_sketcher(width, keys_of), TYPES)
    while True:
        sketches = sketches.groupBy("segment", F.floor(F.col("part") / FAN_IN).cast("int").alias("p")).applyInPandas(_merged, TYPES)
        if parts <= FAN_IN:
            break
        parts = -(-parts // FAN_IN)

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            got = [np.packbits(np.frombuffer(unpack.decompress(x.as_py()), dtype=np.uint8) >= 2, bitorder="little").tobytes() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.binary())], names=["segment", "bits"])

    data = bytearray(DEPTH * width // 8)
    for r in sketches.select("segment", "counts").mapInArrow(bits, "segment int, bits binary").toLocalIterator():    # DEPTH * MOST_WIDTH bits at most
        at = r.segment * SEGMENT // 8
        data[at:at + len(r.bits)] = bytes(r.bits)
    return Repeats(width, bytes(data))
