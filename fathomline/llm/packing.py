"""Best-fit packing of token pieces into sequences of a fixed length, improved by swaps between sequences.

Pieces are dealt at random to shards of bounded size. A shard packs its pieces best-fit, longest first, then searches locally:
a fuller sequence takes a piece from a less full one, or exchanges one piece for a longer one, two for one or one for two.
Each step raises the sum of squared fills; sequences that lose their last piece are gone. Sequences with room left go on,
as they are, to fewer shards, where the search goes on between sequences of different shards, until one shard holds them or a
round gains nothing. A shard never holds more than SHARD_PIECES pieces (on average), whatever the size of the table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.functions.staging import staged

from .tokens import BYTE_BPE, END_ID, encoder, with_end

CAPACITY = 2048
SHARD_PIECES = 50_000
#: a round must lessen the sequences still open by this share, or it is the last
LEAST_GAIN = 0.001
PIECE_TYPES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces_of(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = BYTE_BPE, end_id: int = END_ID) -> DataFrame:
    """Encode `docs` (doc_id, text) and cut only documents longer than `capacity`: all their pieces are full, but the first.

    One row a piece: doc_id, piece, start, length, ids_crc32. A null or empty text is the end id alone. Nulls in doc_id are
    kept; repeated rows are pieces of their own.
    """
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(vocabulary)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = with_end(coder.ids(text.as_py()), end_id).astype("<u4")
                first = len(ids) % capacity or capacity
                for k, start in enumerate([0, *range(first, len(ids), capacity)]):
                    part = ids[start:first + k * capacity]
                    rows.append((doc_id, k, start, len(part), zlib.crc32(part.tobytes())))
            if rows:
                a, b, c, d, e = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int32()), *(pa.array(x, pa.int64()) for x in (c, d, e))],
                                                 names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, PIECE_TYPES)


def best_fit(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of every piece: longest pieces first, each into the fullest bin that has room."""
    bins, rooms, mask, n = np.zeros(len(lengths), dtype=np.int64), [[] for _ in range(capacity + 1)], 0, 0
    for k in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[k])
        fits = mask >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                mask &= ~(1 << room)
        else:
            room, b, n = capacity, n, n + 1
        bins[k] = b
        left = room - size
        if left:
            rooms[left].append(b)
            mask |= 1 << left
    return bins


class _Pool:
    """Pieces of the bins that may give some away, by length."""

    def __init__(self):
        self.by, self.mask = {}, 0

    def add(self, size: int, b: int) -> None:
        self.by.setdefault(size, []).append(b)
        self.mask |= 1 << size

    def longest(self, most: int) -> int:
        """The longest length up to `most`, or 0."""
        return (self.mask & ((1 << (most + 1)) - 1)).bit_length() - 1 if most > 0 and self.mask & ((1 << (most + 1)) - 1) else 0

    def take(self, size: int) -> int:
        held = self.by[size]
        b = held.pop()
        if not held:
            del self.by[size]
            self.mask &= ~(1 << size)
        return b


def improve(lengths: np.ndarray, bins: np.ndarray, capacity: int) -> np.ndarray:
    """Local search between the bins that have room; returns the new bin of every piece.

    Bins are served from the fullest down. The one served takes from bins not yet served, none of them fuller, the change that
    fills it most: a move, a swap of one for one, of two of its own for one, or of one of its own
    for two, the first of them no shorter. Every change raises
    the sum of squared fills, so it ends; sweeps go on while one changes something.
    """
    where: dict[int, dict[int, list[int]]] = {}          # bin -> length -> pieces
    for k, (b, size) in enumerate(zip(bins.tolist(), lengths.tolist())):
        where.setdefault(b, {}).setdefault(size, []).append(k)
    fill = {b: sum(s * len(v) for s, v in held.items()) for b, held in where.items()}
    bins = bins.copy()

    def hand(size: int, old: int, new: int) -> None:
        k = where[old][size].pop()
        if not where[old][size]:
            del where[old][size]
        where[new].setdefault(size, []).append(k)
        fill[old] -= size
        fill[new] += size
        bins[k] = new

    changed = True
    while changed:
        changed = False
        order = sorted((b for b, f in fill.items() if 0 < f < capacity), key=lambda b: (-fill[b], b))
        pool = _Pool()
        for b in reversed(order):
            for size, held in where[b].items():
                for _ in held:
                    pool.add(size, b)
        for b in order:
            for size, held in where[b].items():              # what b holds is no longer to be had
                givers = pool.by.get(size, [])
                for _ in held:
                    givers.remove(b) if givers[-1] != b else givers.pop()
                if not givers and size in pool.by:
                    del pool.by[size]
                    pool.mask &= ~(1 << size)
            while 0 < fill[b] < capacity:
                room = capacity - fill[b]
                best, step = pool.longest(room), None
                if best:
                    step = ((), (best,))
                own = sorted(where[b])
                for y in own if best < room else ():
                    x = pool.longest(y + room)
                    if x - y > best:
                        best, step = x - y, ((y,), (x,))
                    for x1 in sorted((x for x in pool.by if y <= x < y + room), reverse=True) if best < room else ():
                        x2 = pool.longest(min(x1, y + room - x1))
                        if x2 and (x1 != x2 or len(pool.by[x1]) > 1) and x1 + x2 - y > best:
                            best, step = x1 + x2 - y, ((y,), (x1, x2))
                            if best == room:
                                break
                for i, y1 in enumerate(own if best < room else ()):
                    for y2 in own[i:]:
                        if y1 == y2 and len(where[b][y1]) < 2:
                            continue
                        x = pool.longest(y1 + y2 + room)
                        if x - y1 - y2 > best:
                            best, step = x - y1 - y2, ((y1, y2), (x,))
                if step is None:
                    break
                givers = [pool.take(x) for x in step[1]]
                for x, giver in zip(step[1], givers):
                    hand(x, giver, b)
                for y in step[0]:
                    hand(y, b, givers[0])
                    pool.add(y, givers[0])
                changed = True
    return bins


def _packed(rows: pd.DataFrame, capacity: int, number: int) -> pd.DataFrame:
    """One shard in round `number`: its pieces with their bins, and the fill of each bin."""
    rows = rows.sort_values(["length", "bin", "row"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
    lengths = rows["length"].to_numpy()
    if number == 0:
        bins = best_fit(lengths, capacity)
    else:
        bins = np.unique(rows["bin"].to_numpy(), return_inverse=True)[1]
    bins = improve(lengths, bins, capacity)
    rows["bin"] = bins + (int(rows["shard"].iloc[0]) << 24) + (number << 56)
    rows["fill"] = rows.groupby("bin")["length"].transform("sum")
    rows["offset"] = rows.groupby("bin")["length"].cumsum() - rows["length"]
    return rows[["row", "length", "bin", "shard", "fill", "offset"]]


def _packer(capacity: int, number: int):
    return lambda rows: _packed(rows, capacity, number)


def pack(pieces: DataFrame, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Give every row of `pieces` (a `length` of 1 to `capacity`; any other columns) its sequence_id and its gapless offset.

    Rows without a length, or with one outside 1 to `capacity`, stop the job. Repeated rows are packed one by one; columns
    called row, shard, bin or fill may be there and are kept. An empty table stays empty.
    """
    spark = pieces.sparkSession
    given = pieces.columns
    if bad := [c for c in ("sequence_id", "offset") if c in given]:
        raise ValueError(f"pack writes {bad} itself")
    items = staged(pieces.select(F.struct(*[F.col(f"`{c}`") for c in given]).alias("given"), F.monotonically_increasing_id().alias("row"),
                                 F.when(F.col("length").between(1, capacity), F.col("length").cast("long"))
                                 .otherwise(F.raise_error(F.lit("a piece has no length that fits"))).alias("length")), "pieces")
    work = items.select("row", "length", F.lit(0).cast("long").alias("bin"))
    types = "row long, length long, bin long, shard int, fill long, offset long"
    done, number, n_open = None, 0, work.count()
    shards = max(1, -(-n_open // shard_pieces))
    bins_before = None
    while n_open:
        key = F.xxhash64("row") if number == 0 else F.xxhash64("bin")
        dealt = work.select("row", "length", "bin", F.pmod(key, F.lit(shards)).cast("int").alias("shard"))
        result = staged(dealt.groupBy("shard").applyInPandas(_packer(capacity, number), types), "packed")
        is_open = F.col("fill") < capacity
        left = result.where(is_open).agg(F.count("*").alias("rows"), F.count_distinct("bin").alias("bins")).first()
        last = shards == 1 or left.rows == 0 or (bins_before is not None and left.bins > bins_before * (1 - LEAST_GAIN))
        part = (result if last else result.where(~is_open)).select("row", F.col("bin").alias("sequence_id"), "offset")
        done = part if done is None else done.unionByName(part)
        if last:
            break
        work, bins_before, number = result.where(is_open).select("row", "length", "bin"), left.bins, number + 1
        shards = max(1, min(-(-left.rows // shard_pieces), shards // 2))
    if done is None:
        done = spark.createDataFrame([], "row long, sequence_id long, offset long")
    return items.select("given", "row").join(done, "row").select("given.*", "sequence_id", "offset")
