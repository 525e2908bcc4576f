"""Event keys, identifiers and digests."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .guards import Refused, refuse
from .runs import run_ends
from .staging import staged

# fixed values: the closed vocabulary of pool names
CHANNELS = ("physical", "nitrate", "carbon")
DIRECTIONS = ("subduction", "obduction")

KEYS = ("wmo", "cycle_number", "pres_adjusted")
EVENT_KEY = ("k_wmo", "k_cycle", "k_pres")
CANDIDATE_ID_HEX, REVIEW_ID_HEX = 32, 16
_LIMBS, _LIMB_HEX = 8, 8
_PARTS = 1024                   # of a group; a part's sums hold 2^31 keys
BLOCK = 256                     # lines of a list that travel as one


def _whole(c: Column | str) -> Column:
    """The nearest whole number, halves to even; what is not a number becomes null."""
    c = F.col(c) if isinstance(c, str) else c
    number = F.nanvl(c.try_cast("double"), F.lit(None).cast("double"))
    return F.rint(number).cast("bigint")


def event_key(df: DataFrame, wmo: str = "wmo", cycle: str = "cycle_number", pres: str = "pres_adjusted",
              keep_null: bool = False) -> DataFrame:
    """Adds the key `k_wmo, k_cycle, k_pres`; rows without a whole key are dropped."""
    out = df.withColumns({"k_wmo": _whole(wmo), "k_cycle": _whole(cycle), "k_pres": _whole(pres)})
    return out if keep_null else out.dropna(subset=list(EVENT_KEY))


def pool_parts(pool_id: Column | str) -> Column:
    return F.split(F.col(pool_id) if isinstance(pool_id, str) else pool_id, "/")


def pool_id_is_valid(pool_id: Column | str) -> Column:
    """Three non-empty parts, the last two from the closed vocabularies."""
    p = pool_parts(pool_id)
    return F.coalesce((F.size(p) == 3) & (F.length(p[0]) > 0) & p[1].isin(*CHANNELS) & p[2].isin(*DIRECTIONS),
                      F.lit(False))


def require_pool_id(df: DataFrame, pool_id: str = "pool_id") -> DataFrame:
    refuse(df.where(~pool_id_is_valid(pool_id)).select(pool_id).distinct(),
           "pool ids that are not study/channel/direction")
    return df


def event_type(pool_id: Column | str) -> Column:
    p = pool_parts(pool_id)
    return F.concat_ws("_", p[1], p[2])


def id_line(*parts: Column | str) -> Column:
    return F.concat_ws("|", *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts])


def candidate_id(pool_id: Column | str = "pool_id", wmo: Column | str = "k_wmo",
                 cycle: Column | str = "k_cycle", pres: Column | str = "k_pres") -> Column:
    return F.substring(F.sha2(id_line(pool_id, wmo, cycle, pres), 256), 1, CANDIDATE_ID_HEX)


def review_id(batch: Column | str, sheet_digest: Column | str, row: Column | str) -> Column:
    return F.substring(F.sha2(id_line(batch, sheet_digest, row), 256), 1, REVIEW_ID_HEX)


def stamp(df: DataFrame, study_id: str, spec_id: Column | str = "spec_id", pool_id: str = "pool_id") -> DataFrame:
    """Adds the identity columns; expects `pool_id` and the event key."""
    spec = F.col(spec_id) if isinstance(spec_id, str) else spec_id
    return df.withColumns({"study_id": F.lit(study_id), "spec_id": spec, "event_type": event_type(pool_id),
                           "candidate_id": candidate_id(pool_id)})


def content_hash(df: DataFrame, by: Sequence[str] = ("pool_id",), key: Sequence[str] = EVENT_KEY) -> DataFrame:
    """The identity of a key set, independent of row order: `n` and `content_sha256` per group.

    Each distinct key's sha256 is cut into 32-bit pieces, the pieces are summed per group, and the sums
    are hashed. Sums combine on the map side, so no task ever holds a set and nothing is sorted; `listed_hash` is
    the digest over the sorted list as it would be written out. A group is first summed in _PARTS parts, as whole
    numbers of 64 bits, then exactly over the parts: decimals for every key would be most of the work.
    """
    by = list(by)
    digest, limbs = F.sha2(id_line(*key), 256), [f"_s{i}" for i in range(_LIMBS)]
    pair = lambda i: F.conv(F.substring("_d", 1 + 2 * i * _LIMB_HEX, 2 * _LIMB_HEX), 16, -10).cast("bigint")          # noqa: E731
    pairs = (df.select(*by, *key).dropna(subset=list(key)).distinct()
             .select(*by, F.pmod(F.xxhash64(*key), F.lit(_PARTS)).alias("_part"), digest.alias("_d"))
             .select(*by, "_part", *[pair(i).alias(f"_p{i}") for i in range(_LIMBS // 2)]))
    piece = lambda i: F.col(f"_p{i // 2}").bitwiseAND(2**32 - 1) if i % 2 else F.shiftrightunsigned(f"_p{i // 2}", 32)
    parts = pairs.groupBy(*by, "_part").agg(F.count(F.lit(1)).alias("n"), *[F.sum(piece(i)).alias(c) for i, c in enumerate(limbs)])
    sums = parts.groupBy(*by).agg(F.sum("n").alias("n"), *[F.sum(F.col(c).cast("decimal(20,0)")).alias(c) for c in limbs])
    return sums.select(*by, "n", F.sha2(id_line("n", *[f"_s{i}" for i in range(_LIMBS)]), 256).alias("content_sha256"))


def _blocks(names: list[str], glue: str):
    """Rows (by, _at, _line) in order -> the lines of every `BLOCK` rows of a group as one: by, _at of the first, _n, _text.
    A line that is null has no bytes."""
    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ends = run_ends(batch, names)
            cuts = np.unique(np.concatenate([np.zeros(1, dtype=np.int64), ends, *[np.arange(a, b, BLOCK) for a, b in zip(np.r_[0, ends[:-1]], ends)]])).astype(np.int32)
            lines = pc.fill_null(batch.column("_line"), "")
            texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts), lines), glue)
            first = batch.take(pa.array(cuts[:-1])).drop_columns(["_line"])
            yield pa.RecordBatch.from_arrays(
                [*first.columns, pa.array(np.diff(cuts).astype(np.int64)), pa.array([zlib.compress(t.as_py().encode(), 1) for t in texts], pa.binary())],
                names=[*first.schema.names, "_n", "_text"])
    return packed


def _digests(names: list[str], glue: str):
    """Blocks sorted by group and place: one digest a group, whose text goes by block by block."""
    def rows(groups: pa.RecordBatch, n: list[int], digests: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*groups.columns, pa.array(n, pa.int64()), pa.array(digests, pa.string())], names=[*names, "n", "digest"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, n, digest = None, 0, hashlib.sha256()
        for batch in batches:
            if not batch.num_rows:
                continue
            groups, ends = batch.select(names), run_ends(batch, names)
            starts = np.r_[0, ends[:-1]]
            goes_on = last is not None and last.equals(groups.slice(0, 1))
            if last is not None and not goes_on:
                yield rows(last, [n], [digest.hexdigest()])
            sizes, texts, counts, digests = batch.column("_n").to_pylist(), batch.column("_text").to_pylist(), [], []
            for k, (start, end) in enumerate(zip(starts.tolist(), ends.tolist())):
                if k or not goes_on:
                    n, digest = 0, hashlib.sha256()
                for i in range(start, end):
                    digest.update((glue.encode() if n else b"") + zlib.decompress(texts[i]))
                    n += sizes[i]
                counts.append(n)
                digests.append(digest.hexdigest())
            yield rows(groups.take(pa.array(starts[:-1])), counts[:-1], digests[:-1])
            last = groups.slice(int(starts[-1]), 1)
        if last is not None:
            yield rows(last, [n], [digest.hexdigest()])
    return hashed


def _chained_digest(df: DataFrame, by: list[str], order: Sequence[str], line: Column, glue: str, limit: int | None, once: bool = False) -> DataFrame:
    """sha256 over the ordered lines of each group, as `n` and `digest`; `once`: equal rows are one line.

    The rows are sorted over the cluster and their lines joined and compressed in blocks there. A sha256 runs over its bytes in
    sequence, so a group's blocks pass through one task in order, a batch at a time; none holds a list. A group above `limit`
    lines, where one is given, is refused, since a digest that changes its meaning with the size would be no identity.
    """
    placed = df.repartitionByRange(*by, *order)
    # equal rows are in one partition already; rows that differ in their line alone go by it
    placed = placed.distinct().sortWithinPartitions(*by, *order) if once else placed.sortWithinPartitions(*by, *order, line)
    lines = placed.select(*by, F.monotonically_increasing_id().alias("_at"), line.alias("_line"))
    group = [lines.schema[c] for c in by]
    blocks = lines.mapInArrow(_blocks(by, glue), T.StructType([
        *group, T.StructField("_at", T.LongType()), T.StructField("_n", T.LongType()), T.StructField("_text", T.BinaryType())]))
    if limit is not None:
        blocks = staged(blocks, "blocks")
        refuse(blocks.groupBy(*by).agg(F.sum("_n").alias("n")).where(F.col("n") > limit), f"more than {limit} lines have no listed digest")
    return (blocks.repartition(*by).sortWithinPartitions(*by, "_at")
            .mapInArrow(_digests(by, glue), T.StructType([*group, T.StructField("n", T.LongType()), T.StructField("digest", T.StringType())])))


def listed_hash(df: DataFrame, by: Sequence[str] = ("pool_id",), key: Sequence[str] = EVENT_KEY,
                limit: int | None = None) -> DataFrame:
    """sha256 over the numerically sorted `a|b|c` lines of each set, joined by line feeds: the digest of a written list."""
    keys = df.select(*by, *key).dropna(subset=list(key))
    return _chained_digest(keys, list(by), key, id_line(*key), "\n", limit, once=True).withColumnRenamed("digest", "content_sha256")


def joint_digest(df: DataFrame, by: Sequence[str], order: str, digest: str, limit: int | None = None) -> DataFrame:
    """One digest for the sheets of a draw: over `digest TAB sheet LF` in order; a single sheet keeps its own."""
    by = list(by)
    line = F.concat(F.col(digest), F.lit("\t"), F.col(order).cast("string"), F.lit("\n"))
    joint = _chained_digest(df, by, [order], line, "", limit).withColumnRenamed("n", "sheets")
    own = df.groupBy(*by).agg(F.min(digest).alias("_own"))
    return joint.join(own, by).select(*by, "sheets", F.when(F.col("sheets") == 1, F.col("_own")).otherwise(F.col("digest")).alias("digest"))


def decision(label: Column | str) -> Column:
    """0, 1 or 2 as written on a sheet; anything else is blank."""
    value = (F.col(label) if isinstance(label, str) else label).try_cast("double")
    return F.when(value.isin(0.0, 1.0, 2.0), value.cast("tinyint"))


__all__ = ["CHANNELS", "DIRECTIONS", "KEYS", "EVENT_KEY", "Refused", "event_key", "pool_id_is_valid",
           "require_pool_id", "event_type", "candidate_id", "review_id", "stamp", "content_hash",
           "listed_hash", "joint_digest", "decision", "id_line", "pool_parts"]
