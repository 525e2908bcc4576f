"""Mixing sources to target weights by blocks of words.

1. Each source's words, document after document in a fixed pseudo-random order, are cut into blocks of BLOCK words.
2. Targets: the weights share `total` of all words; no target exceeds `most` times its source, the excess is shared anew.
3. Every output shard draws how many of its slots each source gets. The draws are multinomial without replacement from what the
   sources still owe, so that all shards together meet the targets to within one and a half blocks, which free draws would miss.
4. The k-th slot of a source takes block p(k): each pass over the source is a pseudo-random permutation of all its block numbers.
   A pass takes no block twice, so no document is taken more often than there are passes.
5. Slots and blocks meet by (source, block number).

The driver holds one row a source and one a (shard, source); both are few: sources are a declared list, shards at most MOST_SHARDS.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathomline.functions.staging import staged

from .common import WORD, mixed, row_of, settled

BLOCK = 64
WEIGHTS = (3, 1, 2)
TOTAL, MOST = 1.5, 2.0
SHARD_SLOTS, MOST_SHARDS = 65_536, 1_024
SLICE_ROWS = 5_000
TASK_SLOTS = 200_000         # the plan cannot see how many slots a row stands for, so their number sets the tasks
SEED = 20
FEW_SOURCES = 100_000        # rows of a table that may be sent to every executor


def targets(sizes: list[int], weights: list[float], total: float = TOTAL, most: float = MOST) -> list[float]:
    """The target of each source: `total` times all words by weight, none above `most` times its own, the excess shared anew."""
    left, out, free = total * sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    while free:
        unit = left / sum(weights[k] for k in free)
        full = {k for k in free if unit * weights[k] > most * sizes[k]}
        for k in full or free:
            out[k] = most * sizes[k] if full else unit * weights[k]
        if not full:
            break
        left, free = left - sum(out[k] for k in full), free - full
    return out


def shard_counts(owed: list[int], shards: int, seed: int) -> np.ndarray:
    """Slots of each source (columns) in each shard (rows): each shard draws from what is still owed."""
    rng, left, out = np.random.default_rng(seed), np.array(owed, dtype=np.int64), np.zeros((shards, len(owed)), dtype=np.int64)
    for k in range(shards - 1):
        size = int(left.sum()) // (shards - k)
        got = np.minimum(rng.multinomial(size, left / max(1, left.sum())), left)
        while (short := size - int(got.sum())) > 0:           # a source gave all it owed; the rest is drawn from the others
            rest = left - got
            got += np.minimum(rng.multinomial(short, rest / rest.sum()), rest)
        out[k], left = got, left - got
    out[-1] = left
    return out


def permuted(k: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The k-th number of a pseudo-random permutation of 0 to n - 1 given by `key`: a Feistel network, walked until inside."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2).astype(float))).astype(np.int64) + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = k.astype(np.uint64), np.arange(len(k))
    with np.errstate(over="ignore"):
        while len(todo):
            h, m, x, s = half[todo], mask[todo], out[todo], key[todo]
            left, right = x >> h, x & m
            for r in range(4):
                left, right = right, left ^ (mixed(right * np.uint64(0x9E3779B97F4A7C15) + s + np.uint64(r) * np.uint64(0xD1B54A32D192ED03)) & m)
            out[todo] = left << h | right
            todo = todo[out[todo] >= n[todo].astype(np.uint64)]
    return out.astype(np.int64)


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Expand (shard, source_no, first, count, n_blocks, seed): a row a slot, with its pass and block."""
    step = 100_000
    for batch in batches:
        for shard, source, first, count, n, seed in zip(*[c.to_pylist() for c in batch.columns]):
            for at in range(first, first + count, step):
                k = np.arange(at, min(at + step, first + count), dtype=np.int64)
                turn, one = k // n, np.ones(len(k), dtype=np.int64)
                with np.errstate(over="ignore"):
                    key = mixed((turn * 1_000_003 + source * 7_368_787 + seed).astype(np.uint64))
                    place = mixed(mixed(k.astype(np.uint64) + np.uint64(source << 40)) + np.uint64(seed)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (one * shard, one * source, turn, permuted(k % n, one * n, key), place)],
                                                 names=["shard", "source_no", "pass", "block", "place"])


def mixture(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, total: float = TOTAL, most: float = MOST, block: int = BLOCK,
            seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """The sizes and the mix of `docs` (doc_id, source, text; other columns are ignored).

    First table, a row a document: row (its number in `docs`), doc_id, source, size, source_size, target. Second, a row for each
    stretch of a document that the mix takes: shard, place (its order in the shard), pass, source_no, block, row, first_word, n_words.

    A null source is a source of its own, after all others; null and empty texts have no words and are never taken; documents
    of any length are cut by blocks. Rows with equal doc_id and text are documents of their own. An empty table gives empty tables.
    """
    spark = docs.sparkSession
    docs = settled(docs)
    rows = staged(docs.select(row_of(docs).alias("row"), "doc_id", F.col("source").cast("string").alias("source"),
                              F.xxhash64("doc_id", "text").alias("h"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")), "sizes")
    found = rows.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()          # one row a source
    found.sort(key=lambda r: (r.source is None, r.source or ""))
    sizes, n_rows = [int(r["size"]) for r in found], sum(r.n for r in found)
    goals = targets(sizes, [weights[k % len(weights)] for k in range(len(found))], total, most)
    blocks = [-(-s // block) for s in sizes]
    # whole passes over a source, and a part of one more
    owed = [int(g // s) * b + min(b, round((g - g // s * s) / block)) if s else 0 for g, s, b in zip(goals, sizes, blocks)]
    known = spark.createDataFrame([(r.source, k, sizes[k], float(goals[k])) for k, r in enumerate(found)],
                                  "source string, source_no long, source_size long, target double")
    known = F.broadcast(known) if len(found) <= FEW_SOURCES else known
    known = known.withColumnRenamed("source", "s")
    rows = rows.join(known, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    # running sums in a source: equal slices of the hash range, sums of the slices before, and a window in each slice
    n_slices = max(1, n_rows // SLICE_ROWS)
    cut = rows.where("size > 0").select("row", "source_no", "size", "h", F.floor(F.pmod(F.shiftrightunsigned("h", 20), F.lit(1 << 40)) / ((1 << 40) / n_slices)).alias("slice"))
    before = cut.groupBy("source_no", "slice").agg(F.sum("size").alias("size")).select(
        "source_no", "slice", F.coalesce(F.sum("size").over(Window.partitionBy("source_no").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    w = Window.partitionBy("source_no", "slice").orderBy("h", "row").rowsBetween(Window.unboundedPreceding, -1)
    placed = (cut.select("*", F.coalesce(F.sum("size").over(w), F.lit(0)).alias("inside")).join(before, ["source_no", "slice"])
              .select("row", "source_no", "size", (F.col("base") + F.col("inside")).alias("start")))
    end = F.col("start") + F.col("size")
    parts = placed.select("*", F.explode(F.sequence(F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}"))).alias("block"))
    low = F.greatest(F.col("start"), F.col("block") * block)
    parts = parts.select("row", "source_no", "block", (low - F.col("start")).alias("first_word"), (F.least(end, (F.col("block") + 1) * block) - low).alias("n_words"))
    shards = max(1, min(MOST_SHARDS, -(-sum(owed) // SHARD_SLOTS)))
    counts = shard_counts(owed, shards, seed) if owed else np.zeros((0, 0), dtype=np.int64)
    first = np.cumsum(counts, axis=0) - counts
    drawn = [(k, s, int(first[k, s]), int(counts[k, s]), blocks[s], seed) for k, s in zip(*np.nonzero(counts))]
    drawn = [(int(a), int(b), c, d, e, f) for a, b, c, d, e, f in drawn]
    slots = (spark.createDataFrame(drawn, "shard long, source_no long, first long, count long, n_blocks long, seed long").repartition(max(1, -(-sum(owed) // TASK_SLOTS)), F.xxhash64("shard", "source_no"))
             .mapInArrow(_slots, "shard long, source_no long, pass long, block long, place long"))
    # the plan sees the few rows that slots are made from, so it must be told that neither side is small
    mix = slots.join(parts.hint("merge"), ["source_no", "block"]).select("shard", "place", "pass", "source_no", "block", "row", "first_word", "n_words")
    return rows.select("row", "doc_id", "source", "size", "source_size", "target"), mix


def taken(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken, the words that the mix takes of each document."""
    rows, mix = mixture(docs)
    sums = mix.groupBy(F.col("row").alias("r")).agg(F.sum("n_words").alias("taken"))
    return (rows.join(sums, F.col("row") == F.col("r"), "left")
            .select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix as documents with the columns of `docs`: a row for each pass that takes words of a document.

    The text is the document's own where a pass takes all of it, else the words taken, joined by spaces. n_chars, where there is
    one, follows the text.
    """
    docs = settled(docs)
    rows, mix = mixture(docs)
    cut = (mix.groupBy("row", "pass").agg(F.sort_array(F.collect_list(F.struct("first_word", "n_words"))).alias("cuts"), F.sum("n_words").alias("n"))
           .join(rows.select("row", "size"), "row").select("row", (F.col("n") == F.col("size")).alias("whole"), "cuts"))
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("given"), row_of(docs).alias("row")).join(cut, "row")
    d = d.select("given", "cuts", "whole", F.when(~F.col("whole"), F.regexp_extract_all("given.text", F.lit(WORD), 0)).alias("words"))
    text = F.when(F.col("whole"), F.col("given.text")).otherwise(F.array_join(F.flatten(F.transform(
        "cuts", lambda c: F.slice("words", c["first_word"].cast("int") + 1, c["n_words"].cast("int")))), " "))
    d = d.select("given", "whole", text.alias("mixed"))
    new = {"text": F.col("mixed"), "n_chars": F.when(F.col("whole"), F.col("given.n_chars")).otherwise(F.length("mixed").cast("long")) if "n_chars" in docs.columns else None}
    return d.select(*[new[c].alias(c) if new.get(c) is not None else F.col(f"given.`{c}`") for c in docs.columns])
