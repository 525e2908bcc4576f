"""SimHash near-duplicates by multi-index hashing, and the groups they form.

A 64-bit fingerprint is two segments of 32 bits. Two fingerprints that differ in at most three bits differ in at most one bit in
one of the segments. So each distinct fingerprint is filed under the value of either segment, and looks into the files of its own
value and of all values one bit away; only looks that turn a 0 into a 1 are needed, as the other of a pair does the rest. What is
found is compared over all 64 bits.

A file is never turned into all its pairs. Small files are compared pair by pair, large ones by looking up the few numbers within
the distance; either way a file gives at most one link for each of its members, which keep together what belongs together. A range of files is
one task's, and the distinct values of one segment of a file are its only rows: copies and equal fingerprints are gone before.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.functions.staging import staged

from .common import id_or_last, row_of, rows_numbered, settled

DISTANCE = 3
WORDS = 3
SEED = 42
SEGMENT = 32
SMALL = 512                  # members of a file up to which all pairs are compared
BLOCK_PAIRS = 1 << 22
PACKED = 20_000              # shingles whose bits are counted at once


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The SimHash of a text's shingles of `words` words, A-Z lower-cased; 0 where there is no word."""
    found = (text or "").encode().lower().split()
    if not found:
        return 0
    line = b" ".join(found)
    if len(found) <= words:
        return xxhash.xxh64_intdigest(line, SEED)
    sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
    starts = np.zeros(len(found), dtype=np.int64)
    np.cumsum(sizes[:-1] + 1, out=starts[1:])
    ends = (starts + sizes)[words - 1:].tolist()
    h, digest = [], xxhash.xxh64_intdigest
    h = np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts.tolist(), ends)), dtype=np.uint64, count=len(ends))
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, len(h), PACKED):
        ones += np.unpackbits(h[k:k + PACKED].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """row, doc_id and the fingerprint of every row of `docs` (row, doc_id, text), as a signed 64-bit number."""
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = np.fromiter((fingerprint(t.as_py(), words) for t in batch.column(2)), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(got.view(np.int64))], names=["row", "doc_id", "fp"])
    return docs.select("row", "doc_id", "text").mapInArrow(made, "row long, doc_id long, fp long")


def _roots(n: int, left: np.ndarray, right: np.ndarray, root: np.ndarray | None = None) -> np.ndarray:
    """The smallest member of each one's group, of n members and links between them."""
    root = np.arange(n) if root is None else root
    while True:
        a, b = root[left], root[right]
        low = np.minimum(a, b)
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        while True:                                     # every member points at the root of its root
            up = new[new]
            if (up == new).all():
                break
            new = up
        if (new == root).all():
            return root
        root = new


def _flips(most: int, bits: int) -> list[np.ndarray]:
    """For k from 1 to `most`: all numbers with k bits set."""
    return [np.array([sum(1 << b for b in c) for c in combinations(range(bits), k)], dtype=np.uint64) for k in range(1, most + 1)]


_FLIPS = _flips(DISTANCE, SEGMENT)


def file_links(own: np.ndarray, lookers: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of one file, as positions in own + lookers: own members within `distance` of each other, and lookers within
    `distance` - 1 of an own member (the bit by which their segment differs counts). Numbers are the other segment's; own are
    distinct and sorted. The links keep together what the pairs do, and are fewer than the members."""
    n, m = len(own), len(lookers)
    root = np.arange(n + m)
    if n + m <= SMALL:
        gap = np.bitwise_count(own[:, None] ^ np.r_[own, lookers][None, :])
        near = gap <= np.r_[np.full(n, distance), np.full(m, distance - 1)][None, :]
        left, right = np.nonzero(near)
        root = _roots(n + m, left, right)
    else:
        def meet(who: np.ndarray, values: np.ndarray, masks: np.ndarray) -> None:
            nonlocal root
            for k in range(0, len(masks), step := max(1, BLOCK_PAIRS // max(1, len(who)))):
                asked = values[None, :] ^ masks[k:k + step, None]
                at = np.searchsorted(own, asked)
                row, col = np.nonzero(own[np.minimum(at, n - 1)] == asked)
                root = _roots(n + m, who[col], at[row, col], root)
        at = np.searchsorted(own, lookers)
        same = np.nonzero(own[np.minimum(at, n - 1)] == lookers)[0]
        root = _roots(n + m, same + n, at[same], root)
        for k in range(distance):
            # a pair across two groups shows from either; so the largest group need not ask
            names, counts = np.unique(root[:n], return_counts=True)
            ask = np.nonzero(root[:n] != names[counts.argmax()])[0]
            if len(ask):
                meet(ask, own[ask], _FLIPS[k])
            if k < distance - 1 and m:
                ask = np.nonzero(root[n:] == np.arange(n, n + m))[0] if len(np.unique(root[:n])) == 1 else np.arange(m)
                if len(ask):
                    meet(ask + n, lookers[ask], _FLIPS[k])
    linked = np.nonzero(root != np.arange(n + m))[0]
    return linked, root[linked]


def _linker(distance: int):
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (file, own, fp), sorted by them: the links of every file."""
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def links(file, own, fp):
            cuts = np.r_[0, np.nonzero(np.diff(file))[0] + 1, len(file)]
            has = np.add.reduceat(own, cuts[:-1]) if len(file) else np.zeros(0)
            left, right = [], []
            for k in np.nonzero((np.diff(cuts) > 1) & (has > 0))[0].tolist():
                a, b = cuts[k], cuts[k + 1]
                high = np.uint64(file[a] >> 32) == 0     # file numbers: segment's place in bit 32, its value below
                value = fp[a:b].view(np.uint64)
                value = value >> np.uint64(SEGMENT) if high else value & np.uint64(2**SEGMENT - 1)
                order = np.lexsort((value, 1 - own[a:b]))
                n = int(has[k])
                x, y = file_links(value[order][:n], value[order][n:], distance)
                left.append(fp[a:b][order][x])
                right.append(fp[a:b][order][y])
            x, y = (np.concatenate(v) if v else np.zeros(0, dtype=np.int64) for v in (left, right))
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            part = tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns)
            held.append(part)
            file = part[0]
            if file[0] == file[-1]:                      # the file may go on
                continue
            whole = tuple(np.concatenate(x) for x in zip(*held))
            end = int(np.searchsorted(whole[0], file[-1]))
            yield links(*(x[:end] for x in whole))
            held = [tuple(x[end:] for x in whole)]
        if held:
            yield links(*(np.concatenate(x) for x in zip(*held)))
    return link


def linked(distinct: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) that keep together all those within `distance` bits, up to three.

    Not every pair is a row: a file of n fingerprints gives fewer than n links, with the same groups."""
    if not 0 <= distance <= DISTANCE:
        raise ValueError(f"two segments find distances up to {DISTANCE}")
    low = F.col("fp").bitwiseAND(2**SEGMENT - 1)
    high = F.shiftrightunsigned("fp", SEGMENT)
    bits = F.expr(f"sequence(0, {SEGMENT - 1})")
    one = lambda v, kind: F.transform(F.filter(bits, lambda b: F.call_function("getbit", v, b) == 0), lambda b: v + F.call_function("shiftleft", F.lit(1).cast("long"), b) + F.lit(kind << SEGMENT))
    # file 0: by the low segment, compared in the high one; file 1: the other way round
    files = F.concat(F.array(F.struct(low.alias("file"), F.lit(1).alias("own")), F.struct((high + F.lit(1 << SEGMENT)).alias("file"), F.lit(1).alias("own"))),
                     F.transform(F.concat(one(low, 0), one(high, 1)), lambda f: F.struct(f.alias("file"), F.lit(0).alias("own"))))
    rows = distinct.select("fp", F.explode(files).alias("x")).select("x.file", "x.own", "fp")
    return (rows.repartition("file").sortWithinPartitions("file").mapInArrow(_linker(distance), "a long, b long").distinct())


def components(links: DataFrame) -> DataFrame:
    """The smallest node that each node of `links` (a < b) can reach: node, root. Nodes without a link are not there.

    Large-star and small-star steps until nothing changes; each step is written, so a lost executor costs one step. Minima are
    taken by partial aggregation, so a node with very many links is no task of its own."""
    edges = staged(links.select("a", "b").where("a <> b"), "links")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b").select("b", "a", "m")
        new = small.select(F.col("m").alias("a"), F.col("a").alias("b")).unionByName(small.select(F.col("m").alias("a"), "b")).where("a <> b").distinct()
        edges = staged(new, "links")
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if state == before:
            return edges.groupBy("b").agg(F.min("a").alias("root")).select(F.col("b").alias("node"), "root").unionByName(
                edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
        before = state


def grouped(docs: DataFrame, distance: int = DISTANCE, words: int = WORDS) -> DataFrame:
    """Every row of `docs` (doc_id, text; other columns are ignored): row (its number), doc_id, fp, component_id, kept_row.

    component_id is the smallest doc_id that links reach, the row's own included; kept_row is the number of the one row that
    stands for the group, of those with that id the first. A null text and one without words have fingerprint zero, linked like
    any other. A null doc_id reads as the largest id. Rows with equal ids stay rows of their own. An empty table stays empty."""
    texts = rows_numbered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), ["doc_id", "text"])
    rows = staged(fingerprints(texts, words), "fingerprints")
    # one row a fingerprint, told by its smallest id
    reps = staged(rows.groupBy("fp").agg(F.min(F.struct(id_or_last(F.col("doc_id")).alias("id"), "row")).alias("rep")), "fingerprint_ids")
    groups = staged(components(linked(reps.select("fp"), distance)), "groups")
    named = reps.join(groups, F.col("fp") == F.col("node"), "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("rep").alias("least"))
    classes = staged(named.join(least, "root").select("fp", F.col("least.id").alias("component_id"), F.col("least.row").alias("kept_row")), "classes")
    return rows.join(classes, "fp").select("row", "doc_id", "fp", "component_id", "kept_row")


def representatives(docs: DataFrame) -> DataFrame:
    """One row of `docs` for each group, the one with the smallest doc_id, with all its columns."""
    docs = settled(docs)
    kept = staged(grouped(docs).where("row = kept_row").select(F.col("row").alias("kept")), "kept_rows")
    numbered = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("given"), row_of(docs).alias("row"))
    return numbered.join(kept, F.col("row") == F.col("kept"), "left_semi").select("given.*")
