"""Groups of texts whose sets of word shingles are similar: SimHash and MinHash bands find pairs, the sets themselves confirm them.

Fingerprints of 64 bits that differ in at most three are found first, by the method of `simhash`. A SimHash alone cannot tell a
similarity of 0.8: such a pair differs in about ten bits, and balls of that size hold most of the corpus. So the rest is found by
bands: each distinct set of shingles gets BANDS keys, each of as many least hashes as still let a pair at the threshold miss
all keys in less than MISSED of the cases (five at 0.8: 3 in a million). Sets that share a key are compared shingle by shingle.

In a first round each member meets one leader, the least of those of its keys; what is similar, of these and of the fingerprints'
pairs, is contracted, so that a group of near copies costs about one comparison a copy. Keys that still hold several groups are
compared in cells, pair by pair, up to SMALL members. Members of larger keys are filed again under more least hashes (and more
keys, so that as few are missed), where sets that are not similar part. Keys that stay larger are cut into blocks, and each two
blocks are a cell. The number of rounds does not depend on how many groups a key holds. A member of a key of up to SMALL meets fewer than
SMALL others there; only a key of sets that no number of hashes parts takes all its pairs, a cell in a task at a time.

Before texts are compared, counts of shingles by low bits of their hash bound the similarity from above, at about a byte a shingle
before compression; only pairs whose bound reaches the threshold send their texts. A cell is held twice: by these counts, which tell
the members that may have a partner, then by the texts of those. It returns links that join its groups, fewer than its members.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.functions.staging import staged

from .common import Powers, id_or_last, mixed, random_table, row_of, rows_numbered, settled
from .simhash import components, fingerprints, linked

BANDS = 32
MISSED = 1e-5
MOST_ROWS = 16               # least hashes of a key, for similarities near one
CHUNK = 256                  # members compared with a leader in one stretch
STRETCH = 2_000              # shingles whose least hashes are taken at once
SMALL = 1_024                # members of a key that are one cell
LEADERS = 512                # members of a block, where more least hashes do not part a larger key
CELL_BYTES = 1 << 20         # of the marks of a block, compressed; its sets of shingles take some twenty times as many
MORE_ROWS = (4, 9)           # least hashes added where large keys stay apart

_POWERS = Powers(0x9E3779B97F4A7C15)
_VALUES = random_table(5)


def band_rows(similarity: float) -> int:
    """How many least hashes make a key."""
    fits = [r for r in range(1, MOST_ROWS + 1) if (1 - similarity ** r) ** BANDS <= MISSED] if 0 < similarity <= 1 else []
    if not fits:
        raise ValueError(f"{BANDS} keys do not find pairs of similarity {similarity}")
    return fits[-1]


def shingles(text: str | None, words: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles of `words` words, A-Z lower-cased. A text of fewer words is one
    shingle; one without words is the shingle of no bytes."""
    found = (text or "").encode().lower().split()
    raw = np.frombuffer(b" ".join(found), dtype=np.uint8)
    sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
    ends = np.cumsum(sizes + 1) - 1
    if len(found) <= words:
        starts, ends = np.zeros(1, dtype=np.int64), np.full(1, len(raw))
    else:
        starts, ends = (ends - sizes)[:len(found) - words + 1], ends[words - 1:]
    return np.unique(mixed(_POWERS.spans(_VALUES[raw], starts, ends)))


def bands_for(similarity: float, rows: int) -> int:
    """How many keys of so many least hashes miss as few pairs."""
    return math.ceil(math.log(MISSED) / math.log1p(-similarity ** rows)) if similarity < 1 else 1


def keys(h: np.ndarray, rows: int, bands: int = BANDS) -> np.ndarray:
    """The keys of a set of shingles."""
    many = bands * rows
    flip, factor = random_table(17, many)[:, None], random_table(19, many)[:, None] | np.uint64(1)
    least = np.full(many, np.uint64(2**64 - 1))
    step = max(1, STRETCH * BANDS * 5 // many)
    with np.errstate(over="ignore"):
        for k in range(0, len(h), step):
            np.minimum(least, ((h[None, k:k + step] ^ flip) * factor).min(axis=1), out=least)
    data = np.c_[np.arange(bands, dtype=np.uint64), least.reshape(bands, rows)].tobytes()
    width = 8 * (rows + 1)
    return np.array([xxhash.xxh3_64_intdigest(data[k:k + width]) for k in range(0, len(data), width)], dtype=np.uint64)


def counts(h: np.ndarray) -> np.ndarray:
    """How many of the shingles have each value of the low bits of their hash; as many values as shingles or up to twice as many."""
    values = 1 << max(6, int(len(h) - 1).bit_length())
    return np.minimum(np.bincount((h & np.uint64(values - 1)).astype(np.int64), minlength=values), 255).astype(np.uint8)


def marks(h: np.ndarray) -> bytes:
    """The counts of a set of shingles, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(counts(h).tobytes())


def loaded_marks(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8).astype(np.int64)


def most_similar(x: np.ndarray, y: np.ndarray) -> float:
    """No two sets with these marks are more similar. A full count (255) stands for any number of shingles."""
    x, y = (x, y) if len(x) <= len(y) else (y, x)
    capped = bool((x == 255).any() or (y == 255).any())
    total = x.sum() + y.sum()
    y = y.reshape(-1, len(x)).sum(axis=0)                      # low bits: the shorter marks are sums of the longer ones
    both = np.minimum(x, y).sum()
    return 1.0 if capped else both / (total - both)


def jaccard(x: np.ndarray, y: np.ndarray) -> float:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both)


def sketches(texts: DataFrame, rows: int, words: int, bands: int = BANDS) -> DataFrame:
    """row, id, a 128-bit digest of the set of shingles, its marks and its keys for every row of `texts` (row, id, text)."""
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, counted, found = [], [], []
            for t in batch.column(2):
                h = shingles(t.as_py(), words)
                digests.append(xxhash.xxh3_128_digest(h.tobytes()))
                counted.append(marks(h))
                found.append(keys(h, rows, bands).view(np.int64))
            at = pa.array(np.arange(len(found) + 1, dtype=np.int32) * bands)
            flat = pa.array(np.concatenate(found) if found else np.zeros(0, dtype=np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digests, type=pa.binary()), pa.array(counted, type=pa.binary()), pa.ListArray.from_arrays(at, flat)],
                                             names=["row", "id", "digest", "marks", "keys"])
    return texts.select("row", "id", "text").mapInArrow(made, "row long, id long, digest binary, marks binary, keys array<long>")


def compared(pairs: DataFrame, data: DataFrame, load: Callable, fits: Callable, many: bool = False) -> DataFrame:
    """Those of the distinct pairs (leader, node) whose `data` (row, data) fit each other. A leader meets its members in chunks.
    `many`: the pairs grow with the table, so the join is planned alike at every size."""
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (leader, chunk, node, data), sorted by (leader, chunk), the leader's own first in each chunk."""
        head, own = None, None
        for batch in batches:
            a, b = [], []
            for leader, chunk, node, x in zip(*(c.to_pylist() for c in batch.columns[:3]), batch.column(3)):
                x = load(x.as_py())
                if node == leader:
                    head, own = (leader, chunk), x
                elif (leader, chunk) != head:
                    raise AssertionError("a chunk without its leader")
                elif fits(own, x):
                    a.append(leader)
                    b.append(node)
            yield pa.RecordBatch.from_arrays([pa.array(a, type=pa.int64()), pa.array(b, type=pa.int64())], names=["leader", "node"])

    chunks = pairs.groupBy("leader").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    heads = chunks.select("leader", F.explode(F.expr("sequence(0, chunks - 1)")).alias("chunk"), F.col("leader").alias("node"))
    tails = pairs.join(chunks, "leader").select("leader", F.expr("cast(pmod(xxhash64(node), chunks) as int)").alias("chunk"), "node")
    asked = heads.unionByName(tails)
    rows = (asked.hint("merge") if many else asked).join(data, F.col("node") == F.col("row")).select("leader", "chunk", "node", "data")
    rows = rows.repartition("leader", "chunk").sortWithinPartitions("leader", "chunk", F.col("node") != F.col("leader"))
    return rows.mapInArrow(compare, "leader long, node long")


def links_between(pairs: DataFrame, sketched: DataFrame, texts: DataFrame, similarity: float, words: int, many: bool) -> DataFrame:
    """The links (a < b) of the pairs that are as similar: bounded by their marks first, confirmed on whole sets of shingles."""
    pairs = staged(pairs, "pairs")
    near = staged(compared(pairs, sketched.select("row", F.col("marks").alias("data")), loaded_marks, lambda x, y: most_similar(x, y) >= similarity), "near_pairs")
    sure = compared(near, texts.select("row", F.col("text").alias("data")), lambda t: shingles(t, words), lambda x, y: jaccard(x, y) >= similarity, many)
    return staged(sure.select(F.least("leader", "node").alias("a"), F.greatest("leader", "node").alias("b")), "similar")


def near_in_cell(root: np.ndarray, side: np.ndarray, loaded: list[np.ndarray], similarity: float) -> Iterator[tuple[int, np.ndarray]]:
    """The places of a cell's members, each with those of others of different groups that may be similar to it by their counts; a
    pair is there once. Members of two blocks (both values of `side`) meet across them only; those of one block all meet."""
    length, total = np.array([len(x) for x in loaded]), np.array([x.sum(dtype=np.int64) for x in loaded])
    capped = np.array([bool((x == 255).any()) for x in loaded])
    across = bool((side != side[0]).any())
    for values in np.unique(length).tolist():
        # the shorter counts go to 255 at most, so no more is needed of the sums that the longer ones are folded to
        rest = np.nonzero(length >= values)[0]
        table = np.stack([np.minimum(loaded[k].reshape(-1, values).sum(axis=0, dtype=np.int64), 255).astype(np.uint8) for k in rest.tolist()])
        for at in np.nonzero(length[rest] == values)[0].tolist():
            k = int(rest[at])
            may = (root[rest] != root[k]) & ((length[rest] > values) | (rest > k))
            if across:
                may &= side[rest] != side[k]
            may &= capped[rest] | capped[k] | (np.minimum(total[rest], total[k]) / np.maximum(total[rest], total[k]) >= similarity)
            others = np.nonzero(may)[0]
            if len(others):
                both = np.minimum(table[others], table[at]).sum(axis=1, dtype=np.int64)
                others = rest[others]
                yield k, others[capped[others] | capped[k] | (both / (total[others] + total[k] - both) >= similarity)]


def links_in_cell(root: np.ndarray, side: np.ndarray, sets: list[np.ndarray], similarity: float) -> Iterator[tuple[int, int]]:
    """Links between the places of a cell's members that are similar; they join what the pairs of the cell do, once."""
    of = np.unique(root, return_inverse=True)[1].tolist()
    up = list(range(max(of) + 1))

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    for k, others in near_in_cell(root, side, [counts(h) for h in sets], similarity):
        for other in others.tolist():
            x, y = find(of[k]), find(of[other])
            if x != y and jaccard(sets[k], sets[other]) >= similarity:
                up[x] = y
                yield k, other


def by_cell(rows: DataFrame, result: Callable, schema: str) -> DataFrame:
    """`result` of each cell of `rows` (key, low, high, node, root, side, data) that holds several groups."""
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, []

        def of_cell() -> list[pa.RecordBatch]:
            node, root, side, data = zip(*held)
            return [result(cell, np.array(node), np.array(root), np.array(side), data)] if len(set(root)) > 1 else []

        for batch in batches:
            for key, low, high, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if (key, low, high) != cell:
                    if held:
                        yield from of_cell()
                    cell, held = (key, low, high), []
                held.append(row)
        if held:
            yield from of_cell()

    rows = rows.select("key", "low", "high", "node", "root", "side", "data")
    return rows.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high").mapInArrow(found, schema)


def cell_links(files: DataFrame, sketched: DataFrame, texts: DataFrame, similarity: float, words: int) -> DataFrame:
    """Links (a < b) between members of the keys in `files` that join all of one key and different groups that are similar. A key is
    a cell; one of more than SMALL members, or of many bytes, is cut into blocks, and each two of them, and each one, are a cell."""
    def may(cell, node, root, side, data) -> pa.RecordBatch:
        some = np.zeros(len(node), dtype=bool)
        for k, others in near_in_cell(root, side, [np.frombuffer(zstandard.ZstdDecompressor().decompress(x), dtype=np.uint8) for x in data], similarity):
            some[others] = True
            some[k] |= len(others) > 0
        key, low, high = cell
        n = int(some.sum())
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, key)), pa.array(np.full(n, low, dtype=np.int32)), pa.array(np.full(n, high, dtype=np.int32)), pa.array(node[some]), pa.array(root[some]), pa.array(side[some])],
                                          names=["key", "low", "high", "node", "root", "side"])

    def sure(cell, node, root, side, data) -> pa.RecordBatch:
        found = list(links_in_cell(root, side, [shingles(t, words) for t in data], similarity))
        x, y = (node[[f[k] for f in found]] if found else np.zeros(0, dtype=np.int64) for k in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

    blocks = F.greatest(F.when(F.col("n") > SMALL, F.ceil(F.col("n") / LEADERS)).otherwise(1), F.ceil(F.col("bytes") / CELL_BYTES)).cast("int")
    cut = files.select("key", "node", "root", blocks.alias("blocks")).withColumn("block", F.expr("cast(pmod(xxhash64(node), blocks) as int)"))
    asked = cut.select("key", "node", "root", "block", F.explode(F.expr("sequence(0, blocks - 1)")).alias("other"))
    asked = asked.select("key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "node", "root", (F.col("block") > F.col("other")).alias("side"))
    counted = asked.hint("merge").join(sketched.select("row", F.col("marks").alias("data")), F.col("node") == F.col("row"))
    near = staged(by_cell(counted, may, "key long, low int, high int, node long, root long, side boolean"), "near_members")
    wanted = texts.select("row", F.col("text").alias("data")).join(near.select(F.col("node").alias("row")).distinct(), "row", "left_semi")
    return staged(by_cell(near.join(wanted, F.col("node") == F.col("row")), sure, "a long, b long").distinct(), "similar")


def fingerprint_pairs(texts: DataFrame, words: int) -> DataFrame:
    """Pairs (leader, node) of rows of `texts` (row, id, text) that keep together all whose SimHashes differ in at most three bits."""
    prints = staged(fingerprints(texts.select("row", F.col("id").alias("doc_id"), "text"), words).select("row", "fp"), "fingerprints")
    reps = staged(prints.groupBy("fp").agg(F.min("row").alias("own")), "fingerprint_rows")
    one = lambda end, name: reps.select(F.col("fp").alias(end), F.col("own").alias(name))                 # noqa: E731
    near = linked(reps.select("fp")).join(one("a", "leader"), "a").join(one("b", "node"), "b").select("leader", "node").where("leader <> node")
    return near.unionByName(prints.join(reps, "fp").where("row <> own").select(F.col("own").alias("leader"), F.col("row").alias("node")))


def still_apart(files: DataFrame, groups: DataFrame | None) -> DataFrame:
    """key, node, size, root of the keys of `files` (key, node, size) that hold members of several groups, with their members (n), bytes and leader."""
    named = files.withColumn("root", F.col("node")) if groups is None else (
        files.join(groups.withColumnRenamed("node", "member"), F.col("node") == F.col("member"), "left").select("key", "node", "size", F.coalesce("root", "node").alias("root")))
    several = named.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n"), F.sum("size").alias("bytes"), F.min(F.struct(F.xxhash64("node").alias("h"), "node", "root")).alias("lead"))
    return staged(named.join(several.where("low < high").select("key", "n", "bytes", F.col("lead.node").alias("leader"), F.col("lead.root").alias("own")), "key"), "files")


def kept_rows(docs: DataFrame, similarity: float, words: int) -> DataFrame:
    """The numbers (row) of the rows of `docs` (doc_id, text) that stand for a group each: the smallest doc_id, of those the first.

    Groups are what pairs of the similarity or more keep together. A null doc_id reads as the largest id."""
    rows = band_rows(similarity)
    texts = rows_numbered(docs.select(id_or_last(F.col("doc_id")).alias("id"), F.col("text").cast("string").alias("text")), ["id", "text"])
    sketched = staged(sketches(texts, rows, words), "sketches")
    # one row a set of shingles, told by its smallest id
    sets = sketched.groupBy("digest").agg(F.min(F.struct("id", "row")).alias("rep")).select("rep.id", "rep.row")
    sets = staged(sets, "sets")
    filing = lambda made: made.select(F.explode("keys").alias("key"), F.col("row").alias("node"), F.octet_length("marks").alias("size"))      # noqa: E731
    filed = filing(sketched.join(sets.select("row"), "row", "left_semi"))
    close = fingerprint_pairs(texts.join(sets.select("row"), "row", "left_semi"), words)
    levels, groups = [rows + k for k in MORE_ROWS], None

    def settle(new: DataFrame) -> None:
        """The groups with the new links."""
        nonlocal groups
        if not new.isEmpty():                                # groups so far are a link from each member to its root
            links = new if groups is None else new.unionByName(groups.where("node <> root").select(F.col("root").alias("a"), F.col("node").alias("b")))
            groups = staged(components(links), "groups")

    while True:
        shared = filed.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
        files = still_apart(filed.join(shared, "key"), groups)
        least = files.where("root <> own").select("leader", "node").groupBy("node").agg(F.min_by("leader", F.xxhash64("leader")).alias("leader")).select("leader", "node")
        settle(links_between(least if close is None else least.unionByName(close).distinct(), sketched, texts, similarity, words, close is not None))
        close, files = None, still_apart(files.select("key", "node", "size"), groups)
        large = files.where(F.col("n") > SMALL) if levels else files.limit(0)
        again = not large.isEmpty()
        settle(cell_links(files.where(F.col("n") <= SMALL) if again else files, sketched, texts, similarity, words))
        if not again:
            break
        rows = levels.pop(0)
        apart = texts.join(large.select(F.col("node").alias("row")).distinct(), "row", "left_semi")
        filed = staged(filing(sketches(apart, rows, words, bands_for(similarity, rows))), "filed")
    if groups is None:
        return sets.select("row")
    named = sets.join(groups, F.col("row") == F.col("node"), "left").select("id", "row", F.coalesce("root", "row").alias("root"))
    return named.groupBy("root").agg(F.min(F.struct("id", "row")).alias("least")).select("least.row")


def representatives(docs: DataFrame, similarity: float, words: int) -> DataFrame:
    """One row of `docs` for each group, the one with the smallest doc_id, with all its columns."""
    docs = settled(docs)
    kept = staged(kept_rows(docs, similarity, words).select(F.col("row").alias("kept")), "kept_rows")
    numbered = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("given"), row_of(docs).alias("row"))
    return numbered.join(kept.hint("merge"), F.col("row") == F.col("kept"), "left_semi").select("given.*")
