"""A prefix trie over conversations, and totals of its subtrees by time-forward processing.

Each conversation is rebuilt (see `rebuilt`), and each distinct sequence of its first d turns is a node. A node is known by two
running XORs of 64-bit hashes of (place, turn), so a prefix is hashed in slices however long its conversation is.

Subtree totals: nodes are sorted by reverse level order; each takes what its children have sent it from a priority queue and sends
its own total to its parent. Ranges of nodes that stand close together in the tree are shards, each with its own queue, which
spills sorted runs to the shared folder. What a shard sends out of itself is added up by receiver; receivers form a smaller tree
(from each to the receiver that its shard's root sends to), which is worked off in the same way, in a sixteenth of the shards,
until one is enough. A second pass within the shards adds what came in.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathomline.functions.ordered import ordered
from fathomline.functions.staging import new_path, staged

FAMILY = 5                   # conversations that share the first turns of the first of them
MOST_SHARED = 9              # fewer turns than this are shared
SLICE = 4_096                # turns of a conversation hashed in one stretch
ANCHORS = (1, 2, 4, 8)       # depths whose prefixes say which nodes stand close together
SHARD = 100_000              # nodes of a shard, about
HELD = 200_000               # messages of a queue in memory
BLOCK = 4_096                # messages read back at once
CHUNK = 512                  # conversations of one stretch of a listed digest
NODE, PARENT = ["depth", "x1", "x2"], ["up", "p1", "p2"]


class Messages:
    """A priority queue of rows of integers. Beyond `held` rows they go to `folder` as sorted runs, read back block by block."""

    def __init__(self, folder: str, width: int, held: int = HELD):
        self.folder, self.width, self.held, self.rows, self.runs, self.files = folder, width, held, [], [], []
        self.fs = self.path = None

    def push(self, row: tuple) -> None:
        heapq.heappush(self.rows, row)
        if len(self.rows) > self.held:
            self.spill()

    def spill(self) -> None:
        if self.fs is None:
            self.fs, self.path = pyarrow.fs.FileSystem.from_uri(self.folder)
            self.fs.create_dir(self.path)
        context = TaskContext.get()
        name = f"{self.path}/{context.taskAttemptId() if context else 0}-{id(self)}-{len(self.files)}"
        with self.fs.open_output_stream(name) as out:
            out.write(np.array(sorted(self.rows), dtype=np.int64).tobytes())
        self.files.append(name)
        self.rows = []
        self.follow(self._read(name))

    def _read(self, name: str) -> Iterator[tuple]:
        with self.fs.open_input_stream(name) as source:
            while data := source.read(8 * self.width * BLOCK):
                yield from map(tuple, np.frombuffer(data, dtype=np.int64).reshape(-1, self.width).tolist())

    def follow(self, run: Iterator[tuple]) -> None:
        if (row := next(run, None)) is not None:
            heapq.heappush(self.runs, (row, len(self.files) + id(run), run))

    def first(self) -> tuple | None:
        return min([x for x in (self.rows[0] if self.rows else None, self.runs[0][0] if self.runs else None) if x is not None], default=None)

    def pop(self) -> tuple:
        if self.rows and (not self.runs or self.rows[0] <= self.runs[0][0]):
            return heapq.heappop(self.rows)
        row, _, run = heapq.heappop(self.runs)
        self.follow(run)
        return row

    def close(self) -> None:
        self.runs = []
        for name in self.files:
            self.fs.delete_file(name)


SENT = "depth long, x1 long, x2 long, leaves long, saved long"


def _sweeper(folder: str, inside: bool, held: int):
    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Nodes (shard, depth, x1, x2, up, p1, p2, leaves, saved) by shard, the deepest first: the totals of the nodes, or else what
        goes to parents outside the shard."""
        queue, shard, out = Messages(folder, 5, held), None, []

        def told() -> pa.RecordBatch:
            cols = list(zip(*out)) if out else [()] * 5
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["depth", "x1", "x2", "leaves", "saved"])

        def outside(before: tuple | None) -> None:
            """Take all messages in front of a node: their receivers are not in this shard."""
            while (m := queue.first()) is not None and (before is None or m[:3] < before):
                queue.pop()
                if not inside:
                    out.append((-m[0], *m[1:]))

        try:
            for batch in batches:
                for at, depth, x1, x2, up, p1, p2, leaves, saved in zip(*(c.to_pylist() for c in batch.columns)):
                    if at != shard:
                        outside(None)
                        shard = at
                    here = (-depth, x1, x2)
                    outside(here)
                    while (m := queue.first()) is not None and m[:3] == here:
                        queue.pop()
                        leaves, saved = leaves + m[3], saved + m[4]
                    if inside:
                        out.append((depth, x1, x2, leaves, saved))
                    if up is not None:
                        queue.push((-up, p1, p2, leaves, saved))
                yield told()
            outside(None)
            yield told()
        finally:
            queue.close()
    return sweep


def _exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes (shard, depth, x1, x2, up, p1, p2) by shard, the least deep first: the parent outside the shard that each one's total ends at."""
    known: dict[tuple, tuple] = {}
    shard = None
    for batch in batches:
        out = []
        for at, depth, x1, x2, up, p1, p2 in zip(*(c.to_pylist() for c in batch.columns)):
            if at != shard:
                known, shard = {}, at
            known[depth, x1, x2] = exit = known.get((up, p1, p2), (up, p1, p2))
            out.append((depth, x1, x2, *exit))
        cols = list(zip(*out)) if out else [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=[*NODE, *PARENT])


def sharded(tree: DataFrame, shards: int) -> DataFrame:
    """`tree` with `shard`: ranges of nodes whose first turns are alike."""
    near = [f"a{k}" for k in ANCHORS]
    return staged(tree.repartitionByRange(shards, *[F.col(c).asc_nulls_first() for c in near], "conv_id", "depth", "x1", "x2").withColumn("shard", F.spark_partition_id()), "shards")


def subtree_totals(tree: DataFrame, shards: int, held: int = HELD) -> DataFrame:
    """`leaves` and `saved` of every node of a sharded tree, added up over its subtree."""
    folder = new_path(tree.sparkSession, "queues")
    columns = ["shard", *NODE, *PARENT, "leaves", "saved"]
    up = lambda t, inside: (t.select(*columns).repartition("shard").sortWithinPartitions("shard", F.col("depth").desc(), "x1", "x2")        # noqa: E731
                            .mapInArrow(_sweeper(folder, inside, held), SENT))
    if shards > 1:
        sent = staged(up(tree, False).groupBy(*NODE).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")), "sent")
        if not sent.isEmpty():
            exits = tree.select(*columns[:7]).repartition("shard").sortWithinPartitions("shard", "depth").mapInArrow(_exits, ", ".join(f"{c} long" for c in [*NODE, *PARENT]))
            near = tree.select(*NODE, "conv_id", *[f"a{k}" for k in ANCHORS])
            above = sharded(sent.join(exits, NODE).join(near, NODE), max(1, shards // 16))
            added = subtree_totals(above, max(1, shards // 16), held).select(*NODE, F.col("leaves").alias("more_leaves"), F.col("saved").alias("more_saved"))
            tree = tree.join(added, NODE, "left").withColumns({c: F.col(c) + F.coalesce(f"more_{c}", F.lit(0)) for c in ("leaves", "saved")})
    return staged(up(tree, True), "totals")


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns of every rebuilt conversation: conv_id, depth (from 1), x1, x2 (its prefix), p1, p2 (the prefix before), size (bytes
    of the text), length (turns of the conversation), a1, ... (prefixes that hold it); and every conv_id with its length.

    c gets the first h turns of conversation c - c % 5, then its own after the first h; h = crc32(c) % 9."""
    c = conversations.where("conv_id IS NOT NULL")
    role, text = (F.coalesce(F.col(k).cast("string"), F.lit("")) for k in ("role", "text"))
    turns = c.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                     F.unhex(F.md5(F.concat(F.length(role), F.lit(":"), role, text).cast("binary"))).alias("turn_digest"), F.octet_length(text).cast("long").alias("size"))
    turns = staged(ordered(turns, ["conv_id"], [F.col("turn").asc_nulls_first(), "turn_digest"])
                   .select("conv_id", (F.col("rank") + 1).alias("i"), F.col("group_n").alias("n"), "turn_digest", "size"), "turns")
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % MOST_SHARED
    ids = turns.where("i = 1").select("conv_id", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"), "n")
    first = ids.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    ids = ids.join(first, "base", "left").withColumn("s", F.least("h", F.coalesce("n_base", F.lit(0))))
    ids = staged(ids.withColumn("length", F.col("s") + F.greatest(F.col("n") - F.col("h"), F.lit(0))), "conversations")
    cut = F.floor((F.col("i") - 1) / SLICE)
    own = turns.select("conv_id", "i", cut.alias("slice"), "turn_digest", "size").join(
        ids.select("conv_id", "h", "s", "length", F.explode(F.expr(f"sequence(0, (n - 1) div {SLICE})")).alias("slice")), ["conv_id", "slice"]).where("i > h")
    own = own.select("conv_id", "slice", (F.col("s") + F.col("i") - F.col("h")).alias("depth"), "turn_digest", "size", "length")
    lent = turns.where(F.col("i") < MOST_SHARED).select(F.col("conv_id").alias("base"), "i", "turn_digest", "size").join(ids.select("conv_id", "base", "h", "length"), "base").where("i <= h")
    rows = own.unionByName(lent.select("conv_id", F.lit(-1).cast("long").alias("slice"), F.col("i").alias("depth"), "turn_digest", "size", "length"))
    rows = rows.withColumns({"e1": F.xxhash64("depth", "turn_digest"), "e2": F.xxhash64("turn_digest", "depth")})
    run = Window.partitionBy("conv_id", "slice").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    rows = staged(rows.withColumns({"r1": F.bit_xor("e1").over(run), "r2": F.bit_xor("e2").over(run)}).drop("turn_digest"), "slices")
    # a row a slice carries what comes before it, and the prefixes at the anchors, which stand in the first slices
    before = Window.partitionBy("conv_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast("long")
    parts = rows.groupBy("conv_id", "slice").agg(F.bit_xor("e1").alias("t1"), F.bit_xor("e2").alias("t2"), *[F.max(F.when(F.col("depth") == k, F.col("r1"))).alias(f"a{k}") for k in ANCHORS])
    parts = parts.select("conv_id", "slice", *[F.coalesce(F.bit_xor(f"t{k}").over(before), none).alias(f"b{k}") for k in (1, 2)], *[f"a{k}" for k in ANCHORS])
    parts = parts.select("conv_id", "slice", "b1", "b2", *[F.max(F.col(f"a{k}").bitwiseXOR(F.col("b1"))).over(Window.partitionBy("conv_id")).alias(f"a{k}") for k in ANCHORS])
    out = rows.join(parts, ["conv_id", "slice"]).withColumns({"x1": F.col("r1").bitwiseXOR(F.col("b1")), "x2": F.col("r2").bitwiseXOR(F.col("b2"))})
    out = out.select("conv_id", "depth", "x1", "x2", F.col("x1").bitwiseXOR(F.col("e1")).alias("p1"), F.col("x2").bitwiseXOR(F.col("e2")).alias("p2"), "size", "length",
                     *[F.when(F.col("depth") >= k, F.col(f"a{k}")).alias(f"a{k}") for k in ANCHORS])
    return staged(out, "prefixes"), ids.select("conv_id", "length")


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (depth, x1, x2, conv_id): the ids of a node in stretches, joined by commas."""
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [c.to_numpy() for c in batch.columns]
        new = np.zeros(batch.num_rows, dtype=bool)
        new[0] = True
        for c in cols[:3]:
            new[1:] |= c[1:] != c[:-1]
        heads = np.nonzero(new)[0]
        cuts = np.concatenate([np.arange(a, b, CHUNK) for a, b in zip(heads, np.r_[heads[1:], batch.num_rows])])
        ids = [",".join(map(str, cols[3][a:b].tolist())) for a, b in zip(cuts, np.r_[cuts[1:], batch.num_rows])]
        yield pa.RecordBatch.from_arrays([*(pa.array(c[cuts]) for c in cols), pa.array(ids, pa.string())], names=[*NODE, "first", "ids"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches by node and first id: the SHA-256 of each node's whole list."""
    node, state = None, None
    done: list[tuple] = []

    def told() -> pa.RecordBatch:
        cols = list(zip(*done)) if done else [()] * 4
        done.clear()
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())], names=[*NODE, "ends_sha256"])

    for batch in batches:
        for depth, x1, x2, _, ids in zip(*(c.to_pylist() for c in batch.columns)):
            if node != (depth, x1, x2):
                if node is not None:
                    done.append((*node, state.hexdigest()))
                node, state = (depth, x1, x2), hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
        yield told()
    if node is not None:
        done.append((*node, state.hexdigest()))
        yield told()


def trie(conversations: DataFrame, shard: int = SHARD, held: int = HELD) -> DataFrame:
    """A row for every node of the trie over the rebuilt `conversations` (conv_id, turn, role, text; other columns are ignored):
    conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Null roles and texts are empty; a null turn comes first; turns of one number are ordered by the MD5 of role and text, and all
    count. Rows without a conv_id belong to no conversation and take no part. A table without conversations has no node; a
    conversation whose turns are all replaced by none ends at the root."""
    prefixes, ids = rebuilt(conversations)
    zero = F.lit(0).cast("long")
    near = [f"a{k}" for k in ANCHORS]
    nodes = prefixes.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.first("size").alias("size"), (F.first("depth") - 1).alias("up"),
                                        F.first("p1").alias("p1"), F.first("p2").alias("p2"), *[F.first(c).alias(c) for c in near])
    none = F.lit(None).cast("long")
    root = ids.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0").select(
        *[zero.alias(c) for c in NODE], "conv_id", "n_convs", zero.alias("size"), *[none.alias(c) for c in [*PARENT, *near]])
    nodes = staged(nodes.unionByName(root), "nodes")
    children = nodes.where("up IS NOT NULL").groupBy(*PARENT).agg(F.count("*").alias("n_children")).select(*[F.col(a).alias(b) for a, b in zip(PARENT, NODE)], "n_children")
    tree = nodes.join(children, NODE, "left").withColumn("n_children", F.coalesce("n_children", zero))
    tree = tree.withColumns({"leaves": (F.col("n_children") == 0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("size")})
    shards = max(1, -(-nodes.count() // shard))
    tree = sharded(tree, shards)
    totals = subtree_totals(tree, shards, held).select(*NODE, F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"))
    # a shard asks for each parent once
    asked = tree.where("up IS NOT NULL").select("shard", *PARENT).distinct()
    parents = asked.join(nodes.select(*[F.col(a).alias(b) for a, b in zip(NODE, PARENT)], F.col("conv_id").alias("parent_conv_id")), PARENT)
    ends = prefixes.where("depth = length").select(*NODE, "conv_id").unionByName(ids.where("length = 0").select(*[zero.alias(c) for c in NODE], "conv_id"))
    order = [*NODE, "conv_id"]
    lists = ends.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_listed, "depth long, x1 long, x2 long, first long, ids string")
    hashed = staged(lists.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInArrow(_hashed, "depth long, x1 long, x2 long, ends_sha256 string"), "ends")
    out = tree.join(parents, ["shard", *PARENT], "left").join(totals, NODE).join(hashed, NODE, "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                      F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


ORACLE = f"""
WITH crc AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tbl),
t AS (SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, md5(length(role) || ':' || role || text)) AS turns
      FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL) GROUP BY conv_id),
h AS (SELECT conv_id, turns, xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: ascii(x))),
             lambda c, b: xor(c >> 8, tbl[(xor(c, b) & 255) + 1])), 4294967295) % {MOST_SHARED} AS h FROM t, crc),
r AS (SELECT h.conv_id, list_concat(coalesce(b.turns, [])[1:h], h.turns[h + 1:]) AS r FROM h LEFT JOIN t AS b ON b.conv_id = h.conv_id - h.conv_id % {FAMILY}),
p AS (SELECT conv_id, d, r[1:d] AS k, r[1:d - 1] AS up, len(r) = d AS ends, CASE WHEN d = 0 THEN 0 ELSE octet_length(encode(r[d].text)) END AS size
      FROM (SELECT conv_id, r, unnest(range(0, len(r) + 1)) AS d FROM r)),
n AS (SELECT d, k, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(size) AS size, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends) AS ids
      FROM p GROUP BY d, k),
c AS (SELECT d - 1 AS d, up AS k, count(*) AS n_children FROM n WHERE d > 0 GROUP BY d, up),
v AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN c ON c.d = n.d AND c.k = n.k),
u AS (SELECT DISTINCT x.d AS d, x.k AS k, y.d AS d2, y.k AS k2 FROM p AS x JOIN p AS y ON x.conv_id = y.conv_id AND y.d >= x.d),
s AS (SELECT u.d, u.k, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * size) AS saved FROM u JOIN v ON v.d = u.d2 AND v.k = u.k2 GROUP BY u.d, u.k)
SELECT v.conv_id, CAST(v.d AS BIGINT) AS depth, w.conv_id AS parent_conv_id, CAST(v.n_convs AS BIGINT) AS n_convs, CAST(v.n_children AS BIGINT) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
       CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(v.ids, '')) AS ends_sha256
FROM v JOIN s ON s.d = v.d AND s.k = v.k LEFT JOIN v AS w ON w.d = v.d - 1 AND w.k = v.up
"""
