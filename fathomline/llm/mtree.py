"""Exact top-k search by integer inner product in an M-tree of paged metric nodes.

The tree has three levels: routing vectors of the whole table, nodes of at most NODE_ROWS rows each, and leaf pages of at most PAGE
rows. A page stores its routing vector, its covering radius, its distance to the parent's vector, and each row's distance to
its own. With d the Euclidean distance, Cauchy and Schwarz give <q,x> <= <q,c> + |q| d(x,c) for any x, and the triangle inequality
bounds a page from its parent alone: <q,x> <= <q,p> + |q| (d(c,p) + radius). A query goes best-first: the node with the highest
bound is opened next, pages and rows whose stored distances rule them out are never computed, and the search ends when no bound
reaches the k-th score so far. Bounds equal to it are followed, so ties are settled by id.

The routing vectors are at most MOST_ROUTES rows taken by hash; every row is in the index. Queries go in blocks of QUERY_BLOCK,
each sent to all tasks; a task searches its pages and returns at most k rows a query.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.functions.staging import staged

SCALE = 1024
K = 10
PAGE = 256
NODE_ROWS = 65_536
MOST_ROUTES, ROUTE_ROWS = 1_024, 4_096      # at most so many routing vectors, one for so many rows
QUERY_BLOCK = 8_192
LARGEST = 2.0 ** 500         # the squares of larger components are no doubles
BEYOND = 2 ** 63 - 1         # stands, with its sign, for a score that does not fit
PAGES = "dim int, route int, center binary, parent double, radius double, ids array<long>, rows array<long>, vectors binary, dists binary"
SLACK, OF_LENGTHS = 1e-9, 1e-12             # what rounding may add to a bound: a share of it, and of the lengths that it comes from


def quantized(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """row, vec_id and q, floor(SCALE x) of every component, of the rows whose id and components are all finite."""
    v = F.col(vector_col).cast("array<double>")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))                                    # noqa: E731
    whole = lambda x: F.when(F.abs(x) < 2.0 ** 43, F.floor(x * SCALE).cast("double")).otherwise(x * SCALE)     # noqa: E731 - no fraction is left there
    q = F.transform("v", lambda x: F.when(F.abs(x) <= LARGEST, whole(x)).otherwise(F.raise_error(F.lit("a component is too large")).cast("double")))
    return (vectors.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
            .where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).where(~F.exists("v", bad)).select("row", "vec_id", q.alias("q")))


def _matrix(lists: list) -> np.ndarray:
    return np.array(lists, dtype=np.float64).reshape(len(lists), -1)


def _dist(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Euclidean distances of the rows of x to the rows of c."""
    gap = (x * x).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2 * (x @ c.T)
    return np.sqrt(np.maximum(gap, 0))


def _router(sent):
    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each row's dimension and nearest routing vector (-1: the origin)."""
        routes = sent.value
        for batch in batches:
            lists = batch.column(2).to_pylist()
            dim = np.array([len(x) for x in lists], dtype=np.int32)
            to = np.full(len(lists), -1, dtype=np.int32)
            for d in set(dim.tolist()) & set(routes):
                at = np.nonzero(dim == d)[0]
                for k in range(0, len(at), 1024):
                    to[at[k:k + 1024]] = _dist(_matrix([lists[j] for j in at[k:k + 1024]]), routes[d]).argmin(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(dim), pa.array(to)], names=["row", "vec_id", "q", "dim", "route"])
    return route


def _node(sent):
    def build(rows: pd.DataFrame) -> pd.DataFrame:
        """The leaf pages of one node."""
        dim, route = int(rows["dim"].iloc[0]), int(rows["route"].iloc[0])
        rows = rows.sort_values(["h", "vec_id", "row"]).reset_index(drop=True)
        x = _matrix(rows["q"].tolist())
        parent = sent.value[dim][route] if route >= 0 else np.zeros(dim)
        centers = x[np.linspace(0, len(x) - 1, max(1, -(-len(x) // PAGE)), dtype=np.int64)]
        near, gap = np.zeros(len(x), dtype=np.int64), np.zeros(len(x))
        for k in range(0, len(x), 4096):
            d = _dist(x[k:k + 4096], centers)
            near[k:k + 4096] = d.argmin(1)
        gap = np.sqrt(((x - centers[near]) ** 2).sum(1))
        order = np.lexsort((gap, near))
        pages = []
        for c, at in ((c, order[a:b]) for c, a, b in zip(range(len(centers)), *(np.searchsorted(near[order], np.arange(len(centers)), side=s) for s in ("left", "right")))):
            for k in range(0, len(at), PAGE):
                p = at[k:k + PAGE]
                pages.append((dim, route, centers[c].tobytes(), float(np.sqrt(((centers[c] - parent) ** 2).sum())), float(gap[p].max()),
                              rows["vec_id"].to_numpy()[p].tolist(), rows["row"].to_numpy()[p].tolist(), x[p].tobytes(), gap[p].tobytes()))
        return pd.DataFrame(pages, columns=["dim", "route", "center", "parent", "radius", "ids", "rows", "vectors", "dists"])
    return build


def build(q: DataFrame) -> tuple[DataFrame, dict[int, np.ndarray], dict[int, list[tuple[int, int]]]]:
    """The pages of an index over the rows of `q` (row, vec_id, q), its routing vectors, and the (row, id) of each of those."""
    spark = q.sparkSession
    n = q.count()
    sample = q.orderBy(F.xxhash64("vec_id"), "vec_id", "row").limit(max(1, min(MOST_ROUTES, -(-n // ROUTE_ROWS) + K))).collect()
    routes: dict[int, list] = defaultdict(list)
    owners: dict[int, list] = defaultdict(list)
    for r in sample:
        routes[len(r.q)].append(r.q)
        owners[len(r.q)].append((r.row, r.vec_id))
    centers = {d: _matrix(x) for d, x in routes.items()}
    sent = spark.sparkContext.broadcast(centers)
    placed = staged(q.mapInArrow(_router(sent), "row long, vec_id long, q array<double>, dim int, route int"), "placed")
    sizes = placed.groupBy("dim", "route").agg(F.count("*").alias("c"))
    # a node that very many rows are nearest to is several, dealt by hash
    node = F.pmod(F.xxhash64("row", "vec_id"), F.ceil(F.col("c") / NODE_ROWS))
    dealt = placed.join(sizes, ["dim", "route"]).select("dim", "route", node.alias("part"), "row", "vec_id", "q", F.xxhash64("vec_id").alias("h"))
    return staged(dealt.groupBy("dim", "route", "part").applyInPandas(_node(sent), PAGES), "tree_pages"), centers, owners


def products(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Exact inner products of integers held as doubles; -BEYOND or BEYOND where they do not fit."""
    if not len(query) or float(np.abs(vectors).max(initial=0)) * float(np.abs(query).max()) * len(query) < 2.0**53:
        return (vectors @ query).astype(np.int64)
    wide = np.maximum(np.abs(vectors).max(axis=1), 1) * max(1.0, float(np.abs(query).max())) * len(query) >= 2.0**62
    out = np.zeros(len(vectors), dtype=np.int64)
    if not wide.all():
        out[~wide] = vectors[~wide].astype(np.int64) @ query.astype(np.int64)
    ints = [int(x) for x in query] if wide.any() else []
    for k in np.nonzero(wide)[0].tolist():
        out[k] = min(BEYOND, max(-BEYOND, sum(int(x) * y for x, y in zip(vectors[k].tolist(), ints))))
    return out


class _Found:
    """The best k rows of a query so far, by score and then smaller id."""

    def __init__(self, k: int, floor: float):
        self.k, self.floor = k, floor
        self.score, self.ids, self.rows = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def add(self, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        s, i, r = np.r_[self.score, score], np.r_[self.ids, ids], np.r_[self.rows, rows]
        best = np.lexsort((r, i, -s))[:self.k]
        self.score, self.ids, self.rows = s[best], i[best], r[best]
        if len(best) == self.k:
            self.floor = max(self.floor, float(self.score[-1]))


def best_first(query: np.ndarray, own: int, k: int, floor: float, nodes: dict[int, tuple[np.ndarray, list]], counted: list | None = None) -> _Found:
    """Search `nodes`: route -> (its vector, pages of (center, parent distance, radius, ids, rows, vectors, dists)).

    `floor`: a score that k other rows are known to reach. `counted`: gets the number of inner products."""
    size, found, heap, tie = float(np.sqrt(query @ query)), _Found(k, floor), [], 0
    short = lambda bound, length: bound + SLACK * (abs(bound) + size) + OF_LENGTHS * size * length < found.floor        # noqa: E731
    for route, (vector, pages) in nodes.items():
        at, far, long = float(query @ vector), max(p[1] + p[2] for p in pages), float(np.sqrt(vector @ vector))
        bound = at + size * far + OF_LENGTHS * size * (long + far)
        heap.append((-bound, tie := tie + 1, at, pages, None))
    done = len(heap)
    heapq.heapify(heap)
    while heap:
        bound, _, at, pages, page = heapq.heappop(heap)
        if short(-bound, 0):                                  # what lengths may add is in it
            break
        if page is None:
            for p in pages:
                length = float(np.sqrt(p[0] @ p[0])) + p[1] + p[2]
                if short(at + size * (p[1] + p[2]), length):  # known from the parent alone
                    continue
                here = float(query @ p[0])
                done += 1
                if not short(here + size * p[2], length):
                    heapq.heappush(heap, (-(here + size * p[2] + OF_LENGTHS * size * length), tie := tie + 1, here, None, p))
        else:
            center, _, radius, ids, rows, vectors, dists = page
            reach, length = at + size * dists, float(np.sqrt(center @ center)) + radius
            some = np.nonzero((reach + SLACK * (np.abs(reach) + size) + OF_LENGTHS * size * length >= found.floor) & (rows != own))[0]
            if len(some):
                found.add(products(vectors[some], query), ids[some], rows[some])
                done += len(some)
    if counted is not None:
        counted.append(done)
    return found


def _searcher(queries, sent, k: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        routes = sent.value
        nodes: dict[int, dict[int, tuple[np.ndarray, list]]] = defaultdict(dict)
        for batch in batches:
            for dim, route, center, parent, radius, ids, rows, vectors, dists in zip(*[c.to_pylist() for c in batch.columns]):
                vector = routes[dim][route] if route >= 0 else np.zeros(dim)
                nodes[dim].setdefault(route, (vector, []))[1].append((
                    np.frombuffer(center), parent, radius, np.array(ids, dtype=np.int64), np.array(rows, dtype=np.int64),
                    np.frombuffer(vectors).reshape(len(ids), dim), np.frombuffer(dists)))
        for row, query_id, query, floor in queries.value:
            if len(query) in nodes:
                got = best_first(query, row, k, floor, nodes[len(query)])
                n = len(got.ids)
                yield pa.RecordBatch.from_arrays([pa.array([row] * n, pa.int64()), pa.array([query_id] * n, pa.int64()), pa.array(got.rows), pa.array(got.ids),
                                                  pa.array(got.score)], names=["query_row", "query_id", "row", "vec_id", "score"])
    return search


def top_k(vectors: DataFrame, is_query: Column, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows by inner product for every row of `vectors` where `is_query` (on vec_id) holds.

    A query's own row is no candidate; rows that share its id or its vector are. Rows with a null id, a null vector, or null or
    non-finite components take no part. Vectors of another length than the query's are no candidates. Scores are exact at any size; a
    score among the k best that does not fit 64 bits stops the job, as does a component beyond LARGEST.
    Ties go to the smaller vec_id. With fewer than k candidates all are returned; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    q = staged(quantized(vectors, id_col, vector_col), "vectors")
    pages, routes, owners = build(q)
    spread, found = spark.sparkContext.broadcast(routes), None
    asked = q.where(is_query)
    n = asked.count()
    # blocks of about the same size, by hash
    blocks = max(1, -(-n // (QUERY_BLOCK * 3 // 4)))
    block = F.pmod(F.xxhash64("vec_id", "row"), F.lit(blocks))
    for b in range(blocks):
        queries = []
        for r in asked.where(block == b).toLocalIterator():
            x = np.array(r.q, dtype=np.float64)
            floor = -np.inf
            if len(x) in routes:                              # k routing vectors other than the query reach this score
                known = np.sort(products(routes[len(x)], x)[[o[0] != r.row for o in owners[len(x)]]])[::-1]
                floor = float(known[k - 1]) if len(known) >= k else floor
            queries.append((r.row, r.vec_id, x, floor))
        sent = spark.sparkContext.broadcast(queries)
        part = staged(pages.mapInArrow(_searcher(sent, spread, k), "query_row long, query_id long, row long, vec_id long, score long"), "found")
        found = part if found is None else found.unionByName(part)
    w = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    fits = F.when(F.abs("score") < BEYOND, F.col("score")).otherwise(F.raise_error(F.lit("a score does not fit 64 bits")).cast("long"))
    return found.select("query_id", F.row_number().over(w).alias("rank"), "vec_id", "score").where(F.col("rank") <= k).select("query_id", "rank", "vec_id", fits.alias("score"))


ORACLE = f"""
WITH v AS (SELECT vec_id, [CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS q FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
e AS (SELECT vec_id, unnest(q) AS x, generate_subscripts(q, 1) AS k FROM v),
s AS (SELECT a.vec_id AS query_id, b.vec_id, sum(a.x * b.x) AS score FROM e a JOIN e b ON a.k = b.k AND a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, CAST(score AS BIGINT) AS score FROM r WHERE rank <= {K}
"""
