"""Histogram boosted trees with a branch for missing values.

Rows that agree in every feature and the label become one row with a weight before anything moves, so copies cost nothing. The cuts
of the features are made over the cluster from every value of every row, and the rows become bin numbers there, a byte a feature. One
model is fitted in one task from the bin numbers of all its rows; the models of all folds are fitted side by side. A fitted model is a
table of nodes whose size follows from the settings alone; scoring reads it in every task.

Trees grow leaf by leaf, the leaf with the largest gain first. With G and H the sums of gradients p - y and of p (1 - p), a leaf's
value is -rate x G / (H + l2), and a split's gain is the rise of the sum of G^2 / (H + l2). Missing values go to the side with the
larger gain; where a node saw none they go to its larger child. Ties: the earlier feature, the smaller threshold, missing to the right.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.guards import Refused
from ..functions.staging import staged

BLOCKS = "model int, codes binary, y binary, w binary"
NODES = "tree int, node int, feature int, threshold double, missing_left boolean, left int, right int, value double, gain double, n long"
LEAST_HESSIAN = 1e-3         # on either side of a split
OUTERMOST = 1e307


@dataclass(frozen=True)
class TreeModel:
    """`nodes`: a row per node by (tree, node); tree -1 holds the start, the log odds of all rows. A leaf has feature -1."""

    features: tuple[str, ...]
    nodes: pd.DataFrame


def _numbers(features: Sequence[str]) -> list[Column]:
    """The features as doubles; NaN is missing, infinities are the outermost values."""
    none, most = F.lit(None).cast("double"), F.lit(OUTERMOST)
    inside = lambda x: F.when(x > most, most).when(x < -most, -most).otherwise(x)         # noqa: E731
    return [inside(F.nanvl(F.col(f"`{c}`").cast("double"), none)).alias(f"x{i}") for i, c in enumerate(features)]


def _cuts(v: np.ndarray, w: np.ndarray, bins: int) -> np.ndarray:
    """Where a feature's values are cut: between all neighbours if there are few, else at even shares of the rows. `w` are whole numbers."""
    there = ~np.isnan(v)
    values, at = np.unique(v[there], return_inverse=True)
    if len(values) > bins:
        below = np.cumsum(np.bincount(at, weights=w[there]))
        last = np.unique(np.searchsorted(below, below[-1] * np.arange(1, bins) / bins))
        last = last[last < len(values) - 1]
    else:
        last = np.arange(len(values) - 1)
    return (values[last] + values[last + 1]) / 2 if len(values) else np.zeros(0)


def _codes(v: np.ndarray, cuts: np.ndarray, bins: int) -> np.ndarray:
    """A feature's bin numbers in the smallest type; the last bin holds the missing values."""
    return np.where(np.isnan(v), bins, np.searchsorted(cuts, v)).astype(np.min_scalar_type(bins))


def _columns_out(width: int):
    """Rows -> the values of each feature, with their folds and weights in the smallest types."""
    small = lambda v: v.astype(np.promote_types(np.min_scalar_type(v.min()), np.min_scalar_type(v.max())))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            fold, w = (small(b.column(c).to_numpy()) for c in ("fold", "w"))
            for j in range(width):
                v = b.column(f"x{j}").to_numpy(zero_copy_only=False)
                there = ~np.isnan(v)
                if there.any():
                    yield pa.RecordBatch.from_pydict({"j": pa.array([j], pa.int32()), "v": [v[there].tobytes()], "fold": [fold[there].tobytes()],
                                                      "w": [w[there].tobytes()], "fold_type": [fold.dtype.str], "w_type": [w.dtype.str]})
    return work


def _column_cutter(k: int, bins: int):
    """The values of one feature -> its cuts for every model."""
    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v, fold, w = [], [], []
        for b in parts:
            j = int(b["j"].iloc[0])
            v += [np.frombuffer(c) for c in b["v"]]
            fold += [np.frombuffer(c, t) for c, t in zip(b["fold"], b["fold_type"])]
            w += [np.frombuffer(c, t) for c, t in zip(b["w"], b["w_type"])]
        v, fold, w = (np.concatenate(t) for t in (v, fold, w))
        yield pd.DataFrame([(j, i, _cuts(v[fold != i], w[fold != i], bins).tobytes()) for i in range(k)], columns=["j", "model", "cuts"])
    return work


def _cuts_of_all(rows: DataFrame, width: int, k: int, bins: int) -> list[list[np.ndarray]]:
    """The cuts of every model and feature, from all rows outside the model's fold. A feature's values meet in one task, ten bytes or so
    a row; the fit has more of every row in one."""
    columns = rows.mapInArrow(_columns_out(width), "j int, v binary, fold binary, w binary, fold_type string, w_type string")
    found = columns.groupBy("j").applyInPandas(_column_cutter(k, bins), "j int, model int, cuts binary").toPandas()
    out = [[np.zeros(0)] * width for _ in range(k)]
    for j, model, cuts in zip(found["j"], found["model"], found["cuts"]):
        out[model][j] = np.frombuffer(cuts)
    return out


def _binner(sent: Broadcast, bins: int):
    """Rows -> blocks: the bin numbers of a batch's rows, feature by feature, once for every model that may see them."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fold, y, w = (b.column(c).to_numpy() for c in ("fold", "y", "w"))
            for model, cuts in enumerate(sent.value):
                at = fold != model
                if at.any():
                    codes = [_codes(b.column(f"x{j}").to_numpy(zero_copy_only=False)[at], c, bins).tobytes() for j, c in enumerate(cuts)]
                    yield pa.RecordBatch.from_pydict({"model": pa.array([model], pa.int32()), "codes": [b"".join(codes)],
                                                      "y": [y[at].astype(np.uint8).tobytes()], "w": [w[at].astype(np.int64).tobytes()]})
    return work


class _Grower:
    """The trees of one model over binned rows; the last bin of a feature holds the missing ones."""

    def __init__(self, codes: list[np.ndarray], cuts: list[np.ndarray], w: np.ndarray, s: HistogramTrees):
        self.s, self.codes, self.cuts, self.w, self.width = s, codes, cuts, w, s.max_bins + 1
        self.counts = np.array([np.bincount(c, weights=w, minlength=self.width) for c in codes])
        # a cut after the last value only parts the missing from the rest
        self.allowed = np.arange(s.max_bins)[None, :] <= np.array([len(c) for c in self.cuts])[:, None]

    def sums(self, rows: np.ndarray | None = None) -> np.ndarray:
        """Gradients, Hessians and rows of every (feature, bin) of some rows, or of all: then the rows are those of every tree."""
        out = np.empty((3, len(self.codes), self.width))
        if rows is None:
            out[2], rows, values = self.counts, slice(None), [self.g, self.h]
        else:
            values = [t[rows] for t in (self.g, self.h, self.w)]
        for j, codes in enumerate(self.codes):
            code = codes[rows].astype(np.intp)
            for i, t in enumerate(values):
                out[i, j] = np.bincount(code, weights=t, minlength=self.width)
        return out

    def best(self, sums: np.ndarray):
        """The best split of a node: gain, feature, bin, missing to the left. None where no split is allowed."""
        total, gone = sums[:, 0, :].sum(axis=1)[:, None, None], sums[:, :, -1:]
        some = gone[2] > 0
        below = np.cumsum(sums[:, :, :-1], axis=2)
        found = None
        for side in (False, True):
            left = below + gone if side else below
            right = total - left
            ok = self.allowed & (left[2] >= self.s.min_rows_leaf) & (right[2] >= self.s.min_rows_leaf) & (left[1] >= LEAST_HESSIAN) & (right[1] >= LEAST_HESSIAN)
            if side:
                ok &= some
            l2 = self.s.l2
            gain = np.where(ok, left[0] ** 2 / (left[1] + l2) + right[0] ** 2 / (right[1] + l2), -np.inf) - total[0] ** 2 / (total[1] + l2)
            j, b = divmod(int(gain.argmax()), gain.shape[1])
            if gain[j, b] > 1e-12 and (found is None or gain[j, b] > found[0]):
                found = (gain[j, b], j, b, side if some[j, 0] else bool(left[2, j, b] >= right[2, j, b]))
        return found

    def tree(self, g: np.ndarray, h: np.ndarray) -> tuple[list, np.ndarray]:
        """Nodes of the next tree, and what it adds to every row."""
        self.g, self.h = g * self.w, h * self.w
        nodes, rows_of, waiting, leaves = [], [], [], 1

        def add(rows, sums):
            total = sums[:, 0, :].sum(axis=1)
            nodes.append([-1, np.inf, False, -1, -1, -self.s.learning_rate * total[0] / (total[1] + self.s.l2), 0.0, int(round(total[2]))])
            rows_of.append(rows)
            if split := self.best(sums):
                heapq.heappush(waiting, (-split[0], len(nodes) - 1, split, sums))
            return len(nodes) - 1

        everything = np.arange(len(g))
        add(everything, self.sums())
        while waiting and leaves < self.s.max_leaf_nodes:
            _, at, (gain, j, b, missing_left), sums = heapq.heappop(waiting)
            rows, code = rows_of[at], self.codes[j][rows_of[at]]
            to_left = np.where(code == self.s.max_bins, missing_left, code <= b)
            parts = rows[to_left], rows[~to_left]
            small = int(len(parts[1]) < len(parts[0]))
            own = self.sums(parts[small])                                   # the other side is the rest
            both = (own, sums - own) if small == 0 else (sums - own, own)
            threshold = self.cuts[j][b] if b < len(self.cuts[j]) else np.inf
            nodes[at][:5] = [j, threshold, missing_left, add(parts[0], both[0]), add(parts[1], both[1])]
            nodes[at][6] = gain
            rows_of[at] = None
            leaves += 1
        step = np.zeros(len(g))
        for node, rows in zip(nodes, rows_of):
            if rows is not None:
                step[rows] = node[5]
        return nodes, step


def _grown(codes: list[np.ndarray], cuts: list[np.ndarray], y: np.ndarray, w: np.ndarray, s: HistogramTrees) -> pd.DataFrame:
    """The nodes of a model. Feature by feature: nothing is as wide as the rows but `codes`, which is changed in place."""
    order = np.lexsort([y, *reversed(codes)])                               # sums in one order, so that a refit is the same
    y, w, new = y[order], w[order], np.ones(len(order), dtype=bool)
    new[1:] = y[1:] != y[:-1]
    for j, c in enumerate(codes):
        codes[j] = c[order]
        new[1:] |= codes[j][1:] != codes[j][:-1]
    del order
    at = np.nonzero(new)[0]                                                 # rows of the same bins are one, whichever folds they came from
    y, w = y[at].astype(float), np.add.reduceat(w, at).astype(float)
    for j, c in enumerate(codes):
        codes[j] = c[at]
    del at, new
    share = (y * w).sum() / w.sum()
    if not 0 < share < 1:
        raise ValueError("a model needs accepted and rejected rows")
    grower, raw = _Grower(codes, cuts, w, s), np.full(len(y), np.log(share / (1 - share)))
    out = [[-1, 0, -1, np.inf, False, -1, -1, raw[0], 0.0, int(w.sum())]]
    for t in range(s.max_iter):
        p = 1 / (1 + np.exp(-raw))
        nodes, step = grower.tree(p - y, p * (1 - p))
        out += [[t, i, *node] for i, node in enumerate(nodes)]
        raw += step
    return pd.DataFrame(out, columns=[c.split()[0] for c in NODES.split(", ")])


def _block_fitter(s: HistogramTrees, sent: Broadcast):
    """The blocks of one model -> its nodes."""
    def fit(blocks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts, y, w = [], [], []
        for b in blocks:
            model = int(b["model"].iloc[0])
            width = len(sent.value[model])
            parts += [np.frombuffer(c, np.min_scalar_type(s.max_bins)).reshape(width, -1) for c in b["codes"]]
            y += [np.frombuffer(c, np.uint8) for c in b["y"]]
            w += [np.frombuffer(c, np.int64) for c in b["w"]]
        codes = [np.concatenate([p[j] for p in parts]) for j in range(width)]
        parts.clear()
        yield _grown(codes, sent.value[model], np.concatenate(y), np.concatenate(w), s).assign(model=model)
    return fit


def _fitter(s: HistogramTrees, keyed: bool):
    """The same from the values of rows in memory, with no cluster: what the fit of a table has to come to."""
    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        inputs, w = [c for c in rows.columns if c.startswith("x")], rows["w"].to_numpy()
        cuts = [_cuts(rows[c].to_numpy(float), w, s.max_bins) for c in inputs]
        codes = [_codes(rows[c].to_numpy(float), at, s.max_bins) for c, at in zip(inputs, cuts)]
        found = _grown(codes, cuts, rows["y"].to_numpy(), w, s)
        return found.assign(model=rows["model"].iloc[0]) if keyed else found
    return fit


def _apart(spark: SparkSession, k: int) -> int:
    """The least number of partitions that deals `k` models to one each."""
    hashes = [r[0] for r in spark.range(k).select(F.hash(F.col("id").cast("int"))).collect()]
    return next(n for n in range(k, 1 << 31) if len({h % n for h in hashes}) == k)


def raw_scores(x: np.ndarray, trees: list[tuple]) -> np.ndarray:
    """The sum of a row's leaves; all rows go down a tree together, and those in a leaf stay."""
    raw, everyone = np.zeros(len(x)), np.arange(len(x))
    gone = np.isnan(x)
    for feature, threshold, missing_left, left, right, value, depth in trees:
        at = np.zeros(len(x), dtype=np.int64)
        for _ in range(depth):
            j = feature[at]
            go = np.where(gone[everyone, j], missing_left[at], x[everyone, j] <= threshold[at])
            at = np.where(go, left[at], right[at])
        raw += value[at]
    return raw


def _compiled(nodes: pd.DataFrame) -> list[tuple]:
    """A tree's columns as arrays; a leaf leads to itself."""
    trees = []
    for _, t in nodes.sort_values(["tree", "node"]).groupby("tree"):
        feature, own = t["feature"].to_numpy(), np.arange(len(t))
        left, right = (np.where(feature < 0, own, t[c].to_numpy()) for c in ("left", "right"))
        depth = np.zeros(len(t), dtype=int)
        for i in np.nonzero(feature >= 0)[0]:                               # a child's number is larger than its parent's
            depth[left[i]] = depth[right[i]] = depth[i] + 1
        trees.append((np.maximum(feature, 0), t["threshold"].to_numpy(), t["missing_left"].to_numpy(dtype=bool), left, right,
                      np.where(feature < 0, t["value"].to_numpy(), 0.0), int(depth.max())))
    return trees


@dataclass(frozen=True)
class HistogramTrees:
    """The backend. Rows whose label is not 0 or 1 are left out; null and NaN are missing, infinities are the outermost values, all in
    fitting and in scoring. A model without accepted or without rejected rows is refused. Every row counts, and `seed` changes nothing,
    unless a caller sets `max_rows`: beyond so many distinct rows, a share of them, chosen by a hash of their values and `seed`, is
    taken. No plan sets it. All rounds are made."""

    max_iter: int = 300
    learning_rate: float = 0.05
    max_leaf_nodes: int = 31
    l2: float = 1.0
    max_bins: int = 255
    min_rows_leaf: int = 20
    max_rows: int | None = None

    @property
    def name(self) -> str:
        return (f"HistogramTrees(max_iter={self.max_iter}, learning_rate={self.learning_rate}, max_leaf_nodes={self.max_leaf_nodes}, "
                f"l2={self.l2}, max_bins={self.max_bins}, min_rows_leaf={self.min_rows_leaf})")

    def _weighted(self, train: DataFrame, features: Sequence[str], label: str, seed: int, fold: Column, k: int) -> DataFrame:
        if not features:
            raise Refused("a model needs a feature")
        y = F.col(f"`{label}`").cast("int").alias("y")
        rows = train.where(F.col(f"`{label}`").isin(0, 1)).select(*_numbers(features), y, fold.cast("int").alias("fold"))
        rows = staged(rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("w")), "weighted")
        if self.max_rows is not None:
            sizes = {r["fold"]: r["count"] for r in rows.groupBy("fold").count().collect()}
            n = sum(sizes.values()) - min(sizes.get(i, 0) for i in range(k))
            h = F.pmod(F.xxhash64(F.lit(seed), *[c for c in rows.columns if c not in ("w", "fold")]), F.lit(1 << 40)) / float(1 << 40)
            rows = rows.where(h < self.max_rows / max(n, 1))
        return rows

    def _fitted(self, train: DataFrame, features: Sequence[str], label: str, seed: int, fold: Column, k: int) -> pd.DataFrame:
        """The nodes of `k` models, each fitted on the rows outside the fold of its number, all in one job."""
        spark = train.sparkSession
        rows = self._weighted(train, features, label, seed, fold, k)
        kinds = rows.select("fold", "y").distinct().collect()
        bad = sum(len({r["y"] for r in kinds if r["fold"] != i}) < 2 for i in range(k))
        if bad:
            raise Refused(f"{bad} of {k} folds leave no accepted or no rejected rows to fit on" if k > 1 else "a model needs accepted and rejected rows")
        sent = spark.sparkContext.broadcast(_cuts_of_all(rows, len(features), k, self.max_bins))
        blocks = rows.mapInArrow(_binner(sent, self.max_bins), BLOCKS)
        return blocks.repartition(_apart(spark, k), "model").groupBy("model").applyInPandas(_block_fitter(self, sent), NODES + ", model int").toPandas()

    def fit(self, train: DataFrame, features: Sequence[str], label: str = "decision", seed: int = 0) -> TreeModel:
        return TreeModel(tuple(features), self._fitted(train, features, label, seed, F.lit(-1), 1).drop(columns="model"))

    def fit_leaving_out(self, folded: DataFrame, features: Sequence[str], k: int, label: str = "decision", seed: int = 0) -> list[TreeModel]:
        """A model for every fold, fitted on the rows outside it, all in one job."""
        nodes = self._fitted(folded, features, label, seed, F.col("fold"), k)
        return [TreeModel(tuple(features), nodes[nodes["model"] == i].drop(columns="model")) for i in range(k)]

    def transform(self, model: TreeModel, df: DataFrame) -> DataFrame:
        sent = df.sparkSession.sparkContext.broadcast(_compiled(model.nodes))

        @F.pandas_udf("double")
        def scored(rows: pd.DataFrame) -> pd.Series:
            return pd.Series(1 / (1 + np.exp(-raw_scores(rows.to_numpy(float), sent.value))))

        return df.withColumn("score", scored(F.struct(*_numbers(model.features))))

    def save(self, model: TreeModel, spark: SparkSession, path: str) -> None:
        """One file of nodes, one of feature names in their order."""
        spark.createDataFrame(model.nodes, NODES).coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
        spark.createDataFrame(list(enumerate(model.features)), "place int, feature string").coalesce(1).write.mode("overwrite").parquet(f"{path}/features")

    def load(self, spark: SparkSession, path: str) -> TreeModel:
        features = spark.read.parquet(f"{path}/features").orderBy("place").toPandas()["feature"]
        return TreeModel(tuple(features), spark.read.parquet(f"{path}/nodes").toPandas().sort_values(["tree", "node"], ignore_index=True))
