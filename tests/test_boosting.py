"""Histogram trees: the first split against brute force, missing values, weights, folds, refusals, a second backend."""

import math
import random
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fathomline.functions.guards import Refused
from fathomline.functions.staging import staged
from fathomline.operators import boosting
from fathomline.operators import model as M

SCHEMA = "wmo int, a double, b double, decision int"


@pytest.fixture(scope="module")
def rows():
    r = random.Random(4)
    out = []
    for i in range(600):
        a, b = r.choice([None, 1.0, 2.0, 3.0, 5.0, 8.0]), r.choice([None, float("nan"), *range(12)])
        real = (a is None or a > 4) != (r.random() < 0.1)
        out.append((i % 30, a, None if b is None else float(b), int(real)))
    return out


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def brute_split(rows, columns, least=20, l2=1.0):
    p = sum(r[-1] for r in rows) / len(rows)
    part = lambda side: (sum(p - r[-1] for r in side), p * (1 - p) * len(side))            # noqa: E731
    worth = lambda side: part(side)[0] ** 2 / (part(side)[1] + l2)                         # noqa: E731
    found = []
    for j, c in enumerate(columns):
        gone = lambda r: r[c] is None or math.isnan(r[c])                                  # noqa: E731
        values = sorted({r[c] for r in rows if not gone(r)})
        for cut in [(x + y) / 2 for x, y in zip(values, values[1:])] + [math.inf]:
            for missing_left in (False, True):
                left = [r for r in rows if (missing_left if gone(r) else r[c] <= cut)]
                right = [r for r in rows if not (missing_left if gone(r) else r[c] <= cut)]
                if len(left) >= least and len(right) >= least:
                    found.append((worth(left) + worth(right) - worth(rows), j, cut, missing_left, len(left)))
    return max(found, key=lambda f: f[0])


def test_first_split_is_the_best_of_all(rows, table):
    model = M.fit(table, ["a", "b"], 1, M.HistogramTrees(max_iter=1, max_leaf_nodes=2))
    root = model.nodes[(model.nodes.tree == 0) & (model.nodes.node == 0)].iloc[0]
    gain, j, cut, missing_left, n = brute_split(rows, (1, 2))
    assert (root.feature, root.threshold, root.missing_left) == (j, cut, missing_left) and root.gain == pytest.approx(gain)
    assert model.nodes[(model.nodes.tree == 0) & (model.nodes.node == 1)].iloc[0].n == n
    assert model.nodes.iloc[0].value == pytest.approx(math.log(sum(r[-1] for r in rows) / sum(1 - r[-1] for r in rows)))


def test_missing_values_have_a_side_of_their_own(spark, table):
    model = M.fit(table, ["a", "b"], 1, M.HistogramTrees(max_iter=60))
    by = {r.a: r.s for r in M.score(model, table).groupBy("a").agg(F.avg("score").alias("s")).collect()}
    assert by[None] > 0.7 and by[8.0] > 0.7 and by[1.0] < 0.3                    # accepted: missing or above four, a tenth turned round
    edge = spark.createDataFrame([(8.0,), (float("inf"),), (1.0,), (float("-inf"),)], "a double").withColumn("b", F.lit(5.0))
    high, highest, low, lowest = [r.score for r in M.score(model, edge).collect()]
    assert highest == high and lowest == low


def test_settings_bound_the_trees(table):
    nodes = M.fit(table, ["a", "b"], 1, M.HistogramTrees(max_iter=7, max_leaf_nodes=4)).nodes
    trees = nodes[nodes.tree >= 0]
    leaves = trees[trees.feature < 0]
    assert set(trees.tree) == set(range(7)) and leaves.groupby("tree").size().max() <= 4 and leaves.n.min() >= 20
    assert (leaves.groupby("tree").n.sum() == 600).all()


def test_copies_weigh_as_rows(table):
    small = M.HistogramTrees(max_iter=5, min_rows_leaf=40)
    twice = M.fit(table.unionAll(table), ["a", "b"], 1, small).nodes
    assert twice.n.iloc[0] == 1200
    least = M.HistogramTrees(max_iter=1, max_leaf_nodes=2, l2=0.0)
    one, two = (M.fit(t, ["a", "b"], 1, least).nodes for t in (table, table.unionAll(table)))
    assert list(one.feature) == list(two.feature) and list(one.threshold) == list(two.threshold)
    assert list(two.value) == pytest.approx(list(one.value))


def test_more_values_than_bins(spark):
    t = spark.range(4000).select(F.col("id").cast("double").alias("x"), (F.col("id") >= 1500).cast("int").alias("decision"))
    model = M.fit(t, ["x"], 1, M.HistogramTrees(max_iter=30, max_bins=16))
    s = M.score(model, t).groupBy("decision").agg(F.avg("score").alias("s"), F.max("score").alias("m")).collect()
    by = {r.decision: r.s for r in s}
    assert by[1] - by[0] > 0.6
    assert set(model.nodes[model.nodes.feature >= 0].threshold % 1) == {0.5}               # cuts lie between values


def test_folds_fitted_together_are_those_fitted_alone(table):
    small = M.HistogramTrees(max_iter=4)
    folded = M.grouped_folds(table, 3).cache()
    for i, model in enumerate(small.fit_leaving_out(folded, ["a", "b"], 3)):
        alone = M.fit(folded.where(F.col("fold") != i), ["a", "b"], 0, small)
        assert model.nodes.reset_index(drop=True).equals(alone.nodes.reset_index(drop=True))


def test_as_good_as_the_other_backend(table):
    auc = lambda backend: M.auc(M.evaluate(table.withColumn("pool_id", F.lit("p")), ["a", "b"], 3, 1, backend), "oof", "decision").first()["auc"]
    ours = auc(None)
    assert ours > 0.8 and ours > auc(M.BoostedTrees(max_iter=8, step_size=0.3, max_depth=3)) - 0.02


def test_saved_and_read_back(spark, table, tmp_path):
    small = M.HistogramTrees(max_iter=3)
    model = M.fit(table, ["a", "b"], 1, small)
    M.save(model, str(tmp_path), M.provenance(small.name, ["a", "b"], 1, table, spark.createDataFrame([(0.5,)], "rho double")), small)
    again, record = M.load(spark, str(tmp_path), small)
    assert again.features == model.features and again.nodes.equals(model.nodes) and record["rows"] == 600


def test_refusals_and_rows_left_out(spark, table):
    with pytest.raises(Refused):
        M.fit(table.where("decision = 1"), ["a"], 1)
    with pytest.raises(Refused):
        M.fit(table.limit(0), ["a"], 1)
    with pytest.raises(Refused):
        M.fit(table, [], 1)
    odd = spark.createDataFrame([(1, 1.0, 1.0, None), (1, 1.0, 1.0, 2)], SCHEMA)
    assert M.fit(table.unionAll(odd), ["a", "b"], 1, M.HistogramTrees(max_iter=1)).nodes.n.iloc[0] == 600
    all_gone = M.fit(table.withColumn("c", F.lit(None).cast("double")), ["c"], 1, M.HistogramTrees(max_iter=2))
    assert M.score(all_gone, table.withColumn("c", F.lit(1.0))).agg(F.count_distinct("score")).first()[0] == 1


def test_bound_on_rows(spark):
    t = spark.range(3000).select(F.col("id").cast("double").alias("x"), (F.col("id") % 2).cast("int").alias("decision"))
    n = M.fit(t, ["x"], 1, M.HistogramTrees(max_iter=1, max_rows=1000)).nodes.n.iloc[0]
    assert 800 < n < 1200


def test_another_backend_slots_in(table):
    class Half:
        name = "a constant"

        def fit(self, train, features, label, seed):
            return {"seed": seed}

        def transform(self, model, df):
            return df.withColumn("score", F.lit(0.5))

    assert M.fit(table, ["a"], 3, Half()) == {"seed": 3}
    assert {r.oof for r in M.evaluate(table, ["a"], 3, 1, Half()).select("oof").distinct().collect()} == {0.5}


def test_a_fit_holds_little_beside_its_rows():
    """Bins and sums are taken feature by feature; all features at once took several times the rows' own memory."""
    rng = np.random.default_rng(0)
    rows = pd.DataFrame({f"x{j}": np.where(rng.random(20_000) < 0.1, np.nan, rng.normal(size=20_000)) for j in range(40)})
    rows["y"], rows["w"] = (rows.x0.fillna(0) + rng.normal(size=20_000) > 0).astype(int), 1
    tracemalloc.start()
    nodes = boosting._fitter(boosting.HistogramTrees(max_iter=2), False)(rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(nodes) > 60 and peak < 3 * 20_000 * 40 * 8


@pytest.fixture(scope="module")
def many(spark):
    """900,000 rows, no two alike, every tenth without a value."""
    x = F.when(F.col("id") % 10 > 0, F.sin(F.col("id").cast("double")) * 100)
    return staged(spark.range(900_000).select(F.lit("p").alias("pool_id"), F.floor(F.col("id") / 3).alias("wmo"), F.col("id").cast("double").alias("a"), x.alias("b"),
                                              F.lit(1.0).alias("c"), (F.xxhash64("id") % 3 == 0).cast("int").alias("decision")))


def test_held_out_models_count_every_row(many):
    """each of the models of the folds is made from all rows outside its fold, its cuts too."""
    folded = staged(many.withColumn("fold", (F.col("wmo") % 3).cast("int")))
    models = M.HistogramTrees(max_iter=1, max_leaf_nodes=2).fit_leaving_out(folded, ["a", "b", "c"], 3)
    assert [m.nodes.n.iloc[0] for m in models] == [600_000] * 3


def test_cuts_are_those_of_all_rows(spark):
    """Shares of uneven weights, a value that a third of the rows have, few values, one value and none; a fold without some of them."""
    rng, n = np.random.default_rng(5), 3000
    x = np.stack([rng.normal(size=n) * 10.0 ** rng.integers(-3, 4, n), np.where(rng.random(n) < 0.3, 7.0, np.round(rng.normal(size=n), 2)),
                  rng.integers(0, 20, n) / 4, np.ones(n), np.full(n, np.nan), rng.integers(0, 17, n).astype(float)], axis=1)
    x[rng.random((n, 6)) < 0.1] = np.nan
    rows = pd.DataFrame(x, columns=[f"x{j}" for j in range(6)]).assign(fold=np.arange(n) % 3, w=rng.integers(1, 9, n), y=np.arange(n) % 2)
    rows.loc[rows.x5 == 16, "fold"] = 1
    t = spark.createDataFrame(rows.astype(object).where(rows.notna(), None), ", ".join(f"x{j} double" for j in range(6)) + ", fold int, w long, y int")
    for bins in (16, 255):
        got = boosting._cuts_of_all(t, 6, 3, bins)
        for i in range(3):
            seen = rows[rows.fold != i]
            for j in range(6):
                assert list(got[i][j]) == list(boosting._cuts(seen[f"x{j}"].to_numpy(), seen.w.to_numpy(), bins)), (bins, i, j)


def test_a_table_is_fitted_as_rows_in_memory(table, rows):
    small = M.HistogramTrees(max_iter=4, max_bins=8)
    own = pd.DataFrame([(a, b, y, 1) for _, a, b, y in rows], columns=["x0", "x1", "y", "w"]).astype({"x0": float, "x1": float})
    pd.testing.assert_frame_equal(M.fit(table, ["a", "b"], 1, small).nodes.reset_index(drop=True), boosting._fitter(small, False)(own), check_dtype=False, check_exact=True)


def test_a_model_counts_every_row(many):
    """one model of 900,000 rows; its thresholds are cuts between even shares of all of them."""
    nodes = M.fit(many, ["a", "c"], 1, M.HistogramTrees(max_iter=1)).nodes
    trees = nodes[nodes.tree == 0]
    assert nodes.n.iloc[0] == trees.n.iloc[0] == trees[trees.feature < 0].n.sum() == 900_000
    cuts = boosting._cuts(np.arange(900_000.0), np.ones(900_000, dtype=int), 255)
    assert len(cuts) == 254 and len(trees) > 1 and set(trees[trees.feature == 0].threshold) <= set(cuts)


def test_a_transferred_model_counts_every_row(many):
    """the model that is read on the other limb is made from every row of the first."""
    key = ["k_wmo", "k_cycle", "k_pres"]
    up = many.withColumns({"k_wmo": F.col("wmo"), "k_cycle": F.col("a"), "k_pres": F.lit(1)})
    down = up.where("wmo < 1000").withColumn("b", -F.col("b"))
    model, rule = M.fit(up, ["a", "b"], 1, M.HistogramTrees(max_iter=1)), M.alignment_rule(up.where("wmo < 1000"), down, ["b"])
    assert model.nodes.n.iloc[0] == 900_000
    assert M.transfer_score(model, down, rule).select(*key, "score_transfer").dropna().count() == 3000


def test_a_saved_model_counts_every_row(spark, many, tmp_path):
    """a model that is saved and read back is made from the rows its record names."""
    small = M.HistogramTrees(max_iter=1)
    M.save(M.fit(many, ["a", "b"], 1, small), str(tmp_path), M.provenance(small.name, ["a", "b"], 1, many, spark.createDataFrame([(0.5,)], "rho double")), small)
    again, record = M.load(spark, str(tmp_path), small)
    assert again.nodes.n.iloc[0] == record["rows"] == 900_000
