"""Registered queries: the score and what is said about it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.keys import EVENT_KEY
from ..functions.staging import new_path, staged
from ..operators import model as M
from ..operators.boosting import NODES
from ..operators.rows import feature_columns as numeric_columns
from . import bindings as B
from .bindings import DOWN, UP, sql, u
from .catalog_grids import window_table
from .registry import query

_LAB = "lab AS (SELECT * FROM frame WHERE decision < 2)"


def _labelled(spark, d):
    return B.frame(spark, d).where(F.col("decision") < 2)


@query("auc", sql("frame", """SELECT pool_id, n, n1, round((r - n1 * (n1 + 1) / 2) / (n1 * (n - n1)), 6) AS auc FROM (SELECT pool_id, count(*) AS n, sum(decision)::BIGINT AS n1,
    sum(CASE WHEN decision = 1 THEN rk END) AS r FROM (SELECT *, rank() OVER (PARTITION BY pool_id ORDER BY l_quantity) + (count(*) OVER (PARTITION BY pool_id, l_quantity) - 1) / 2 AS rk FROM lab) GROUP BY ALL)""", _LAB))
def auc(spark, d):
    return M.auc(_labelled(spark, d), "l_quantity", "decision")


@query("rho", sql("frame", "SELECT pool_id, round(corr(score, decision), 6) AS rho FROM lab GROUP BY ALL", _LAB))
def rho(spark, d):
    return M.rho(_labelled(spark, d), "score", "decision")


_EDGES = """edges AS (SELECT pool_id, list_sort(list_distinct(list(e))) AS e FROM (SELECT pool_id, unnest(quantile_cont({x}, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1])) AS e FROM lab GROUP BY pool_id) GROUP BY ALL)"""
_CAL = """SELECT pool_id, bin, count(*) AS n, round(avg(decision), 6) AS observed, round(avg({x}), 6) AS predicted FROM (SELECT lab.*, len(list_filter(list_slice(e, 2, len(e) - 1), lambda v: v < {x})) AS bin
    FROM lab JOIN edges USING (pool_id)) GROUP BY ALL"""


@query("calibrate", sql("frame", _CAL.format(x="score"), _LAB + ", " + _EDGES.format(x="score")))
def calibrate(spark, d):
    return M.calibrate(_labelled(spark, d), "score", "decision")


@query("calibrate_tied_edges", sql("frame", _CAL.format(x="t"), "lab AS (SELECT *, greatest(l_tax, 0.04) AS t FROM frame WHERE decision < 2), " + _EDGES.format(x="t")))
def calibrate_tied_edges(spark, d):
    return M.calibrate(_labelled(spark, d).withColumn("t", F.greatest("l_tax", F.lit(0.04))), "t", "decision")


@query("grouped_folds", sql("frame", f"""SELECT wmo, CASE WHEN (r // 5) % 2 = 0 THEN r % 5 ELSE 4 - r % 5 END AS fold FROM (SELECT wmo, row_number() OVER (
    ORDER BY share DESC, {u(3, 'fold', 'wmo')}, wmo) - 1 AS r FROM (SELECT wmo, avg(decision) AS share FROM lab GROUP BY ALL))""", _LAB))
def grouped_folds(spark, d):
    return M.grouped_folds(_labelled(spark, d), 5, seed=3).select("wmo", "fold").distinct()


@query("attach_oof", sql("frame", """SELECT pool_id, k_wmo, k_cycle, k_pres, round(CASE WHEN decision < 2 THEN l_discount ELSE score END, 6) AS score, decision < 2 AS score_is_oof FROM frame"""))
def attach_oof(spark, d):
    f = staged(B.frame(spark, d), "frame")
    oof = f.where(F.col("decision") < 2).withColumn("oof", F.col("l_discount"))
    return M.attach_oof(f.select("pool_id", *EVENT_KEY, "score"), oof)


# features with a planted mirror: the price negated, the discount and tax swapped and negated as a pair
_SIDES = """sides AS (SELECT 'source' AS side, unnest(['price', 'quantity', 'd_min_res', 'd_max_res']) AS feature, unnest([l_extendedprice, l_quantity, l_discount, 1 + l_tax]) AS v FROM prof WHERE l_linestatus = 'F'
    UNION ALL SELECT 'target', unnest(['price', 'quantity', 'd_min_res', 'd_max_res']), unnest([-l_extendedprice, l_quantity, -1 - l_tax, -l_discount]) FROM prof WHERE l_linestatus = 'O'),
    qs AS (SELECT side, feature, quantile_cont(v, [%s]) AS q FROM sides GROUP BY ALL)""" % ", ".join(str((5 + 5 * i) / 100) for i in range(19))
_MIR = "list_avg([abs({t}[i] + {s}[20 - i]) for i in range(1, 20)]) < 0.5 * list_avg([abs({t}[i] - {s}[i]) for i in range(1, 20)]) AND list_avg([abs({t}[i] + {s}[20 - i]) for i in range(1, 20)]) / (list_avg([abs(x) for x in {s}]) + 1e-12) < 0.25"


@query("alignment_rule", sql("prof", f"""SELECT a.feature, CASE WHEN p.other IS NOT NULL AND {_MIR.format(t='b.q', s='c.q')} AND {_MIR.format(t='e.q', s='a.q')} THEN 'swap_negate:' || p.other
    WHEN {_MIR.format(t='b.q', s='a.q')} THEN 'flip' ELSE 'keep' END AS rule FROM qs a JOIN qs b ON b.feature = a.feature AND a.side = 'source' AND b.side = 'target'
    LEFT JOIN (VALUES ('d_min_res', 'd_max_res'), ('d_max_res', 'd_min_res')) p(feature, other) ON p.feature = a.feature
    LEFT JOIN qs c ON c.feature = p.other AND c.side = 'source' LEFT JOIN qs e ON e.feature = p.other AND e.side = 'target'""", _SIDES))
def alignment_rule(spark, d):
    p = B.profiles(spark, d)
    side = lambda price, low, high: p.select(price.alias("price"), F.col("l_quantity").alias("quantity"), low.alias("d_min_res"), high.alias("d_max_res"), "l_linestatus")
    x, y = F.col("l_discount"), 1 + F.col("l_tax")
    source = side(F.col("l_extendedprice"), x, y).where(F.col("l_linestatus") == "F")
    target = side(-F.col("l_extendedprice"), -y, -x).where(F.col("l_linestatus") == "O")
    return M.alignment_rule(source, target, ["price", "quantity", "d_min_res", "d_max_res"])


# the first split of the first tree: every cut between neighbouring values of every feature, the missing on either side
_SPLIT = """one AS (SELECT decision AS y, [l_quantity, CASE WHEN l_discount > 0 THEN l_discount END, CASE WHEN l_tax > 0 THEN l_tax END]::DOUBLE[] AS x FROM frame WHERE decision < 2),
    base AS (SELECT avg(y) AS p, count(*) AS n, sum(y) AS s FROM one),
    vals AS (SELECT f, x[f + 1] AS v, sum(y) AS s, count(*) AS c FROM one, (VALUES (0), (1), (2)) k(f) GROUP BY ALL),
    gone AS (SELECT f, coalesce(sum(s) FILTER (v IS NULL), 0) AS ms, coalesce(sum(c) FILTER (v IS NULL), 0) AS mc FROM vals GROUP BY f),
    cuts AS (SELECT f, coalesce((v + lead(v) OVER w) / 2, 'inf'::DOUBLE) AS threshold, sum(s) OVER w AS s, sum(c) OVER w AS c FROM vals WHERE v IS NOT NULL WINDOW w AS (PARTITION BY f ORDER BY v)),
    sides AS (SELECT f, threshold, b AS to_left, s + CASE WHEN b THEN ms ELSE 0 END AS ls, c + CASE WHEN b THEN mc ELSE 0 END AS lc, mc FROM cuts JOIN gone USING (f), (VALUES (false), (true)) t(b) WHERE mc > 0 OR NOT b),
    sums AS (SELECT *, p * lc - ls AS lg, p * (1 - p) * lc AS lh, p * (n - lc) - (s - ls) AS rg, p * (1 - p) * (n - lc) AS rh FROM sides, base WHERE lc >= 20 AND n - lc >= 20),
    gains AS (SELECT *, lg * lg / (lh + 1) + rg * rg / (rh + 1) - (p * n - s) * (p * n - s) / (p * (1 - p) * n + 1) AS gain FROM sums)"""


@query("histogram_first_split", sql("frame", """SELECT f AS feature, round(CASE WHEN isinf(threshold) THEN NULL ELSE threshold END, 6) AS threshold, CASE WHEN mc > 0 THEN to_left ELSE lc >= n - lc END AS missing_left,
    round(gain, 6) AS gain, lc::BIGINT AS n_left, (n - lc)::BIGINT AS n_right, round(-0.05 * lg / (lh + 1), 6) AS value_left, round(-0.05 * rg / (rh + 1), 6) AS value_right FROM gains
    ORDER BY gain DESC, f, threshold, to_left LIMIT 1""", _SPLIT))
def histogram_first_split(spark, d):
    """The root of the first tree over all labelled rows, two of three features with missing values."""
    none = lambda c: F.when(F.col(c) > 0, F.col(c))                                       # noqa: E731
    t = _labelled(spark, d).select("decision", "l_quantity", none("l_discount").alias("discount"), none("l_tax").alias("tax"))
    model = M.fit(t, ["l_quantity", "discount", "tax"], 1, M.HistogramTrees(max_iter=1, max_leaf_nodes=2))
    nodes = spark.createDataFrame(model.nodes, NODES)
    side = lambda k: nodes.where(f"tree = 0 AND node = {k}")                              # noqa: E731
    root = side(0).select("tree", "feature", F.when(F.abs("threshold") < float("inf"), F.col("threshold")).alias("threshold"), "missing_left", "gain")
    return (root.join(side(1).select("tree", F.col("n").alias("n_left"), F.col("value").alias("value_left")), "tree")
            .join(side(2).select("tree", F.col("n").alias("n_right"), F.col("value").alias("value_right")), "tree").drop("tree"))


def _training(spark, d):
    """Candidates of the two physical pools with their features; a strong salinity signal is called real. Its size itself is no
    feature, its neighbours' are."""
    t = window_table(spark, d).where(F.col("pool_id").isin(UP, DOWN))
    real = F.coalesce(F.abs("abs_sal_res_at_det") > 0.5, F.lit(False)).cast("int")
    t = staged(t.withColumn("decision", real), "training")
    return t, [c for c in numeric_columns(t) if c not in ("decision", "abs_sal_res_at_det")]


@query("model_out_of_fold")
def model_out_of_fold(spark, d):
    """Five refits on held-out floats, read as an exact AUC per pool."""
    t, features = _training(spark, d)
    return M.auc(staged(M.evaluate(t, features, 5, 1), "oof"), "oof", "decision")


@query("model_score")
def model_score(spark, d):
    t, features = _training(spark, d)
    s = M.score(M.fit(t.where(F.col("pool_id") == UP), features, 1), t)
    return s.groupBy("pool_id", "decision").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("score"))


@query("model_transfer")
def model_transfer(spark, d):
    """The upward model read on the downward limb, its features aligned first."""
    t, features = _training(spark, d)
    up, down = t.where(F.col("pool_id") == UP), t.where(F.col("pool_id") == DOWN)
    scored = M.transfer_score(M.fit(up, features, 1), down, M.alignment_rule(up, down, features))
    return M.auc(scored, "score_transfer", "decision")


@query("model_saved")
def model_saved(spark, d):
    """A saved model read back scores as the one that was saved."""
    t, features = _training(spark, d)
    model = M.fit(t, features, 1)
    before = staged(M.score(model, t), "before")
    path = new_path(spark, "model")
    M.save(model, path, M.provenance(M.default_backend().name, features, 1, t, M.rho(before, "score", "decision").agg(F.avg("rho").alias("rho"))))
    again, record = M.load(spark, path)
    both = M.score(again, before.withColumnRenamed("score", "before"))
    return both.groupBy("pool_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.abs(F.col("score") - F.col("before"))).alias("largest_change"),
                                       F.lit(record["n_features"]).cast("bigint").alias("n_features"))
