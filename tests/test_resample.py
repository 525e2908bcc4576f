"""Resampling by counts: against the distributions' own sums, and error bars against their closed forms."""

import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomline.functions import resample as R
from fathomline.operators import estimate as E
from fathomline.operators import session as Q


@pytest.mark.parametrize("n, p", [(1, 0.5), (7, 0.2), (42, 0.93), (1_000, 0.01), (5, 0.0), (5, 1.0)])
def test_binomials_invert_the_distribution_function(n, p):
    u = np.linspace(0, 1, 501)[:-1] + 1e-9
    cdf = np.cumsum([math.comb(n, k) * p ** k * (1 - p) ** (n - k) for k in range(n + 1)])
    assert R.binomials(u, np.full(len(u), n), p).tolist() == [min(n, int((cdf <= x).sum())) for x in u]


def test_binomials_of_large_counts_and_multinomials():
    u = R.uniforms(3, -5, np.arange(4), 20_000)
    assert 0 <= u.min() and u.max() < 1 and abs(u.mean() - 0.5) < 0.01 and len(np.unique(u)) == u.size
    k = R.binomials(u[0], np.full(20_000, 10**9), 0.3)
    assert k.mean() == pytest.approx(3e8, rel=1e-5) and k.std() == pytest.approx(math.sqrt(10**9 * 0.21), rel=0.02)
    counts = np.array([5, 1, 0, 4])
    got = R.multinomials(u, np.full(20_000, 10), counts)
    assert (got.sum(axis=0) == 10).all() and not got[2].any() and (got >= 0).all()
    assert np.cov(got)[0, 1] == pytest.approx(-10 * 0.5 * 0.1, abs=0.03) and got[3].var() == pytest.approx(10 * 0.4 * 0.6, rel=0.04)


@pytest.mark.parametrize("top, p", [(600, 0.002), (360_000, 0.0016), (900, 0.5), (40, 0.97)])
def test_many_sizes_step_to_the_same_counts(monkeypatch, top, p):
    n, u = np.arange(top - 40, top + 1).repeat(50), R.uniforms(1, 2, np.arange(1), 41 * 50)[0]
    start = time.perf_counter()
    got = R.binomials(u, n, p)
    took = time.perf_counter() - start
    monkeypatch.setattr(R, "SIZES", 10**9)                          # one size after the other
    assert (R.binomials(u, n, p) == got).all() and took < 1


def test_a_resample_by_shares_is_spread_over_tasks(spark):
    """Twenty thousand floats of different sums and 2,000 replicates: draws that were one or two tasks' before."""
    t = spark.range(20_000).select(F.lit("p").alias("pool_id"), F.col("id").alias("wmo"), F.when(F.col("id") % 3 == 0, 1).otherwise(0).alias("decision"),
                                   (1 / (1 + F.col("id") / 20_000)).alias("inclusion_probability"))
    w, y = 1 + np.arange(20_000) / 20_000, np.arange(20_000) % 3 == 0
    start = time.perf_counter()
    got = E.cluster_bootstrap(t).first()["se"]
    assert time.perf_counter() - start < 60
    assert got == pytest.approx(math.sqrt(((w * (y - (w * y).sum() / w.sum())) ** 2).sum()) / w.sum(), rel=0.07)


@pytest.fixture(scope="module")
def rows(spark):
    t = spark.range(4_000).select(F.lit("p").alias("pool_id"), F.concat(F.lit("s"), (F.col("id") % 4).cast("string")).alias("design_stratum"), (F.col("id") % 700).alias("wmo"),
                                  (F.pmod(F.xxhash64("id"), F.lit(10)) < F.col("id") % 4 + 1).cast("int").alias("decision"), (0.1 + 0.2 * (F.col("id") % 4)).alias("inclusion_probability"))
    return t


def test_error_bars_against_closed_forms(spark, rows):
    sizes = spark.createDataFrame([("p", f"s{k}", 10_000 * (k + 1)) for k in range(4)], "pool_id string, design_stratum string, frame_n long")
    want = E.stratified_bootstrap_limit(rows, sizes).first()["se"]
    assert E.stratified_bootstrap(rows, sizes, 20_000).first()["se"] == pytest.approx(want, rel=0.02)
    w = rows.withColumn("w", 1 / F.col("inclusion_probability"))
    f = w.groupBy("wmo").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("decision")).alias("wy")).toPandas()
    linear = math.sqrt(((f.wy - f.wy.sum() / f.w.sum() * f.w) ** 2).sum()) / f.w.sum()
    assert E.cluster_bootstrap(rows, 20_000).first()["se"] == pytest.approx(linear, rel=0.02)
    assert E.cluster_bootstrap(rows.repartition(7), 300, 4).first()["se"] == pytest.approx(E.cluster_bootstrap(rows, 300, 4).first()["se"], rel=1e-12)


def test_kappa_limits(spark):
    pairs = [("s", k, a, b) for k, (a, b) in enumerate([(0, 0)] * 20 + [(1, 1)] * 15 + [(0, 1)] * 4 + [(1, 0)] * 3)] + [("t", 1, 0, 0), ("t", 2, None, 1)]
    df = spark.createDataFrame(pairs, "sheet_id string, sample_id long, a int, b int")
    got = {r.sheet_id: (r.lo, r.hi) for r in Q.kappa_ci(df, "a", "b", 20_000, by=("sheet_id",)).collect()}
    rng = np.random.default_rng(1)
    x = np.array([(p[2], p[3]) for p in pairs[:42]])[rng.integers(0, 42, (20_000, 42))]
    po = (x[..., 0] == x[..., 1]).mean(axis=1)
    one, two = x.mean(axis=1).T
    pe = one * two + (1 - one) * (1 - two)
    assert got["s"] == pytest.approx(tuple(np.quantile((po - pe) / (1 - pe), [0.025, 0.975])), abs=0.02) and got["t"] == (1.0, 1.0)
