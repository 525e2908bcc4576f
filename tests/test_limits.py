"""Both sides of every size at which something used to change, and inputs that gave wrong answers."""

import hashlib
import math
from itertools import combinations

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fathomline.functions import keys as K
from fathomline.functions import stats as S
from fathomline.functions.guards import Refused
from fathomline.operators import allocation as A
from fathomline.operators import draw as P
from fathomline.operators import estimate as E
from fathomline.operators import labels as L
from fathomline.operators import model as M
from fathomline.operators import session as Q
from fathomline.operators.rows import apply_alignment
from fathomline.plans.catalog_sessions import fisher_sql


def one_sided(d, n):
    """P(D_n+ >= d), a finite sum; twice that is the two-sided tail from one half on."""
    return sum(d * math.comb(n, j) * (d + j / n) ** (j - 1) * (1 - d - j / n) ** (n - j) for j in range(int(n * (1 - d)) + 1))


@pytest.mark.parametrize("n", [1, 2, 7, 40, 200])
def test_kolmogorov_is_the_closed_form_from_one_half_on(n):
    for d in (0.5, 0.6, 0.83):
        assert S._kolmogorov(d, n) == pytest.approx(min(1, 2 * one_sided(d, n)), rel=1e-8, abs=1e-13)


def test_kolmogorov_does_not_jump_with_the_number_of_rows():
    a, b, c = (S._kolmogorov(0.02, n) for n in (1999, 2000, 2001))
    assert a > b > c and abs((a - b) - (b - c)) < 1e-6
    x = 0.02 * math.sqrt(20_000)
    assert S._kolmogorov(0.02, 20_000) == pytest.approx(2 * math.exp(-2 * x * x), rel=0.05)


@pytest.mark.parametrize("n1,n2", [(1, 1), (2, 5), (3, 4), (4, 6)])
def test_rank_sums_by_counting_all_orders(n1, n2):
    us = [sum(sum(1 for k in range(n1 + n2) if k not in c and k < i) for i in c) for c in combinations(range(n1 + n2), n1)]
    for u in range(n1 * n2 + 1):
        tail = sum(x >= max(u, n1 * n2 - u) for x in us) / len(us)
        assert S._rank_sum(u, n1, n2) == pytest.approx(min(1, 2 * tail), rel=1e-12)


def test_rank_sum_stays_exact_for_long_groups():
    a, b = S._rank_sum(3000, 8, 12_500), S._rank_sum(3000, 8, 12_501)
    assert a == pytest.approx(5.7185e-10, rel=1e-4) and b == pytest.approx(a, rel=1e-3) and b < a
    assert S._rank_sum(0, 1, 500_000) == pytest.approx(2 / 500_001)


def test_fisher_is_the_sql_to_the_last_bit():
    """Splits of a sheet that are equally likely are ordered by the last bits of p, so these must be those of the SQL."""
    rng = np.random.default_rng(0)
    n = rng.integers(16, 121, 5_000)
    before = rng.integers(8, n - 7)
    a, c = rng.binomial(before, 0.3), rng.binomial(n - before, 0.3)
    t = pd.DataFrame({"a": a, "b": before - a, "c": c, "d": n - before - c})                # noqa: F841
    want = duckdb.sql(f"SELECT {fisher_sql('a', 'b', 'c', 'd')} AS p FROM t").df().p.to_numpy()
    assert (S._fishers(*[t[x].to_numpy(np.int64) for x in "abcd"]) == want).all()
    assert S._fishers(*[np.array([x]) for x in (1900, 2000, 150, 200)]) == pytest.approx(S._fisher_tails(S._ln_factorial, *[np.array([x]) for x in (1900, 2000, 150, 200)]), rel=1e-9)


def test_a_listed_digest_means_one_thing(spark):
    t = spark.createDataFrame([("p", i, 1, i) for i in range(10)], "pool_id string, k_wmo long, k_cycle long, k_pres long")
    assert K.listed_hash(t, limit=10).first()["content_sha256"] == K.listed_hash(t).first()["content_sha256"]
    with pytest.raises(Refused, match="listed digest"):
        K.listed_hash(t, limit=9).collect()


def test_a_listed_digest_of_any_length(spark):
    n = 1_000_001                                                   # one above the size that used to be refused
    t = spark.range(n).select(F.when(F.col("id") < n, "p").alias("pool_id"), (F.col("id") % 7).alias("k_wmo"), F.col("id").alias("k_cycle"), F.lit(1).cast("long").alias("k_pres"))
    few = spark.createDataFrame([(None, 3, 2, 1), (None, 3, 2, 1), ("q", 10, 1, 1), ("q", 9, 1, 1)], t.schema)
    got = {r.pool_id: (r.n, r.content_sha256) for r in K.listed_hash(t.unionByName(few).repartition(5)).collect()}
    digest = lambda lines: hashlib.sha256("\n".join(lines).encode()).hexdigest()       # noqa: E731
    assert got == {"p": (n, digest(f"{w}|{c}|1" for w in range(7) for c in range(w, n, 7))),
                   "q": (2, digest(["9|1|1", "10|1|1"])), None: (1, digest(["3|2|1"]))}


def test_a_joint_digest_of_any_number_of_sheets(spark):
    t = spark.range(100_001).select(F.lit("d").alias("draw"), "id", F.sha2(F.col("id").cast("string"), 256).alias("sheet"))
    got = K.joint_digest(t, ["draw"], "id", "sheet").first()
    want = hashlib.sha256("".join(f"{hashlib.sha256(str(i).encode()).hexdigest()}\t{i}\n" for i in range(100_001)).encode()).hexdigest()
    assert (got.sheets, got.digest) == (100_001, want)


def test_second_looks_take_any_number_of_cells(spark):
    cells = [("b", f"c{k}", 1 / 7, 0.5, 1000 if k else 3) for k in range(7)]
    t = spark.createDataFrame(cells, "batch_id string, cell string, share double, q double, available long")
    got = {r["cell"]: r["draw_n"] for r in A.rejudge_allocation(t, 123, floor=5).collect()}
    assert got.pop("c0") == 3 and set(got.values()) == {20}
    both = spark.createDataFrame([("b", "a", 0.9, 0.5, 30), ("b", "b", 0.099, 0.5, 500), ("b", "c", 0.001, 0.5, 500)], t.schema)
    assert {r["cell"]: r["draw_n"] for r in A.rejudge_allocation(both, 100, floor=10).collect()} == {"a": 30, "b": 60, "c": 10}


def test_pairs_of_features_are_decided_together(spark):
    # the two halves of a mirrored pair, one of them with few values
    up = spark.range(500).select((F.col("id") % 50 + 1.0).alias("a_max_res"), (-(F.col("id") % 50) / 10 - 0.1).alias("a_min_res"))
    down = up.select((-F.col("a_min_res")).alias("a_max_res"), (-F.col("a_max_res")).alias("a_min_res"))
    for column, rules in (("a_max_res", {"swap_negate:a_min_res", "swap_negate:a_max_res"}), ("a_min_res", {"keep"})):
        few = F.row_number().over(__import__("pyspark.sql", fromlist=["Window"]).Window.orderBy(F.lit(1))) <= 50
        thin = lambda d: d.withColumn("few", few).withColumn(column, F.when(F.col("few"), F.col(column))).drop("few")   # noqa: E731, B023
        got = {r["feature"]: r["rule"] for r in M.alignment_rule(thin(up), thin(down), ["a_max_res", "a_min_res"]).collect()}
        assert set(got.values()) == rules, got


def test_a_key_verified_twice_is_one_label(spark):
    keys = "k_wmo long, k_cycle long, k_pres long"
    det = spark.createDataFrame([(1, 1, 1), (2, 1, 1)], keys)
    ver = spark.createDataFrame([(1, 1, 1, 0, 1), (1, 1, 1, 1, 2)], keys + ", category int, row int")
    got = {r["k_wmo"]: r["source"] for r in L.external_labels(det, ver, det).collect()}
    assert got == {1: "external_verified", 2: "external_not_verified"}
    with pytest.raises(Refused):
        L.external_labels(det, ver.drop("row"), det)


def test_drift_bands_weigh_a_shared_stratum_once(spark):
    rows = spark.createDataFrame([("p", b, "s", h, 1) for b in ("b1", "b2", "b3") for h in ("first", "second")], "pool_id string, batch_id string, design_stratum string, half string, decision int")
    sizes = spark.createDataFrame([("p", "s", 10)], "pool_id string, design_stratum string, frame_n long")
    got = E.drift_band(rows, sizes).first()
    assert got["rate_first_half"] == got["rate_second_half"] == 1.0


def test_a_rate_refuses_rows_that_were_not_drawn(spark):
    rows = spark.createDataFrame([("p", "s", 1, 0.5), ("p", "s", 0, None)], "pool_id string, design_stratum string, decision int, inclusion_probability double")
    sizes = spark.createDataFrame([("p", "s", 10)], "pool_id string, design_stratum string, frame_n long")
    with pytest.raises(Refused):
        E.stratified_rate(rows, sizes)


def test_calibration_refuses_a_key_twice(spark):
    t = spark.createDataFrame([("s", 1, 1, 1, 1, 1)] * 2, "sheet_id string, k_wmo long, k_cycle long, k_pres long, label int, ref_label int")
    with pytest.raises(Refused, match="twice"):
        Q.calibration_report(t, t.limit(1))


def test_draws_refuse_frames_that_do_not_hold_their_rows(spark):
    df = spark.createDataFrame([("p", "s", w, 1, float(w)) for w in range(6)], "pool_id string, design_stratum string, wmo long, cycle_number int, pres_adjusted double")
    strata = spark.createDataFrame([("p", "s", 9, 3)], "pool_id string, design_stratum string, frame_n long, draw_n long")
    with pytest.raises(Refused, match="does not hold"):
        P.draw_one_per_cluster(df, strata, 1).collect()
    assert P.draw_one_per_cluster(df, strata.withColumn("frame_n", F.lit(6).cast("long")), 1).count() == 3


def test_rules_of_alignment(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0, 4.0)], "a double, b double, c double, d double")
    assert tuple(apply_alignment(df, {"a": "flip", "b": "swap_negate:c", "c": "swap_negate:b", "d": "keep"}).first()) == (-1.0, -3.0, -2.0, 4.0)
