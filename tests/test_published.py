"""Published inputs must give the published outputs."""

import csv
import math
import os

import pytest
from pyspark.sql import functions as F

from fathomline.functions import keys as K
from fathomline.functions import stats as S
from fathomline.operators import allocation as A
from fathomline.operators import estimate as E
from fathomline.operators import session as Q

HERE = os.path.dirname(__file__)


def published(name):
    with open(os.path.join(HERE, name)) as f:
        return list(csv.DictReader(f))


@pytest.fixture(scope="module")
def counts(spark):
    rows = [(r["pool_id"], r["design_stratum"], int(r["frame_n"]), int(r["n_h"]), float(r["a_h"])) for r in published("published_rates.csv")]
    return spark.createDataFrame(rows, "pool_id string, design_stratum string, frame_n bigint, n_h bigint, a_h double")


@pytest.fixture(scope="module")
def draws(spark):
    rows = [(r["pool"], r["design_stratum"], int(r["frame_n"]), float(r["w"]), float(r["p_planned"]), int(r["draw_n"])) for r in published("published_draws.csv")]
    return spark.createDataFrame(rows, "pool_id string, design_stratum string, frame_n bigint, w double, p_planned double, published bigint")


def reviews_of(counts):
    """The verdicts behind the counts, one row each."""
    t = counts.withColumn("i", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n_h"))))
    return t.select("pool_id", "design_stratum", F.col("i").alias("wmo"), (F.col("i") <= F.col("a_h")).cast("int").alias("decision"),
                    (F.col("n_h") / F.col("frame_n")).alias("inclusion_probability"))


def test_rates_and_their_errors(counts):
    r = {x["pool_id"]: x for x in E.stratified_rate(reviews_of(counts), counts.select("pool_id", "design_stratum", "frame_n")).collect()}
    assert r["up"]["rate"] == pytest.approx(0.12882141062040214, rel=1e-13)
    assert r["up"]["se_design"] == pytest.approx(0.010864747528893907, rel=1e-13)
    assert r["down"]["rate"] == pytest.approx(0.18738977257005085, rel=1e-13)
    assert r["down"]["se_design"] == pytest.approx(0.013117930047141783, rel=1e-13)
    assert (r["up"]["zero_or_full_strata"], r["down"]["zero_or_full_strata"]) == (3, 1)
    assert (r["up"]["n"], r["up"]["frame_n"], r["down"]["n"], r["down"]["frame_n"]) == (665, 186275, 779, 133307)


def test_precision_still_needed(counts):
    r = {x["pool_id"]: x for x in E.precision_plan(E.rate_from_counts(
        E.stratum_counts(reviews_of(counts), counts.select("pool_id", "design_stratum", "frame_n")))).collect()}
    assert (r["up"]["needed"], r["up"]["more"], r["up"]["meets_target"]) == (808, 143, False)
    assert (r["down"]["needed"], r["down"]["more"], r["down"]["meets_target"]) == (652, 0, True)
    assert r["up"]["hours"] == pytest.approx(1.1400277777777776)


def test_the_bootstrap_within_strata_tends_to_its_limit(counts):
    rows, sizes = reviews_of(counts), counts.select("pool_id", "design_stratum", "frame_n")
    limit = {r["pool_id"]: r["se"] for r in E.stratified_bootstrap_limit(rows, sizes).collect()}
    boot = {r["pool_id"]: r["se"] for r in E.stratified_bootstrap(rows, sizes, 400, 1).collect()}
    assert limit["up"] == pytest.approx(0.010313265257633293, rel=0.03)     # published with 3,000 replicates
    assert limit["down"] == pytest.approx(0.0129696665251389, rel=0.03)
    for p in limit:
        assert boot[p] == pytest.approx(limit[p], rel=0.12)


def test_allocations(draws):
    for pool, n in (("rate_obduction_01", 579), ("rate_subduction_01", 792), ("rate_obduction_02", 90)):
        got = A.neyman(draws.where(F.col("pool_id") == pool), n).collect()
        assert sum(r["draw_n"] for r in got) == n
        assert {r["design_stratum"]: r["draw_n"] for r in got} == {r["design_stratum"]: r["published"] for r in got}


def test_the_size_of_a_draw(draws):
    v = 0.00010929102303467304
    down = draws.where(F.col("pool_id") == "rate_subduction_01")
    for deff, n in ((1.0, 719), (1.0918181818181818, 784), (1.106818181818182, 796), (1.114644859813084, 801), (1.1005347593582888, 792)):
        assert {r["n"] for r in A.solve_n(down, v / deff).collect()} == {n}
    up = draws.where(F.col("pool_id") == "rate_obduction_01")
    held = 5.663355868820585e-07
    for deff, n in ((1.0, 526), (1.0911477572559367, 574), (1.0972413793103448, 577), (1.0855555555555556, 571), (1.1004625, 579)):
        assert {r["n"] for r in A.solve_n(up, v / deff, held / deff).collect()} == {n}


def test_designs_compared(draws):
    for pool, n, prop, srs in (("rate_subduction_01", 792, 0.7970684456823152, 0.6658596464958183),
                               ("rate_obduction_02", 90, 0.9769307668264202, 0.9647152806386624)):
        r = A.compare_designs(A.neyman(draws.where(F.col("pool_id") == pool), n)).first()
        assert r["vs_proportional"] == pytest.approx(prop, rel=1e-9)
        assert r["vs_srs"] == pytest.approx(srs, rel=1e-9)


CELLS = [("0|first", 241, 43, 0.39630223654512126, 0.0641025641025641, 38), ("0|second", 269, 20, 0.41630799088482795, 0.011904761904761904, 41),
         ("1|first", 99, 22, 0.11007909168396889, 0.6818181818181818, 10), ("1|second", 70, 15, 0.07731068088608199, 0.75, 9)]


def test_a_shaped_second_look(spark):
    t = spark.createDataFrame([("b", *c) for c in CELLS], "batch_id string, cell string, available bigint, published bigint, share double, q double, seen bigint")
    got = A.rejudge_allocation(t, 100)
    assert {r["cell"]: r["draw_n"] for r in got.collect()} == {c[0]: c[2] for c in CELLS}
    s = A.compare_shapes(got, 100, t.select("batch_id", "cell", F.col("seen").alias("n"))).first()
    assert s["se_shape"] == pytest.approx(0.022699311144481222, rel=1e-12)
    assert s["se_uniform"] == pytest.approx(0.02462415573599873, rel=1e-12)
    assert s["se_pooled"] == pytest.approx(0.016691007224384602, rel=1e-12)


def test_jeffreys_planning_rates(spark):
    cells = spark.createDataFrame([("b", "0|first"), ("b", "1|second"), ("b", "none")], "batch_id string, cell string")
    prior = spark.createDataFrame([("b", "0|first", 38, 2), ("b", "1|second", 9, 7)], "batch_id string, cell string, n bigint, accepted bigint")
    q = {r["cell"]: r["q"] for r in A.prior_cell_rates(cells, prior).collect()}
    assert q["0|first"] == pytest.approx(0.0641025641025641) and q["1|second"] == pytest.approx(0.75) and q["none"] == 0.5


def test_identifiers(spark):
    t = spark.createDataFrame([("net_carbon_v1/physical/subduction", 1902303, 12.0, p) for p in (250.4, 250.5, 250.6, 251.5)],
                              "pool_id string, wmo bigint, cycle_number double, pres_adjusted double")
    k = K.event_key(t).withColumn("id", K.candidate_id()).orderBy("pres_adjusted").collect()
    assert [r["k_pres"] for r in k] == [250, 250, 251, 252]
    assert k[0]["id"] == "096abcc91e816054fbd747dffe6656af"


def test_tails(spark):
    row = spark.range(1).select(
        S.fisher_p(F.lit(13), F.lit(30), F.lit(8), F.lit(68)).alias("change"), S.fisher_p(F.lit(5), F.lit(6), F.lit(5), F.lit(3)).alias("flips"),
        S.fisher_p(F.lit(1), F.lit(38), F.lit(1), F.lit(40)).alias("same"), S.binomial_p(F.lit(22), F.lit(42), F.lit(18 / 42)).alias("binom"),
        S.chi2_tail(F.lit(1.3629328637616547)).alias("chi"), S.kolmogorov_p(F.lit(0.274), F.lit(10)).alias("ks"),
        S.rank_sum_p(F.lit(3.0), F.lit(3), F.lit(5)).alias("exact"),
        *[S.beta_quantile(F.lit(q), F.lit(k + 0.5), F.lit(10 - k + 0.5)).alias(f"b{k}{i}") for k in (8, 1) for i, q in enumerate((0.025, 0.975))]).first()
    assert row["change"] == pytest.approx(0.01118664434284708, rel=1e-9)
    assert row["flips"] == pytest.approx(0.64992, abs=1e-5) and row["same"] == pytest.approx(1.0)
    assert row["binom"] == pytest.approx(0.216532, abs=1e-6)
    assert row["chi"] == pytest.approx(0.24302983676150214, rel=1e-12)
    assert row["ks"] == pytest.approx(0.3715203845434957, rel=1e-9)
    assert row["exact"] == pytest.approx(0.25)
    assert [row[f"b8{i}"] for i in (0, 1)] == pytest.approx([0.49722550356000694, 0.9559405864473692], rel=1e-9)
    assert [row[f"b1{i}"] for i in (0, 1)] == pytest.approx([0.011011673763161135, 0.38131477106661626], rel=1e-9)


def test_stratified_position_test(spark):
    """Rows per stratum and half as published; four strata inform, the rest drop out."""
    halves = [("d6", 9, 1, 9, 0), ("d7", 6, 1, 4, 0), ("d8", 11, 4, 7, 0), ("d9", 7, 3, 4, 3), ("d0", 3, 0, 4, 0), ("d2", 0, 0, 2, 0)]
    rows = [("b", s, h, int(i < a)) for s, n1, a1, n2, a2 in halves for h, n, a in (("first", n1, a1), ("second", n2, a2)) for i in range(n)]
    t = spark.createDataFrame(rows, "batch_id string, design_stratum string, half string, label int")
    r = Q.cmh(t).first()
    assert r["chi2"] == pytest.approx(1.3629328637616547, rel=1e-12) and r["p"] == pytest.approx(0.24302983676150214, rel=1e-12)
    assert (r["used"], r["dropped"], r["verdict"]) == (4, 2, "FLAT")


def test_calibration_copy(spark):
    """22 of 42 accepted against the reference's 18, agreeing on 36."""
    pairs = [(1, 1)] * 17 + [(1, 0)] * 5 + [(0, 1)] * 1 + [(0, 0)] * 19
    t = spark.createDataFrame([("s", i, 1, 1, a, b) for i, (a, b) in enumerate(pairs)],
                              "sheet_id string, k_wmo bigint, k_cycle bigint, k_pres bigint, label int, ref_label int")
    r = Q.calibration_report(t.drop("ref_label"), t.drop("label")).first()
    assert r["kappa"] == pytest.approx(0.71622, abs=1e-5) and r["p_base"] == pytest.approx(0.216532, abs=1e-6) and r["verdict"] == "PASS"
    g = Q.pass_region(spark.createDataFrame([("s", 42, 18 / 42)], "sheet_id string, n bigint, p0 double"), "n", "p0").first()
    assert (g["lo"], g["hi"]) == (12, 24)


def test_the_drift_corrected_rate_is_linear_in_its_cells(spark):
    """400 rows, acceptance 0.30 then 0.15: a second look at every cell's own rate changes nothing."""
    rows = [("p", "b", "s", i, "first" if i < 200 else "second", int((i % 20) < (6 if i < 200 else 3)), 0.4) for i in range(400)]
    t = spark.createDataFrame(rows, "pool_id string, batch_id string, design_stratum string, wmo bigint, half string, decision int, inclusion_probability double")
    sizes = spark.createDataFrame([("p", "s", 1000)], "pool_id string, design_stratum string, frame_n bigint")
    same = spark.createDataFrame([("b", c, 50, 50 * int(c[0])) for c in ("0|first", "0|second", "1|first", "1|second")], "batch_id string, cell string, n bigint, accepted bigint")
    assert E.drift_corrected_rate(t, sizes, same).first()["rate"] == pytest.approx(0.225)
    look = spark.createDataFrame([("b", "0|first", 40, 4), ("b", "0|second", 40, 4), ("b", "1|first", 20, 10), ("b", "1|second", 10, 9)],
                                 "batch_id string, cell string, n bigint, accepted bigint")
    r = E.drift_corrected_rate(t, sizes, look).first()
    assert r["rate"] == pytest.approx((140 * 0.1 + 170 * 0.1 + 60 * 0.5 + 30 * 0.9) / 400) and (r["rows_corrected"], r["rows_kept"]) == (400, 0)
    rates = E.stratified_rate(t, sizes)
    se = E.correction_error(t, sizes, look, rates).first()
    var = sum((n / 400) ** 2 * q * (1 - q) / m for n, q, m in ((140, .1, 40), (170, .1, 40), (60, .5, 20), (30, .9, 10)))
    assert se["se_rejudge"] == pytest.approx(math.sqrt(var))
    twice = look.withColumns({"n": F.col("n") * 2, "accepted": F.col("accepted") * 2})
    assert E.correction_error(t, sizes, twice, rates).first()["se_rejudge"] == pytest.approx(math.sqrt(var / 2))
    boot = E.correction_error(t, sizes, look, rates, n_boot=400).first()["se_rejudge"]
    assert boot == pytest.approx(math.sqrt(var), rel=0.12)
