"""Window features: every candidate meets its profile's bins in one shuffle; odd values, equal bins and missing keys."""

import math

import pytest

from fathomline.operators import features as X

NAN = float("nan")


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture
def around(spark):
    def made(candidates, coarse, fine, half_width=1):
        c = spark.createDataFrame([(*x, x[1], x[2], round(x[3]) if x[3] is not None else None) for x in candidates],
                                  "pool_id string, wmo long, cycle_number long, pres_adjusted double, k_wmo long, k_cycle long, k_pres long")
        g = spark.createDataFrame(coarse, "wmo long, cycle_number long, pres_adjusted double, t double, t_scale_res_rob double")
        f = spark.createDataFrame(fine, "wmo long, cycle_number long, pres_adjusted double, t_res double")
        return X.window_features(c, g, f, ["t"], half_width, 40, 10)
    return made


def test_features_are_looked_up_in_one_shuffle(around):
    t = around([("p", 1, 1, 40.0)], [(1, 1, 40.0, 1.0, 2.0)], [(1, 1, 40.0, 3.0)])
    assert "Join" not in _plan(t)


def test_features_of_odd_rows(around):
    coarse = [(1, 1, 0.0, 10.0, -1.0), (1, 1, 40.0, None, 2.0), (1, 1, 80.0, 12.0, NAN), (1, 2, 40.0, 5.0, None),
              (2, 1, 40.0, 1.0, 1.0), (2, 1, 45.0, 7.0, NAN), (2, 1, 50.0, 3.0, -4.0), (None, 1, 40.0, 9.0, 9.0), (1, 1, None, 9.0, 9.0)]
    fine = [(1, 1, 30.0, 0.3), (1, 1, 40.0, 0.4), (1, 2, 50.0, 0.5)]
    asked = [("p", 1, 1, 40.0), ("p", 1, 1, 40.0), ("q", 1, 1, 40.0), ("p", 1, 2, 40.0), ("p", 2, 1, 44.0), ("p", 3, 1, 40.0), (None, 1, 1, 40.0), ("p", 1, 1, None)]
    got = {(x["pool_id"], x["wmo"], x["cycle_number"]): x for x in around(asked, coarse, fine).collect()}
    assert set(got) == {("p", 1, 1), ("q", 1, 1), ("p", 1, 2), ("p", 2, 1), ("p", 3, 1)}
    x = got["p", 1, 1]
    assert (x["t_prof_m1"], x["t_prof_p0"], x["t_prof_p1"]) == (10.0, None, 12.0)
    assert (x["t_rel_m1"], x["t_rel_p0"], x["t_res_at_det"], x["t_res_abs_at_det"], x["t_min_res"]) == (-3.0, 0.0, 2.0, 2.0, -1.0)
    assert math.isnan(x["t_rel_p1"]) and math.isnan(x["t_max_res"])
    assert (x["t_fine_dev_m1"], x["t_fine_dev_p0"], x["t_fine_dev_p1"]) == (0.3, 0.4, None)
    assert got["q", 1, 1]["t_min_res"] == -1.0
    x = got["p", 1, 2]                                                           # a bin without a scale, no neighbours
    assert (x["t_prof_p0"], x["t_min_res"], x["t_max_res"], x["t_fine_dev_p1"]) == (5.0, None, None, 0.5)
    x = got["p", 2, 1]                                                           # three rows in one bin
    assert x["t_prof_p0"] == 7.0 and math.isnan(x["t_max_res"]) and x["t_min_res"] == -4.0
    assert all(v is None for c, v in got["p", 3, 1].asDict().items() if c.startswith("t_"))


def test_features_of_a_single_bin(around):
    x = around([("p", 1, 1, 40.0)], [(1, 1, 40.0, 1.0, -2.0)], [], 0).first()
    assert (x["t_rel_p0"], x["t_max_res"], x["t_min_res"], x["t_res_abs_at_det"], x["t_fine_dev_p0"]) == (0.0, -2.0, -2.0, 2.0, None)
