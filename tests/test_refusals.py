"""What must stop a job, and name the rows that stopped it."""

import pytest
from pyspark.sql import functions as F

from fathomline.functions.guards import Refused
from fathomline.functions import keys as K
from fathomline.operators import allocation as A
from fathomline.operators import draw as P
from fathomline.operators import estimate as E
from fathomline.operators import features as X
from fathomline.operators import grid as G
from fathomline.operators import labels as L
from fathomline.operators import rows as R
from fathomline.sources import reviews as W

BATCH = "batch_id string, pool_id string, role string, decides boolean, criterion_version string, columns_kept array<string>, sampling struct<design:string,frame:string>"
REVIEW = "batch_id string, candidate_id string, decision int, role string, criterion_version string, control_arm string"


def batch(**kw):
    b = dict(batch_id="b1", pool_id="p", role="analysis", decides=True, criterion_version="c1", columns_kept=["LABEL"], sampling=("probability", "f"))
    b.update(kw)
    return tuple(b.values())


def refused(fn, *words):
    with pytest.raises(Refused) as e:
        fn()
    for w in words:
        assert w in str(e.value), str(e.value)


@pytest.mark.parametrize("record,word", [
    (batch(role="training"), "no analysis batch"), (batch(sampling=("score_selected", "f")), "probability design"),
    (batch(criterion_version="c2"), "judged under"), (batch(decides=False), "decides")])
def test_a_rate_needs_an_analysis_batch(spark, record, word):
    b = spark.createDataFrame([record], BATCH)
    r = spark.createDataFrame([("b1", "x", 1, None, "c1", None)], REVIEW)
    refused(lambda: L.analysis_sample(r, b, "p", "c1"), word)


def test_who_is_in_the_sample(spark):
    b = spark.createDataFrame([batch(), batch(batch_id="b2", role="training")], BATCH)
    r = spark.createDataFrame([("b1", "x", 1, None, "c1", None), ("b1", "y", 2, None, "c1", "target"), ("b1", "z", 0, None, "c1", "target"),
                               ("b1", "n", 0, None, "c1", "neg_ctrl"), ("b1", None, 1, None, "c1", None), ("b2", "t", 1, None, "c1", None)], REVIEW)
    assert sorted(x["candidate_id"] for x in L.analysis_sample(r, b, "p", "c1").collect()) == ["x", "z"]
    refused(lambda: L.analysis_sample(r, b, "p", ""), "criterion")


def test_label_table_integrity(spark):
    r = spark.createDataFrame([("b1", "x", 1, "analysis", "c1", None)], REVIEW)
    refused(lambda: L.load_reviews(r.withColumn("criterion_version", F.lit("c9")), spark.createDataFrame([batch()], BATCH)), "disagree")
    refused(lambda: L.load_reviews(r, spark.createDataFrame([batch(), batch()], BATCH)), "repeated")
    refused(lambda: L.load_reviews(r, spark.createDataFrame([batch(role="guess")], BATCH)), "unknown roles")
    two = spark.createDataFrame([batch(), batch(batch_id="b2")], BATCH)
    refused(lambda: L.analysis_sample(r.unionByName(r.withColumn("batch_id", F.lit("b2"))), two, "p", "c1"), "more than one")
    assert L.load_reviews(r, spark.createDataFrame([batch()], BATCH)).first()["sampling_design"] == "probability"


def test_pool_ids(spark):
    bad = ["a/physical", "a//obduction", "a/paper/obduction", "a/physical/sideways", "/physical/obduction", "a/physical/obduction/x"]
    for p in bad:
        refused(lambda: K.require_pool_id(spark.createDataFrame([(p,)], "pool_id string")), "study/channel/direction")
    K.require_pool_id(spark.createDataFrame([("a/carbon/subduction",)], "pool_id string"))


def test_keys_that_are_not_numbers_are_dropped(spark):
    t = spark.createDataFrame([("1", "2.0", "250.5"), ("x", "2", "3"), ("1", None, "3"), ("1", "2", "NaN")], "wmo string, cycle_number string, pres_adjusted string")
    assert [tuple(r)[3:] for r in K.event_key(t).collect()] == [(1, 2, 250)]


def test_allocation_inputs(spark):
    s = spark.createDataFrame([("p", "a", 0.5, 0.2), ("p", "b", 0.5, 0.0)], "pool_id string, design_stratum string, w double, p_planned double")
    refused(lambda: A.neyman(s, 10), "planned acceptance")
    ok = s.withColumn("p_planned", F.lit(0.3))
    refused(lambda: A.neyman(ok, -1), "negative")
    assert {r["draw_n"] for r in A.neyman(ok, 0).collect()} == {0}
    refused(lambda: A.solve_n(ok, 1e-4, 2e-4), "exceeds")
    refused(lambda: A.solve_n(ok, 1e-7), "no draw up to")
    assert A.stratified_variance(A.neyman(ok, 0)).first()["variance"] == float("inf")


def test_an_allocation_with_a_floor(spark):
    p = [0.005, 0.01, 0.02, 0.04, 0.08, 0.12, 0.2, 0.3, 0.45, 0.6]
    s = spark.createDataFrame([("p", f"d{i}", 0.1, x) for i, x in enumerate(p)], "pool_id string, design_stratum string, w double, p_planned double")
    n = [r["draw_n"] for r in A.neyman(s, 400).orderBy("design_stratum").collect()]
    assert sum(n) == 400 and min(n) >= 20
    all_low = s.where("design_stratum < 'd3'")
    assert sorted(r["draw_n"] for r in A.neyman(all_low, 10, floor=0.4).collect()) == [3, 3, 4]


def test_second_look_limits(spark):
    t = spark.createDataFrame([("b", "0|first", 0.5, 0.1, 30), ("b", "1|first", 0.5, 0.5, 30)], "batch_id string, cell string, share double, q double, available bigint")
    refused(lambda: A.rejudge_allocation(t, 61), "rows that are left")
    refused(lambda: A.rejudge_allocation(t, 20), "floors")
    capped = {r["cell"]: r["draw_n"] for r in A.rejudge_allocation(t.withColumn("available", F.when(F.col("cell") == "1|first", 16).otherwise(100)), 60).collect()}
    assert capped == {"0|first": 44, "1|first": 16}
    zero = A.rejudge_allocation(t.withColumn("q", F.lit(0.0)), 40).collect()
    assert [r["draw_n"] for r in zero] == [20, 20]


def test_draw_inputs(spark):
    s = spark.createDataFrame([("p", "a", 5, 6)], "pool_id string, design_stratum string, frame_n bigint, draw_n bigint")
    refused(lambda: P.require_drawable(s), "fewer rows")
    cell = spark.createDataFrame([("b", "c", 1)], "batch_id string, cell string, sample_id int")
    sizes = spark.createDataFrame([("b", "c", 2)], "batch_id string, cell string, draw_n int")
    refused(lambda: P.draw_per_cell(cell, sizes, 1), "fewer rows")
    refused(lambda: P.control_slots(spark.createDataFrame([("b", 3, 4)], "batch_id string, n_rows bigint, n_controls bigint"), 1), "more controls")
    refused(lambda: P.require_not_drawn(spark.createDataFrame([("b1",)], "batch_id string"), "b1"), "drawn already")
    refused(lambda: P.require_tiers_full(spark.createDataFrame([("p", 1)], "pool_id string, wmo int"), 2), "calibration set")
    P.require_not_drawn(spark.createDataFrame([("b1",)], "batch_id string"), "b2")


def test_one_candidate_once_per_batch(spark):
    t = spark.createDataFrame([("b", 1, 1, 1, "d0")], "batch_id string, k_wmo bigint, k_cycle bigint, k_pres bigint, design_stratum string")
    refused(lambda: P.assemble(t, t.withColumn("control_arm", F.lit("pos_ctrl")), 1), "twice")


def test_rate_inputs(spark):
    t = spark.createDataFrame([("p", "a", 1, 1, None)], "pool_id string, design_stratum string, wmo int, decision int, inclusion_probability double")
    refused(lambda: E.hajek_rate(t), "inclusion probability")
    refused(lambda: E.hajek_rate(t.withColumn("inclusion_probability", F.lit(1.5))), "inclusion probability")
    refused(lambda: E.stratified_rate(t, spark.createDataFrame([("p", "b", 3)], "pool_id string, design_stratum string, frame_n bigint")), "frame size")


def test_children_need_their_parents(spark):
    refused(lambda: G.require_parents(spark.createDataFrame([("c", "p")], "pool_id string, parent string")), "parents")
    G.require_parents(spark.createDataFrame([("c", "p"), ("p", None)], "pool_id string, parent string"))


def test_build_guards(spark):
    ids = lambda *w: spark.createDataFrame([(x,) for x in w], "wmo bigint")
    refused(lambda: G.require_on_list(ids(1, 2), ids(1), ids(9)), "fleet list")
    refused(lambda: G.require_on_list(ids(1, 9), ids(1, 9), ids(9)), "excluded")
    G.require_on_list(ids(1), ids(1, 2), ids(9))
    refused(lambda: G.require_other_folder("/data/bound/x", "/data/bound"), "inside")
    G.require_other_folder("/data/bound2", "/data/bound")


def test_gates_need_their_channels(spark):
    g = spark.createDataFrame([(1, 1, 10.0, 2.0)], "wmo int, cycle_number int, pres_adjusted double, aou_scale_res_rob double")
    refused(lambda: G.detect(g, [G.Gate("p", (G.Term("nitrate", 1.0),))]), "nitrate")


def test_every_candidate_has_features(spark):
    c = spark.createDataFrame([("p", 1, 1, 1, 1)], "pool_id string, k_wmo int, k_cycle int, k_pres int, wmo int")
    refused(lambda: X.require_covered(c, c.where("wmo > 1")), "no features")
    X.require_covered(c, c)


def test_steering_labels_must_be_out_of_fold(spark):
    lab = spark.createDataFrame([(1, 1, 1, 1)], "k_wmo int, k_cycle int, k_pres int, decision int")
    s = spark.createDataFrame([("p", 1, 1, 1, 0.5, False)], "pool_id string, k_wmo int, k_cycle int, k_pres int, score double, score_is_oof boolean")
    refused(lambda: L.steering_labels(lab, s), "fitted on them")


def test_reference_is_frozen_once_and_whole(spark):
    key = spark.createDataFrame([("b", 0, 1, 1, 1), ("b", 1, 2, 1, 1)], "batch_id string, sample_id int, k_wmo int, k_cycle int, k_pres int")
    full = spark.createDataFrame([("b", 0, 1), ("b", 1, 0)], "batch_id string, sample_id int, label int")
    frozen = L.freeze_reference(full, key, "one pass")
    assert frozen.count() == 2
    refused(lambda: L.freeze_reference(full, key, "again", frozen), "frozen")
    refused(lambda: L.freeze_reference(full.where("sample_id = 0"), key, "x"), "undecided")
    refused(lambda: L.freeze_reference(full.withColumn("label", F.lit(2)), key, "x"), "undecided")


def test_sheets_and_keys_agree(spark):
    cols = "batch_id string, sample_id int, k_wmo int, k_cycle int, k_pres int"
    key = spark.createDataFrame([("b", 0, 1, 1, 1)], cols)
    sheet = key.withColumn("label", F.lit(1))
    assert W.read_sheets(sheet, key).first()["label"] == 1
    refused(lambda: W.read_sheets(sheet.withColumn("k_pres", F.lit(2)), key), "disagree")
    refused(lambda: W.read_sheets(sheet.unionByName(sheet), key), "two sheets")


def test_a_batch_is_loaded_once(spark):
    t = spark.createDataFrame([("b", "x", "sha1")], "batch_id string, candidate_id string, sheet_sha256 string")
    refused(lambda: W.append_reviews(t, t), "loaded already")
    assert W.append_reviews(t, t, replace=True).count() == 1
    refused(lambda: W.append_reviews(t, t.withColumn("sheet_sha256", F.lit("sha2")), replace=True), "not the one loaded")


def test_the_held_region_is_the_recorded_one(spark):
    cols = "pool_id string, k_wmo int, k_cycle int, k_pres int, pres_adjusted double, r1 double"
    t = spark.createDataFrame([("p", 1, 1, 100, 100.0, 2.0), ("p", 1, 1, 300, 300.0, 2.0), ("p", 1, 1, 400, 400.0, 1.0)], cols)
    rec = lambda n: spark.createDataFrame([("held|<=200", 1), ("held|260-400", n)], "design_stratum string, frame_n bigint")
    assert L.held_region(t.drop("r1"), t, ["r1"], expected=rec(1)).count() == 2
    refused(lambda: L.held_region(t.drop("r1"), t, ["r1"], expected=rec(2)), "recorded")
    deep = t.withColumn("pres_adjusted", F.lit(1200.0))
    refused(lambda: L.held_region(deep.drop("r1"), t, ["r1"]), "band")


def test_unknown_range_policy(spark):
    refused(lambda: R.valid_range(spark.createDataFrame([(1.0,)], "x double"), "x", 0, 1, "guess"), "policy")


def test_a_pool_and_its_list_meet_once(spark):
    """One shuffle by key: no join in the result, whose counts say what is refused."""
    rows = lambda ks, more: spark.createDataFrame([("p", k, 1, 1, float(v)) for k, v in ks], f"pool_id string, k_wmo long, k_cycle long, k_pres long, {more} double")
    scores, lists = rows([(1, 0.5), (2, 0.25)], "score"), rows([(1, 10), (2, 20), (3, 30)], "pres_adjusted").withColumn("note", F.when(F.col("k_wmo") == 1, "a"))
    got = L.pool_frame(scores, lists)
    assert "Join" not in got._jdf.queryExecution().toString()
    assert got.columns == ["pool_id", "k_wmo", "k_cycle", "k_pres", "score", "pres_adjusted", "note"]
    assert sorted(map(tuple, got.collect())) == [("p", 1, 1, 1, 0.5, 10.0, "a"), ("p", 2, 1, 1, 0.25, 20.0, None)]
    without = lists.withColumn("k_wmo", F.when(F.col("k_wmo") != 2, F.col("k_wmo")))
    for a, b, what in ((scores.unionByName(scores), lists, "scored twice"), (scores, lists.unionByName(lists), "listed twice"), (scores, without, "not in the list"),
                       (scores.withColumn("k_wmo", F.when(F.col("k_wmo") != 2, F.col("k_wmo"))), without, "not in the list")):
        with pytest.raises(Refused, match=what):
            L.pool_frame(a, b)
