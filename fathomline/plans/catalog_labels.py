"""Registered queries: the label table, its joins and its gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.keys import EVENT_KEY, event_key
from ..functions.staging import staged
from ..operators import labels as L
from ..operators.rows import dedup
from ..sources import reviews as W
from . import bindings as B
from .bindings import UP, sql
from .registry import query

_KEYS = "k_wmo, k_cycle, k_pres"
_SAMPLE = f"""smp AS (SELECT r.* FROM reviews r JOIN batches b USING (batch_id) WHERE b.pool_id = '{UP}' AND b.role = 'analysis' AND b.decides
    AND r.decision IN (0, 1) AND coalesce(r.control_arm, 'target') = 'target')"""


@query("load_reviews", sql("reviews batches", """SELECT r.batch_id, b.role AS role_batch, r.criterion_version AS criterion_version_review, b.criterion_version AS criterion_version_batch,
    'probability' AS sampling_design, sampling_frame, count(*) AS n FROM reviews r LEFT JOIN batches b USING (batch_id) GROUP BY ALL"""))
def load_reviews(spark, d):
    t = L.load_reviews(B.reviews(spark, d), B.batches(spark, d))
    return t.groupBy("batch_id", "role_batch", "criterion_version_review", "criterion_version_batch", "sampling_design",
                     "sampling_frame").agg(F.count(F.lit(1)).alias("n"))


def _sample(spark, d):
    return L.analysis_sample(B.reviews(spark, d), B.batches(spark, d), UP, "crit_1")


@query("analysis_sample", sql("reviews batches", "SELECT batch_id, candidate_id, CAST(decision AS INT) AS decision FROM smp", _SAMPLE))
def analysis_sample(spark, d):
    return _sample(spark, d).select("batch_id", "candidate_id", F.col("decision").cast("int").alias("decision"))


@query("labelled_keys", sql("reviews batches", """SELECT DISTINCT key_wmo::DOUBLE AS k_wmo, key_cycle::DOUBLE AS k_cycle, key_pres::DOUBLE AS k_pres FROM reviews r
    LEFT JOIN batches b USING (batch_id) WHERE coalesce(b.role, r.role) <> 'answer_key' AND (NOT has_label OR decision IN (0, 1, 2))"""))
def labelled_keys(spark, d):
    return L.labelled_keys(B.reviews(spark, d), B.batches(spark, d))


_OWN = f""", own AS (SELECT * EXCLUDE (rn) FROM (SELECT key_wmo AS k_wmo, key_cycle AS k_cycle, key_pres AS k_pres, CAST(decision AS INT) AS decision, row_number() OVER (
    PARTITION BY key_wmo, key_cycle, key_pres ORDER BY batch_id, candidate_id) AS rn FROM smp) WHERE rn = 1)"""


def _own(spark, d):
    return L.own_labels(_sample(spark, d), B.frame(spark, d).where(F.col("pool_id") == UP))


@query("own_labels", sql("reviews batches", f"SELECT {_KEYS}, decision, 'own_reviews' AS source FROM own", _SAMPLE + _OWN))
def own_labels(spark, d):
    return _own(spark, d)


# an earlier study's detections: every order; verified: the finished ones
_EXT = """ext AS (SELECT k_wmo, k_cycle, k_pres, CASE WHEN category IN (1, 2) THEN 1 ELSE 0 END AS decision, CASE WHEN category IN (1, 2) THEN 'external_verified'
    WHEN category = 0 THEN 'external_rejected' ELSE 'external_not_verified' END AS source FROM (SELECT o_custkey AS k_wmo, o_orderkey AS k_cycle,
    CAST(round_even(o_totalprice / 1000, 0) AS BIGINT) AS k_pres, CASE WHEN o_orderstatus <> 'O' THEN left(o_orderpriority, 1)::INT - 1 END AS category FROM orders)
    WHERE (category IS NULL OR category IN (0, 1, 2)) AND k_wmo IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0))"""


def _detections(spark, d):
    o = B.table(spark, d, "orders").select(F.col("o_custkey").alias("wmo"), F.col("o_orderkey").alias("cycle_number"),
                                           (F.col("o_totalprice") / 1000).alias("pres_adjusted"), "o_orderstatus",
                                           (F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("category"))
    return event_key(o)


def _external(spark, d):
    det = _detections(spark, d)
    rich = B.table(spark, d, "customer").where(F.col("c_acctbal") > 0).select(F.col("c_custkey").alias("k_wmo"))
    return L.external_labels(det, det.where(F.col("o_orderstatus") != "O").withColumn("row", F.col("cycle_number")), det.join(rich, "k_wmo", "left_semi"))


@query("external_labels", sql("", f"SELECT {_KEYS}, decision, source FROM ext", _EXT))
def external_labels(spark, d):
    return _external(spark, d)


@query("training_set", sql("reviews batches frame", f"""SELECT {_KEYS}, round(score, 6) AS score, o.decision, 'own_reviews' AS source, true AS in_probability_sample FROM frame f
    JOIN own o USING ({_KEYS}) WHERE f.pool_id = '{UP}'""", _SAMPLE + _OWN))
def training_set(spark, d):
    pool = B.frame(spark, d).where(F.col("pool_id") == UP).select(*EVENT_KEY, "score")
    return L.training_set(pool, _own(spark, d))


@query("labels_by_source", sql("", "SELECT source, count(*) AS n, sum(decision)::BIGINT AS accepted FROM ext GROUP BY ALL", _EXT))
def labels_by_source(spark, d):
    return L.counts_by_source(_external(spark, d))


@query("steering_labels", sql("", f"""SELECT {_KEYS}, 'p' AS pool_id, round(k_pres / 1000, 6) AS score, decision::DOUBLE AS y FROM ext""", _EXT))
def steering_labels(spark, d):
    det = _detections(spark, d)
    scores = det.select(F.lit("p").alias("pool_id"), *EVENT_KEY, (F.col("k_pres") / 1000).alias("score"), F.lit(True).alias("score_is_oof"))
    return L.steering_labels(_external(spark, d), scores)


@query("verdict_status", """SELECT o_orderkey AS k_cycle, CASE WHEN o_orderstatus = 'O' THEN 'none' WHEN left(o_orderpriority, 1)::INT - 1 IN (1, 2) THEN 'verified'
    WHEN left(o_orderpriority, 1)::INT - 1 = 0 THEN 'rejected' ELSE 'none' END AS status FROM orders""")
def verdict_status(spark, d):
    det = _detections(spark, d)
    ver = det.where(F.col("o_orderstatus") != "O").select(*EVENT_KEY, "category")
    return L.status(det, ver, {1: "verified", 2: "verified", 0: "rejected"}).select("k_cycle", "status")


@query("previously_judged", sql("keyed", """SELECT pool_id, previously_judged, count(*) AS n FROM (SELECT pool_id,
    k_cycle IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') OR k_cycle IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 400000) AS previously_judged FROM keyed) GROUP BY ALL"""))
def previously_judged(spark, d):
    o = B.table(spark, d, "orders").withColumn("k_cycle", F.col("o_orderkey"))
    t = L.previously_judged(event_key(B.lines(spark, d)), o.where(F.col("o_orderstatus") == "F"), o.where(F.col("o_totalprice") > 400000), key=("k_cycle",))
    return t.groupBy("pool_id", "previously_judged").agg(F.count(F.lit(1)).alias("n"))


_HELD = """held AS (SELECT pool_id, k_wmo, k_cycle, k_pres, 'held|' || CASE WHEN pres_adjusted <= 200 THEN '<=200' WHEN pres_adjusted <= 260 THEN '200-260' WHEN pres_adjusted <= 400 THEN '260-400'
    WHEN pres_adjusted <= 600 THEN '400-600' ELSE '600-1000' END AS design_stratum FROM frame WHERE l_discount * 40 >= 1.96 AND l_tax * 50 >= 1.96)"""


@query("held_region", sql("frame", f"SELECT pool_id, {_KEYS}, design_stratum FROM held", _HELD))
def held_region(spark, d):
    f = B.frame(spark, d)
    ref = f.select("pool_id", *EVENT_KEY, (F.col("l_discount") * 40).alias("r1"), (F.col("l_tax") * 50).alias("r2"))
    return L.held_region(f, ref, ["r1", "r2"]).select("pool_id", *EVENT_KEY, "design_stratum")


@query("pool_frame", sql("frame", f"SELECT pool_id, {_KEYS}, round(score, 6) AS score, pres_adjusted, l_partkey FROM frame"))
def pool_frame(spark, d):
    f = staged(B.frame(spark, d), "frame")
    return L.pool_frame(f.select("pool_id", *EVENT_KEY, "score"), f.select("pool_id", *EVENT_KEY, "pres_adjusted", "l_partkey"))


# the sheets of the first five users' letters carry their answers; the others are read from the frozen ones
@query("reference_for", sql("sheets", """SELECT batch_id, event_id AS k_cycle, CASE WHEN max(CASE WHEN value > 200 THEN 1 ELSE 0 END) OVER (PARTITION BY batch_id) = 1
    THEN label ELSE second_label END AS ref_label FROM sheets WHERE label IN (0, 1)"""))
def reference_for(spark, d):
    t = B.sheets(spark, d).withColumns({"k_wmo": F.col("wmo"), "k_cycle": F.col("event_id"), "k_pres": F.lit(0)}).where(F.col("label").isin(0, 1))
    high = t.where(F.col("value") > 200).select("batch_id").distinct().withColumn("own", F.lit(True))
    key = t.join(high, "batch_id", "left").withColumn("ref_label", F.when(F.col("own"), F.col("label")))
    frozen = t.withColumn("ref_label", F.col("second_label"))
    return L.reference_for(key, frozen).select("batch_id", "k_cycle", "ref_label")


@query("freeze_reference", sql("sheets", "SELECT batch_id, event_id AS k_cycle, label AS ref_label, 'one pass' AS how FROM sheets WHERE label IN (0, 1)"))
def freeze_reference(spark, d):
    t = staged(B.sheets(spark, d).where(F.col("label").isin(0, 1)), "sheets")
    key = t.select("batch_id", "sample_id", F.col("wmo").alias("k_wmo"), F.col("event_id").alias("k_cycle"), F.lit(0).alias("k_pres"))
    return L.freeze_reference(t.select("batch_id", "sample_id", "label"), key, "one pass").select("batch_id", "k_cycle", "ref_label", "how")


_ASOF = """SELECT s.user_id, s.event_id AS sheet_id, c.event_id AS copy_id, CASE WHEN c.value IS NULL THEN NULL WHEN c.value > 15 THEN 'PASS' ELSE 'DRIFTED' END AS verdict,
    c.ts::DATE < s.ts::DATE AS earlier_day, s.value / 100 AS obs, c.value / 100 AS ref FROM (SELECT * FROM events WHERE event_type = 'purchase') s
    ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') c ON s.user_id = c.user_id AND s.ts > c.ts"""


def _asof(spark, d):
    e = B.table(spark, d, "events")
    sheets = e.where(F.col("event_type") == "purchase").select("user_id", F.col("event_id").alias("sheet_id"), F.col("ts").alias("sheet_ts"),
                                                               (F.col("value") / 100).alias("base_rate_observed"))
    copies = e.where(F.col("event_type") == "view").select(
        "user_id", F.col("event_id").alias("copy_id"), F.col("ts").alias("copy_ts"), F.when(F.col("value") > 15, "PASS").otherwise("DRIFTED").alias("verdict"),
        (F.col("value") / 100).alias("base_rate_reference"))
    return L.calibration_asof(sheets, copies, ("user_id",))


@query("calibration_asof", f"SELECT user_id, sheet_id, copy_id, verdict, earlier_day FROM ({_ASOF})")
def calibration_asof(spark, d):
    return _asof(spark, d).select("user_id", "sheet_id", "copy_id", "verdict", "earlier_day")


@query("calibration_gate", f"""SELECT sheet_id, CASE WHEN verdict = 'PASS' THEN 'load' ELSE 'refuse' END AS decision, CASE WHEN verdict = 'PASS' THEN 'the copy before it passed'
    WHEN copy_id IS NULL THEN 'no copy was labelled before it' ELSE 'the copy before it did not pass' END AS reason, coalesce(verdict = 'PASS', false) AS counts_for_correction,
    CASE WHEN ref <> 0 THEN round(obs / ref - 1, 6) END AS base_rate_drift FROM ({_ASOF})""")
def calibration_gate(spark, d):
    return L.calibration_gate(_asof(spark, d)).select("sheet_id", "decision", "reason", "counts_for_correction", "base_rate_drift")


@query("calibration_copies", "SELECT event_id AS copy_id FROM events WHERE event_type = 'view' AND value > 5 AND value < 100")
def calibration_copies(spark, d):
    v = B.table(spark, d, "events").where(F.col("event_type") == "view")
    t = v.select(F.col("event_id").alias("copy_id"), F.when(F.col("value") > 5, "PASS").alias("verdict"),
                 F.when(F.col("value") > 5, F.col("value") >= 100).alias("reference_is_this_pass"))
    return L.calibration_copies(t).select("copy_id")


_SRC = """src AS (SELECT sheet_id, event_id, label, sample_id, quantile_cont(CASE WHEN label IN (0, 1) AND control_arm = 'target' THEN sample_id END, 0.5) OVER (PARTITION BY sheet_id) AS cut,
    control_arm FROM sheets)"""


@query("science_rows", sql("sheets", """SELECT sheet_id, event_id, label AS original_label, sample_id AS original_sample_id, CASE WHEN sample_id <= cut THEN 'first' ELSE 'second' END AS original_half
    FROM src WHERE label IN (0, 1) AND control_arm = 'target'""", _SRC))
def science_rows(spark, d):
    t = staged(B.sheets(spark, d), "sheets")
    out = L.science_rows(t.select("sheet_id", "sample_id", "label"), t.drop("label"))
    return out.select("sheet_id", "event_id", "original_label", "original_sample_id", "original_half")


@query("read_sheets", sql("sheets", "SELECT batch_id, sample_id, label, control_arm FROM sheets"))
def read_sheets(spark, d):
    t = staged(event_key(B.sheets(spark, d).withColumn("pres_adjusted", F.col("value")), cycle="event_id"), "sheets")
    cols = ["batch_id", "sample_id", *EVENT_KEY]
    return W.read_sheets(t.select(*cols, "label"), t.select(*cols, "control_arm")).select("batch_id", "sample_id", "label", "control_arm")


@query("worksheet_files", sql("sheets", "SELECT batch_id, sample_id, label FROM sheets"))
def worksheet_files(spark, d):
    from ..functions.staging import new_path
    from ..sources.records import read_csv
    t = staged(B.sheets(spark, d).select("batch_id", "sample_id", "label", "control_arm"), "sheets")
    path = new_path(spark, "sheets")
    W.write_sheets(t.select("sample_id", "label"), t, path)
    back = read_csv(spark, f"{path}/answer_key", "batch_id string, sample_id bigint, label int, control_arm string")
    return back.select("batch_id", "sample_id", "label")


@query("rejudgements_of", sql("batches reviews", """SELECT batch_id, rejudges, batch_id IN (SELECT DISTINCT batch_id FROM reviews WHERE decision = 1) AS loaded FROM batches WHERE role = 'rejudgement'"""))
def rejudgements_of(spark, d):
    return L.rejudgements_of(B.batches(spark, d), B.reviews(spark, d).where(F.col("decision") == 1))


# every purchase is a second look at its user's work; a later one is a later look
_LOOKS = """looks AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS place, CASE WHEN value < 10 THEN NULL ELSE value > 30 END AS counts
    FROM events WHERE event_type = 'purchase')"""


def _looks(spark, d):
    e = B.table(spark, d, "events").where(F.col("event_type") == "purchase")
    draws = e.select(F.col("event_id").cast("string").alias("batch_id"), F.lit("rejudgement").alias("role"), F.col("user_id").alias("rejudges"))
    done = e.select(F.col("event_id").cast("string").alias("batch_id"), F.col("ts").alias("labelled_ts"),
                    F.when(F.col("value") >= 10, F.col("value") > 30).alias("counts_for_correction"))
    return L.loaded_rejudgements(draws, done)


@query("rejudgements_counted", sql("", "SELECT event_id::VARCHAR AS batch_id, user_id AS rejudges, place FROM looks WHERE coalesce(counts, true)", _LOOKS))
def rejudgements_counted(spark, d):
    return _looks(spark, d)[0].select("batch_id", "rejudges", F.col("place").cast("bigint").alias("place"))


@query("rejudgements_skipped", sql("", "SELECT event_id::VARCHAR AS batch_id, user_id AS rejudges, place FROM looks WHERE NOT counts", _LOOKS))
def rejudgements_skipped(spark, d):
    return _looks(spark, d)[1].select("batch_id", "rejudges", F.col("place").cast("bigint").alias("place"))


@query("repeated_candidates", """SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1""")
def repeated_candidates(spark, d):
    """What `require_unique` would refuse: the keys that repeat."""
    t = B.table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n"))
    return t.where(F.col("n") > 1)


@query("count_differences", sql("sizes", """SELECT pool_id, design_stratum, frame_n AS got, CASE WHEN design_stratum = 'd3' THEN frame_n + 1 END AS recorded FROM sizes
    WHERE design_stratum IN ('d3', 'd7')"""))
def count_differences(spark, d):
    s = staged(B.sizes(B.strat(spark, d)), "sizes")
    other = s.where(F.col("design_stratum") != "d7").withColumn("frame_n", F.col("frame_n") + F.when(F.col("design_stratum") == "d3", 1).otherwise(0))
    return L.compare_counts(s, other, ["pool_id", "design_stratum"])


@query("row_disagreements", sql("sheets", "SELECT sheet_id, sample_id FROM sheets WHERE second_label <> label"))
def row_disagreements(spark, d):
    t = staged(B.sheets(spark, d).where(F.col("second_label").isNotNull()), "sheets")
    side = lambda c: t.select("sheet_id", "sample_id", F.col("wmo").alias("k_wmo"), F.col("event_id").alias("k_cycle"), F.col(c).alias("k_pres"))
    return L.disagreeing_rows(side("label"), side("second_label")).select("sheet_id", "sample_id")


@query("first_verdict_per_key", """SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY ALL""")
def first_verdict_per_key(spark, d):
    return dedup(B.table(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")
