"""Registered queries: keys, identifiers, digests, filters, stored candidate lists."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from ..functions import keys as K
from ..functions.staging import new_path
from ..operators import rows as R
from ..sources import candidates as C
from ..sources import records, reviews as W
from . import bindings as B
from .bindings import DOWN, SPEC, STUDY, UP, sql
from .registry import query

_LINE = "pool_id || '|' || k_wmo || '|' || k_cycle || '|' || k_pres"
_KEY = "pool_id, k_wmo, k_cycle, k_pres"


@query("event_key", sql("keyed", "SELECT k_wmo, k_cycle, k_pres, count(*) AS n FROM keyed GROUP BY ALL"))
def event_key(spark, d):
    return K.event_key(B.lines(spark, d)).groupBy(*K.EVENT_KEY).agg(F.count(F.lit(1)).alias("n"))


@query("event_key_from_text", """SELECT try_cast(p_type AS DOUBLE) IS NULL AS dropped, CAST(round_even(p_retailprice / 8, 0) AS BIGINT) AS k_pres,
    count(*) AS n FROM part GROUP BY ALL""")
def event_key_from_text(spark, d):
    t = B.table(spark, d, "part").select(F.col("p_type").alias("wmo"), F.col("p_partkey").alias("cycle_number"),
                                         (F.col("p_retailprice") / 8).cast("string").alias("pres_adjusted"))
    k = K.event_key(t, keep_null=True)
    return k.groupBy(F.col("k_wmo").isNull().alias("dropped"), "k_pres").agg(F.count(F.lit(1)).alias("n"))


@query("pool_id_grammar", """SELECT pool_id, len(string_split(pool_id, '/')) = 3 AND split_part(pool_id, '/', 1) <> ''
    AND split_part(pool_id, '/', 2) IN ('physical', 'nitrate', 'carbon')
    AND split_part(pool_id, '/', 3) IN ('subduction', 'obduction') AS valid, count(*) AS n FROM (
    SELECT CASE o_orderpriority WHEN '1-URGENT' THEN '' ELSE 'demo_v1' END || '/' ||
    CASE o_orderstatus WHEN 'F' THEN 'physical' WHEN 'O' THEN 'carbon' ELSE o_orderpriority END || '/' ||
    CASE WHEN o_custkey < 500 THEN 'subduction' WHEN o_custkey < 1000 THEN 'obduction' ELSE 'up/down' END AS pool_id FROM orders) GROUP BY ALL""")
def pool_id_grammar(spark, d):
    status, cust = F.col("o_orderstatus"), F.col("o_custkey")
    t = B.table(spark, d, "orders").select(F.concat_ws(
        "/", F.when(F.col("o_orderpriority") == "1-URGENT", "").otherwise(STUDY),
        F.when(status == "F", "physical").when(status == "O", "carbon").otherwise(F.col("o_orderpriority")),
        F.when(cust < 500, "subduction").when(cust < 1000, "obduction").otherwise("up/down")).alias("pool_id"))
    return (t.groupBy("pool_id").agg(F.count(F.lit(1)).alias("n"))
            .select("pool_id", K.pool_id_is_valid("pool_id").alias("valid"), "n"))


@query("event_type", sql("li", """SELECT pool_id, split_part(pool_id, '/', 2) || '_' || split_part(pool_id, '/', 3) AS event_type,
    count(*) AS n FROM li GROUP BY ALL"""))
def event_type(spark, d):
    return B.lines(spark, d).groupBy("pool_id", K.event_type("pool_id").alias("event_type")).agg(F.count(F.lit(1)).alias("n"))


@query("candidate_id", sql("frame", f"SELECT {_KEY}, substr(sha256({_LINE}), 1, 32) AS candidate_id FROM frame"))
def candidate_id(spark, d):
    return B.frame(spark, d).select("pool_id", *K.EVENT_KEY, K.candidate_id().alias("candidate_id"))


@query("stamp", sql("frame", f"""SELECT {_KEY}, '{STUDY}' AS study_id, '{SPEC}' AS spec_id, substr(sha256({_LINE}), 1, 32) AS candidate_id,
    split_part(pool_id, '/', 2) || '_' || split_part(pool_id, '/', 3) AS event_type FROM frame"""))
def stamp(spark, d):
    t = K.stamp(B.frame(spark, d), STUDY, F.lit(SPEC))
    return t.select("pool_id", *K.EVENT_KEY, "study_id", "spec_id", "candidate_id", "event_type")


_LIMBS = ", ".join(f"sum(('0x' || substr(h, {1 + 8 * i}, 8))::BIGINT) AS s{i}" for i in range(8))
_SET_HASH = ("SELECT pool_id, n, sha256(n || '|' || " + " || '|' || ".join(f"s{i}" for i in range(8)) + ") AS content_sha256 FROM ("
             f"SELECT pool_id, count(*) AS n, {_LIMBS} FROM (SELECT pool_id, sha256(k_wmo || '|' || k_cycle || '|' || k_pres) AS h FROM frame) GROUP BY ALL)")


@query("content_hash", sql("frame", _SET_HASH))
def content_hash(spark, d):
    return K.content_hash(K.event_key(B.lines(spark, d)))


@query("listed_hash", sql("frame", """SELECT pool_id, count(*) AS n, sha256(string_agg(k_wmo || '|' || k_cycle || '|' || k_pres, chr(10)
    ORDER BY k_wmo, k_cycle, k_pres)) AS content_sha256 FROM (SELECT DISTINCT pool_id, k_wmo, k_cycle, k_pres FROM frame) GROUP BY ALL"""))
def listed_hash(spark, d):
    return K.listed_hash(K.event_key(B.lines(spark, d)))


@query("review_id", sql("sheets", """SELECT sheet_id, sample_id, substr(sha256(batch_id || '|' || sha256(sheet_id) || '|' || sample_id), 1, 16)
    AS review_id FROM sheets"""))
def review_id(spark, d):
    t = B.sheets(spark, d)
    return t.select("sheet_id", "sample_id", K.review_id("batch_id", F.sha2("sheet_id", 256), "sample_id").alias("review_id"))


@query("joint_digest", """SELECT o_custkey, count(*) AS sheets, CASE WHEN count(*) = 1 THEN min(sha256(o_orderkey::VARCHAR)) ELSE
    sha256(string_agg(sha256(o_orderkey::VARCHAR) || chr(9) || o_orderkey || chr(10), '' ORDER BY o_orderkey)) END AS digest
    FROM orders GROUP BY ALL""")
def joint_digest(spark, d):
    t = B.table(spark, d, "orders").select("o_custkey", "o_orderkey", F.sha2(F.col("o_orderkey").cast("string"), 256).alias("digest"))
    return K.joint_digest(t, ["o_custkey"], "o_orderkey", "digest")


@query("decision_cast", """SELECT o_orderpriority, CASE WHEN try_cast(left(o_orderpriority, 1) AS INT) IN (0, 1, 2) THEN
    try_cast(left(o_orderpriority, 1) AS INT) END AS decision, count(*) AS n FROM orders GROUP BY ALL""")
def decision_cast(spark, d):
    t = B.table(spark, d, "orders")
    return (t.groupBy("o_orderpriority", K.decision(F.substring("o_orderpriority", 1, 1)).cast("int").alias("decision"))
            .agg(F.count(F.lit(1)).alias("n")))


@query("feature_columns", sql("frame", """SELECT pool_id, k_wmo, k_cycle, k_pres, round(score, 6) AS score, l_partkey, l_quantity, l_extendedprice, l_discount,
    l_tax, decision FROM frame"""))
def feature_columns(spark, d):
    return R.numeric_only(B.frame(spark, d))


@query("dedup_on_key", sql("frame", f"SELECT {_KEY}, wmo, cycle_number, pres_adjusted, round(score, 6) AS score, l_partkey, decision FROM frame"))
def dedup_on_key(spark, d):
    return B.frame(spark, d).select("pool_id", *K.EVENT_KEY, *K.KEYS, "score", "l_partkey", "decision")


_MEASURES = StructType([StructField("wmo", LongType()), StructField("cycle_number", DoubleType()), StructField("pres_adjusted", DoubleType()),
                        StructField("l_discount", DoubleType()), StructField("bbp_iqrn", DoubleType()), StructField("pool_id", StringType())])


@query("conform_schema", sql("li", """SELECT wmo, cycle_number::DOUBLE AS cycle_number, pres_adjusted, l_discount, NULL::DOUBLE AS bbp_iqrn,
    pool_id FROM li"""))
def conform_schema(spark, d):
    return R.conform(B.lines(spark, d), _MEASURES)


_AOU = "SELECT wmo, cycle_number, count(*) AS n, count(v) AS kept, sum(v) AS total FROM"


def _range_totals(t):
    return t.groupBy("wmo", "cycle_number").agg(F.count(F.lit(1)).alias("n"), F.count("aou").alias("kept"), F.sum("aou").alias("total"))


_SUM = "SELECT wmo, cycle_number, count(*) AS n, count(v) AS kept, round(sum(v), 6) AS total FROM"


@query("valid_range_mask", sql("prof", f"{_SUM} (SELECT *, CASE WHEN aou BETWEEN 10 AND 90 THEN aou END AS v FROM prof) GROUP BY ALL"))
def valid_range_mask(spark, d):
    return _range_totals(R.valid_range(B.profiles(spark, d), "aou", 10, 90, "mask"))


@query("valid_range_clip", sql("prof", f"""{_SUM} (SELECT *, CASE WHEN aou BETWEEN 8 AND 92 THEN least(greatest(aou, 10), 90) END AS v
    FROM prof) GROUP BY ALL"""))
def valid_range_clip(spark, d):
    return _range_totals(R.valid_range(B.profiles(spark, d), "aou", 10, 90, "clip", 2))


@query("valid_range_drop_cycle", sql("prof", f"""{_SUM} (SELECT *, aou AS v FROM prof p WHERE NOT EXISTS (SELECT 1 FROM prof q
    WHERE q.wmo = p.wmo AND q.cycle_number = p.cycle_number AND q.aou NOT BETWEEN 1.5 AND 104)) GROUP BY ALL"""))
def valid_range_drop_cycle(spark, d):
    return _range_totals(R.valid_range(B.profiles(spark, d), "aou", 1.5, 104, "drop_cycle"))


@query("mask_fill", """SELECT l_suppkey AS wmo, count(*) AS n, count(CASE WHEN l_quantity NOT IN (1, 50) AND abs(l_quantity) < 45 THEN 1 END) AS quantity,
    count(CASE WHEN l_tax NOT IN (1, 50) AND abs(l_tax) < 45 THEN 1 END) AS tax FROM lineitem GROUP BY ALL""")
def mask_fill(spark, d):
    t = R.mask_fill(B.table(spark, d, "lineitem"), ["l_quantity", "l_tax"], [1, 50], 45)
    return t.groupBy(F.col("l_suppkey").alias("wmo")).agg(F.count(F.lit(1)).alias("n"), F.count("l_quantity").alias("quantity"),
                                                          F.count("l_tax").alias("tax"))


@query("in_window", """SELECT year(l_shipdate) AS y, count(*) AS n FROM lineitem WHERE l_shipdate >= DATE '1996-02-08'
    AND l_shipdate < DATE '2000-03-16' GROUP BY ALL""")
def in_window(spark, d):
    t = R.in_window(B.table(spark, d, "lineitem"), "1996-02-08", "2000-03-15", "l_shipdate")
    return t.groupBy(F.year("l_shipdate").alias("y")).agg(F.count(F.lit(1)).alias("n"))


@query("excluded_floats", """SELECT s_suppkey AS wmo, 'balance below zero' AS reason, coalesce(n, 0) AS rows_removed FROM supplier
    LEFT JOIN (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL) ON l_suppkey = s_suppkey WHERE s_acctbal < 0""")
def excluded_floats(spark, d):
    bad = (B.table(spark, d, "supplier").where(F.col("s_acctbal") < 0)
           .select(F.col("s_suppkey").alias("wmo"), F.lit("balance below zero").alias("reason")))
    return R.exclude(B.lines(spark, d), bad)[1]


@query("kept_floats", """SELECT l_suppkey AS wmo, count(*) AS n FROM lineitem WHERE l_suppkey NOT IN
    (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) GROUP BY ALL""")
def kept_floats(spark, d):
    bad = B.table(spark, d, "supplier").where(F.col("s_acctbal") < 0).select(F.col("s_suppkey").alias("wmo"))
    return R.exclude(B.lines(spark, d), bad)[0].groupBy("wmo").agg(F.count(F.lit(1)).alias("n"))


@query("adjusted_or_raw", """SELECT l_orderkey, count(v) AS n, round(sum(v), 6) AS total FROM (SELECT l_orderkey,
    CASE WHEN bool_or(l_discount >= 0.08) OVER (PARTITION BY l_orderkey) THEN CASE WHEN l_discount >= 0.08 THEN l_quantity END
    ELSE l_tax END AS v FROM lineitem) GROUP BY ALL""")
def adjusted_or_raw(spark, d):
    t = B.table(spark, d, "lineitem").withColumn("adj", F.when(F.col("l_discount") >= 0.08, F.col("l_quantity")))
    t = R.adjusted_or_raw(t, "adj", "l_tax", "v", ["l_orderkey"])
    return t.groupBy("l_orderkey").agg(F.count("v").alias("n"), F.sum("v").alias("total"))


@query("median_smooth", """SELECT event_id, round(quantile_cont(value, 0.5) OVER (PARTITION BY user_id ORDER BY event_id
    ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS smooth FROM events""")
def median_smooth(spark, d):
    t = R.median_smooth(B.table(spark, d, "events"), "value", 2, "smooth", "event_id", ["user_id"])
    return t.select("event_id", "smooth")


@query("apply_alignment", sql("frame", f"SELECT {_KEY}, round(-l_discount, 6) + 0 AS l_discount, -l_extendedprice AS l_quantity, -l_quantity AS l_extendedprice, l_tax FROM frame"))
def apply_alignment(spark, d):
    t = B.frame(spark, d).select("pool_id", *K.EVENT_KEY, "l_discount", "l_quantity", "l_extendedprice", "l_tax")
    return R.apply_alignment(t, {"l_discount": "flip", "l_quantity": "swap_negate:l_extendedprice",
                                 "l_extendedprice": "swap_negate:l_quantity"})


@query("blind_worksheet", sql("frame", """SELECT NULL::DOUBLE AS label, l_partkey AS sample_id, wmo, cycle_number, pres_adjusted,
    NULL::DOUBLE AS latitude, NULL::DOUBLE AS longitude, time, split_part(pool_id, '/', 2) || '_' || split_part(pool_id, '/', 3) AS event_type
    FROM frame"""))
def blind_worksheet(spark, d):
    t = B.frame(spark, d).withColumns({"sample_id": F.col("l_partkey"), "latitude": F.lit(None).cast("double"),
                                       "longitude": F.lit(None).cast("double"), "event_type": K.event_type("pool_id")})
    return R.blind(t)


def _saved(spark, d):
    t = K.stamp(B.frame(spark, d), STUDY, F.lit(SPEC)).select("pool_id", "spec_id", "candidate_id", *K.KEYS, *K.EVENT_KEY, "score")
    path = new_path(spark, "candidates")
    return path, C.write_candidates(t, path, "source_1")


@query("scan_candidates", sql("frame", f"SELECT k_wmo, k_cycle, k_pres, score FROM frame WHERE pool_id = '{UP}'".replace("score", "round(score, 6) AS score", 1)))
def scan_candidates(spark, d):
    path, _ = _saved(spark, d)
    return C.scan_candidates(spark, path, UP, [*K.EVENT_KEY, "score"])


@query("scan_verified", sql("frame", f"SELECT k_wmo, k_cycle, k_pres FROM frame WHERE pool_id = '{DOWN}'"))
def scan_verified(spark, d):
    path, side = _saved(spark, d)
    pools = side.select("pool_id", "spec_id")
    return C.scan_verified(spark, path, side, pools, DOWN, list(K.EVENT_KEY), "source_1")


@query("candidate_sidecar", sql("frame", f"""SELECT pool_id, n AS n_rows, '{SPEC}' AS spec_id, content_sha256, 'source_1' AS source_digest
    FROM ({_SET_HASH})"""))
def candidate_sidecar(spark, d):
    return _saved(spark, d)[1]


@query("pool_summary", sql("frame", f"""SELECT pool_id, '{SPEC}' AS spec_id, count(*) AS n_rows, split_part(pool_id, '/', 2) || '_' ||
    split_part(pool_id, '/', 3) AS event_type FROM frame GROUP BY ALL"""))
def pool_summary(spark, d):
    return C.pool_summary(B.frame(spark, d).withColumn("spec_id", F.lit(SPEC)))


@query("scan_pinned", "SELECT o_orderkey, o_totalprice FROM orders")
def scan_pinned(spark, d):
    path = f"{d}/orders.parquet"
    key = ["o_orderkey"]
    pin = K.content_hash(B.table(spark, d, "orders").withColumn("_all", F.lit(1)), ["_all"], key).first()["content_sha256"]
    return C.scan_pinned(spark, path, ["o_orderkey", "o_totalprice"], key, pin)


@query("csv_round_trip", "SELECT o_orderkey, o_custkey, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 3 END AS category FROM orders")
def csv_round_trip(spark, d):
    s = F.col("o_orderstatus")
    path = new_path(spark, "csv")
    (B.table(spark, d, "orders").select("o_orderkey", "o_custkey", F.when(s == "F", 0).when(s == "O", 1).otherwise(3).alias("category"))
     .write.csv(path, header=True))
    return records.read_csv(spark, path, "o_orderkey bigint, o_custkey bigint, category int")


@query("records_flattened", sql("batches", """SELECT batch_id, pool_id, role, decides, criterion_version, rejudges,
    'probability' AS sampling_design, sampling_frame FROM batches"""))
def records_flattened(spark, d):
    path = new_path(spark, "records")
    B.batches(spark, d).write.json(path)
    t = records.flatten(records.read_records(spark, path))
    return t.select("batch_id", "pool_id", "role", "decides", "criterion_version", "rejudges", "sampling_design", "sampling_frame")


@query("append_reviews", sql("reviews", "SELECT batch_id, count(*) AS n, count(decision) AS judged FROM reviews GROUP BY ALL"))
def append_reviews(spark, d):
    r = B.reviews(spark, d)
    early = r.where(F.col("batch_id") < "b1998")
    path = new_path(spark, "reviews")
    W.write_reviews(early, path)
    rest = r.where(F.col("batch_id") >= "b1998")
    t = W.append_reviews(spark.read.parquet(path), rest)
    return t.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"), F.count("decision").alias("judged"))


@query("upsert_batch", sql("batches", "SELECT batch_id, CASE WHEN role = 'training' THEN 'audit' ELSE role END AS role FROM batches"))
def upsert_batch(spark, d):
    b = B.batches(spark, d)
    new = b.where(F.col("role") == "training").withColumn("role", F.lit("audit"))
    return W.upsert_batch(b, new).select("batch_id", "role")


@query("strata_membership", sql("strat", "SELECT pool_id, k_wmo, k_cycle, k_pres, design_stratum FROM strat"))
def strata_membership(spark, d):
    s = B.strat(spark, d)
    path = new_path(spark, "membership")
    side = W.save_strata(s, path)
    return W.load_strata(spark, path, side, B.sizes(s))


@query("score_sink", sql("frame", "SELECT pool_id, count(*) AS n_rows, 6 AS n_columns FROM frame GROUP BY ALL"))
def score_sink(spark, d):
    t = B.frame(spark, d).select("pool_id", *K.EVENT_KEY, "score", F.lit(False).alias("score_is_oof"))
    return W.write_scores(t, new_path(spark, "scores"))
