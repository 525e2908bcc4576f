"""The engine's inputs read off the test tables, in Spark and in SQL.

`lineitem` stands for a candidate table and its verdicts, `events` for labelled sittings, the other tables for
lists and dimensions. Every binding reads its whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import unit
from ..functions.keys import EVENT_KEY, event_key
from ..functions.ordered import ordered
from ..functions.staging import staged
from ..operators import allocation as A
from ..operators import draw as P
from ..operators.rows import dedup

STUDY = "demo_v1"
SPEC = "spec_demo"
DOWN, UP = f"{STUDY}/physical/subduction", f"{STUDY}/physical/obduction"
TIE_BREAK = ("l_partkey", "l_extendedprice", "l_discount", "l_tax", "time", "l_returnflag", "pres_adjusted")
CHANNELS = ("aou", "abs_sal")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as flagged levels: supplier = float, order = profile, line and quantity = pressure."""
    flag = F.col("l_returnflag")
    return table(spark, sf_dir, "lineitem").select(
        F.when(F.col("l_linestatus") == "F", DOWN).otherwise(UP).alias("pool_id"),
        F.col("l_suppkey").alias("wmo"), F.col("l_orderkey").alias("cycle_number"),
        (F.col("l_linenumber") * 100 + F.col("l_quantity") / 2).alias("pres_adjusted"),
        (F.col("l_extendedprice") / 110000).alias("score"), "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
        F.col("l_shipdate").alias("time"), "l_returnflag", "l_linestatus",
        F.when(flag == "R", 1).when(flag == "A", 0).otherwise(2).alias("decision"))


def frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scored pool: one row per event key."""
    # the most selective column first: a sort then rarely looks at the others
    return dedup(event_key(lines(spark, sf_dir)), ["k_cycle", "k_wmo", "k_pres", "pool_id"], TIE_BREAK)


def strat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frame with its score strata, saved once as a drawn frame is."""
    # the strata read the frame twice, and making it unique is the costly part
    f = A.score_deciles(staged(frame(spark, sf_dir), "frame"))
    return staged(f.withColumn("design_stratum", F.concat(F.lit("d"), F.col("decile").cast("string"))), "strata")


def sizes(s: DataFrame) -> DataFrame:
    return s.groupBy("pool_id", "design_stratum").agg(F.count(F.lit(1)).alias("frame_n"))


def sample(s: DataFrame, frame_sizes: DataFrame) -> DataFrame:
    """The decided rows, as the sample of the frame they are in; a shipping year is a batch."""
    rows = s.where(F.col("decision").isin(0, 1))
    n = rows.groupBy("pool_id", "design_stratum").agg(F.count(F.lit(1)).alias("n_h"))
    pi = staged(n.join(frame_sizes, ["pool_id", "design_stratum"]).select(
        "pool_id", "design_stratum", (F.col("n_h") / F.col("frame_n")).alias("inclusion_probability")), "pi")
    limb = F.element_at(F.split("pool_id", "/"), -1)
    return (rows.join(pi, ["pool_id", "design_stratum"])
            .withColumn("batch_id", F.concat(F.lit("b"), F.year("time").cast("string"), F.lit("_"), limb))
            .withColumn("half", F.when(F.month("time") <= 6, "first").otherwise("second")))


def strata(s: DataFrame) -> DataFrame:
    """The strata table with a planned acceptance: the raw share of accepted rows, shrunk from 0 and 1."""
    t = A.stratum_table(s.withColumn("p", F.col("score") * 0.5))
    return A.planned_acceptance(t, 0.13)


def cells(rows: DataFrame) -> DataFrame:
    """Second-look counts per batch and cell: a row is called real again where its discount is 5 % or more."""
    cell = F.concat_ws("|", F.col("decision").cast("string"), F.col("half"))
    return rows.groupBy("batch_id", cell.alias("cell")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_discount") >= 0.05).alias("accepted"))


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.keys import candidate_id
    limb = F.element_at(F.split("pool_id", "/"), -1)
    f = frame(spark, sf_dir)
    return f.select(
        F.concat(F.lit("b"), F.year("time").cast("string"), F.lit("_"), limb).alias("batch_id"), "pool_id",
        candidate_id().alias("candidate_id"), F.when(F.col("l_discount") > 0, F.col("decision")).cast("tinyint").alias("decision"),
        F.lit(None).cast("string").alias("role"), F.lit("crit_1").alias("criterion_version"),
        F.when(F.col("l_tax") == 0.08, "pos_ctrl").when(F.col("l_tax") > 0, "target").alias("control_arm"),
        F.col("k_wmo").alias("key_wmo"), F.col("k_cycle").alias("key_cycle"), F.col("k_pres").alias("key_pres"),
        F.sha2(F.year("time").cast("string"), 256).alias("sheet_sha256"))


def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record per shipping year and limb; the year gives the role."""
    years = lines(spark, sf_dir).select("pool_id", F.year("time").alias("year")).distinct()
    limb = F.element_at(F.split("pool_id", "/"), -1)
    y = F.col("year")
    role = (F.when(y <= 1998, "analysis").when(y == 1999, "rejudgement").when(y == 2000, "training").otherwise("answer_key"))
    return years.select(
        F.concat(F.lit("b"), y.cast("string"), F.lit("_"), limb).alias("batch_id"), "pool_id", role.alias("role"),
        (y != 1995).alias("decides"), F.lit("crit_1").alias("criterion_version"),
        F.when(y == 1999, F.concat(F.lit("b1998_"), limb)).alias("rejudges"),
        F.when(y == 2000, F.array(F.lit("NOTE"))).otherwise(F.array(F.lit("LABEL"), F.lit("NOTE"))).alias("columns_kept"),
        F.struct(F.lit("probability").alias("design"), F.concat(F.lit("frame of "), y.cast("string")).alias("frame")).alias("sampling"))


def sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as labelled sittings: a user's events in time order, cut into sittings of at most 120 rows."""
    e = table(spark, sf_dir, "events")
    t = e.event_type
    rows = e.select(
        "event_id", "ts", F.col("user_id").alias("wmo"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("batch_id"),
        F.when(t == "purchase", 1).when(t.isin("view", "click"), 0).when(t == "signup", 2).alias("label"),
        F.when(F.col("value") >= 110, "pos_ctrl").when(F.col("value") < 5, "neg_ctrl").otherwise("target").alias("control_arm"),
        F.concat(F.lit("v"), F.least(F.floor(F.col("value") / 20), F.lit(4)).cast("string")).alias("design_stratum"),
        (F.col("value") / 50).alias("score"), (F.hour("ts") < 12).alias("previously_judged"),
        F.to_date("ts").alias("day"), "value")
    # one user may hold any share of the events: placed by a range sort, never by a window over the user
    r = ordered(rows, ["batch_id"], ["ts", "event_id"])
    r = r.withColumn("sample_id", F.col("rank")).withColumn("session", P.session_of(F.col("rank"), F.col("group_n")))
    r = r.withColumn("sheet_id", F.concat_ws("_s", "batch_id", F.col("session").cast("string"))).drop("rank", "group_n")
    flip = unit(7, "flip", "event_id") < 0.8
    return r.withColumn("second_label", F.when(F.col("label").isin(0, 1), F.when(flip, F.col("label")).otherwise(1 - F.col("label"))))


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as raw readings: supplier = float, shipping year = profile, day of the year = pressure."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("wmo"), F.year("l_shipdate").alias("cycle_number"),
        (F.dayofyear("l_shipdate") * 2.5).alias("pres_adjusted"), (F.col("l_extendedprice") / 997).alias("aou"),
        F.when(F.col("l_discount") > 0, F.col("l_quantity") * (1 + F.col("l_discount")) / 0.97).alias("abs_sal"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_shipdate",
        "l_returnflag", "l_linestatus")


# the same bindings in SQL: name -> (what it needs, the query)
_SQL = {
    "li": ((), f"""SELECT CASE WHEN l_linestatus = 'F' THEN '{DOWN}' ELSE '{UP}' END AS pool_id, l_suppkey AS wmo,
        l_orderkey AS cycle_number, l_linenumber * 100 + l_quantity / 2 AS pres_adjusted, l_extendedprice / 110000 AS score,
        l_partkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate AS time, l_returnflag, l_linestatus,
        CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 0 ELSE 2 END AS decision FROM lineitem"""),
    "keyed": (("li",), """SELECT *, CAST(wmo AS BIGINT) AS k_wmo, CAST(cycle_number AS BIGINT) AS k_cycle,
        CAST(round_even(pres_adjusted, 0) AS BIGINT) AS k_pres FROM li"""),
    "frame": (("keyed",), f"""SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (
        PARTITION BY pool_id, k_wmo, k_cycle, k_pres ORDER BY {', '.join(TIE_BREAK)}) AS rn FROM keyed) WHERE rn = 1"""),
    "strat": (("frame",), """SELECT *, 'd' || decile AS design_stratum FROM (SELECT *, ((row_number() OVER (PARTITION BY pool_id
        ORDER BY score, wmo, cycle_number, pres_adjusted) - 1) * 10) // count(*) OVER (PARTITION BY pool_id) AS decile FROM frame)"""),
    "sizes": (("strat",), "SELECT pool_id, design_stratum, count(*) AS frame_n FROM strat GROUP BY ALL"),
    "pi": (("sizes",), """SELECT s.pool_id, s.design_stratum, n_h, frame_n, n_h / frame_n AS inclusion_probability FROM sizes s JOIN (
        SELECT pool_id, design_stratum, count(*) AS n_h FROM strat WHERE decision IN (0, 1) GROUP BY ALL) USING (pool_id, design_stratum)"""),
    "rows": (("pi",), """SELECT s.*, p.inclusion_probability, 'b' || year(time) || '_' || split_part(s.pool_id, '/', 3) AS batch_id,
        CASE WHEN month(time) <= 6 THEN 'first' ELSE 'second' END AS half
        FROM strat s JOIN pi p USING (pool_id, design_stratum) WHERE decision IN (0, 1)"""),
    "counts": (("rows",), """SELECT *, frame_n / sum(frame_n) OVER (PARTITION BY pool_id) AS w, a_h / n_h AS p_h,
        CASE WHEN a_h = 0 OR a_h = n_h THEN (a_h + 0.5) / (n_h + 1.0) ELSE a_h / n_h END AS p_v FROM (
        SELECT pool_id, design_stratum, count(*) AS n_h, sum(decision)::DOUBLE AS a_h FROM rows GROUP BY ALL)
        JOIN sizes USING (pool_id, design_stratum)"""),
    "var": (("counts",), "SELECT *, w * w * p_v * (1 - p_v) / greatest(n_h - 1, 1) * (1 - n_h / frame_n) AS v FROM counts"),
    "rates": (("var",), "SELECT pool_id, sum(w * p_h) AS rate, sqrt(sum(v)) AS se_design, sum(n_h)::BIGINT AS n, sum(frame_n)::BIGINT AS frame_n FROM var GROUP BY ALL"),
    "strata0": (("strat",), """SELECT *, frame_n / sum(frame_n) OVER (PARTITION BY pool_id) AS w FROM (
        SELECT pool_id, design_stratum, count(*) AS frame_n, count(DISTINCT wmo) AS floats, min(score) AS score_min, max(score) AS score_max,
        avg(score * 0.5) AS p_raw FROM strat GROUP BY ALL) JOIN (SELECT pool_id, design_stratum, max(c) / sum(c) AS max_float_share FROM (
        SELECT pool_id, design_stratum, wmo, count(*) AS c FROM strat GROUP BY ALL) GROUP BY ALL) USING (pool_id, design_stratum)"""),
    "strata": (("strata0",), """SELECT *, least(greatest(p_raw * rescale, 0.005), 0.995) AS p_planned FROM (
        SELECT *, 0.13 / sum(w * p_raw) OVER (PARTITION BY pool_id) AS rescale FROM strata0)"""),
    "cells": (("rows",), """SELECT batch_id, decision || '|' || half AS cell, count(*) AS n, count(*) FILTER (l_discount >= 0.05) AS accepted
        FROM rows GROUP BY ALL"""),
    "reviews": (("frame",), """SELECT 'b' || year(time) || '_' || split_part(pool_id, '/', 3) AS batch_id, pool_id,
        substr(sha256(pool_id || '|' || k_wmo || '|' || k_cycle || '|' || k_pres), 1, 32) AS candidate_id,
        CASE WHEN l_discount > 0 THEN decision END AS decision, NULL::VARCHAR AS role, 'crit_1' AS criterion_version,
        CASE WHEN l_tax = 0.08 THEN 'pos_ctrl' WHEN l_tax > 0 THEN 'target' END AS control_arm,
        k_wmo AS key_wmo, k_cycle AS key_cycle, k_pres AS key_pres, sha256(year(time)::VARCHAR) AS sheet_sha256 FROM frame"""),
    "batches": (("li",), """SELECT 'b' || y || '_' || split_part(pool_id, '/', 3) AS batch_id, pool_id,
        CASE WHEN y <= 1998 THEN 'analysis' WHEN y = 1999 THEN 'rejudgement' WHEN y = 2000 THEN 'training' ELSE 'answer_key' END AS role,
        y <> 1995 AS decides, 'crit_1' AS criterion_version, CASE WHEN y = 1999 THEN 'b1998_' || split_part(pool_id, '/', 3) END AS rejudges,
        y <> 2000 AS has_label, 'frame of ' || y AS sampling_frame FROM (SELECT DISTINCT pool_id, year(time) AS y FROM li)"""),
    "sheets": ((), """SELECT * EXCLUDE (n, k), batch_id || '_s' || session AS sheet_id, CASE WHEN label IN (0, 1) THEN
        CASE WHEN ('0x' || substr(sha256('7|flip|' || event_id), 1, 13))::BIGINT / pow(2, 52) < 0.8 THEN label ELSE 1 - label END END AS second_label
        FROM (SELECT *, CASE WHEN sample_id < (n - (n // k) * k) * (n // k + 1) THEN sample_id // (n // k + 1)
        ELSE (n - (n // k) * k) + (sample_id - (n - (n // k) * k) * (n // k + 1)) // (n // k) END + 1 AS session FROM (
        SELECT *, greatest(1, CAST(ceil(n / 120) AS BIGINT)) AS k FROM (
        SELECT event_id, ts, user_id AS wmo, 'u' || user_id AS batch_id, CASE WHEN event_type = 'purchase' THEN 1
        WHEN event_type IN ('view', 'click') THEN 0 WHEN event_type = 'signup' THEN 2 END AS label,
        CASE WHEN value >= 110 THEN 'pos_ctrl' WHEN value < 5 THEN 'neg_ctrl' ELSE 'target' END AS control_arm,
        'v' || least(CAST(floor(value / 20) AS BIGINT), 4) AS design_stratum, value / 50 AS score, hour(ts) < 12 AS previously_judged,
        ts::DATE AS day, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS sample_id,
        count(*) OVER (PARTITION BY user_id) AS n FROM events)))"""),
    "prof": ((), """SELECT l_suppkey AS wmo, year(l_shipdate) AS cycle_number, dayofyear(l_shipdate) * 2.5::DOUBLE AS pres_adjusted,
        l_extendedprice / 997 AS aou, CASE WHEN l_discount > 0 THEN l_quantity * (1 + l_discount) / 0.97::DOUBLE END AS abs_sal, * FROM lineitem"""),
}


def sql(names: str, select: str, extra: str = "") -> str:
    """`select` over the named bindings, with whatever they need in front of it."""
    needed: list[str] = []

    def add(n: str) -> None:
        for d in _SQL[n][0]:
            add(d)
        if n not in needed:
            needed.append(n)

    for n in names.split():
        add(n)
    parts = [f"{n} AS ({_SQL[n][1]})" for n in needed] + ([extra] if extra else [])
    return f"WITH {', '.join(parts)} {select}" if parts else select


def u(seed: int | str, tag: str, *key: str) -> str:
    """`functions.hashing.unit` in SQL."""
    text = " || '|' || ".join([f"'{seed}|{tag}'", *[f"({k})::VARCHAR" for k in key]])
    return f"(('0x' || substr(sha256({text}), 1, 13))::BIGINT / pow(2, 52))"
