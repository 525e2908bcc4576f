"""Registered queries: gridding, detection, nesting, features, checks of a grid source."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.keys import EVENT_KEY, event_key
from ..functions.staging import staged
from ..operators import features as X
from ..operators import grid as G
from ..operators.rows import median_smooth
from ..sources import grids as S
from . import bindings as B
from .bindings import DOWN, UP, sql
from .detect import detect_study
from .registry import query

CH = ("aou", "abs_sal")
CHILD_DOWN, CHILD_UP = "demo_v1/nitrate/subduction", "demo_v1/nitrate/obduction"
GATES = (
    G.Gate(DOWN, (G.Term("aou", 0.6, "negative", True),), None, "g1", 0, 900),
    G.Gate(UP, (G.Term("aou", 0.6, "positive", True),), None, "g2", 0, 900),
    G.Gate(CHILD_DOWN, (G.Term("aou", 0.6, "negative", True), G.Term("abs_sal", 0.4)), DOWN, "g3", 0, 900),
    G.Gate(CHILD_UP, (G.Term("aou", 0.6, "positive", True), G.Term("abs_sal", 0.4, "positive")), UP, "g4", 0, 900),
)


def grid_sql(name: str, width: int) -> str:
    """The residual grid by its definition, for both channels."""
    q = lambda c: f"quantile_cont({c}_res, [0.25, 0.75]) OVER wide"
    bg = lambda c: (f"CASE WHEN len(v_{c}) >= 3 THEN list_sum(list_slice(v_{c}, CAST(floor(len(v_{c}) * 0.2) AS INT) + 1, greatest(CAST(ceil(len(v_{c}) * 0.8) AS INT), CAST(floor(len(v_{c}) * 0.2) AS INT) + 1)))"
                    f" / (greatest(CAST(ceil(len(v_{c}) * 0.8) AS INT), CAST(floor(len(v_{c}) * 0.2) AS INT) + 1) - CAST(floor(len(v_{c}) * 0.2) AS INT)) END")
    near = lambda c: f"list_sort(coalesce(list({c}) FILTER ({c} IS NOT NULL) OVER near, [])) AS v_{c}"
    iq = lambda c: f"CASE WHEN count({c}_res) OVER wide >= 3 THEN (({q(c)})[2] - ({q(c)})[1]) / 1.349 END AS {c}_iqrn"
    return f"""{name}_b AS (SELECT wmo, cycle_number, CAST(floor(pres_adjusted / {width}) AS BIGINT) AS bin, avg(aou) AS aou, avg(abs_sal) AS abs_sal FROM prof GROUP BY ALL),
        {name}_v AS (SELECT *, {near('aou')}, {near('abs_sal')} FROM {name}_b WINDOW near AS (PARTITION BY wmo, cycle_number ORDER BY bin ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)),
        {name}_r AS (SELECT wmo, cycle_number, bin, bin * {width}.0::DOUBLE AS pres_adjusted, aou, abs_sal, aou - {bg('aou')} AS aou_res, abs_sal - {bg('abs_sal')} AS abs_sal_res FROM {name}_v),
        {name}_q AS (SELECT *, {iq('aou')}, {iq('abs_sal')} FROM {name}_r WINDOW wide AS (PARTITION BY wmo, cycle_number ORDER BY bin ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING)),
        {name} AS (SELECT *, CASE WHEN aou_iqrn > 0 THEN aou_res / aou_iqrn END AS aou_scale_res_rob, CASE WHEN abs_sal_iqrn > 0 THEN abs_sal_res / abs_sal_iqrn END AS abs_sal_scale_res_rob FROM {name}_q)"""


COARSE, FINE = grid_sql("coarse", 40), grid_sql("fine", 10)


def _grid(spark, d, resolution="coarse"):
    return G.residual_grid(B.profiles(spark, d), CH, resolution=resolution)


_GRID_COLS = ("wmo, cycle_number, bin, pres_adjusted, round(aou, 6) AS aou, round(abs_sal, 6) AS abs_sal, round(aou_res, 6) + 0 AS aou_res, round(abs_sal_res, 6) + 0 AS abs_sal_res, "
              "round(aou_iqrn, 6) AS aou_iqrn, round(abs_sal_iqrn, 6) AS abs_sal_iqrn, round(aou_scale_res_rob, 6) + 0 AS aou_scale_res_rob, "
              "round(abs_sal_scale_res_rob, 6) + 0 AS abs_sal_scale_res_rob")


@query("residual_grid_coarse", sql("prof", f"SELECT {_GRID_COLS} FROM coarse", COARSE))
def residual_grid_coarse(spark, d):
    return _grid(spark, d).drop("resolution")


@query("residual_grid_fine", sql("prof", f"SELECT {_GRID_COLS} FROM fine", FINE))
def residual_grid_fine(spark, d):
    return _grid(spark, d, "fine").drop("resolution")


# the gate by its definition; a missing neighbour counts as zero
_FLAGS = COARSE + """, near AS (SELECT *, abs(coalesce(lag(aou_scale_res_rob) OVER w, 0)) AS b, abs(coalesce(lead(aou_scale_res_rob) OVER w, 0)) AS a FROM coarse
    WINDOW w AS (PARTITION BY wmo, cycle_number ORDER BY pres_adjusted)),
    base AS (SELECT *, pres_adjusted BETWEEN 0 AND 900 AND abs(aou_scale_res_rob) >= 0.6 AND abs(aou_scale_res_rob) > a AND abs(aou_scale_res_rob) > b AS g FROM near),
    flagged AS (SELECT '%s' AS pool_id, * FROM base WHERE g AND aou_scale_res_rob < 0 UNION ALL SELECT '%s', * FROM base WHERE g AND aou_scale_res_rob > 0
    UNION ALL SELECT '%s', * FROM base WHERE g AND aou_scale_res_rob < 0 AND abs(abs_sal_scale_res_rob) >= 0.4
    UNION ALL SELECT '%s', * FROM base WHERE g AND aou_scale_res_rob > 0 AND abs_sal_scale_res_rob >= 0.4)""" % (DOWN, UP, CHILD_DOWN, CHILD_UP)


@query("detect", sql("prof", "SELECT pool_id, wmo, cycle_number, pres_adjusted, round(aou_scale_res_rob, 6) AS aou_scale_res_rob FROM flagged", _FLAGS))
def detect(spark, d):
    return G.detect(_grid(spark, d), GATES, ["aou_scale_res_rob"]).drop("spec_id")


_IDS = "substr(sha256(pool_id || '|' || wmo || '|' || cycle_number || '|' || CAST(pres_adjusted AS BIGINT)), 1, 32) AS candidate_id"


@query("detect_study", sql("prof", f"SELECT pool_id, wmo, cycle_number, pres_adjusted, {_IDS}, split_part(pool_id, '/', 2) || '_' || split_part(pool_id, '/', 3) AS event_type FROM flagged", _FLAGS))
def study(spark, d):
    t = detect_study(_grid(spark, d), GATES, "demo_v1")
    return t.select("pool_id", "wmo", "cycle_number", "pres_adjusted", "candidate_id", "event_type")


# nesting: a child flagged at another gate than its parent's keeps only the parent's levels
_LOOSE = (GATES[0], G.Gate(CHILD_DOWN, (G.Term("abs_sal", 0.8),), DOWN, "g5", 0, 900))


@query("nest_in_parent", sql("prof", f"""SELECT pool_id, wmo, cycle_number, pres_adjusted FROM (SELECT * FROM flagged WHERE pool_id = '{DOWN}' UNION ALL
    SELECT '{CHILD_DOWN}', * FROM base WHERE abs(abs_sal_scale_res_rob) >= 0.8 AND pres_adjusted BETWEEN 0 AND 900 AND g AND aou_scale_res_rob < 0)""", _FLAGS))
def nest_in_parent(spark, d):
    c = staged(event_key(G.detect(_grid(spark, d), _LOOSE)), "candidates")      # nesting reads them twice
    pools = spark.createDataFrame([(g.pool_id, g.parent) for g in _LOOSE], "pool_id string, parent string")
    return G.nest(c, pools).select("pool_id", "wmo", "cycle_number", "pres_adjusted")


@query("verify_set", sql("keyed", """SELECT pool_id, saved, regenerated, saved_only, new_only, saved_only = 0 AND new_only = 0 AS exact FROM (SELECT pool_id, count(*) FILTER (s) AS saved,
    count(*) FILTER (r) AS regenerated, count(*) FILTER (s AND NOT r) AS saved_only, count(*) FILTER (r AND NOT s) AS new_only FROM (SELECT pool_id, k_wmo, k_cycle, k_pres,
    bool_or(l_discount > 0.01) AS s, bool_or(l_discount < 0.09 OR l_linestatus = 'F') AS r FROM keyed GROUP BY ALL) WHERE s OR r GROUP BY ALL)"""))
def verify_set(spark, d):
    k = event_key(B.lines(spark, d))
    return G.verify_set(k.where(F.col("l_discount") > 0.01), k.where((F.col("l_discount") < 0.09) | (F.col("l_linestatus") == "F")))


def _files(spark, d):
    """Line items as grid rows: return flag = kind, line status = resolution."""
    return B.profiles(spark, d).withColumnsRenamed({"l_returnflag": "grid_kind"}).withColumn(
        "resolution", F.when(F.col("l_linestatus") == "F", "fine").otherwise("coarse"))


@query("paired_grids", """SELECT l_suppkey AS wmo, cycle_number, l_returnflag AS grid_kind, count(*) AS n FROM (SELECT *, year(l_shipdate) * 12 + month(l_shipdate) AS cycle_number FROM lineitem)
    WHERE (l_suppkey * 100000 + cycle_number, l_returnflag) IN (SELECT (l_suppkey * 100000 + year(l_shipdate) * 12 + month(l_shipdate), l_returnflag) FROM lineitem GROUP BY ALL HAVING count(DISTINCT l_linestatus) = 2) GROUP BY ALL""")
def paired_grids(spark, d):
    month = F.year("l_shipdate") * 12 + F.month("l_shipdate")
    t = _files(spark, d).withColumns({"cycle_number": month, "wmo": F.col("wmo") * 100000 + month})
    t = S.paired_grids(t)
    return (t.withColumn("wmo", F.floor(F.col("wmo") / 100000)).groupBy("wmo", F.col("cycle_number"), "grid_kind").agg(F.count(F.lit(1)).alias("n")))


@query("grid_kind_of", "SELECT o_custkey AS wmo, min(o_orderpriority) AS grid_kind FROM orders GROUP BY ALL")
def grid_kind_of(spark, d):
    return S.grid_kind_of(B.table(spark, d, "orders").select(F.col("o_custkey").alias("wmo"), F.col("o_orderpriority").alias("grid_kind")))


@query("kinds_supporting", """WITH kinds AS (SELECT strftime(o_orderdate, '%Y-%m-%d') AS grid_kind, list(DISTINCT o_orderstatus) AS channels FROM orders GROUP BY ALL),
    needs AS (SELECT o_orderstatus AS pool_id, list(DISTINCT o_orderstatus) AS need FROM orders GROUP BY ALL)
    SELECT pool_id, grid_kind FROM needs JOIN kinds ON list_has_all(channels, need)""")
def kinds_supporting(spark, d):
    o = B.table(spark, d, "orders")
    kinds = o.groupBy(F.date_format("o_orderdate", "yyyy-MM-dd").alias("grid_kind")).agg(F.collect_set("o_orderstatus").alias("channels"))
    needs = o.groupBy(F.col("o_orderstatus").alias("pool_id")).agg(F.collect_set("o_orderstatus").alias("need"))
    return S.kinds_supporting(kinds, needs)


@query("grid_kind_earned", """WITH have AS (SELECT o_custkey AS wmo, list(DISTINCT o_orderstatus) AS c FROM orders GROUP BY ALL)
    SELECT wmo, arg_max(grid_kind, (n, grid_kind)) AS grid_kind FROM have JOIN (VALUES ('kind_f', ['F'], 1), ('kind_fo', ['F', 'O'], 2), ('kind_fp', ['F', 'P'], 2), ('kind_fop', ['F', 'O', 'P'], 3)) k(grid_kind, ch, n)
    ON list_has_all(c, ch) GROUP BY ALL""")
def grid_kind_earned(spark, d):
    raw = B.table(spark, d, "orders").select(F.col("o_custkey").alias("wmo"), F.col("o_orderstatus").alias("channel"), F.col("o_totalprice").alias("value"))
    kinds = spark.createDataFrame([("kind_f", ["F"]), ("kind_fo", ["F", "O"]), ("kind_fp", ["F", "P"]), ("kind_fop", ["F", "O", "P"])],
                                  "grid_kind string, channels array<string>")
    return G.grid_kind_earned(raw, kinds)


@query("build_manifest", """WITH b AS (SELECT l_suppkey AS wmo, min(l_returnflag) AS earned_kind, count(*) AS n_rows, count(DISTINCT year(l_shipdate)) AS n_cycles, count(*) FILTER (l_discount = 0) AS n_masked
    FROM lineitem GROUP BY ALL) SELECT s_suppkey AS wmo, CASE WHEN s_nationkey < 15 THEN 'A' ELSE 'N' END AS promised_kind, earned_kind, n_rows, n_cycles, n_masked,
    CASE WHEN s_acctbal < 0 THEN 'balance' END AS reason, CASE WHEN s_acctbal < 0 THEN 'excluded' WHEN earned_kind IS NULL THEN 'missing'
    WHEN earned_kind <> CASE WHEN s_nationkey < 15 THEN 'A' ELSE 'N' END THEN 'other kind' ELSE 'ok' END AS status FROM supplier LEFT JOIN b ON wmo = s_suppkey""")
def build_manifest(spark, d):
    s = B.table(spark, d, "supplier")
    fleet = s.select(F.col("s_suppkey").alias("wmo"), F.when(F.col("s_nationkey") < 15, "A").otherwise("N").alias("grid_kind"))
    gone = s.where(F.col("s_acctbal") < 0).select(F.col("s_suppkey").alias("wmo"), F.lit("balance").alias("reason"))
    return G.build_manifest(_files(spark, d), fleet, gone, "abs_sal")


@query("grid_health", """SELECT wmo, channel, count(*) AS levels, count(*) FILTER (v = 50) AS fills, count(*) FILTER (channel = 'aou' AND abs(v) > 104) AS over_ceiling,
    round(count(*) FILTER (v IS NOT NULL AND v <> 50 AND NOT (channel = 'aou' AND abs(v) > 104)) / count(*), 6) AS share_ok,
    count(*) FILTER (v = 50) = 0 AND count(*) FILTER (channel = 'aou' AND abs(v) > 104) = 0 AS healthy FROM (
    SELECT l_suppkey AS wmo, 'aou' AS channel, l_extendedprice / 997 AS v FROM lineitem UNION ALL SELECT l_suppkey, 'l_quantity', l_quantity FROM lineitem) GROUP BY ALL""")
def grid_health(spark, d):
    return G.grid_health(B.profiles(spark, d), ["aou", "l_quantity"], {"aou": 104.0, "l_quantity": None}, [50])


@query("compare_rebuild", """WITH a AS (SELECT l_suppkey AS wmo, l_returnflag AS resolution, count(*) AS n, bool_or(l_extendedprice > 104000) AS changed, bool_or(l_linenumber > 0) AS x FROM lineitem GROUP BY ALL)
    SELECT wmo, resolution, n AS rows_bound, n AS rows_rebuilt, CASE WHEN changed THEN 'DIFF' ELSE 'SAME' END AS status FROM a""")
def compare_rebuild(spark, d):
    t = B.profiles(spark, d).withColumnRenamed("l_returnflag", "resolution")
    moved = t.withColumn("aou", F.when(F.col("l_extendedprice") > 104000, F.col("aou") + 1).otherwise(F.col("aou")))
    return G.compare_rebuild(t, moved.repartition("l_orderkey", "l_linenumber"))      # other files, as many as it takes


@query("failure_capture", """SELECT l_returnflag AS grid_kind, l_suppkey AS wmo, 'read' AS stage, 'demo' AS pool_id, 'quantity ' || CAST(l_quantity AS INT) AS error, count(*) AS n FROM lineitem WHERE l_quantity >= 49 GROUP BY ALL""")
def failure_capture(spark, d):
    t = _files(spark, d).withColumn("error", F.when(F.col("l_quantity") >= 49, F.concat(F.lit("quantity "), F.col("l_quantity").cast("int").cast("string"))))
    return S.split_failures(t, "demo")[1].groupBy("pool_id", "wmo", "grid_kind", "stage", "error").agg(F.count(F.lit(1)).alias("n"))


@query("scan_raw", """SELECT l_suppkey AS wmo, count(*) AS n FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_nationkey = 3 AND s_acctbal > 1000) GROUP BY ALL""")
def scan_raw(spark, d):
    s = B.table(spark, d, "supplier").withColumnsRenamed({"s_suppkey": "wmo", "s_nationkey": "tier"})
    t = S.scan_raw(B.profiles(spark, d), s, tier=3, done=s.where(F.col("s_acctbal") <= 1000))
    return t.groupBy("wmo").agg(F.count(F.lit(1)).alias("n"))


@query("first_floats", """SELECT l_suppkey AS wmo, count(*) AS n FROM lineitem WHERE l_suppkey IN (SELECT DISTINCT l_suppkey FROM lineitem ORDER BY 1 LIMIT 7) GROUP BY ALL""")
def first_floats(spark, d):
    return X.first_floats(B.profiles(spark, d), 7).groupBy("wmo").agg(F.count(F.lit(1)).alias("n"))


@query("smoothed_grid_input", """SELECT l_suppkey AS wmo, l_orderkey, l_linenumber, l_partkey, round(quantile_cont(l_tax, 0.5) OVER (PARTITION BY l_suppkey ORDER BY p ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 6) AS smooth
    FROM (SELECT *, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS p FROM lineitem)""")
def smoothed_grid_input(spark, d):
    t = B.profiles(spark, d).withColumn("p", F.struct("l_orderkey", "l_linenumber", "l_partkey", "wmo", "l_extendedprice", "l_shipdate"))
    t = median_smooth(t, "l_tax", 3, "smooth", "p", ["wmo"])
    return t.select("wmo", "l_orderkey", "l_linenumber", "l_partkey", "smooth")


_H = 2


def _feature_sql() -> str:
    cols = []
    n = lambda i: f"m{-i}" if i < 0 else f"p{i}"
    for c in CH:
        at = lambda col, i: f"max(CASE WHEN i = {i} THEN {col} END)"
        cols += [f"round({at(f'{c}_scale_res_rob', i)} - {at(f'{c}_scale_res_rob', 0)}, 6) + 0 AS {c}_rel_{n(i)}" for i in range(-_H, _H + 1)]
        cols += [f"round({at(c, i)}, 6) AS {c}_prof_{n(i)}" for i in range(-_H, _H + 1)]
        cols += [f"round(min({c}_scale_res_rob), 6) + 0 AS {c}_min_res", f"round(max({c}_scale_res_rob), 6) + 0 AS {c}_max_res",
                 f"round({at(f'{c}_scale_res_rob', 0)}, 6) + 0 AS {c}_res_at_det", f"round(abs({at(f'{c}_scale_res_rob', 0)}), 6) AS {c}_res_abs_at_det"]
        cols += [f"round({at(f'f_{c}', i)}, 6) + 0 AS {c}_fine_dev_{n(i)}" for i in range(-_H, _H + 1)]
    return f"""SELECT pool_id, wmo, cycle_number, pres_adjusted, {', '.join(cols)} FROM (SELECT f.pool_id, f.wmo, f.cycle_number, f.pres_adjusted, i, c.* EXCLUDE (wmo, cycle_number, pres_adjusted, bin),
        e.aou_res AS f_aou, e.abs_sal_res AS f_abs_sal FROM (SELECT pool_id, wmo, cycle_number, pres_adjusted, unnest(range(-{_H}, {_H + 1})) AS i FROM flagged) f
        LEFT JOIN coarse c ON c.wmo = f.wmo AND c.cycle_number = f.cycle_number AND c.bin = floor(f.pres_adjusted / 40) + i
        LEFT JOIN fine e ON e.wmo = f.wmo AND e.cycle_number = f.cycle_number AND e.bin = floor(f.pres_adjusted / 10) + i) GROUP BY ALL"""


def window_table(spark, d):
    coarse = staged(_grid(spark, d), "coarse")
    c = event_key(G.detect(coarse, GATES))
    return X.window_features(c, coarse, _grid(spark, d, "fine"), CH, _H, 40, 10)


@query("window_features", sql("prof", _feature_sql(), _FLAGS + ", " + FINE))
def window_features(spark, d):
    return window_table(spark, d).drop(*EVENT_KEY)


@query("uncovered_floats", """SELECT s_suppkey AS wmo FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 45 AND l_discount > 0.09)""")
def uncovered_floats(spark, d):
    """The floats `require_covered` would name: candidates without features."""
    have = B.profiles(spark, d).where((F.col("l_quantity") > 45) & (F.col("l_discount") > 0.09)).select("wmo")
    return B.table(spark, d, "supplier").select(F.col("s_suppkey").alias("wmo")).join(have, "wmo", "left_anti")
