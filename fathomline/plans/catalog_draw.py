"""Registered queries: strata, allocation, the draw, and the sheets made from it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.keys import EVENT_KEY, candidate_id, event_type
from ..functions.staging import staged
from ..functions.stats import rel_half_width
from ..operators import allocation as A
from ..operators import draw as P
from . import bindings as B
from . import draw as plan
from .bindings import DOWN, UP, sql, u
from .registry import query

N_DRAW, SEED = 400, 11


@query("score_deciles", sql("strat", "SELECT pool_id, k_wmo, k_cycle, k_pres, decile FROM strat"))
def score_deciles(spark, d):
    return B.strat(spark, d).select("pool_id", *EVENT_KEY, "decile")


@query("pressure_bands", sql("li", """SELECT pool_id, CASE WHEN p > 1000 THEN NULL WHEN p <= 200 THEN '<=200' WHEN p <= 260 THEN '200-260' WHEN p <= 400 THEN '260-400'
    WHEN p <= 600 THEN '400-600' ELSE '600-1000' END AS band, count(*) AS n FROM (SELECT *, pres_adjusted * 1.5 AS p FROM li) GROUP BY ALL"""))
def pressure_bands(spark, d):
    t = A.pressure_bands(B.lines(spark, d).withColumn("pres_adjusted", F.col("pres_adjusted") * 1.5))
    return t.groupBy("pool_id", "band").agg(F.count(F.lit(1)).alias("n"))


# the best monotone fit at a point is the least, over later ends, of the greatest mean that starts at or before it
@query("isotonic_acceptance", sql("li", """SELECT x AS score, round(least(greatest(max(m), 0.005), 0.995), 6) AS p, any_value(n) AS n FROM (SELECT p.x, a.x AS a, min(m.m) AS m
    FROM pts p JOIN pts a ON a.x <= p.x JOIN means m ON m.a = a.x AND m.b >= p.x GROUP BY ALL) JOIN (SELECT l_quantity AS x, count(*) AS n FROM li GROUP BY ALL) USING (x) GROUP BY x""",
    """pts AS (SELECT x, sum(y) AS s, count(*) AS n FROM (SELECT l_quantity AS x, CASE WHEN decision = 1 OR l_tax > 0.05 THEN 1.0 ELSE 0.0 END AS y
    FROM li WHERE decision < 2) GROUP BY ALL), means AS (SELECT i.x AS a, j.x AS b, sum(k.s) / sum(k.n) AS m FROM pts i JOIN pts j ON j.x >= i.x
    JOIN pts k ON k.x BETWEEN i.x AND j.x GROUP BY ALL)"""))
def isotonic_acceptance(spark, d):
    t = B.lines(spark, d).withColumn("score", F.col("l_quantity"))
    y = F.when((F.col("decision") == 1) | (F.col("l_tax") > 0.05), 1.0).otherwise(0.0)
    pool = A.isotonic_acceptance(t.where(F.col("decision") < 2).select("score", y.alias("y")), t.select("score"))
    return pool.groupBy("score", "p").agg(F.count(F.lit(1)).alias("n"))


_TABLE = ("pool_id, design_stratum, frame_n, floats, round(score_min, 6) AS score_min, round(score_max, 6) AS score_max, round(p_raw, 6) AS p_raw, "
          "round(max_float_share, 6) AS max_float_share, round(w, 6) AS w")


@query("stratum_table", sql("strata0", f"SELECT {_TABLE} FROM strata0"))
def stratum_table(spark, d):
    return A.stratum_table(B.strat(spark, d).withColumn("p", F.col("score") * 0.5))


@query("planned_acceptance", sql("strata", f"SELECT {_TABLE}, round(rescale, 6) AS rescale, round(p_planned, 6) AS p_planned FROM strata"))
def planned_acceptance(spark, d):
    return B.strata(B.strat(spark, d))


@query("planned_acceptance_part", sql("strata strat", """SELECT pool_id, design_stratum, p.frame_n, round(least(greatest(p.p_raw * rescale, 0.005), 0.995), 6) AS p_planned
    FROM (SELECT pool_id, design_stratum, count(*) AS frame_n, avg(score * 0.5) AS p_raw FROM strat WHERE pres_adjusted <= 400 GROUP BY ALL) p
    JOIN (SELECT DISTINCT pool_id, rescale FROM strata) USING (pool_id)"""))
def planned_acceptance_part(spark, d):
    s = B.strat(spark, d)
    factor = staged(B.strata(s).select("pool_id", "rescale").distinct(), "factor")
    part = A.stratum_table(s.where(F.col("pres_adjusted") <= 400).withColumn("p", F.col("score") * 0.5))
    return A.planned_acceptance(part, 0.13, factor).select("pool_id", "design_stratum", "frame_n", "p_planned")


@query("base_rate", sql("frame", "SELECT pool_id, round(avg(decision), 6) AS p_plan, count(*) AS n_labels FROM frame WHERE decision < 2 GROUP BY ALL"))
def base_rate(spark, d):
    return A.base_rate(B.frame(spark, d).where(F.col("decision") < 2), "decision")


# the allocation by its definition: strata pinned to the floor one after another, at most ten of them
_NEYMAN = """s0 AS (SELECT pool_id, design_stratum, frame_n, floats, w, p_planned, w * sqrt(p_planned * (1 - p_planned)) AS s FROM strata),
    ks AS (SELECT a.*, (SELECT count(*) FROM s0 b WHERE b.pool_id = a.pool_id AND b.s < a.s) AS k,
    (SELECT sum(b.s) FROM s0 b WHERE b.pool_id = a.pool_id AND b.s >= a.s) AS tail FROM s0 a),
    k0 AS (SELECT pool_id, arg_min(k, k) AS k0, arg_min(tail, k) AS t0 FROM ks WHERE (1 - 0.05 * k) * s / tail >= 0.05 - 1e-12 GROUP BY ALL),
    shares AS (SELECT ks.*, CASE WHEN k < k0 THEN 0.05 ELSE (1 - 0.05 * k0) * s / t0 END AS share FROM ks JOIN k0 USING (pool_id))"""


def _given(n: str, source: str = "shares") -> str:
    return f"""(SELECT *, CASE WHEN row_number() OVER (PARTITION BY pool_id, n ORDER BY raw - base DESC, design_stratum) <= n - sum(base) OVER (PARTITION BY pool_id, n)
        THEN base + 1 ELSE base END::BIGINT AS draw_n FROM (SELECT *, share * n AS raw, floor(share * n) AS base FROM (SELECT *, {n} AS n FROM {source})))"""


@query("neyman_allocation", sql("strata", f"SELECT pool_id, design_stratum, draw_n FROM {_given(str(N_DRAW))}", _NEYMAN))
def neyman_allocation(spark, d):
    return A.neyman(staged(B.strata(B.strat(spark, d)), "table"), N_DRAW).select("pool_id", "design_stratum", "draw_n")


def _allocated(spark, d, n=N_DRAW):
    s = B.strat(spark, d)
    return s, staged(A.neyman(staged(B.strata(s), "table"), n), "allocated")


_ALLOC = _NEYMAN + f", alloc AS (SELECT * FROM {_given(str(N_DRAW))})"


@query("stratified_variance", sql("strata", """SELECT pool_id, round(1e6 * sum(w * w * p_planned * (1 - p_planned) * 1.1 / draw_n), 6) AS variance_ppm,
    round(1.96 * sqrt(sum(w * w * p_planned * (1 - p_planned) * 1.1 / draw_n)) / 0.13, 6) AS rel FROM alloc GROUP BY ALL""", _ALLOC))
def stratified_variance(spark, d):
    v = A.stratified_variance(_allocated(spark, d)[1], 1.1)
    return v.select("pool_id", (F.col("variance") * 1e6).alias("variance_ppm"), rel_half_width("variance", F.lit(0.13)).alias("rel"))


@query("solve_n", sql("strata", f"""SELECT pool_id, n, design_stratum, draw_n FROM tries QUALIFY n = min(CASE WHEN v <= target THEN n END) OVER (PARTITION BY pool_id)""",
    _NEYMAN + f""", tries AS (SELECT *, pow(0.15 * 0.13 / 1.96, 2) AS target, sum(CASE WHEN draw_n > 0 THEN w * w * p_planned * (1 - p_planned) / draw_n
    ELSE 'Infinity'::DOUBLE END) OVER (PARTITION BY pool_id, n) AS v FROM {_given('n', '(SELECT * FROM shares, range(1, 3000) t(n))')})"""))
def solve_n(spark, d):
    t = A.solve_n(staged(B.strata(B.strat(spark, d)), "table"), (0.15 * 0.13 / 1.96) ** 2)
    return t.select("pool_id", F.col("n").cast("bigint").alias("n"), "design_stratum", "draw_n")


@query("compare_designs", sql("strata", """SELECT pool_id, n, round(1e6 * v, 6) AS variance_ppm, round(v / vp, 6) AS vs_proportional, round(v / (p * (1 - p) / n), 6) AS vs_srs FROM (
    SELECT pool_id, sum(draw_n)::BIGINT AS n, sum(w * w * p_planned * (1 - p_planned) / draw_n) AS v, sum(w * p_planned) AS p,
    sum(w * w * p_planned * (1 - p_planned) / greatest(1, round_even(w * n, 0))) AS vp FROM alloc GROUP BY ALL)""", _ALLOC))
def compare_designs(spark, d):
    t = A.compare_designs(_allocated(spark, d)[1])
    return t.select("pool_id", "n", (F.col("variance") * 1e6).alias("variance_ppm"), "vs_proportional", "vs_srs")


def _many_floats(s):
    """Parts stand for floats: of a hundred suppliers each would be read so often that no size meets the target."""
    return s.withColumn("wmo", F.col("l_partkey"))


@query("design_effect_rounds")
def design_effect_rounds(spark, d):
    s = _many_floats(B.strat(spark, d))
    t = staged(B.strata(s).withColumn("p_plan", F.lit(0.13)), "table")
    return plan.solve_with_design_effect(s, t, 0.15, SEED)[2]


@query("frame_sizes", sql("sizes", "SELECT pool_id, design_stratum, frame_n FROM sizes"))
def frame_sizes(spark, d):
    limbs = (B.sizes(B.strat(spark, d)).groupBy("pool_id").agg(F.collect_list(F.struct("design_stratum", "frame_n")).alias("strata"))
             .withColumn("role", F.lit("analysis")))
    return A.frame_sizes(limbs.unionByName(limbs.withColumn("role", F.lit("rejudgement"))))


_CELLS = """w AS (SELECT pool_id, design_stratum, frame_n / sum(frame_n) OVER (PARTITION BY pool_id) AS w FROM sizes),
    weights AS (SELECT batch_id, cell, sum(w * c / n_h) AS share, sum(c)::BIGINT AS available FROM (SELECT *, sum(c) OVER (PARTITION BY batch_id, pool_id, design_stratum) AS n_h
    FROM (SELECT batch_id, pool_id, design_stratum, decision || '|' || half AS cell, count(*) AS c FROM rows GROUP BY ALL)) JOIN w USING (pool_id, design_stratum) GROUP BY ALL),
    prior AS (SELECT batch_id, cell, (accepted + 0.5) / (n + 1.0) AS q, n AS seen FROM cells WHERE batch_id < 'b1998'),
    planned AS (SELECT batch_id, cell, share, available, coalesce(q, 0.5) AS q, seen FROM weights LEFT JOIN prior USING (batch_id, cell))"""


def _planned(spark, d):
    s = B.strat(spark, d)
    n = staged(B.sizes(s), "sizes")
    rows = B.sample(s, n).withColumn("cell", F.concat_ws("|", F.col("decision").cast("string"), "half"))
    weights = A.cell_weights(rows, n)
    prior = B.cells(rows).where(F.col("batch_id") < "b1998")
    return staged(A.prior_cell_rates(weights, prior), "planned"), staged(prior, "prior"), rows


@query("cell_weights", sql("rows cells", "SELECT batch_id, cell, round(share, 6) AS share, available FROM weights", _CELLS))
def cell_weights(spark, d):
    return _planned(spark, d)[0].drop("q")


@query("prior_cell_rates", sql("rows cells", "SELECT batch_id, cell, round(q, 6) AS q FROM planned", _CELLS))
def prior_cell_rates(spark, d):
    return _planned(spark, d)[0].select("batch_id", "cell", "q")


# floors first: with 100 rows over four wide cells only the floor of 15 can bind, so pinning goes in order of weight
_REJ = _CELLS + """, r0 AS (SELECT *, share * sqrt(q * (1 - q)) AS s FROM planned),
    r1 AS (SELECT *, 100 * s / sum(s) OVER (PARTITION BY batch_id) AS x1 FROM r0),
    r2 AS (SELECT *, CASE WHEN x1 < 15 THEN 15 ELSE (100 - 15 * count(*) FILTER (x1 < 15) OVER (PARTITION BY batch_id)) * s / sum(s) FILTER (x1 >= 15) OVER (PARTITION BY batch_id) END AS x2 FROM r1),
    r3 AS (SELECT *, CASE WHEN x2 <= 15 THEN 15 ELSE (100 - 15 * count(*) FILTER (x2 <= 15) OVER (PARTITION BY batch_id)) * s / sum(s) FILTER (x2 > 15) OVER (PARTITION BY batch_id) END AS x3 FROM r2),
    r4 AS (SELECT *, CASE WHEN x3 <= 15 THEN 15 ELSE (100 - 15 * count(*) FILTER (x3 <= 15) OVER (PARTITION BY batch_id)) * s / sum(s) FILTER (x3 > 15) OVER (PARTITION BY batch_id) END AS x FROM r3),
    rej AS (SELECT *, (floor(x) + CASE WHEN row_number() OVER (PARTITION BY batch_id ORDER BY x - floor(x) DESC, cell) <= 100 - sum(floor(x)) OVER (PARTITION BY batch_id)
    THEN 1 ELSE 0 END)::BIGINT AS draw_n FROM r4)"""


@query("rejudge_allocation", sql("rows cells", "SELECT batch_id, cell, draw_n FROM rej", _REJ))
def rejudge_allocation(spark, d):
    return A.rejudge_allocation(_planned(spark, d)[0], 100).select("batch_id", "cell", "draw_n")


@query("correction_se", sql("rows cells", "SELECT batch_id, round(sqrt(sum(share * share * q * (1 - q) / draw_n)), 6) AS se FROM rej GROUP BY ALL", _REJ))
def correction_se(spark, d):
    return A.correction_se(A.rejudge_allocation(_planned(spark, d)[0], 100))


@query("compare_shapes", sql("rows cells", """SELECT batch_id, round(sqrt(sum(share * share * q * (1 - q) / draw_n)), 6) AS se_shape,
    round(sqrt(sum(share * share * q * (1 - q) / un)), 6) AS se_uniform, round(sqrt(sum(share * share * q * (1 - q) / (draw_n + seen))), 6) AS se_pooled FROM (
    SELECT *, 50 * available / sum(available) OVER (PARTITION BY batch_id, split_part(cell, '|', 2)) AS un FROM rej) GROUP BY ALL""", _REJ))
def compare_shapes(spark, d):
    planned, prior, _ = _planned(spark, d)
    return A.compare_shapes(A.rejudge_allocation(planned, 100), 100, prior)


_CLUSTERS = f"""placed AS (SELECT s.pool_id, s.design_stratum, wmo, cycle_number, pres_adjusted, k_wmo, k_cycle, k_pres, score, l_tax, decision, time, a.frame_n, draw_n,
    greatest(1, a.frame_n // draw_n) AS m, row_number() OVER (PARTITION BY pool_id, design_stratum, wmo ORDER BY cycle_number, pres_adjusted) - 1 AS r
    FROM strat s JOIN alloc a USING (pool_id, design_stratum)),
    sized AS (SELECT pool_id, design_stratum, wmo, r // m AS chunk, count(*) AS size, any_value(frame_n) AS frame_n, any_value(draw_n) AS draw_n FROM placed GROUP BY ALL),
    run AS (SELECT *, sum(size) OVER (PARTITION BY pool_id, design_stratum ORDER BY h, wmo, chunk) AS s FROM (
    SELECT *, {u(SEED, 'cluster', 'pool_id', 'design_stratum', 'wmo', 'chunk')} AS h, {u(SEED, 'start', 'pool_id', 'design_stratum')} AS st FROM sized)),
    hits AS (SELECT *, CAST(floor({u(SEED, 'place', 'pool_id', 'design_stratum', 'wmo', 'chunk')} * size) AS BIGINT) AS place FROM run
    WHERE ceil(draw_n * s / frame_n - st) > ceil(draw_n * (s - size) / frame_n - st)),
    drawn AS (SELECT p.*, h.draw_n / h.frame_n AS inclusion_probability FROM placed p JOIN hits h ON p.pool_id = h.pool_id AND p.design_stratum = h.design_stratum
    AND p.wmo = h.wmo AND p.r = h.chunk * p.m + h.place)"""


@query("clusters", sql("strata strat", "SELECT pool_id, design_stratum, wmo || '#' || (r // m) AS cluster, count(*) AS n FROM placed GROUP BY ALL", _ALLOC + ", " + _CLUSTERS))
def clusters(spark, d):
    s, a = _allocated(spark, d)
    t = P.clusters(s.select("pool_id", "design_stratum", "wmo", "cycle_number", "pres_adjusted"), a)
    return t.groupBy("pool_id", "design_stratum", "cluster").agg(F.count(F.lit(1)).alias("n"))


@query("chunked_floats", sql("strata strat", """SELECT pool_id, design_stratum, count(*) FILTER (c > m) AS floats_chunked FROM (SELECT pool_id, design_stratum, wmo, count(*) AS c, any_value(m) AS m
    FROM placed GROUP BY ALL) GROUP BY ALL""", _ALLOC + ", " + _CLUSTERS))
def chunked_floats(spark, d):
    return P.chunked_floats(*_allocated(spark, d))


@query("draw_one_per_cluster", sql("strata strat", "SELECT pool_id, design_stratum, k_wmo, k_cycle, k_pres, round(inclusion_probability, 6) AS inclusion_probability FROM drawn",
                                   _ALLOC + ", " + _CLUSTERS))
def draw_one_per_cluster(spark, d):
    s, a = _allocated(spark, d)
    return P.draw_one_per_cluster(s, a, SEED).select("pool_id", "design_stratum", *EVENT_KEY, "inclusion_probability")


def _drawn(spark, d):
    s, a = _allocated(spark, d)
    t = P.draw_one_per_cluster(s, a, SEED)
    t = t.withColumn("batch_id", F.element_at(F.split("pool_id", "/"), -1)).withColumn("previously_judged", F.col("decision") == 1)
    return s, staged(t.withColumn("candidate_id", candidate_id()), "drawn")


@query("draw_diagnostics", sql("strata strat", """SELECT split_part(pool_id, '/', 3) AS batch_id, sum(c)::BIGINT AS n_science, count(*) AS floats, count(*) FILTER (c > 1) AS floats_above_one,
    max(c) AS max_one_float, round(sum(c) / count(*), 6) AS panels_per_float, sum(j)::BIGINT AS previously_judged FROM (SELECT pool_id, wmo, count(*) AS c,
    count(*) FILTER (decision = 1) AS j FROM drawn GROUP BY ALL) GROUP BY ALL""", _ALLOC + ", " + _CLUSTERS))
def draw_diagnostics(spark, d):
    return P.draw_diagnostics(_drawn(spark, d)[1])


def _controls_sql(source: str, tag: str, n: int, out: str) -> str:
    row = u(SEED, f"{tag}-row", "pool_id", "k_wmo", "k_cycle", "k_pres")
    flt = u(SEED, f"{tag}-float", "pool_id", "wmo")
    return f"""{out} AS (SELECT * EXCLUDE (rn, hf) FROM (SELECT *, {flt} AS hf FROM (SELECT *, row_number() OVER (PARTITION BY pool_id, wmo ORDER BY {row}, k_wmo, k_cycle, k_pres) AS rn
        FROM {source}) WHERE rn = 1) QUALIFY row_number() OVER (PARTITION BY pool_id ORDER BY hf, pool_id, wmo) <= {n})"""


@query("draw_controls", sql("frame", "SELECT pool_id, k_wmo, k_cycle, k_pres FROM c", _controls_sql("(SELECT * FROM frame WHERE decision = 1)", "control", 20, "c")))
def draw_controls(spark, d):
    return P.draw_controls(B.frame(spark, d).where(F.col("decision") == 1), 20, SEED).select("pool_id", *EVENT_KEY)


_BLIND = ", ".join([_ALLOC, _CLUSTERS,
                    _controls_sql("(SELECT * FROM strat WHERE decision = 1 AND l_tax = 0.08 AND (pool_id, k_wmo, k_cycle, k_pres) NOT IN (SELECT (pool_id, k_wmo, k_cycle, k_pres) FROM drawn))", "pos", 20, "pos"),
                    _controls_sql("(SELECT * FROM strat WHERE decision = 0 AND score < 0.5 AND (pool_id, k_wmo, k_cycle, k_pres) NOT IN (SELECT (pool_id, k_wmo, k_cycle, k_pres) FROM drawn UNION ALL SELECT (pool_id, k_wmo, k_cycle, k_pres) FROM pos))", "neg", 20, "neg")])


def _control_sources(s):
    s = s.withColumn("candidate_id", candidate_id())
    return (s.where((F.col("decision") == 1) & (F.col("l_tax") == 0.08)),
            s.where((F.col("decision") == 0) & (F.col("score") < P.NEG_SCORE_CAP)))


@query("blind_controls", sql("strata strat", "SELECT pool_id, k_wmo, k_cycle, k_pres, 'pos_ctrl' AS control_arm FROM pos UNION ALL SELECT pool_id, k_wmo, k_cycle, k_pres, 'neg_ctrl' FROM neg", _BLIND))
def blind_controls(spark, d):
    s, science = _drawn(spark, d)
    return P.blind_controls(*_control_sources(s), science, 20, SEED).select("pool_id", *EVENT_KEY, "control_arm")


@query("draw_per_cell", sql("sheets", f"""SELECT batch_id, label, sample_id, round(least(5, n) / n, 6) AS inclusion_probability FROM (SELECT batch_id, label, sample_id,
    count(*) OVER (PARTITION BY batch_id, label) AS n, row_number() OVER (PARTITION BY batch_id, label ORDER BY {u(SEED, 'cell', 'batch_id', 'label', 'sample_id')}, sample_id) AS r
    FROM sheets WHERE label IN (0, 1)) WHERE r <= 5"""))
def draw_per_cell(spark, d):
    t = B.sheets(spark, d).where(F.col("label").isin(0, 1))
    sizes = t.groupBy("batch_id", "label").agg(F.least(F.count(F.lit(1)), F.lit(5)).alias("draw_n"))
    return P.draw_per_cell(t, sizes, SEED, ("batch_id", "label")).select("batch_id", "label", "sample_id", "inclusion_probability")


@query("exclude_keys", sql("strata strat", """SELECT pool_id, count(*) AS n FROM strat WHERE (k_wmo, k_cycle, k_pres) NOT IN (SELECT (k_wmo, k_cycle, k_pres) FROM drawn) GROUP BY ALL""",
                           _ALLOC + ", " + _CLUSTERS))
def exclude_keys(spark, d):
    s, science = _drawn(spark, d)
    return P.exclude_keys(s, science).groupBy("pool_id").agg(F.count(F.lit(1)).alias("n"))


# 12, 12 and 18 rows a pool
_TIERS = (("clear_TP", "decile = 9 AND decision = 1", 12), ("clear_FP", "decile <= 2 AND decision = 0", 6), ("clear_FP", "decile = 0 AND decision = 2", 6),
          ("borderline", "decile BETWEEN 5 AND 8 AND decision = 1", 9), ("borderline", "decile BETWEEN 5 AND 8 AND decision = 0", 5),
          ("borderline", "decile BETWEEN 5 AND 8 AND decision = 2", 4))


def _tier_sql() -> str:
    parts, used = [], []
    for i, (_, cond, n) in enumerate(_TIERS):
        gone = " AND ".join(f"(pool_id, wmo) NOT IN (SELECT (pool_id, wmo) FROM t{j})" for j in used) or "true"
        parts.append(_controls_sql(f"(SELECT * FROM strat WHERE {cond} AND {gone})", f"tier{i}", n, f"t{i}"))
        used.append(i)
    return ", ".join(parts)


@query("calibration_draw", sql("strat", " UNION ALL ".join(f"SELECT pool_id, k_wmo, k_cycle, k_pres, '{t[0]}' AS tier FROM t{i}" for i, t in enumerate(_TIERS)), _tier_sql()))
def calibration_draw(spark, d):
    t = P.calibration_draw(B.strat(spark, d), [(name, F.expr(cond), n) for name, cond, n in _TIERS], SEED)
    return t.select("pool_id", *EVENT_KEY, "tier")


@query("control_slots", sql("sheets", f"""SELECT sheet_id, i, least(CAST(floor((i + {u(SEED, 'slots', 'sheet_id')}) * n / k) AS BIGINT), n - 1) AS slot FROM (
    SELECT *, unnest(range(k)) AS i FROM (SELECT sheet_id, count(*) AS n, count(*) FILTER (control_arm <> 'target') AS k FROM sheets GROUP BY ALL))"""))
def control_slots(spark, d):
    t = B.sheets(spark, d).groupBy("sheet_id").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("control_arm") != P.TARGET).alias("n_controls"))
    return P.control_slots(t, SEED, ("sheet_id",))


def _order_sql(source: str, by: str, arm: str, key: str) -> str:
    h = u(SEED, "order", by, *key.split(", "))
    lad = u(SEED, "ladder", by, "a")
    ph = u(SEED, "slots", by)
    return f"""o1 AS (SELECT *, {arm} IN ('pos_ctrl', 'neg_ctrl') AS c, CASE WHEN {arm} IN ('pos_ctrl', 'neg_ctrl') THEN {arm} ELSE '' END AS a, {h} AS h, {ph} AS ph FROM {source}),
    o2 AS (SELECT *, count(*) OVER (PARTITION BY {by}) AS n, count(*) FILTER (c) OVER (PARTITION BY {by}) AS k,
    (row_number() OVER (PARTITION BY {by}, a ORDER BY h, {key}) - 1 + {lad}) / count(*) OVER (PARTITION BY {by}, a) AS ladder FROM o1),
    o3 AS (SELECT *, row_number() OVER (PARTITION BY {by}, c ORDER BY ladder, a, h, {key}) - 1 AS r FROM o2),
    ctrl AS (SELECT *, least(CAST(floor((r + ph) * n / k) AS BIGINT), n - 1) AS pos FROM o3 WHERE c),
    free AS (SELECT {by}, pos, row_number() OVER (PARTITION BY {by} ORDER BY pos) - 1 AS r FROM (SELECT {by}, unnest(range(any_value(n))) AS pos FROM o3 GROUP BY {by})
    WHERE ({by}, pos) NOT IN (SELECT ({by}, pos) FROM ctrl)),
    placed_rows AS (SELECT * FROM ctrl UNION ALL BY NAME SELECT o3.*, free.pos FROM o3 JOIN free ON free.{by} = o3.{by} AND free.r = o3.r WHERE NOT o3.c)"""


_BATCH = ", ".join([_BLIND, """rows_in AS (SELECT split_part(pool_id, '/', 3) AS batch_id, pool_id, k_wmo, k_cycle, k_pres, 'target' AS control_arm FROM drawn UNION ALL
    SELECT split_part(pool_id, '/', 3), pool_id, k_wmo, k_cycle, k_pres, 'pos_ctrl' FROM pos UNION ALL
    SELECT split_part(pool_id, '/', 3), pool_id, k_wmo, k_cycle, k_pres, 'neg_ctrl' FROM neg)""", _order_sql("rows_in", "batch_id", "control_arm", "k_wmo, k_cycle, k_pres")])


def _assembled(spark, d):
    s, science = _drawn(spark, d)
    ctrl = P.blind_controls(*_control_sources(s), science, 20, SEED).withColumn("batch_id", F.element_at(F.split("pool_id", "/"), -1))
    add = lambda t: t.withColumn("event_type", event_type("pool_id"))
    return P.assemble(add(science), add(ctrl), SEED)


@query("assemble_key", sql("strata strat", "SELECT batch_id, pos AS sample_id, k_wmo, k_cycle, k_pres, control_arm FROM placed_rows", _BATCH))
def assemble_key(spark, d):
    return _assembled(spark, d)[1].select("batch_id", "sample_id", *EVENT_KEY, "control_arm")


@query("assemble_worksheet", sql("strata strat", """SELECT NULL::DOUBLE AS label, pos AS sample_id, k_wmo AS wmo, k_cycle AS cycle_number, CAST(k_pres AS DOUBLE) AS pres,
    split_part(pool_id, '/', 2) || '_' || split_part(pool_id, '/', 3) AS event_type FROM placed_rows""", _BATCH))
def assemble_worksheet(spark, d):
    t = _assembled(spark, d)[0]
    return t.select("label", "sample_id", "wmo", "cycle_number", F.bround("pres_adjusted", 0).alias("pres"), "event_type")


@query("interleave", sql("sheets", "SELECT sheet_id, event_id, pos AS new_id FROM placed_rows", _order_sql("(SELECT sheet_id, event_id, control_arm FROM sheets)", "sheet_id", "control_arm", "event_id")))
def interleave(spark, d):
    t = B.sheets(spark, d).select("sheet_id", "event_id", "control_arm")
    return P.interleave(t, SEED, ("sheet_id",), key=("event_id",)).select("sheet_id", "event_id", F.col("sample_id").alias("new_id"))


@query("split_sessions", sql("sheets", "SELECT batch_id, sheet_id, count(*) AS n, min(sample_id) AS first_id, max(sample_id) AS last_id FROM sheets GROUP BY ALL"))
def split_sessions(spark, d):
    t = P.split_sessions(B.sheets(spark, d).drop("session", "sheet_id"))
    t = t.withColumn("sheet_id", F.concat_ws("_s", "batch_id", F.col("session").cast("string")))
    return t.groupBy("batch_id", "sheet_id").agg(F.count(F.lit(1)).alias("n"), F.min("sample_id").alias("first_id"), F.max("sample_id").alias("last_id"))


@query("repass", sql("strat", f"""SELECT pool_id, k_wmo, k_cycle, k_pres, row_number() OVER (ORDER BY {u('copy_2', 'repass', 'k_wmo', 'k_cycle', 'k_pres')}, k_wmo, k_cycle, k_pres) - 1 AS sample_id
    FROM (SELECT * FROM t0 UNION ALL SELECT * FROM t1 UNION ALL SELECT * FROM t2 UNION ALL SELECT * FROM t3 UNION ALL SELECT * FROM t4 UNION ALL SELECT * FROM t5)""", _tier_sql()))
def repass(spark, d):
    t = P.calibration_draw(B.strat(spark, d), [(name, F.expr(cond), n) for name, cond, n in _TIERS], SEED)
    t = t.withColumns({"event_type": event_type("pool_id"), "latitude": F.lit(None).cast("double"), "longitude": F.lit(None).cast("double")})
    return P.repass(t, "copy_2")[1].select("pool_id", *EVENT_KEY, "sample_id")


def _arm(spark, d, which, **kw):
    s = kw.pop("floats", lambda t: t)(B.strat(spark, d)).withColumn("previously_judged", F.col("decision") == 1).withColumn("candidate_id", candidate_id())
    s = s.withColumn("event_type", event_type("pool_id"))
    t = staged(B.strata(s).withColumn("p_plan", F.lit(0.13)), "table")
    pos, neg = _control_sources(s)
    return which(s, t, kw.pop("size"), SEED, pos, neg, F.element_at(F.split("pool_id", "/"), -1))


@query("rate_arm")
def rate_arm(spark, d):
    sheet, _, record = _arm(spark, d, plan.rate_arm, size=0.15, floats=_many_floats)
    return record.select("batch_id", "pool_id", "role", "n_science", F.size("strata").alias("n_strata"))


@query("held_arm", sql("strata strat", "SELECT batch_id, pos AS sample_id, k_wmo, k_cycle, k_pres, control_arm FROM placed_rows", _BATCH))
def held_arm(spark, d):
    return _arm(spark, d, plan.held_arm, size=N_DRAW)[1].select("batch_id", "sample_id", *EVENT_KEY, "control_arm")


_LIMB = """w AS (SELECT pool_id, design_stratum, frame_n / sum(frame_n) OVER (PARTITION BY pool_id) AS w FROM sizes),
    planned AS (SELECT batch_id, cell, sum(w * c / n_h) AS share, 0.5 AS q, sum(c)::BIGINT AS available FROM (SELECT *, sum(c) OVER (PARTITION BY pool_id, design_stratum) AS n_h
    FROM (SELECT split_part(pool_id, '/', 3) AS batch_id, pool_id, design_stratum, decision || '|' || half AS cell, count(*) AS c FROM rows GROUP BY ALL))
    JOIN w USING (pool_id, design_stratum) GROUP BY ALL)""" + _REJ[len(_CELLS):]


@query("rejudge_arm", sql("rows", """SELECT batch_id, 'target' AS control_arm, left(cell, 1)::INT AS original_label, split_part(cell, '|', 2) AS original_half, draw_n AS n FROM rej
    UNION ALL SELECT DISTINCT batch_id, arm, NULL::INT, NULL, 10::BIGINT FROM rej, (VALUES ('pos_ctrl'), ('neg_ctrl')) a(arm)""", _LIMB))
def rejudge_arm(spark, d):
    """A second look at every limb's decided rows, by first verdict and half."""
    s = B.strat(spark, d).withColumn("candidate_id", candidate_id())
    n = staged(B.sizes(s), "sizes")
    rows = B.sample(s, n).withColumn("batch_id", F.element_at(F.split("pool_id", "/"), -1))
    # what follows from the key is not written with it
    rows = staged(rows.select("batch_id", F.concat_ws("|", F.col("decision").cast("string"), "half").alias("cell"), "pool_id", *EVENT_KEY, "wmo", "cycle_number", "pres_adjusted",
                              "design_stratum", "time", F.col("decision").alias("original_label"), F.col("half").alias("original_half"), "score"), "rows")
    sizes = A.rejudge_allocation(A.prior_cell_rates(A.cell_weights(rows, n)), 100)
    pool = s.select("pool_id", *EVENT_KEY).withColumn("event_type", event_type("pool_id"))
    pos, neg = [t.withColumn("event_type", event_type("pool_id")) for t in _control_sources(s)]
    science = rows.withColumns({"original_sample_id": F.concat_ws("|", *EVENT_KEY), "candidate_id": candidate_id()})
    _, key = plan.rejudge_arm(science, pool, staged(sizes, "cells"), ("batch_id", "cell"), SEED, pos, neg, F.element_at(F.split("pool_id", "/"), -1))
    return key.groupBy("batch_id", "control_arm", "original_label", "original_half").agg(F.count(F.lit(1)).alias("n"))
