"""Registered queries: reading sittings, controls, second looks and calibration copies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.staging import staged
from ..operators import session as Q
from ..operators.estimate import pace as pace_of
from ..operators.labels import calibration_asof
from . import bindings as B
from .bindings import sql, u
from .registry import query

SID = "sheet_id"


@query("session_counts", sql("sheets", """SELECT sheet_id, count(*) AS n_rows, count(*) FILTER (label IN (0, 1)) AS decided, count(*) FILTER (label = 1) AS accepted,
    count(*) FILTER (label = 0) AS rejected, count(*) FILTER (label = 2) AS uncertain, count(*) FILTER (label IS NULL) AS blank FROM sheets GROUP BY ALL"""))
def session_counts(spark, d):
    return Q.session_counts(B.sheets(spark, d))


@query("position_bins", sql("sheets", """SELECT sheet_id, bin, min(sample_id) AS from_id, max(sample_id) AS to_id, count(*) AS n, round(avg(label), 6) AS accept FROM (
    SELECT *, ntile(4) OVER (PARTITION BY sheet_id ORDER BY sample_id) AS bin FROM sheets WHERE label IN (0, 1)) GROUP BY ALL"""))
def position_bins(spark, d):
    return Q.position_bins(B.sheets(spark, d))


_SCI = "(SELECT * FROM sheets WHERE label IN (0, 1) AND control_arm = 'target')"


@query("quarters", sql("sheets", f"""SELECT sheet_id, quarter, count(*) AS n, round(avg(label), 6) AS accept FROM (SELECT *, greatest(1, CAST(ceil((r - 1) * 4 / greatest(n - 1, 1)) AS BIGINT)) AS quarter
    FROM (SELECT *, row_number() OVER (PARTITION BY sheet_id ORDER BY sample_id) AS r, count(*) OVER (PARTITION BY sheet_id) AS n FROM {_SCI})) GROUP BY ALL"""))
def quarters(spark, d):
    return Q.quarters(B.sheets(spark, d))


# erfc by its power series: enough terms for six places up to where it is nothing
_ERFC = """CASE WHEN {x} > 4.6 THEN 0 WHEN {x} <= 0 THEN 1 ELSE 1 - 2 / sqrt(pi()) * list_sum([CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END *
    exp((2 * k + 1) * ln({x}) - lgamma(k + 1)) / (2 * k + 1) for k in range(0, 140)]) END"""
_MW = """mw AS (SELECT *, CASE WHEN n_accepted >= 1 AND n_rejected >= 1 THEN rk - n_accepted * (n_accepted + 1) / 2 END AS u FROM (
    SELECT sheet_id, count(*) FILTER (label = 1) AS n_accepted, count(*) FILTER (label = 0) AS n_rejected, sum(CASE WHEN label = 1 THEN r ELSE 0 END) AS rk FROM (
    SELECT *, row_number() OVER (PARTITION BY sheet_id ORDER BY sample_id) AS r FROM sheets WHERE label IN (0, 1)) GROUP BY ALL))"""


@query("mann_whitney", sql("sheets", """SELECT sheet_id, n_accepted, n_rejected, round(u, 6) AS u FROM mw""", _MW))
def mann_whitney(spark, d):
    return Q.mann_whitney(B.sheets(spark, d)).drop("p")


@query("mann_whitney_p", sql("sheets", f"SELECT sheet_id, round(least(1, {_ERFC.format(x='x')}), 6) AS p FROM (SELECT *, (greatest(u, n_accepted * n_rejected - u) - n_accepted * n_rejected / 2 - 0.5) / sqrt(n_accepted * n_rejected * (n_accepted + n_rejected + 1) / 12) / sqrt(2) AS x FROM mw WHERE n_accepted > 8 AND n_rejected > 8)", _MW))
def mann_whitney_p(spark, d):
    """The normal limit; sheets with at most eight rows of a kind take the exact distribution and are tested apart."""
    t = Q.mann_whitney(B.sheets(spark, d))
    return t.where((F.col("n_accepted") > 8) & (F.col("n_rejected") > 8)).select(SID, "p")


@query("mann_whitney_exact")
def mann_whitney_exact(spark, d):
    t = Q.mann_whitney(B.sheets(spark, d), min_each=3)
    return t.where((F.col("n_accepted") <= 8) | (F.col("n_rejected") <= 8))


def fisher_sql(a: str, b: str, c: str, d: str) -> str:
    """Fisher's two-sided p: every table of the same margins that is no likelier than this one."""
    ln = (f"lgamma({a}+{b}+1.0) + lgamma({c}+{d}+1.0) + lgamma({a}+{c}+1.0) + lgamma({b}+{d}+1.0) - lgamma({a}+{b}+{c}+{d}+1.0)"
          "- lgamma({k}+1.0) - lgamma({r}-{k}+1.0) - lgamma({s}-{k}+1.0) - lgamma({t}+{k}+1.0)")
    f = lambda k: ln.format(k=k, r=f"({a}+{b})", s=f"({a}+{c})", t=f"({d}-{a})")
    return (f"least(1, list_sum([CASE WHEN {f('k')} <= {f(a)} + 1e-7 THEN exp({f('k')}) ELSE 0 END for k in "
            f"range(CAST(greatest(0, {a}-{d}) AS BIGINT), CAST(least({a}+{b}, {a}+{c}) + 1 AS BIGINT))]))")


@query("change_point", sql("sheets", f"""SELECT sheet_id, splits, sample_id, round(a / n, 6) AS accept_before, round((aa - a) / (nn - n), 6) AS accept_after, round(p, 6) AS p_raw,
    round(least(1, p * splits), 6) AS p_adjusted FROM (SELECT *, count(*) OVER (PARTITION BY sheet_id) AS splits FROM (SELECT *, {fisher_sql('a', '(n-a)', '(aa-a)', '(nn-n-aa+a)')} AS p FROM (
    SELECT sheet_id, sample_id, row_number() OVER w AS n, sum(label) OVER w AS a, count(*) OVER (PARTITION BY sheet_id) AS nn, sum(label) OVER (PARTITION BY sheet_id) AS aa
    FROM sheets WHERE label IN (0, 1) WINDOW w AS (PARTITION BY sheet_id ORDER BY sample_id)) WHERE n >= 8 AND nn - n >= 8))
    QUALIFY row_number() OVER (PARTITION BY sheet_id ORDER BY round(p, 12), sample_id) = 1"""))
def change_point(spark, d):
    return Q.change_point(B.sheets(spark, d))


_HALF = """half AS (SELECT *, CASE WHEN cut_at IS NOT NULL THEN CASE WHEN sample_id <= cut_at THEN 'first' ELSE 'second' END END AS half FROM (
    SELECT *, quantile_cont(CASE WHEN label IN (0, 1) AND control_arm = 'target' THEN sample_id END, 0.5) OVER (PARTITION BY sheet_id) AS cut_at FROM sheets))"""


@query("halves", sql("sheets", "SELECT sheet_id, sample_id, round(cut_at, 6) AS cut_at, half FROM half", _HALF))
def halves(spark, d):
    return Q.with_half(B.sheets(spark, d)).select(SID, "sample_id", "cut_at", "half")


@query("control_arms", sql("sheets", """SELECT sheet_id, control_arm, count(*) AS n, count(*) FILTER (label = 1) AS accepted FROM sheets
    WHERE label IN (0, 1) AND control_arm <> 'target' GROUP BY ALL"""))
def control_arms(spark, d):
    return Q.control_arms(B.sheets(spark, d)).drop("lo", "hi")


@query("control_intervals")
def control_intervals(spark, d):
    t = Q.control_arms(B.sheets(spark, d), by=("design_stratum",))
    return t.select("design_stratum", "control_arm", "lo", "hi")


@query("control_arms_vs_history", sql("sheets", f"""SELECT sheet_id, control_arm, n, accepted, round({fisher_sql('accepted', '(n-accepted)', 'rk', '(m-rk)')}, 6) AS fisher_p FROM (
    SELECT sheet_id, control_arm, count(*) AS n, count(*) FILTER (label = 1) AS accepted FROM sheets WHERE label IN (0, 1) AND control_arm <> 'target' GROUP BY ALL)
    JOIN (SELECT control_arm, count(*) AS m, count(*) FILTER (second_label = 1) AS rk FROM sheets WHERE second_label IS NOT NULL AND control_arm <> 'target' GROUP BY ALL) USING (control_arm)"""))
def control_arms_vs_history(spark, d):
    s = B.sheets(spark, d)
    ref = (s.where(F.col("second_label").isNotNull() & (F.col("control_arm") != "target")).groupBy("control_arm")
           .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("second_label") == 1).alias("k")))
    return Q.control_arms(s, ref).select(SID, "control_arm", "n", "accepted", "fisher_p")


@query("negative_flags", sql("sheets", """SELECT batch_id, n, accepted, n_high, accepted_high, coalesce(accepted / nullif(n, 0) > 0.2, false) AS above_ceiling FROM (SELECT batch_id,
    count(*) FILTER (label IN (0, 1)) AS n, count(*) FILTER (label = 1) AS accepted, count(*) FILTER (score * 10 >= 0.5) AS n_high,
    count(*) FILTER (score * 10 >= 0.5 AND label = 1) AS accepted_high FROM sheets WHERE control_arm = 'neg_ctrl' GROUP BY ALL)"""))
def negative_flags(spark, d):
    return Q.negative_flags(B.sheets(spark, d).withColumn("score", F.col("score") * 10), by=("batch_id",))


_KS = """ks AS (SELECT sheet_id, control_arm, count(*) AS n, CASE WHEN count(*) >= 5 THEN max(greatest(i / k - uu, uu - (i - 1) / k)) END AS d,
    count(*) FILTER (q = 0) AS quarter_1, count(*) FILTER (q = 1) AS quarter_2, count(*) FILTER (q = 2) AS quarter_3, count(*) FILTER (q = 3) AS quarter_4 FROM (
    SELECT *, least(floor(uu * 4), 3) AS q, row_number() OVER (PARTITION BY sheet_id, control_arm ORDER BY uu) AS i, count(*) OVER (PARTITION BY sheet_id, control_arm) AS k FROM (
    SELECT *, (sample_id - min(sample_id) OVER (PARTITION BY sheet_id) + 0.5) / count(*) OVER (PARTITION BY sheet_id) AS uu FROM sheets) WHERE control_arm <> 'target') GROUP BY ALL)"""


@query("control_positions", sql("sheets", "SELECT sheet_id, control_arm, n, round(d, 6) AS d, quarter_1, quarter_2, quarter_3, quarter_4 FROM ks", _KS))
def control_positions(spark, d):
    return Q.control_positions(B.sheets(spark, d)).drop("p", "verdict")


@query("control_position_verdicts")
def control_position_verdicts(spark, d):
    return Q.control_positions(B.sheets(spark, d)).groupBy("control_arm", "verdict").agg(F.count(F.lit(1)).alias("n"), F.min("p").alias("least_p"))


_CMH = """per AS (SELECT day, design_stratum, count(*)::DOUBLE AS t, count(*) FILTER (h = 'first')::DOUBLE AS n1, sum(label)::DOUBLE AS m1,
    sum(CASE WHEN h = 'first' THEN label ELSE 0 END)::DOUBLE AS a FROM (SELECT *, CASE WHEN hour(ts) < 12 THEN 'first' ELSE 'second' END AS h FROM sheets
    WHERE label IN (0, 1) AND control_arm = 'target') GROUP BY ALL),
    says AS (SELECT *, t >= 2 AND n1 > 0 AND t - n1 > 0 AND m1 > 0 AND t - m1 > 0 AS ok FROM per),
    cmh AS (SELECT day, sum(CASE WHEN ok THEN a - n1 * m1 / t END) AS num, sum(CASE WHEN ok THEN n1 * (t - n1) * m1 * (t - m1) / (t * t * (t - 1)) END) AS var,
    count(*) FILTER (ok) AS used, count(*) FILTER (NOT ok) AS dropped, sum(a) / nullif(sum(n1), 0) AS accept_first, sum(m1 - a) / nullif(sum(t - n1), 0) AS accept_second FROM says GROUP BY ALL)"""


def _by_day(spark, d):
    t = B.sheets(spark, d).where(Q.decided() & Q.science())
    return t.withColumn("half", F.when(F.hour("ts") < 12, "first").otherwise("second"))


@query("cmh", sql("sheets", f"""SELECT day::VARCHAR AS day, round(num * num / var, 6) AS chi2, round({_ERFC.format(x='sqrt(num * num / var / 2)')}, 6) AS p, used, dropped,
    round(accept_first, 6) AS accept_first, round(accept_second, 6) AS accept_second, CASE WHEN num * num / var > 6.634896601021214 THEN 'DRIFTED' ELSE 'FLAT' END AS verdict FROM cmh""", _CMH))
def cmh(spark, d):
    return Q.cmh(_by_day(spark, d).withColumn("day", F.col("day").cast("string")), by=("day",))


@query("cmh_continuity", sql("sheets", "SELECT day::VARCHAR AS day, round(pow(greatest(abs(num) - 0.5, 0), 2) / var, 6) AS chi2 FROM cmh", _CMH))
def cmh_continuity(spark, d):
    return Q.cmh(_by_day(spark, d).withColumn("day", F.col("day").cast("string")), True, by=("day",)).select("day", "chi2")


@query("drift_gate", sql("sheets", """SELECT day::VARCHAR AS batch_id, CASE WHEN dayofmonth(day) > 5 AND num * num / var > 2.705543454095404 AND dayofmonth(day) % 2 = 1 THEN 'refuse' ELSE 'load' END AS decision,
    CASE WHEN dayofmonth(day) <= 5 THEN 'not a rate batch' WHEN coalesce(num * num / var, 0) <= 2.705543454095404 THEN 'acceptance did not move across the sitting'
    WHEN dayofmonth(day) % 2 = 0 THEN 'a second look of this batch has been drawn' ELSE 'acceptance moved and no second look has been drawn' END AS reason FROM cmh""", _CMH))
def drift_gate(spark, d):
    t = Q.cmh(_by_day(spark, d), by=("day",)).select("day", "p")
    day = F.dayofmonth("day")
    tests = t.select(F.col("day").cast("string").alias("batch_id"), F.when(day > 5, "analysis").otherwise("calibration").alias("role"), "p")
    looks = t.where(day % 2 == 0).select(F.col("day").cast("string").alias("rejudges"))
    return Q.drift_gate(tests, looks, alpha=0.1).select("batch_id", "decision", "reason")


_FLIPS = """src AS (SELECT batch_id, label, second_label, half FROM half WHERE second_label IS NOT NULL AND control_arm = 'target'),
    flips AS (SELECT batch_id, coalesce(half, 'overall') AS part, count(*) AS n, count(*) FILTER (label = 1 AND second_label = 1) AS accept_to_accept,
    count(*) FILTER (label = 1 AND second_label = 0) AS accept_to_reject, count(*) FILTER (label = 0 AND second_label = 1) AS reject_to_accept,
    count(*) FILTER (label = 0 AND second_label = 0) AS reject_to_reject FROM src GROUP BY GROUPING SETS ((batch_id, half), (batch_id)))"""


def _flips(spark, d):
    t = Q.with_half(B.sheets(spark, d)).where(F.col("control_arm") == "target")
    return Q.flip_table(t, "label", "second_label", "half")


@query("flip_table", sql("sheets", """SELECT *, round(accept_to_accept / nullif(accept_to_accept + accept_to_reject, 0), 6) AS rate_of_accepted,
    round(reject_to_accept / nullif(reject_to_accept + reject_to_reject, 0), 6) AS rate_of_rejected FROM flips""", _HALF + ", " + _FLIPS))
def flip_table(spark, d):
    return _flips(spark, d)


@query("flip_cells", sql("sheets", """SELECT batch_id, '1|' || part AS cell, accept_to_accept + accept_to_reject AS n, accept_to_accept AS accepted FROM flips WHERE part <> 'overall' UNION ALL
    SELECT batch_id, '0|' || part, reject_to_accept + reject_to_reject, reject_to_accept FROM flips WHERE part <> 'overall'""", _HALF + ", " + _FLIPS))
def flip_cells(spark, d):
    return Q.cells_of(_flips(spark, d))


@query("flip_fisher", sql("sheets", f"""SELECT f.batch_id, CASE WHEN f.accept_to_accept + f.accept_to_reject > 0 AND s.accept_to_accept + s.accept_to_reject > 0 THEN
    round({fisher_sql('f.accept_to_accept', 'f.accept_to_reject', 's.accept_to_accept', 's.accept_to_reject')}, 6) END AS p_accepted,
    CASE WHEN f.reject_to_accept + f.reject_to_reject > 0 AND s.reject_to_accept + s.reject_to_reject > 0 THEN
    round({fisher_sql('f.reject_to_accept', 'f.reject_to_reject', 's.reject_to_accept', 's.reject_to_reject')}, 6) END AS p_rejected
    FROM flips f JOIN flips s ON f.batch_id = s.batch_id AND f.part = 'first' AND s.part = 'second'""", _HALF + ", " + _FLIPS))
def flip_fisher(spark, d):
    return Q.flip_fisher(_flips(spark, d))


_KAPPA = """conf AS (SELECT {by}, a, b, count(*) AS c FROM {src} WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY ALL),
    kap AS (SELECT {by}, n, agree, CASE WHEN x = n * n THEN 1.0 ELSE (agree / n - x / (n * n)) / (1 - x / (n * n)) END AS kappa FROM (
    SELECT {by}, sum(c)::BIGINT AS n, sum(CASE WHEN a = b THEN c ELSE 0 END)::BIGINT AS agree FROM conf GROUP BY ALL)
    JOIN (SELECT {by}, sum(na * nb)::DOUBLE AS x FROM (SELECT {by}, a AS k, sum(c) AS na FROM conf GROUP BY ALL) JOIN (SELECT {by}, b AS k, sum(c) AS nb FROM conf GROUP BY ALL)
    USING ({by}, k) GROUP BY ALL) USING ({by}))"""


@query("kappa", "WITH " + _KAPPA.format(by="source", src="(SELECT source, quality AS a, 1 - toxic AS b FROM documents JOIN labels USING (doc_id))")
       + " SELECT source, n, agree, round(kappa, 6) AS kappa FROM kap")
def kappa(spark, d):
    t = B.table(spark, d, "documents").select("doc_id", "source").join(B.table(spark, d, "labels"), "doc_id")
    return Q.kappa(t.withColumn("other", 1 - F.col("toxic")), "quality", "other", ("source",))


@query("kappa_many_classes", sql("sheets", "SELECT batch_id, n, agree, round(kappa, 6) AS kappa FROM kap",
    _KAPPA.format(by="batch_id", src="(SELECT batch_id, label AS a, coalesce(second_label, 2) AS b FROM sheets)")))
def kappa_many_classes(spark, d):
    t = B.sheets(spark, d).withColumn("other", F.coalesce("second_label", F.lit(2)))
    return Q.kappa(t, "label", "other", ("batch_id",))


@query("kappa_ci")
def kappa_ci(spark, d):
    return Q.kappa_ci(B.sheets(spark, d), "label", "second_label", seed=9)


def binomial_sql(k: str, n: str, p: str) -> str:
    f = lambda x: f"lgamma({n}+1.0) - lgamma({x}+1.0) - lgamma({n}-{x}+1.0) + {x} * ln({p}) + ({n}-{x}) * ln(1-{p})"
    return (f"CASE WHEN {p} <= 0 OR {p} >= 1 THEN CASE WHEN {k} = {n} * {p} THEN 1 ELSE 0 END ELSE least(1, list_sum([CASE WHEN {f('j')} <= {f(k)} + 1e-7 THEN exp({f('j')}) "
            f"ELSE 0 END for j in range(0, CAST({n} + 1 AS BIGINT))])) END")


_CAL = _KAPPA.format(by="sheet_id", src="(SELECT sheet_id, label AS a, second_label AS b FROM sheets)")


def _calibration(spark, d):
    """The second reading as the reference of the first, sheet by sheet."""
    s = B.sheets(spark, d).select("*", F.col("wmo").alias("k_wmo"), F.col("event_id").alias("k_cycle"), F.lit(0).alias("k_pres"))
    ref = s.where(F.col("second_label").isNotNull()).withColumn("ref_label", F.col("second_label"))
    return Q.calibration_report(s, ref)


@query("calibration_report", sql("sheets", f"""SELECT sheet_id, n AS n_reference, 0::BIGINT AS n_missing, n AS n_decided, acc AS accepted, ref AS ref_accepted, 0::BIGINT AS n_undecided,
    round(ref / n, 6) AS base_rate_reference, round(acc / n, 6) AS base_rate_observed, round(p, 6) AS p_base, round(kappa, 6) AS kappa, agree,
    CASE WHEN kappa > 0.6 AND p >= 0.05 THEN 'PASS' ELSE 'DRIFTED' END AS verdict FROM (SELECT *, {binomial_sql('acc', 'n', '(ref / n)')} AS p FROM (
    SELECT sheet_id, sum(label)::BIGINT AS acc, sum(second_label)::BIGINT AS ref FROM sheets WHERE second_label IS NOT NULL GROUP BY ALL) JOIN kap USING (sheet_id))""", _CAL))
def calibration_report(spark, d):
    return _calibration(spark, d)


@query("pass_region", sql("sheets", f"""SELECT sheet_id, min(k) AS lo, max(k) AS hi FROM (SELECT *, unnest(range(n + 1)) AS k FROM (
    SELECT sheet_id, count(*) AS n, avg(second_label) AS p0 FROM sheets WHERE second_label IS NOT NULL GROUP BY ALL)) WHERE {binomial_sql('k', 'n', 'p0')} >= 0.05 GROUP BY ALL"""))
def pass_region(spark, d):
    t = (B.sheets(spark, d).where(F.col("second_label").isNotNull()).groupBy(SID)
         .agg(F.count(F.lit(1)).alias("n"), F.avg("second_label").alias("p0")))
    return Q.pass_region(t, "n", "p0")


@query("agreement_by_tier", sql("sheets", """SELECT design_stratum, previously_judged, count(*) AS n, count(*) FILTER (label = second_label) AS agree FROM sheets WHERE label IN (0, 1) GROUP BY ALL"""))
def agreement_by_tier(spark, d):
    return Q.agreement_by(B.sheets(spark, d), "label", "second_label", "design_stratum", ("previously_judged",))


@query("disagreements", sql("sheets", "SELECT sheet_id, sample_id, label, second_label FROM sheets WHERE label IN (0, 1) AND label <> second_label"))
def disagreements(spark, d):
    return Q.disagreements(B.sheets(spark, d), "label", "second_label").select(SID, "sample_id", "label", "second_label")


@query("base_rate_drift", sql("sheets", """SELECT sheet_id, CASE WHEN avg(second_label) <> 0 THEN round(avg(label) / avg(second_label) - 1, 6) END AS drift FROM sheets
    WHERE second_label IS NOT NULL GROUP BY ALL"""))
def base_rate_drift(spark, d):
    t = _calibration(spark, d)
    return t.select(SID, Q.drift_relative("base_rate_observed", "base_rate_reference").alias("drift"))


@query("covariates", sql("sheets", f"""SELECT sheet_id, count(*) AS n, round(avg(label), 6) AS accept, count(*) FILTER (previously_judged) AS n_before,
    count(*) FILTER (previously_judged AND label = 1) AS accepted_before FROM {_SCI} GROUP BY ALL"""))
def covariates(spark, d):
    return Q.covariates(B.sheets(spark, d))


@query("acceptance_by_stratum", sql("sheets", f"SELECT sheet_id, design_stratum, count(*) AS n, count(*) FILTER (label = 1) AS accepted FROM {_SCI} GROUP BY ALL"))
def acceptance_by_stratum(spark, d):
    return Q.acceptance_by(B.sheets(spark, d))


_TREND = f"""trend AS (SELECT sheet_id, CASE WHEN n_accepted > 8 AND n_rejected > 8 THEN least(1, {_ERFC.format(x='x')}) END AS p FROM (SELECT *, (greatest(u, n_accepted * n_rejected - u)
    - n_accepted * n_rejected / 2 - 0.5) / sqrt(greatest(n_accepted * n_rejected * (n_accepted + n_rejected + 1), 1) / 12) / sqrt(2) AS x FROM mw)),
    ends AS (SELECT sheet_id, avg(label) FILTER (r <= greatest(1, floor((n - 1) / 4) + 1)) AS a, avg(label) FILTER (greatest(1, ceil((r - 1) * 4 / greatest(n - 1, 1))) = 4) AS b FROM (
    SELECT sheet_id, label, row_number() OVER (PARTITION BY sheet_id ORDER BY sample_id) AS r, count(*) OVER (PARTITION BY sheet_id) AS n FROM sheets WHERE label IN (0, 1) AND control_arm = 'target') GROUP BY ALL)"""


@query("session_flags", sql("sheets", """SELECT sheet_id AS batch_id, concat_ws(' | ', CASE WHEN p < 0.05 THEN 'acceptance moved with position: ' || CAST(round_even(a * 100, 0) AS BIGINT) || '% in the first quarter, '
    || CAST(round_even(b * 100, 0) AS BIGINT) || '% in the last' END, CASE WHEN na / nullif(nn, 0) > 0.2 THEN 'negative controls ' || na || '/' || nn || ' above the ceiling' END,
    CASE WHEN ha > 0 THEN ha || ' of ' || hn || ' likely negatives accepted' END) AS flags FROM trend LEFT JOIN ends USING (sheet_id) LEFT JOIN (SELECT sheet_id, count(*) FILTER (label IN (0, 1)) AS nn,
    count(*) FILTER (label = 1) AS na, count(*) FILTER (score * 10 >= 0.5) AS hn, count(*) FILTER (score * 10 >= 0.5 AND label = 1) AS ha FROM sheets WHERE control_arm = 'neg_ctrl' GROUP BY ALL) USING (sheet_id)""",
                            _MW + ", " + _TREND))
def session_flags(spark, d):
    """Every sitting with its trend, its first and last quarter and its negative controls. The exact p of sheets with at most eight
    rows of a kind is tested apart (`mann_whitney_exact`) and gives no flag here."""
    sheets = staged(B.sheets(spark, d), "sheets")
    limit = (F.col("n_accepted") > 8) & (F.col("n_rejected") > 8)
    trend = Q.mann_whitney(sheets).select("sheet_id", F.when(limit, F.col("p")).alias("trend_p"))
    at = lambda k: F.max(F.when(F.col("quarter") == k, F.col("accept")))                  # noqa: E731
    ends = Q.quarters(sheets).groupBy("sheet_id").agg(at(1).alias("accept_first"), at(4).alias("accept_last"))
    neg = Q.negative_flags(sheets.withColumn("score", F.col("score") * 10), by=("sheet_id",))
    neg = neg.select("sheet_id", F.col("n").alias("neg_n"), F.col("accepted").alias("neg_accepted"), F.col("n_high").alias("neg_high_n"), F.col("accepted_high").alias("neg_high_accepted"))
    t = trend.join(ends, "sheet_id", "left").join(neg, "sheet_id", "left")
    return Q.session_flags(t.withColumnRenamed("sheet_id", "batch_id"))


@query("pace", """WITH e AS (SELECT *, lag(CASE WHEN event_type = 'view' THEN ts END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts) AS copy_ts FROM events)
    SELECT event_id::VARCHAR AS sheet_id, round((epoch_us(ts) - epoch_us(copy_ts)) / 1e6 / 103, 6) AS seconds_per_row FROM e WHERE event_type = 'purchase'""")
def pace(spark, d):
    e = B.table(spark, d, "events")
    sheets = e.where(F.col("event_type") == "purchase").select("user_id", F.col("event_id").cast("string").alias("sheet_id"), F.col("ts").alias("sheet_ts"))
    copies = e.where(F.col("event_type") == "view").select("user_id", F.col("event_id").alias("copy_id"), F.col("ts").alias("copy_ts"))
    t = calibration_asof(sheets, copies, ("user_id",)).withColumn("n_rows", F.lit(103))
    return pace_of(t)
