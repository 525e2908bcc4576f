"""Reading a sitting: counts, position, drift, controls, second looks and calibration.

A sheet is one sitting of at most 120 rows (see `draw.split_sessions`), so windows over a sheet are small by
definition; everything above a sheet is an aggregate. `sheet` rows carry `sheet_id, sample_id, label` (0, 1, 2 or
null), `control_arm`, `design_stratum`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.guards import refuse
from ..functions.resample import kappa_limits
from ..functions.stats import (beta_quantile, binomial_p, chi2_tail, fisher_p, kolmogorov_p, rank_sum_p)
from .draw import NEG_CTRL, POS_CTRL, TARGET

# fixed values
DRIFT_ALPHA = 0.01
POSITION_ALPHA = 0.01
KAPPA_PASS = 0.6
BASE_RATE_ALPHA = 0.05
NEG_CEILING = 0.20
HIGH_SCORE = 0.5
MIN_SIDE = 8                    # decided rows left on either side of a change point
MIN_TREND = 3                   # verdicts of either kind for a trend on science rows
MIN_CONTROLS = 5                # controls of an arm for its position test

SHEET = ("sheet_id",)


def decided() -> Column:
    return F.col("label").isin(0, 1)


def science() -> Column:
    """Rows of the sample itself: not a control."""
    return F.coalesce(F.col("control_arm") == TARGET, F.lit(True))


def session_counts(sheet: DataFrame, by: Sequence[str] = SHEET) -> DataFrame:
    c = F.col("label")
    return sheet.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(c.isin(0, 1)).alias("decided"), F.count_if(c == 1).alias("accepted"),
        F.count_if(c == 0).alias("rejected"), F.count_if(c == 2).alias("uncertain"),
        F.count_if(c.isNull()).alias("blank"))


def position_bins(sheet: DataFrame, k: int = 4, by: Sequence[str] = SHEET) -> DataFrame:
    """Decided rows in `k` bins of equal size along the sheet: where each bin runs and its acceptance."""
    w = Window.partitionBy(*by).orderBy("sample_id")
    t = sheet.where(decided()).withColumn("bin", F.ntile(k).over(w))
    return t.groupBy(*by, "bin").agg(F.min("sample_id").alias("from_id"), F.max("sample_id").alias("to_id"),
                                     F.count(F.lit(1)).alias("n"), F.avg("label").alias("accept"))


def quarters(sheet: DataFrame, by: Sequence[str] = SHEET) -> DataFrame:
    """Science rows only, cut at the quartiles of their ranks: acceptance along the sheet."""
    whole = Window.partitionBy(*by)
    t = sheet.where(decided() & science())
    t = t.withColumn("_r", F.row_number().over(whole.orderBy("sample_id"))).withColumn("_n", F.count(F.lit(1)).over(whole))
    # right-closed quartile edges at 1 + (n - 1) q
    q = F.greatest(F.lit(1), F.ceil((F.col("_r") - 1) * 4 / F.greatest(F.col("_n") - 1, F.lit(1))))
    return t.withColumn("quarter", q).groupBy(*by, "quarter").agg(F.count(F.lit(1)).alias("n"), F.avg("label").alias("accept"))


def mann_whitney(sheet: DataFrame, min_each: int = 1, by: Sequence[str] = SHEET) -> DataFrame:
    """Do accepted rows sit earlier or later than rejected ones? Positions are unique, so ranks have no ties."""
    t = sheet.where(decided()).withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy("sample_id")))
    g = t.groupBy(*by).agg(F.count_if(F.col("label") == 1).alias("n_accepted"), F.count_if(F.col("label") == 0).alias("n_rejected"),
                           F.sum(F.when(F.col("label") == 1, F.col("_r")).otherwise(0)).alias("_ranks"))
    n1, n0 = F.col("n_accepted"), F.col("n_rejected")
    enough = (n1 >= min_each) & (n0 >= min_each)
    u = F.when(enough, F.col("_ranks") - n1 * (n1 + 1) / 2)
    return g.withColumn("u", u).withColumn("p", rank_sum_p("u", "n_accepted", "n_rejected")).drop("_ranks")


def change_point(sheet: DataFrame, min_side: int = MIN_SIDE, by: Sequence[str] = SHEET) -> DataFrame:
    """The split of the decided rows that separates acceptance most, by Fisher's test, corrected for all splits.

    One row per split of a sheet: at most 119 of them, as a sheet is at most 120 rows.
    """
    whole = Window.partitionBy(*by)
    t = sheet.where(decided()).select(*by, "sample_id", F.col("label").cast("bigint").alias("y"))
    w = whole.orderBy("sample_id")
    t = t.withColumns({"n_before": F.row_number().over(w), "a_before": F.sum("y").over(w),
                       "n_all": F.count(F.lit(1)).over(whole), "a_all": F.sum("y").over(whole)})
    t = t.where((F.col("n_before") >= min_side) & (F.col("n_all") - F.col("n_before") >= min_side))
    n_after, a_after = F.col("n_all") - F.col("n_before"), F.col("a_all") - F.col("a_before")
    t = t.withColumn("p_raw", fisher_p("a_before", F.col("n_before") - F.col("a_before"), a_after, n_after - a_after))
    g = t.groupBy(*by).agg(
        F.count(F.lit(1)).alias("splits"),
        F.min_by(F.struct("sample_id", (F.col("a_before") / F.col("n_before")).alias("accept_before"),
                          (a_after / n_after).alias("accept_after"), "p_raw"),
                 F.struct(F.floor(F.col("p_raw") * 1e12 + 0.5), "sample_id")).alias("s"))      # twelve places, rounded as doubles are
    return g.select(*by, "splits", "s.*").withColumn("p_adjusted", F.least(F.lit(1.0), F.col("p_raw") * F.col("splits")))


def with_half(sheet: DataFrame, by: Sequence[str] = SHEET) -> DataFrame:
    """Adds `half` and `cut_at`: the half of the sitting, cut at the median position of its decided science rows."""
    cut = F.percentile(F.when(decided() & science(), F.col("sample_id")), F.lit(0.5)).over(Window.partitionBy(*by))
    return (sheet.withColumn("cut_at", cut)
            .withColumn("half", F.when(F.col("cut_at").isNotNull(),
                                       F.when(F.col("sample_id") <= F.col("cut_at"), "first").otherwise("second"))))


def control_arms(sheet: DataFrame, reference: DataFrame | None = None, by: Sequence[str] = SHEET) -> DataFrame:
    """Decided controls per arm, their Jeffreys interval and, against a standing reference, Fisher's p.

    `reference(control_arm, k, n)` is the arm's blind history.
    """
    g = (sheet.where(decided() & F.col("control_arm").isin(POS_CTRL, NEG_CTRL)).groupBy(*by, "control_arm")
         .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == 1).alias("accepted")))
    a, b = F.col("accepted") + 0.5, F.col("n") - F.col("accepted") + 0.5
    g = g.withColumn("lo", beta_quantile(F.lit(0.025), a, b)).withColumn("hi", beta_quantile(F.lit(0.975), a, b))
    if reference is not None:
        r = F.broadcast(reference.select("control_arm", F.col("k").alias("ref_k"), F.col("n").alias("ref_n")))  # one row per arm
        g = g.join(r, "control_arm", "left").withColumn("fisher_p", fisher_p(
            "accepted", F.col("n") - F.col("accepted"), "ref_k", F.col("ref_n") - F.col("ref_k")))
    return g


def fisher(df: DataFrame, a: str, b: str, c: str, d: str) -> DataFrame:
    return df.withColumn("p", fisher_p(a, b, c, d))


def negative_flags(sheet: DataFrame, ceiling: float = NEG_CEILING, by: Sequence[str] = SHEET) -> DataFrame:
    """Accepted negatives against the ceiling (shown, never a filter), and those the score calls likely."""
    neg = sheet.where(F.col("control_arm") == NEG_CTRL)
    high = F.coalesce(F.col("score") >= HIGH_SCORE, F.lit(False))
    g = neg.groupBy(*by).agg(F.count_if(decided()).alias("n"), F.count_if(F.col("label") == 1).alias("accepted"),
                             F.count_if(high).alias("n_high"), F.count_if(high & (F.col("label") == 1)).alias("accepted_high"))
    return g.withColumn("above_ceiling", F.coalesce(F.col("accepted") / F.nullif(F.col("n"), F.lit(0)) > ceiling, F.lit(False)))


def control_positions(sheet: DataFrame, alpha: float = POSITION_ALPHA, min_n: int = MIN_CONTROLS,
                      by: Sequence[str] = SHEET) -> DataFrame:
    """Is each control arm spread over the sheet? Kolmogorov's distance of (position + 1/2) / rows from flat."""
    whole = Window.partitionBy(*by)
    t = (sheet.withColumn("_n", F.count(F.lit(1)).over(whole)).withColumn("_pos", F.col("sample_id") - F.min("sample_id").over(whole))
         .where(F.col("control_arm").isin(POS_CTRL, NEG_CTRL)))
    arm = Window.partitionBy(*by, "control_arm")
    t = (t.withColumn("_u", (F.col("_pos") + 0.5) / F.col("_n"))
         .withColumn("_i", F.row_number().over(arm.orderBy("_pos"))).withColumn("_k", F.count(F.lit(1)).over(arm)))
    d = F.greatest(F.col("_i") / F.col("_k") - F.col("_u"), F.col("_u") - (F.col("_i") - 1) / F.col("_k"))
    q = F.least(F.floor(F.col("_u") * 4), F.lit(3))
    g = t.groupBy(*by, "control_arm").agg(F.count(F.lit(1)).alias("n"), F.max(d).alias("d"),
                                          *[F.count_if(q == i).alias(f"quarter_{i + 1}") for i in range(4)])
    g = g.withColumn("d", F.when(F.col("n") >= min_n, F.col("d"))).withColumn("p", kolmogorov_p("d", "n"))
    return g.withColumn("verdict", F.when(F.coalesce(F.col("p") < alpha, F.lit(False)), "FAIL").otherwise("PASS"))


def cmh(df: DataFrame, continuity: bool = False, by: Sequence[str] = ("batch_id",), y: str = "label",
        half: str = "half", stratum: str = "design_stratum", alpha: float = DRIFT_ALPHA) -> DataFrame:
    """Did acceptance move between the halves with the stratum held fixed? (Cochran, Mantel and Haenszel.)

    A stratum with one half or one verdict only says nothing: it is dropped and counted.
    """
    second = F.col(half) == "second"
    per = df.groupBy(*by, stratum).agg(
        F.count(F.lit(1)).alias("t"), F.count_if(~second).alias("n1"), F.sum(F.col(y).cast("bigint")).alias("m1"),
        F.sum(F.when(~second, F.col(y).cast("bigint")).otherwise(0)).alias("a"))
    per = per.withColumn("n2", F.col("t") - F.col("n1")).withColumn("m2", F.col("t") - F.col("m1"))
    says = (F.col("t") >= 2) & (F.col("n1") > 0) & (F.col("n2") > 0) & (F.col("m1") > 0) & (F.col("m2") > 0)
    n1, n2, m1, m2, t = [F.col(c).cast("double") for c in ("n1", "n2", "m1", "m2", "t")]
    g = per.groupBy(*by).agg(
        F.sum(F.when(says, F.col("a") - n1 * m1 / t)).alias("_num"),
        F.sum(F.when(says, n1 * n2 * m1 * m2 / (t * t * (t - 1)))).alias("_var"),
        F.count_if(says).alias("used"), F.count_if(~says).alias("dropped"),
        (F.sum("a") / F.nullif(F.sum("n1"), F.lit(0))).alias("accept_first"),
        (F.sum(F.col("m1") - F.col("a")) / F.nullif(F.sum("n2"), F.lit(0))).alias("accept_second"))
    d = F.greatest(F.abs("_num") - (0.5 if continuity else 0.0), F.lit(0.0))
    g = g.withColumn("chi2", F.when(F.col("_var") > 0, d * d / F.col("_var"))).drop("_num", "_var")
    g = g.withColumn("p", chi2_tail("chi2"))
    return g.withColumn("verdict", F.when(F.coalesce(F.col("p") < alpha, F.lit(False)), "DRIFTED").otherwise("FLAT"))


def drift_gate(tests: DataFrame, rejudgements: DataFrame, accept: bool = False, alpha: float = DRIFT_ALPHA) -> DataFrame:
    """Whether an analysis batch may be loaded. `tests(batch_id, role, p)`, `rejudgements(rejudges)`."""
    drawn = rejudgements.select(F.col("rejudges").alias("batch_id")).distinct().withColumn("_looked", F.lit(True))
    t = tests.join(drawn, "batch_id", "left")
    moved = F.coalesce(F.col("p") < alpha, F.lit(False))
    reason = (F.when(F.col("role") != "analysis", "not a rate batch")
              .when(~moved, "acceptance did not move across the sitting")
              .when(F.col("_looked"), "a second look of this batch has been drawn")
              .otherwise("accepted by hand" if accept else "acceptance moved and no second look has been drawn"))
    stop = (F.col("role") == "analysis") & moved & F.col("_looked").isNull() & F.lit(not accept)
    return t.withColumn("decision", F.when(stop, "refuse").otherwise("load")).withColumn("reason", reason).drop("_looked")


def flip_table(df: DataFrame, first: str = "original_label", second: str = "label", half: str = "original_half",
               by: Sequence[str] = ("batch_id",)) -> DataFrame:
    """What a second look did to the first, per half of the first sitting and overall."""
    a, b = F.col(first), F.col(second)
    t = df.where(a.isin(0, 1) & b.isin(0, 1))
    counts = [F.count(F.lit(1)).alias("n"), *[F.count_if((a == i) & (b == j)).alias(f"{x}_to_{y}")
                                             for i, x in ((1, "accept"), (0, "reject")) for j, y in ((1, "accept"), (0, "reject"))]]
    g = (t.groupingSets([[*by, half], [*by]], *by, half).agg(*counts)
         .withColumn("part", F.coalesce(F.col(half), F.lit("overall"))).drop(half))
    share = lambda x: F.col(f"{x}_to_accept") / F.nullif(F.col(f"{x}_to_accept") + F.col(f"{x}_to_reject"), F.lit(0))
    return g.withColumn("rate_of_accepted", share("accept")).withColumn("rate_of_rejected", share("reject"))


def flip_fisher(flips: DataFrame, by: Sequence[str] = ("batch_id",)) -> DataFrame:
    """Does the second half flip differently from the first? Per first verdict; null where a half is empty."""
    at = lambda part, c: F.max(F.when(F.col("part") == part, F.col(c)))
    g = flips.groupBy(*by).agg(*[at(p, f"{x}_to_{y}").alias(f"{p}_{x}_{y}") for p in ("first", "second")
                                 for x in ("accept", "reject") for y in ("accept", "reject")])
    for x in ("accept", "reject"):
        cells = [f"first_{x}_accept", f"first_{x}_reject", f"second_{x}_accept", f"second_{x}_reject"]
        full = (F.col(cells[0]) + F.col(cells[1]) > 0) & (F.col(cells[2]) + F.col(cells[3]) > 0)
        g = g.withColumn(f"p_{x}ed", fisher_p(F.when(full, F.col(cells[0])), *[F.col(c) for c in cells[1:]]))
    return g.select(*by, "p_accepted", "p_rejected")


def cells_of(flips: DataFrame, by: Sequence[str] = ("batch_id",)) -> DataFrame:
    """The four cells of a flip table as rows: `cell` = `<first verdict>|<half>`, n and accepted."""
    rows = F.array(*[F.struct(F.concat(F.lit(f"{v}|"), F.col("part")).alias("cell"),
                              (F.col(f"{x}_to_accept") + F.col(f"{x}_to_reject")).alias("n"),
                              F.col(f"{x}_to_accept").alias("accepted")) for v, x in ((1, "accept"), (0, "reject"))])
    return flips.where(F.col("part") != "overall").select(*by, F.explode(rows).alias("c")).select(*by, "c.*")


def kappa(df: DataFrame, a: str, b: str, by: Sequence[str] = SHEET) -> DataFrame:
    """Cohen's kappa over any number of classes, from the confusion counts; 1 where chance agreement is certain."""
    by = list(by)
    n = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*by, F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("c"))
    return _kappa(n, by)


def _kappa(confusion: DataFrame, by: list[str]) -> DataFrame:
    side = lambda c: confusion.select(*by, F.col(c).alias("k"), F.when(F.lit(c == "a"), F.col("c")).otherwise(0).alias("na"),
                                      F.when(F.lit(c == "b"), F.col("c")).otherwise(0).alias("nb"),
                                      F.when(F.lit(c == "a") & (F.col("a") == F.col("b")), F.col("c")).otherwise(0).alias("same"))
    per = side("a").unionByName(side("b")).groupBy(*by, "k").agg(F.sum("na").alias("na"), F.sum("nb").alias("nb"), F.sum("same").alias("same"))
    g = per.groupBy(*by).agg(F.sum("na").alias("n"), F.sum("same").alias("agree"), F.sum(F.col("na") * F.col("nb")).alias("_x"))
    n = F.col("n").cast("double")
    pe, po = F.col("_x") / (n * n), F.col("agree") / n
    return g.withColumn("kappa", F.when(F.col("_x") == F.col("n") * F.col("n"), 1.0).otherwise((po - pe) / (1 - pe))).drop("_x")


def kappa_ci(df: DataFrame, a: str, b: str, n_boot: int = 2000, seed: int = 0, by: Sequence[str] = SHEET) -> DataFrame:
    """A bootstrap interval on kappa: the confusion counts of a sheet are resampled, not its rows."""
    by = list(by)
    cells = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*by, F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).agg(F.count(F.lit(1)).alias("c"))
    sheets = cells.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("a", "b", "c"))).alias("x"))
    return sheets.select(*by, kappa_limits(F.lit(seed), F.xxhash64(F.lit("kappa"), *by), F.lit(n_boot), F.col("x.a"), F.col("x.b"), F.col("x.c")).alias("_q")).select(*by, "_q.lo", "_q.hi")


def calibration_report(sheet: DataFrame, reference: DataFrame, by: Sequence[str] = SHEET,
                       key: Sequence[str] = ("k_wmo", "k_cycle", "k_pres"), kappa_pass: float = KAPPA_PASS,
                       alpha: float = BASE_RATE_ALPHA) -> DataFrame:
    """A calibration copy against its reference: PASS where kappa is above the mark, the base rate is on target
    and every reference row was decided. `reference` carries `by`, the key and `ref_label` (0/1)."""
    by = list(by)
    for df, what in ((reference, "reference"), (sheet, "sheet")):
        refuse(df.groupBy(*by, *key).count().where("count > 1"), f"keys that are twice on a {what}")
    m = reference.select(*by, *key, "ref_label").join(
        sheet.select(*by, *key, "label", F.lit(True).alias("_on_sheet")), [*by, *key], "left")
    dec = F.coalesce(F.col("label").isin(0, 1), F.lit(False))
    g = m.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_reference"), F.count_if(F.col("_on_sheet").isNull()).alias("n_missing"),
        F.count_if(dec).alias("n_decided"), F.count_if(dec & (F.col("label") == 1)).alias("accepted"),
        F.sum("ref_label").alias("ref_accepted"))
    g = g.withColumn("n_undecided", F.col("n_reference") - F.col("n_missing") - F.col("n_decided"))
    g = g.withColumn("base_rate_reference", F.col("ref_accepted") / F.col("n_reference"))
    g = g.withColumn("base_rate_observed", F.col("accepted") / F.nullif(F.col("n_decided"), F.lit(0)))
    some = F.col("n_decided") > 0
    g = g.withColumn("p_base", binomial_p(F.when(some, F.col("accepted")), F.col("n_decided"), F.col("base_rate_reference")))
    k = kappa(m.where(dec), "label", "ref_label", by).select(*by, "kappa", "agree")
    g = g.join(k, by, "left")
    ok = (F.col("n_decided") == F.col("n_reference")) & (F.col("kappa") > kappa_pass) & (F.col("p_base") >= alpha)
    return g.withColumn("verdict", F.when(F.coalesce(ok, F.lit(False)), "PASS").otherwise("DRIFTED"))


def pass_region(df: DataFrame, n: str, p0: str, alpha: float = BASE_RATE_ALPHA, by: Sequence[str] = SHEET) -> DataFrame:
    """The accepted counts the base-rate test would let pass, lowest and highest."""
    t = df.select(*by, n, p0).withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n).cast("bigint"))))
    t = t.withColumn("_p", binomial_p("k", n, p0)).where(F.col("_p") >= alpha)
    return t.groupBy(*by).agg(F.min("k").alias("lo"), F.max("k").alias("hi"))


def agreement_by(df: DataFrame, a: str, b: str, tier: str = "tier", by: Sequence[str] = SHEET) -> DataFrame:
    t = df.where(F.col(a).isin(0, 1))
    return t.groupBy(*by, tier).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(a) == F.col(b)).alias("agree"))


def disagreements(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.where(F.col(a).isin(0, 1) & (F.col(a) != F.col(b)))


def drift_relative(observed: Column | str, reference: Column | str) -> Column:
    o, r = [F.col(c) if isinstance(c, str) else c for c in (observed, reference)]
    return F.when(r != 0, o / r - 1)


def covariates(sheet: DataFrame, by: Sequence[str] = SHEET) -> DataFrame:
    """Raw acceptance of the science rows, in all and among those judged before."""
    t = sheet.where(decided() & science())
    before = F.coalesce(F.col("previously_judged"), F.lit(False))
    return t.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("label").alias("accept"),
                              F.count_if(before).alias("n_before"), F.count_if(before & (F.col("label") == 1)).alias("accepted_before"))


def acceptance_by(sheet: DataFrame, column: str = "design_stratum", by: Sequence[str] = SHEET) -> DataFrame:
    return (sheet.where(decided() & science()).groupBy(*by, column)
            .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == 1).alias("accepted")))


def session_flags(reports: DataFrame) -> DataFrame:
    """What a reader should see beside a rate; reported, never a filter.

    `reports(batch_id, trend_p, accept_first, accept_last, neg_n, neg_accepted, neg_high_n, neg_high_accepted)`
    """
    pct = lambda c: F.format_number(F.col(c) * 100, 0)
    flags = F.array(
        F.when(F.col("trend_p") < 0.05, F.concat(F.lit("acceptance moved with position: "), pct("accept_first"),
                                                 F.lit("% in the first quarter, "), pct("accept_last"), F.lit("% in the last"))),
        F.when(F.col("neg_accepted") / F.nullif(F.col("neg_n"), F.lit(0)) > NEG_CEILING,
               F.concat(F.lit("negative controls "), F.col("neg_accepted").cast("string"), F.lit("/"), F.col("neg_n").cast("string"),
                        F.lit(" above the ceiling"))),
        F.when(F.col("neg_high_accepted") > 0, F.concat(F.col("neg_high_accepted").cast("string"), F.lit(" of "),
                                                        F.col("neg_high_n").cast("string"), F.lit(" likely negatives accepted"))))
    return reports.select("batch_id", F.array_join(F.filter(flags, lambda f: f.isNotNull()), " | ").alias("flags"))
