"""Design-based rates, their error bars, drift correction and the net.

`rows` carry `pool_id, design_stratum, wmo, decision, inclusion_probability`; `frame_sizes` carry
`pool_id, design_stratum, frame_n`. Everything is one aggregate per stratum followed by work on strata.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.guards import refuse
from ..functions.hashing import unit
from ..functions.ordered import ordered
from ..functions.resample import binomial_counts, multinomial_totals, weighted_totals
from ..functions.staging import staged
from ..functions.stats import Z, jeffreys
from .allocation import POOL, STRATUM

# fixed values
TARGET_REL = 0.15               # the relative half-width a rate aims at
SECONDS_PER_PANEL = 28.7        # planning pace of a reviewer
N_BOOT = 2000
REPLICATES = 100                # that one task draws the shares of

Y, PI = "decision", "inclusion_probability"


def _y() -> Column:
    return F.col(Y).cast("double")


def require_probabilities(rows: DataFrame) -> None:
    pi = F.col(PI)
    refuse(rows.where(~F.coalesce((pi > 0) & (pi <= 1), F.lit(False))).select(POOL, "wmo", PI),
           "rows whose inclusion probability is missing, not above 0 or above 1")


def hajek_rate(rows: DataFrame, by: Sequence[str] = (POOL,)) -> DataFrame:
    """The mean of verdicts weighted by 1 / inclusion probability."""
    require_probabilities(rows)
    w = 1 / F.col(PI)
    return rows.groupBy(*by).agg((F.sum(w * _y()) / F.sum(w)).alias("rate"), F.count(F.lit(1)).alias("n"),
                                 F.sum(w).alias("sum_w"))


def replicates(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))


def _poisson_one(u: Column) -> Column:
    """The Poisson(1) number at quantile u: how often a unit is taken in one resample."""
    cdf, term, out = 0.0, 2.718281828459045 ** -1, F.lit(None)
    cuts = []
    for k in range(0, 16):
        term = term if k == 0 else term / k
        cdf += term
        cuts.append(cdf)
    out = F.when(u < cuts[0], 0)
    for k, c in enumerate(cuts[1:], start=1):
        out = out.when(u < c, k)
    return out.otherwise(len(cuts))


def cluster_bootstrap(rows: DataFrame, n_boot: int = N_BOOT, seed: int = 0, method: str = "counts",
                      by: Sequence[str] = (POOL,), group: str = "wmo") -> DataFrame:
    """The standard error of the weighted mean when whole floats are resampled.

    Rows are first summed per float. As many floats as there are are drawn with replacement in every replicate:
    `counts` draws how often each kind of float is taken, floats of equal sums being of one kind, first by share of
    kinds, then within each share, so that no task sees more than about the square root of them; `multinomial` draws
    the floats one by one. `poisson` gives every float its own Poisson(1) count.
    """
    require_probabilities(rows)
    by = list(by)
    w = 1 / F.col(PI)
    floats = rows.groupBy(*by, group).agg(F.sum(w * _y()).alias("_wy"), F.sum(w).alias("_w"))
    if method == "poisson":
        t = floats.withColumn("b", replicates(n_boot))
        t = t.withColumn("_t", _poisson_one(unit(seed, "poisson", *by, group, "b")))
        sums = t.groupBy(*by, "b").agg(F.sum(F.col("_t") * F.col("_wy")).alias("_wy"), F.sum(F.col("_t") * F.col("_w")).alias("_w"))
    elif method == "counts":
        sums = _drawn_by_counts(floats, by, n_boot, seed)
    else:
        placed = ordered(floats, by, [group])
        drawn = placed.select(*by, "rank", "group_n").withColumn("b", replicates(n_boot))
        drawn = drawn.select(*by, "b", F.floor(unit(seed, "float", *by, "b", "rank") * F.col("group_n")).alias("rank"))
        t = drawn.join(placed.select(*by, "rank", "_wy", "_w"), [*by, "rank"])
        sums = t.groupBy(*by, "b").agg(F.sum("_wy").alias("_wy"), F.sum("_w").alias("_w"))
    return sums.groupBy(*by).agg(F.stddev_samp(F.when(F.col("_w") > 0, F.col("_wy") / F.col("_w"))).alias("se"))


def _drawn_by_counts(floats: DataFrame, by: list[str], n_boot: int, seed: int) -> DataFrame:
    # sums in another order differ in their last bits; nine decimals make one kind of them
    kinds = staged(floats.withColumns({c: F.round(c, 9) for c in ("_wy", "_w")}).groupBy(*by, "_wy", "_w").agg(F.count(F.lit(1)).alias("c")), "kinds")
    most = kinds.groupBy(*by).count().agg(F.max("count")).first()[0] or 1
    shares = kinds.withColumn("share", F.pmod(F.xxhash64("_wy", "_w"), F.lit(1 + int(most ** 0.5))))
    cells = F.array_sort(F.collect_list(F.struct("_wy", "_w", "c")))
    shares = staged(shares.groupBy(*by, "share").agg(F.sum("c").alias("c"), cells.alias("cells")), "shares")
    # small tables, much work: they are spread over tasks by number, not by their size
    tasks = int(floats.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = F.array_sort(F.collect_list(F.struct("share", "c")))
    drawn = shares.groupBy(*by).agg(parts.alias("parts")).withColumn("first", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1), F.lit(REPLICATES))))
    drawn = drawn.withColumn("n", F.least(F.lit(REPLICATES), F.lit(n_boot) - F.col("first"))).repartition(tasks, *by, "first")
    drawn = drawn.select(*by, "first", "n", "parts", multinomial_totals(
        F.lit(seed), F.xxhash64(F.lit("shares"), *by), "first", "n", F.col("parts.c")).alias("drawn"))
    drawn = drawn.select(*by, "first", "n", "drawn", F.posexplode("parts").alias("i", "part"))
    drawn = drawn.select(*by, F.col("part.share").alias("share"), F.struct("first", F.slice("drawn", F.col("i") * F.col("n") + 1, F.col("n")).alias("draws")).alias("d"))
    drawn = drawn.groupBy(*by, "share").agg(F.flatten(F.array_sort(F.collect_list("d"))["draws"]).alias("draws"))
    x = shares.join(drawn, [*by, "share"]).repartition(tasks, *by, "share").select(*by, weighted_totals(
        F.lit(seed), F.xxhash64(F.lit("kinds"), *by, "share"), "draws", F.col("cells.c"), F.col("cells._wy"), F.col("cells._w")).alias("x"))
    each = x.select(*by, F.posexplode(F.arrays_zip(F.col("x.wy").alias("_wy"), F.col("x.w").alias("_w"))).alias("b", "y"))
    return each.groupBy(*by, "b").agg(F.sum("y._wy").alias("_wy"), F.sum("y._w").alias("_w"))


def _binomial_draws(n_boot: int, seed: int, tag: str, key: list[str], n: str, p: str) -> Column:
    """An array of `n_boot` binomial counts for a row with this key."""
    u = F.transform(F.sequence(F.lit(0), F.lit(n_boot - 1)), lambda b: unit(seed, tag, *key, b))
    return binomial_counts(u, F.col(n).cast("long"), F.col(p).cast("double"))


def stratum_counts(rows: DataFrame, frame_sizes: DataFrame) -> DataFrame:
    """Per stratum: rows, accepted, frame size and the stratum's weight in its pool."""
    counts = rows.groupBy(POOL, STRATUM).agg(F.count(F.lit(1)).alias("n_h"), F.sum(_y()).alias("a_h"))
    sizes = frame_sizes.select(POOL, STRATUM, "frame_n", F.sum("frame_n").over(Window.partitionBy(POOL)).alias("pool_n"))
    return (counts.join(sizes, [POOL, STRATUM], "left")
            .withColumn("w", F.col("frame_n") / F.col("pool_n")).withColumn("p_h", F.col("a_h") / F.col("n_h")))


def require_known_strata(rows: DataFrame, frame_sizes: DataFrame) -> None:
    refuse(rows.select(POOL, STRATUM).distinct().join(frame_sizes.select(POOL, STRATUM), [POOL, STRATUM], "left_anti"),
           "rows of strata with no frame size")


def _variance_term() -> Column:
    """A stratum's part of the design variance. A stratum with no or only accepts is given the Jeffreys mean:
    a zero count is an expected outcome, not zero variance."""
    a, n = F.col("a_h"), F.col("n_h")
    p = F.when((a == 0) | (a == n), jeffreys(a, n)).otherwise(F.col("p_h"))
    return F.col("w") ** 2 * p * (1 - p) / F.greatest(n - 1, F.lit(1)) * (1 - n / F.col("frame_n"))


def stratified_rate(rows: DataFrame, frame_sizes: DataFrame) -> DataFrame:
    """Per pool: the stratified mean, its design standard error and half-widths.

    A stratum keeps its frame share as weight when uncertain rows drop out of it.
    """
    require_known_strata(rows, frame_sizes)
    if "inclusion_probability" in rows.columns:
        refuse(rows.where(F.col("inclusion_probability").isNull()).limit(1), "rows that no probability sample drew")
    return rate_from_counts(stratum_counts(rows, frame_sizes))


def rate_from_counts(counts: DataFrame) -> DataFrame:
    a, n = F.col("a_h"), F.col("n_h")
    g = counts.groupBy(POOL).agg(
        F.sum(F.col("w") * F.col("p_h")).alias("rate"), F.sqrt(F.sum(_variance_term())).alias("se_design"),
        F.sum("n_h").alias("n"), F.count(F.lit(1)).alias("strata"),
        F.count_if((a == 0) | (a == n)).alias("zero_or_full_strata"), F.max("pool_n").alias("frame_n"))
    return g.withColumns({"half_width": Z * F.col("se_design"),
                          "half_width_rel": F.when(F.col("rate") > 0, Z * F.col("se_design") / F.col("rate"))
                          .otherwise(F.lit(float("inf")))})


def stratum_report(rows: DataFrame, frame_sizes: DataFrame) -> DataFrame:
    """Per stratum: frame size, rows, accepted, rate and share of the pool's variance."""
    t = stratum_counts(rows, frame_sizes).withColumn("_v", _variance_term())
    total = F.sum("_v").over(Window.partitionBy(POOL))
    return t.select(POOL, STRATUM, "frame_n", F.col("n_h").alias("n"), F.col("a_h").cast("bigint").alias("accepted"),
                    F.col("p_h").alias("rate"), F.when(total > 0, F.col("_v") / total).alias("variance_share"))


def stratified_bootstrap(rows: DataFrame, frame_sizes: DataFrame, n_boot: int = N_BOOT, seed: int = 0) -> DataFrame:
    """The standard error when rows are resampled within their stratum.

    Verdicts are 0 or 1, so a resample of a stratum is one binomial count; the work is strata x replicates.
    """
    counts = stratum_counts(rows, frame_sizes).select(POOL, STRATUM, "w", "n_h", "p_h")
    draws = counts.select(POOL, "w", "n_h", F.posexplode(_binomial_draws(n_boot, seed, "row", [POOL, STRATUM], "n_h", "p_h")).alias("b", "k"))
    means = draws.groupBy(POOL, "b").agg(F.sum(F.col("w") * F.col("k") / F.col("n_h")).alias("_m"))
    return means.groupBy(POOL).agg(F.stddev_samp("_m").alias("se"))


def stratified_bootstrap_limit(rows: DataFrame, frame_sizes: DataFrame) -> DataFrame:
    """What the bootstrap within strata tends to as replicates grow: sum w^2 p (1 - p) / n, no replicates drawn."""
    t = stratum_counts(rows, frame_sizes)
    return t.groupBy(POOL).agg(F.sqrt(F.sum(F.col("w") ** 2 * F.col("p_h") * (1 - F.col("p_h")) / F.col("n_h"))).alias("se"))


def design_effect(rows: DataFrame, frame_sizes: DataFrame) -> DataFrame:
    """The design variance over that of independent rows under the same weights, from one pass of sums."""
    w = 1 / F.col(PI)
    s = rows.groupBy(POOL).agg(F.sum(w * _y()).alias("wy"), F.sum(w).alias("w"), F.sum(w * w).alias("w2"),
                               F.sum(w * w * _y()).alias("w2y"), F.sum(w * w * _y() * _y()).alias("w2yy"))
    p = F.col("wy") / F.col("w")
    s = s.select(POOL, (F.sqrt(F.col("w2yy") - 2 * p * F.col("w2y") + p * p * F.col("w2")) / F.col("w")).alias("se_iid"))
    return (stratified_rate(rows, frame_sizes).select(POOL, "se_design").join(s, POOL)
            .withColumn("deff", F.when(F.col("se_iid") > 0, (F.col("se_design") / F.col("se_iid")) ** 2)))


def denominators(frame_sizes: DataFrame, candidates: DataFrame) -> DataFrame:
    """Levels the samples cover, levels of the pool, and the remainder: reported, never extrapolated to."""
    s = frame_sizes.groupBy(POOL).agg(F.sum("frame_n").alias("sampled_n"))
    c = candidates.groupBy(POOL).agg(F.count(F.lit(1)).alias("pool_n"))
    return c.join(s, POOL, "left").select(POOL, F.coalesce("sampled_n", F.lit(0).cast("bigint")).alias("sampled_n"), "pool_n",
                                          (F.col("pool_n") - F.coalesce("sampled_n", F.lit(0))).alias("unsampled_n"))


def precision_plan(rates: DataFrame, target: float = TARGET_REL, pace: float = SECONDS_PER_PANEL) -> DataFrame:
    """Rows needed for the target at the variance realised, how many more, and the hours they take."""
    v_target = (F.lit(target) * F.col("rate") / Z) ** 2
    needed = F.when(v_target > 0, F.ceil(F.col("n") * F.col("se_design") ** 2 / F.greatest(v_target, F.lit(1e-12))))
    t = rates.withColumn("needed", needed)
    t = t.withColumn("more", F.greatest(F.lit(0).cast("bigint"), F.col("needed") - F.col("n")))
    return t.withColumn("hours", F.col("more") * pace / 3600).withColumn("meets_target", F.col("half_width_rel") <= target)


def drift_band(rows: DataFrame, frame_sizes: DataFrame) -> DataFrame:
    """The rate had the whole sitting read like its first half, or its second; a half empty in a stratum counts 0.

    A stratum that several batches share is one mean over their rows, so that the weights of a pool add up to 1.
    """
    sizes = frame_sizes.select(POOL, STRATUM, (F.col("frame_n") / F.sum("frame_n").over(Window.partitionBy(POOL))).alias("w"))
    one = lambda h: F.avg(F.when(F.col("half") == h, _y())).alias(h)
    per = rows.groupBy(POOL, STRATUM).agg(one("first"), one("second"))
    t = per.join(sizes, [POOL, STRATUM])
    return t.groupBy(POOL).agg(*[F.sum(F.col("w") * F.coalesce(h, F.lit(0.0))).alias(f"rate_{h}_half") for h in ("first", "second")])


def pool_cells(parts: DataFrame, by: Sequence[str] = ("batch_id",)) -> DataFrame:
    """Several second looks of one sheet read as one: counts add, and the looks they came from are listed."""
    return (parts.where(F.col("n") > 0).groupBy(*by, "cell")
            .agg(F.sum("n").alias("n"), F.sum("accepted").alias("accepted"),
                 F.array_sort(F.collect_list(F.struct("look_id", F.col("n"), F.col("accepted")))).alias("pooled_from")))


def _in_cells(rows: DataFrame, cells: DataFrame) -> DataFrame:
    """Rows with their cell `<verdict>|<half>` and, where a second look covers the batch, the cell's rate `q`."""
    cell = F.concat_ws("|", F.col(Y).cast("int").cast("string"), F.col("half"))
    # four cells per batch: staged, so that the rows are not shuffled to meet them
    rate = staged(cells.where(F.col("n") > 0).select("batch_id", "cell", (F.col("accepted") / F.col("n")).alias("q")), "cells")
    return rows.withColumn("cell", cell).join(rate, ["batch_id", "cell"], "left")


def drift_corrected_rate(rows: DataFrame, frame_sizes: DataFrame, cells: DataFrame) -> DataFrame:
    """The rate had every row been read the way the second look reads it.

    A row counts as its cell's rate; a row of a batch nobody looked at twice keeps its verdict.
    """
    require_known_strata(rows, frame_sizes)
    t = _in_cells(rows, cells)
    per = t.groupBy(POOL, STRATUM).agg(F.avg(F.coalesce(F.col("q"), _y())).alias("m"), F.count("q").alias("c"),
                                       F.count(F.lit(1)).alias("n"))
    sizes = frame_sizes.select(POOL, STRATUM, (F.col("frame_n") / F.sum("frame_n").over(Window.partitionBy(POOL))).alias("w"))
    return per.join(sizes, [POOL, STRATUM]).groupBy(POOL).agg(
        F.sum(F.col("w") * F.col("m")).alias("rate"), F.sum("c").alias("rows_corrected"),
        (F.sum("n") - F.sum("c")).alias("rows_kept"))


def correction_error(rows: DataFrame, frame_sizes: DataFrame, cells: DataFrame, rates: DataFrame,
                     n_boot: int | None = None, seed: int = 0) -> DataFrame:
    """How well the second look pins the corrected rate, and the whole error with `se_design` in quadrature.

    The corrected rate is linear in the cell rates, so the closed form is the limit of resampling each cell;
    `n_boot` resamples instead.
    """
    sizes = frame_sizes.select(POOL, STRATUM, (F.col("frame_n") / F.sum("frame_n").over(Window.partitionBy(POOL))).alias("w"))
    t = _in_cells(rows, cells)
    counts = t.groupBy(POOL, STRATUM, "batch_id", "cell").agg(F.count("q").alias("c"), F.max("q").alias("q"), F.count(F.lit(1)).alias("k"))
    counts = counts.withColumn("n_h", F.sum("k").over(Window.partitionBy(POOL, STRATUM))).join(sizes, [POOL, STRATUM])
    coeff = (counts.where(F.col("q").isNotNull()).groupBy(POOL, "batch_id", "cell")
             .agg(F.sum(F.col("w") * F.col("c") / F.col("n_h")).alias("coeff"), F.max("q").alias("q"))
             .join(cells.select("batch_id", "cell", F.col("n").alias("n_c")), ["batch_id", "cell"]))
    if n_boot is None:
        part = coeff.groupBy(POOL).agg(F.sqrt(F.sum(F.col("coeff") ** 2 * F.col("q") * (1 - F.col("q")) / F.col("n_c"))).alias("se_rejudge"))
    else:
        draws = coeff.select(POOL, "coeff", "n_c", F.posexplode(_binomial_draws(n_boot, seed, "cell", [POOL, "batch_id", "cell"], "n_c", "q")).alias("b", "k"))
        sums = draws.groupBy(POOL, "b").agg(F.sum(F.col("coeff") * F.col("k") / F.col("n_c")).alias("m"))
        part = sums.groupBy(POOL, "b").agg(F.sum("m").alias("m")).groupBy(POOL).agg(F.stddev_samp("m").alias("se_rejudge"))
    return (rates.select(POOL, "se_design").join(part, POOL, "left")
            .withColumn("se_rejudge", F.coalesce("se_rejudge", F.lit(0.0)))
            .withColumn("se_total", F.sqrt(F.col("se_design") ** 2 + F.col("se_rejudge") ** 2)))


def net(limbs: DataFrame) -> DataFrame:
    """Accepted levels downward minus upward, per study; quoted only where both limbs are drift-corrected.

    `limbs(pool_id, frame_n, rate_corrected, se_total)`, null where a limb has no correction.
    """
    p = F.split(POOL, "/")
    t = limbs.withColumn("study_id", p[0]).withColumn("channel", p[1]).withColumn("limb", p[2])
    of = lambda limb, c: F.max(F.when(F.col("limb") == limb, c))
    g = t.groupBy("study_id", "channel").agg(
        of("subduction", F.col("rate_corrected") * F.col("frame_n")).alias("down"),
        of("obduction", F.col("rate_corrected") * F.col("frame_n")).alias("up"),
        of("subduction", F.col("se_total") * F.col("frame_n")).alias("se_down"),
        of("obduction", F.col("se_total") * F.col("frame_n")).alias("se_up"))
    quoted = F.col("down").isNotNull() & F.col("up").isNotNull()
    missing = F.concat_ws(", ", F.when(F.col("down").isNull(), "subduction"), F.when(F.col("up").isNull(), "obduction"))
    return g.select("study_id", "channel", quoted.alias("quoted"),
                    F.when(quoted, F.col("down") - F.col("up")).alias("net"),
                    F.when(quoted, Z * F.sqrt(F.col("se_down") ** 2 + F.col("se_up") ** 2)).alias("half_width"),
                    F.when(~quoted, F.concat(F.lit("no drift correction: "), missing)).alias("reason"))


def next_pool(rates: DataFrame, pools: DataFrame) -> DataFrame:
    """The pool the next batch goes to: one without a rate first, else the one with the widest relative half-width."""
    t = pools.select(POOL).join(rates.select(POOL, "half_width_rel"), POOL, "left")
    return t.orderBy(F.col("half_width_rel").desc_nulls_first(), POOL).limit(1)


def pace(sheets: DataFrame) -> DataFrame:
    """Seconds per row between the calibration copy and the sheet. `sheets(sheet_id, copy_ts, sheet_ts, n_rows)`."""
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    took = (micros("sheet_ts") - micros("copy_ts")) / F.lit(1e6)
    return sheets.select("sheet_id", (took / F.col("n_rows")).alias("seconds_per_row"))


def uncertain(rows: DataFrame, by: Sequence[str] = (POOL,)) -> DataFrame:
    """Rows read as uncertain: out of the rate, and counted."""
    return rows.groupBy(*by).agg(F.count_if(F.col(Y) == 2).alias("n_uncertain"))
