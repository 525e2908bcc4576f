"""From the label table to the rate report: one row per pool."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.staging import staged
from ..functions.stats import Z
from ..operators import estimate as E


def rate_report(rows: DataFrame, frame_sizes: DataFrame, candidates: DataFrame, cells: DataFrame | None = None,
                target: float = E.TARGET_REL) -> DataFrame:
    """Rate, error bars, denominators, precision still needed, drift band, corrected rate and net, per pool.

    `rows` are decided target rows with `batch_id` and `half`. Their few columns are staged once; every figure is one
    aggregate over them, by stratum, batch and half.
    """
    rows = staged(rows.select("pool_id", "design_stratum", "batch_id", "wmo", "half", "decision", "inclusion_probability"), "rows")
    sizes = staged(frame_sizes, "sizes")
    rates = staged(E.stratified_rate(rows, sizes), "rates")
    out = (E.precision_plan(rates, target)
           .join(E.denominators(sizes, candidates), "pool_id")
           .join(E.drift_band(rows, sizes), "pool_id")
           .join(E.hajek_rate(rows).select("pool_id", F.col("rate").alias("hajek_rate")), "pool_id")
           .join(E.design_effect(rows, sizes).select("pool_id", "se_iid", "deff"), "pool_id")
           .join(E.stratified_bootstrap_limit(rows, sizes).select("pool_id", F.col("se").alias("se_stratified")), "pool_id")
           .join(rows.groupBy("pool_id").agg(F.count_distinct("wmo").alias("floats")), "pool_id")
           .withColumn("accepted_levels", F.col("rate") * F.col("frame_n")))
    if cells is None:
        for c in ("rate_corrected", "se_rejudge", "se_total", "half_width_corrected"):
            out = out.withColumn(c, F.lit(None).cast("double"))
    else:
        corrected = (E.drift_corrected_rate(rows, sizes, cells).where(F.col("rows_corrected") > 0)
                     .select("pool_id", F.col("rate").alias("rate_corrected"), "rows_corrected"))
        errors = E.correction_error(rows, sizes, cells, rates).select("pool_id", "se_rejudge", "se_total")
        both = corrected.join(errors, "pool_id").withColumn("half_width_corrected", Z * F.col("se_total"))
        out = out.join(both, "pool_id", "left")
    return out
