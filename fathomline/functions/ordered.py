"""Ranks, running totals, carried values and quantiles of groups of any size.

A window partitioned by a group puts the whole group in one task, and one group may hold a third of all
rows. Here the rows are range-partitioned on (group, order), so a large group spreads over many tasks;
each task works on its own slice, and one small row per (group, slice) carries counts, sums and last
values from slice to slice.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .hashing import unit
from .staging import staged

SLICES = 1 << 14                # equal cuts of a hash number

def _columns(names: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in names]


def ordered(df: DataFrame, by: Sequence[str], order: Sequence[str | Column],
            totals: Mapping[str, Column] | None = None,
            carry: Mapping[str, Column] | None = None) -> DataFrame:
    """Every row with its place in its group under a total order.

    Adds `rank` (from 0) and `group_n`; for each total `x`, the running sum `x` up to and including the
    row and the group's sum `x_all`; for each carried value `x`, its last non-null value up to and
    including the row. `by` columns may not be null.
    """
    totals, carry = dict(totals or {}), dict(carry or {})
    by = list(by)
    for name, value in {**totals, **carry}.items():
        df = df.withColumn(f"_in_{name}", value)
    keys = [F.col(c) for c in by] + _columns(order)
    slices = staged(df.repartitionByRange(*keys).sortWithinPartitions(*keys)
                    .withColumn("_slice", F.spark_partition_id())
                    .withColumn("_row", F.monotonically_increasing_id()), "ordered")

    # one row per (group, slice), whatever the size of the group
    parts = slices.groupBy(*by, "_slice").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"),
        *[F.sum(f"_in_{x}").alias(f"_sum_{x}") for x in totals],
        *[F.max_by(f"_in_{x}", F.when(F.col(f"_in_{x}").isNotNull(), F.col("_row"))).alias(f"_last_{x}")
          for x in carry])
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    before = whole.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        *by, "_slice", "_first",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        F.sum("_n").over(whole).alias("group_n"),
        *[c for x in totals for c in (
            F.coalesce(F.sum(f"_sum_{x}").over(before), F.lit(0)).alias(f"_before_{x}"),
            F.sum(f"_sum_{x}").over(whole).alias(f"{x}_all"))],
        *[F.last(f"_last_{x}", ignorenulls=True).over(before).alias(f"_before_{x}") for x in carry])

    out = slices
    if totals or carry:
        local = (Window.partitionBy(*by, "_slice").orderBy("_row")
                 .rowsBetween(Window.unboundedPreceding, Window.currentRow))
        for x in totals:
            out = out.withColumn(f"_run_{x}", F.sum(f"_in_{x}").over(local))
        for x in carry:
            out = out.withColumn(f"_run_{x}", F.last(f"_in_{x}", ignorenulls=True).over(local))
    out = out.join(parts, [*by, "_slice"])
    kept = [c for c in df.columns if not c.startswith("_in_")]
    return out.select(
        *kept,
        (F.col("_row") - F.col("_first") + F.col("_before")).alias("rank"), "group_n",
        *[c for x in totals for c in (
            (F.coalesce(F.col(f"_run_{x}"), F.lit(0)) + F.col(f"_before_{x}")).alias(x), f"{x}_all")],
        *[F.coalesce(F.col(f"_run_{x}"), F.col(f"_before_{x}")).alias(x) for x in carry])


def order_statistics(df: DataFrame, by: Sequence[str], value: str, qs: Sequence[float]) -> DataFrame:
    """Exact quantiles of every group by linear interpolation, as `q` (the array, in the order of `qs`).

    Equal values are counted before they are ordered: a value may be that of any share of the rows, and a range sort
    brings equal values to one task.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_c"))
    ranked = ordered(counts, by, [value], totals={"_upto": F.col("_c")})
    at = F.array(*[F.lit(float(q)) for q in qs])
    holds = lambda rank: (rank < F.col("_upto")) & (rank >= F.col("_upto") - F.col("_c"))                 # noqa: E731
    hits = (ranked.select(*by, value, "_c", "_upto", F.col("_upto_all").alias("group_n"), F.posexplode(at).alias("i", "q"))
            .withColumn("h", (F.col("group_n") - 1) * F.col("q"))
            .where(holds(F.floor("h")) | holds(F.ceil("h"))))
    low = F.max(F.when(holds(F.floor("h")), F.col(value)))
    high = F.max(F.when(holds(F.ceil("h")), F.col(value)))
    share = F.max(F.col("h") - F.floor("h"))
    per_q = hits.groupBy(*by, "i").agg((low + (high - low) * share).alias("v"), F.max("group_n").alias("group_n"))
    return per_q.groupBy(*by).agg(
        F.max("group_n").alias("group_n"),
        F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("q"))


def hash_ordered(df: DataFrame, by: Sequence[str], u: str, tie: Sequence[str],
                 totals: Mapping[str, Column] | None = None, buckets: int = SLICES) -> DataFrame:
    """`ordered` for an order that is a hash number in [0, 1): the slices are known beforehand.

    Equal cuts of a uniform number are equal shares of any group, so nothing has to be sampled or staged.
    """
    totals = dict(totals or {})
    by = list(by)
    df = df.withColumn("_slice", F.floor(F.col(u) * buckets))
    for x, value in totals.items():
        df = df.withColumn(f"_in_{x}", value)
    local = Window.partitionBy(*by, "_slice").orderBy(u, *tie)
    out = df.withColumn("_local", F.row_number().over(local))
    upto = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for x in totals:
        out = out.withColumn(f"_run_{x}", F.sum(f"_in_{x}").over(upto))
    whole = Window.partitionBy(*by)
    before = whole.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    parts = df.groupBy(*by, "_slice").agg(F.count(F.lit(1)).alias("_n"),
                                          *[F.sum(f"_in_{x}").alias(f"_sum_{x}") for x in totals])
    parts = parts.select(
        *by, "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        F.sum("_n").over(whole).alias("group_n"),
        *[c for x in totals for c in (
            F.coalesce(F.sum(f"_sum_{x}").over(before), F.lit(0)).alias(f"_before_{x}"),
            F.sum(f"_sum_{x}").over(whole).alias(f"{x}_all"))])
    kept = [c for c in df.columns if c != "_slice" and not c.startswith("_in_")]
    return out.join(parts, [*by, "_slice"]).select(
        *kept, (F.col("_local") - 1 + F.col("_before")).alias("rank"), "group_n",
        *[c for x in totals for c in ((F.col(f"_run_{x}") + F.col(f"_before_{x}")).alias(x), f"{x}_all")])


def smallest(df: DataFrame, by: Sequence[str], n: Column | int, seed: int, tag: str,
             key: Sequence[str]) -> DataFrame:
    """`n` rows of every group, drawn without replacement: those with the smallest hash numbers.

    Counts per slice of the hash say in which slices the first `n` lie; only those rows are ranked, all others
    are passed over while scanning. Adds `rank` and `group_n`.
    """
    by = list(by)
    n = F.lit(n) if isinstance(n, int) else n
    t = df.withColumn("_u", unit(seed, tag, *key)).withColumn("_n", n.cast("bigint"))
    t = t.withColumn("_slice", F.floor(F.col("_u") * SLICES))
    whole = Window.partitionBy(*by)
    before = F.coalesce(F.sum("_c").over(whole.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = t.groupBy(*by, "_slice").agg(F.count(F.lit(1)).alias("_c"), F.max("_n").alias("_m"))
    parts = parts.select(*by, "_slice", "_m", before.alias("_before"), F.sum("_c").over(whole).alias("group_n"))
    near = staged(parts.where(F.col("_before") < F.col("_m")).drop("_m"), "slices")
    local = Window.partitionBy(*by, "_slice").orderBy("_u", *key)
    out = t.join(near, [*by, "_slice"]).withColumn("rank", F.row_number().over(local) - 1 + F.col("_before"))
    return out.where(F.col("rank") < F.col("_n")).select(*df.columns, "rank", "group_n")


def running_median(df: DataFrame, by: Sequence[str], order: str, value: str, k: int, out: str,
                   slice_rows: int = 4096) -> DataFrame:
    """The median over the `k` rows on either side, for groups of any length.

    Groups are cut into slices of `slice_rows`; the `k` rows beyond each end are lent to the neighbour.
    """
    if k >= slice_rows:
        raise ValueError("the half width must be below the slice length")
    r = ordered(df, by, [order])
    home = F.floor(F.col("rank") / slice_rows)
    lent = F.array_distinct(F.array(F.floor((F.col("rank") - k) / slice_rows), home,
                                    F.floor((F.col("rank") + k) / slice_rows)))
    r = (r.withColumn("_home", home).withColumn("_slice", F.explode(lent))
         .where((F.col("_slice") >= 0)))
    w = Window.partitionBy(*by, "_slice").orderBy("rank").rowsBetween(-k, k)
    return (r.withColumn(out, F.percentile(value, F.lit(0.5)).over(w))
            .where(F.col("_home") == F.col("_slice")).drop("_home", "_slice", "rank", "group_n"))
