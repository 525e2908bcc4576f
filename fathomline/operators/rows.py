"""Row-level work: column choice, filters, masks, de-duplication."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StructType

from ..functions.guards import Refused
from ..functions.keys import EVENT_KEY, KEYS
from ..functions.ordered import running_median

# fixed values: columns that say what a row is, not what was measured there
IDENTITY = {*KEYS, *EVENT_KEY, "event_type", "pool_id", "spec_id", "latitude", "longitude", "abs_latitude"}
# fixed values: the blind worksheet, and what it may never show
WORKSHEET = ("label", "sample_id", "wmo", "cycle_number", "pres_adjusted", "latitude", "longitude", "time", "event_type")
HIDDEN = {"score", "stratum", "src", "inclusion_probability", "candidate_id", "ref_label", "decile",
          "design_stratum", "region", "control_arm", "previously_judged"}


def feature_columns(df: DataFrame) -> list[str]:
    """The numeric columns that are neither identity nor geography."""
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, NumericType) and f.name.lower() not in IDENTITY]


def numeric_only(df: DataFrame) -> DataFrame:
    """The event key and the numeric columns."""
    return df.select(*[c for c in df.columns if c in EVENT_KEY or c == "pool_id"], *feature_columns(df))


def dedup(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first row of every key. `order` should be total, so that the row kept does not depend on partitions.

    The `= 1` filter lets Spark drop the other rows before the shuffle, so many copies of one key stay cheap.
    """
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """Exactly the columns of `schema`, in its order and types; an absent measure is null."""
    have = {c.lower(): c for c in df.columns}
    return df.select(*[(F.col(have[f.name.lower()]) if f.name.lower() in have else F.lit(None))
                       .cast(f.dataType).alias(f.name) for f in schema.fields])


def valid_range(df: DataFrame, channel: str, lo: float, hi: float, policy: str, tolerance: float = 0.0,
                by: Sequence[str] = ("wmo", "cycle_number")) -> DataFrame:
    """What happens to a reading outside [lo, hi].

    `mask`: it becomes null. `clip`: within `tolerance` beyond an edge it is moved to the edge, further
    out it becomes null. `drop_cycle`: its whole profile goes.
    """
    c = F.col(channel)
    if policy == "mask":
        return df.withColumn(channel, F.when(c.between(lo, hi), c))
    if policy == "clip":
        near = c.between(lo - tolerance, hi + tolerance)
        return df.withColumn(channel, F.when(near, F.least(F.greatest(c, F.lit(lo)), F.lit(hi))))
    if policy == "drop_cycle":
        return df.join(df.where(~c.between(lo, hi)).select(*by).distinct(), list(by), "left_anti")
    raise Refused(f"unknown range policy {policy!r}")


def mask_fill(df: DataFrame, columns: Sequence[str], fills: Sequence[float], abs_min: float | None = None) -> DataFrame:
    """Placeholder values become null, before anything is derived from them."""
    def one(c: Column) -> Column:
        bad = c.isin(*[float(f) for f in fills])
        if abs_min is not None:
            bad = bad | (F.abs(c) >= abs_min)
        return F.when(~bad, F.nanvl(c, F.lit(None).cast("double")))
    return df.withColumns({c: one(F.col(c).cast("double")) for c in columns})


def in_window(df: DataFrame, since: str, until: str, time: str = "time") -> DataFrame:
    """Profiles between two dates, both days whole; as a range on the raw column, so it reaches the scan."""
    t = F.col(time)
    return df.where((t >= F.lit(since).cast("date").cast("timestamp"))
                    & (t < F.date_add(F.lit(until).cast("date"), 1).cast("timestamp")))


def exclude(df: DataFrame, exclusions: DataFrame, by: str = "wmo") -> tuple[DataFrame, DataFrame]:
    """(the rows kept, one row per declared exclusion with how many rows it removed)."""
    kept = df.join(exclusions.select(by).distinct(), by, "left_anti")
    removed = (df.join(exclusions.select(by).distinct(), by, "left_semi").groupBy(by)
               .agg(F.count(F.lit(1)).alias("rows_removed")))
    report = exclusions.join(removed, by, "left").withColumn("rows_removed", F.coalesce("rows_removed", F.lit(0)))
    return kept, report


def adjusted_or_raw(df: DataFrame, adjusted: str, raw: str, out: str,
                    by: Sequence[str] = ("wmo", "cycle_number")) -> DataFrame:
    """A profile without any adjusted value reads its raw column; the choice is per profile.

    The flag is aggregated (combining on the map side) and joined, so a long profile is never one window.
    """
    flag = df.groupBy(*by).agg(F.bool_or(F.col(adjusted).isNotNull()).alias("_has_adjusted"))
    return (df.join(flag, list(by))
            .withColumn(out, F.when(F.col("_has_adjusted"), F.col(adjusted)).otherwise(F.col(raw)))
            .drop("_has_adjusted"))


def median_smooth(df: DataFrame, channel: str, k: int, out: str | None = None, pressure: str = "pres_adjusted",
                  by: Sequence[str] = ("wmo", "cycle_number")) -> DataFrame:
    """The backscatter prefilter: the median of the reading and its `k` neighbours on either side."""
    return running_median(df, by, pressure, channel, k, out or f"{channel}_smooth")


def apply_alignment(df: DataFrame, rule: Mapping[str, str]) -> DataFrame:
    """Features of one limb in the sense of the other's. A rule is `keep`, `flip` (negated), or `swap_negate:<feature>` (that
    feature's values, negated); a feature without one is kept."""
    parts = {c: rule.get(c, "keep").partition(":") for c in df.columns}
    values = {c: F.col(partner or c) for c, (_, _, partner) in parts.items()}
    return df.select(*[(values[c] if action == "keep" else F.negative(values[c])).alias(c) for c, (action, _, _) in parts.items()])


def blind(df: DataFrame) -> DataFrame:
    """The nine worksheet columns, with an empty label; nothing that would tell the reviewer more."""
    out = df.withColumn("label", F.lit(None).cast("double")).select(*WORKSHEET)
    shown = HIDDEN & {c.lower() for c in out.columns}
    if shown:
        raise Refused(f"the worksheet is not blind: {sorted(shown)}")
    return out
