"""Gridding, the multi-channel threshold gate, nesting, and the checks of a grid source.

The gridding and gradient formulas are this engine's own (see README): the knobs carry the usual names.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.guards import Refused, refuse
from ..functions.keys import EVENT_KEY
from ..functions.runs import whole_runs
from .rows import dedup

PROFILE = ("wmo", "cycle_number")
IQR_OF_A_NORMAL = 1.349         # fixed value: the interquartile range of a standard normal
STRIP = 1 << 14                 # rows whose windows are taken at once


@dataclass(frozen=True)
class Knobs:
    """How a profile is binned and what its background and scale are."""

    bin_width_fine: float = 10.0
    bin_width_coarse: float = 40.0
    trimmed_mean_window: int = 5        # bins on either side
    trimmed_mean_min_periods: int = 3
    trimmed_mean_lo: float = 0.2
    trimmed_mean_hi: float = 0.8
    scale_window: int = 10
    scale_min_periods: int = 3


@dataclass(frozen=True)
class Term:
    """One channel's part of a gate."""

    channel: str
    cutoff: float
    sign: str | None = None             # positive, negative, or either
    gradient: bool = False


@dataclass(frozen=True)
class Gate:
    """A pool and the terms every one of its candidates passes."""

    pool_id: str
    terms: tuple[Term, ...]
    parent: str | None = None
    spec_id: str = ""
    pres_min: float = 0.0
    pres_max: float = 1000.0
    gradient_window: int = 1            # bins on either side
    needs: tuple[str, ...] = field(default=())


def _around(v: np.ndarray, start: np.ndarray, end: np.ndarray, k: int, rows: np.ndarray) -> np.ndarray:
    """The values of the `k` rows on either side of `rows` and their own, within [start, end); NaN beyond."""
    at = rows[:, None] + np.arange(-k, k + 1)[None, :]
    inside = (at >= start[rows, None]) & (at < end[rows, None])
    return np.where(inside, v[np.clip(at, 0, len(v) - 1)], np.nan)


def _trimmed_means(v: np.ndarray, there: np.ndarray, start: np.ndarray, end: np.ndarray, knobs: Knobs) -> tuple[np.ndarray, np.ndarray]:
    """The trimmed running mean, and where there is one. What is not there is NaN in `v`; a NaN that is there is the greatest value."""
    mean, has = np.empty(len(v)), np.empty(len(v), dtype=bool)
    for rows in _strips(len(v)):
        n = np.nansum(_around(there.astype(float), start, end, knobs.trimmed_mean_window, rows), axis=1).astype(np.int64)
        values = np.sort(_around(v, start, end, knobs.trimmed_mean_window, rows), axis=1)
        first = np.floor(n * knobs.trimmed_mean_lo).astype(np.int64)
        last = np.minimum(np.maximum(np.ceil(n * knobs.trimmed_mean_hi).astype(np.int64), first + 1), n)
        total = np.zeros(len(rows))
        for i in range(values.shape[1]):                # in order, as the sum is defined
            total = np.where((first <= i) & (i < last), total + values[:, i], total)
        has[rows] = (n >= knobs.trimmed_mean_min_periods) & (last > first)
        mean[rows] = total / np.maximum(last - first, 1)
    return mean, has


def _quartile_ranges(v: np.ndarray, there: np.ndarray, start: np.ndarray, end: np.ndarray, knobs: Knobs) -> tuple[np.ndarray, np.ndarray]:
    """The running interquartile range in units of a normal's, by linear interpolation, and where there is one."""
    scale, has = np.empty(len(v)), np.empty(len(v), dtype=bool)
    for rows in _strips(len(v)):
        n = np.nansum(_around(there.astype(float), start, end, knobs.scale_window, rows), axis=1).astype(np.int64)
        values = np.sort(_around(v, start, end, knobs.scale_window, rows), axis=1)
        every = np.arange(len(rows))

        def quantile(q: float) -> np.ndarray:
            place = np.maximum(n - 1, 0) * q
            low, high = np.floor(place), np.ceil(place)
            a, b = values[every, low.astype(np.int64)], values[every, high.astype(np.int64)]
            return np.where(a == b, a, np.where(low == high, a, (high - place) * a + (place - low) * b))

        has[rows] = (n >= knobs.scale_min_periods) & (n > 0)
        scale[rows] = (quantile(0.75) - quantile(0.25)) / IQR_OF_A_NORMAL
    return scale, has


def _strips(n: int) -> Iterator[np.ndarray]:
    return (np.arange(k, min(k + STRIP, n)) for k in range(0, n, STRIP))


def _residuals(values: list[str], added: list[str], knobs: Knobs):
    """Rows by profile and bin -> the same with the residual and the scale of every channel."""
    def profiles(rows: pa.RecordBatch, ends: np.ndarray) -> pa.RecordBatch:
        sizes = np.diff(np.r_[0, ends])
        start, end = np.repeat(np.r_[0, ends[:-1]], sizes), np.repeat(ends, sizes)
        residuals, scales = [], []
        with np.errstate(all="ignore"):
            for c in values:
                v, there = rows.column(c).to_numpy(zero_copy_only=False), rows.column(c).is_valid().to_numpy(zero_copy_only=False)
                mean, has = _trimmed_means(v, there, start, end, knobs)
                has &= there
                left = np.where(has, v - mean, np.nan)
                residuals.append(pa.array(left, mask=~has))
                scale, known = _quartile_ranges(left, has, start, end, knobs)
                scales.append(pa.array(scale, mask=~known))
        kept = rows.drop_columns(values)
        return pa.RecordBatch.from_arrays([*kept.columns, *residuals, *scales], names=[*kept.schema.names, *added])

    return whole_runs(PROFILE, profiles)


def residual_grid(raw: DataFrame, channels: Sequence[str], knobs: Knobs = Knobs(), resolution: str = "coarse",
                  pressure: str = "pres_adjusted") -> DataFrame:
    """Bin means, and per channel the residual from a trimmed running mean in units of a robust scale.

    Binning aggregates on the map side; after it a profile is one row per bin, so the windows along the
    profile are bounded by the number of bins however many raw levels a float holds. A task gets whole profiles in
    order and takes the windows of a batch of rows at once; Spark's own windows would count each frame anew.
    """
    width = knobs.bin_width_coarse if resolution == "coarse" else knobs.bin_width_fine
    binned = (raw.withColumn("bin", F.floor(F.col(pressure) / width).cast("bigint"))
              .groupBy(*PROFILE, "bin").agg(*[F.avg(c).alias(c) for c in channels]))
    binned = (binned.withColumn("pres_adjusted", F.col("bin") * F.lit(width)).withColumn("resolution", F.lit(resolution))
              .withColumns({f"_v_{c}": F.col(c).cast("double") for c in channels}))
    added = [f"{c}_res" for c in channels] + [f"{c}_iqrn" for c in channels]
    kept = [f for f in binned.schema.fields if not f.name.startswith("_v_")]
    out = (binned.repartition(*PROFILE).sortWithinPartitions(*PROFILE, "bin")
           .mapInArrow(_residuals([f"_v_{c}" for c in channels], added, knobs), StructType(kept + [StructField(c, DoubleType()) for c in added])))
    for c in channels:
        out = out.withColumn(f"{c}_scale_res_rob", F.when(F.col(f"{c}_iqrn") > 0, F.col(f"{c}_res") / F.col(f"{c}_iqrn")))
    return out


def grid_kind_earned(raw: DataFrame, kinds: DataFrame) -> DataFrame:
    """The richest declared kind whose channels the float has: `wmo, channel, value` rows in,
    `kinds(grid_kind, channels)` beside them."""
    have = (raw.where(F.col("value").isNotNull()).groupBy("wmo").agg(F.collect_set("channel").alias("_have")))
    # kinds is a handful of declared rows, so pairing it with the floats multiplies by that handful
    fits = have.join(kinds, F.size(F.array_except("channels", "_have")) == 0)
    return fits.groupBy("wmo").agg(
        F.max_by("grid_kind", F.struct(F.size("channels"), "grid_kind")).alias("grid_kind"))


def _passes(df: DataFrame, gate: Gate, along: Window) -> Column:
    ok = F.col("pres_adjusted").between(gate.pres_min, gate.pres_max)
    for t in gate.terms:
        r = F.col(f"{t.channel}_scale_res_rob")
        ok = ok & (F.abs(r) >= t.cutoff)
        if t.sign == "positive":
            ok = ok & (r > 0)
        elif t.sign == "negative":
            ok = ok & (r < 0)
        if t.gradient:
            # the anomaly stands out of its neighbourhood: both sides, within the window, lie nearer to zero
            near = [F.coalesce(f(r, k).over(along), F.lit(0.0)) for f in (F.lag, F.lead)
                    for k in range(1, gate.gradient_window + 1)]
            side = lambda vals: F.least(*[F.abs(v) for v in vals]) if len(vals) > 1 else F.abs(vals[0])
            before, after = near[:gate.gradient_window], near[gate.gradient_window:]
            ok = ok & (F.abs(r) > side(before)) & (F.abs(r) > side(after))
    return F.coalesce(ok, F.lit(False))


def detect(grids: DataFrame, gates: Sequence[Gate], measures: Sequence[str] = ()) -> DataFrame:
    """The levels each gate flags, all pools in one scan of the grids."""
    along = Window.partitionBy(*PROFILE).orderBy("pres_adjusted")
    have = {c.lower() for c in grids.columns}
    for g in gates:
        lacking = [t.channel for t in g.terms if f"{t.channel}_scale_res_rob".lower() not in have]
        if lacking:
            raise Refused(f"{g.pool_id}: the grid carries no {lacking}")
    flags = {f"_pass_{i}": _passes(grids, g, along) for i, g in enumerate(gates)}
    hit = F.filter(F.array(*[F.when(F.col(f"_pass_{i}"), F.struct(F.lit(g.pool_id).alias("pool_id"),
                                                                F.lit(g.spec_id).alias("spec_id")))
                             for i, g in enumerate(gates)]), lambda s: s.isNotNull())
    return (grids.withColumns(flags).withColumn("_hit", F.explode(hit))
            .select(F.col("_hit.pool_id"), F.col("_hit.spec_id"), *PROFILE, "pres_adjusted", *measures))


def require_parents(pools: DataFrame) -> None:
    """A child pool asked for without its parent is refused. `pools(pool_id, parent)`."""
    children = pools.where(F.col("parent").isNotNull())
    refuse(children.join(pools.select(F.col("pool_id").alias("parent")), "parent", "left_anti"),
           "children requested without their parents")


def nest(candidates: DataFrame, pools: DataFrame) -> DataFrame:
    """A child's candidates are kept only where the key is in its own parent."""
    named = candidates.join(pools.select("pool_id", "parent"), "pool_id", "left")
    parents = candidates.select(F.col("pool_id").alias("parent"), *EVENT_KEY).distinct()
    top = named.where(F.col("parent").isNull())
    kept = named.where(F.col("parent").isNotNull()).join(parents, ["parent", *EVENT_KEY], "left_semi")
    return top.drop("parent").unionByName(kept.drop("parent"))


def verify_set(saved: DataFrame, regenerated: DataFrame, by: str = "pool_id") -> DataFrame:
    """Key sets compared pool by pool: anything but exact is a failure."""
    key = [by, *EVENT_KEY]
    side = lambda df, bit: df.select(*key).distinct().withColumn("_side", F.lit(bit))
    both = side(saved, 1).unionByName(side(regenerated, 2)).groupBy(*key).agg(F.sum("_side").alias("_side"))
    out = both.groupBy(by).agg(
        F.count_if(F.col("_side") != 2).alias("saved"), F.count_if(F.col("_side") != 1).alias("regenerated"),
        F.count_if(F.col("_side") == 1).alias("saved_only"), F.count_if(F.col("_side") == 2).alias("new_only"))
    return out.withColumn("exact", (F.col("saved_only") == 0) & (F.col("new_only") == 0))


def build_manifest(grids: DataFrame, fleet: DataFrame, exclusions: DataFrame, channel: str) -> DataFrame:
    """Per promised float: the kind promised and earned, rows, profiles, missing readings, and its standing."""
    built = grids.groupBy("wmo").agg(
        F.min("grid_kind").alias("earned_kind"), F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct("cycle_number").alias("n_cycles"),
        F.count_if(F.col(channel).isNull()).alias("n_masked"))
    out = (fleet.select("wmo", F.col("grid_kind").alias("promised_kind"))
           .join(built, "wmo", "full_outer")
           .join(exclusions.select("wmo", "reason"), "wmo", "left"))
    status = (F.when(F.col("reason").isNotNull(), "excluded")
              .when(F.col("promised_kind").isNull(), "not promised")
              .when(F.col("earned_kind").isNull(), "missing")
              .when(F.col("earned_kind") != F.col("promised_kind"), "other kind").otherwise("ok"))
    return out.withColumn("status", status)


def grid_health(grids: DataFrame, channels: Sequence[str], ceilings: Mapping[str, float | None],
                fills: Sequence[float], by: Sequence[str] = ("wmo",)) -> DataFrame:
    """Per grid and channel: surviving placeholders, levels above the ceiling, share of plausible readings.

    A channel without a ceiling is reported, never judged by one.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("channel"), F.col(c).cast("double").alias("v"),
                               F.lit(ceilings.get(c)).cast("double").alias("ceiling")) for c in channels])
    long = grids.select(*by, F.explode(pairs).alias("_p")).select(*by, "_p.*")
    v, top = F.col("v"), F.col("ceiling")
    is_fill = v.isin(*[float(f) for f in fills])
    over = top.isNotNull() & (F.abs(v) > top)
    plausible = v.isNotNull() & ~F.isnan(v) & ~is_fill & ~F.coalesce(over, F.lit(False))
    out = long.groupBy(*by, "channel").agg(
        F.count(F.lit(1)).alias("levels"), F.count_if(is_fill).alias("fills"),
        F.count_if(over).alias("over_ceiling"), (F.count_if(plausible) / F.count(F.lit(1))).alias("share_ok"))
    return out.withColumn("healthy", (F.col("fills") == 0) & (F.col("over_ceiling") == 0))


def table_digest(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """The row count and an order-independent digest of the whole content of every group."""
    rest = sorted(c for c in df.columns if c not in by)
    h = F.xxhash64(*[F.col(c) for c in rest])
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.bit_xor(h).alias("_x"),
                               F.sum(h.cast("decimal(20,0)")).alias("_s"))


def compare_rebuild(bound: DataFrame, rebuilt: DataFrame, by: Sequence[str] = ("wmo", "resolution")) -> DataFrame:
    """Per grid: SAME, DIFF, or where it is missing."""
    a, b = table_digest(bound, by).alias("a"), table_digest(rebuilt, by).alias("b")
    joined = a.join(b, list(by), "full_outer")
    same = F.col("a.n").eqNullSafe(F.col("b.n")) & F.col("a._x").eqNullSafe(F.col("b._x")) \
        & F.col("a._s").eqNullSafe(F.col("b._s"))
    status = (F.when(F.col("a.n").isNull(), "missing from the bound source")
              .when(F.col("b.n").isNull(), "missing from the rebuild").when(same, "SAME").otherwise("DIFF"))
    return joined.select(*by, F.col("a.n").alias("rows_bound"), F.col("b.n").alias("rows_rebuilt"), status.alias("status"))


def require_on_list(wanted: DataFrame, fleet: DataFrame, exclusions: DataFrame) -> None:
    """Floats asked for must be on the fleet list and not excluded."""
    refuse(wanted.join(fleet.select("wmo"), "wmo", "left_anti"), "floats that are not on the fleet list")
    refuse(wanted.join(exclusions.select("wmo"), "wmo", "left_semi"), "floats that are excluded")


def require_other_folder(target: str, bound: str) -> None:
    """A build never writes into the source the study is bound to."""
    t, b = target.rstrip("/") + "/", bound.rstrip("/") + "/"
    if t.startswith(b):
        raise Refused(f"{target} lies inside the bound source {bound}")


def unique_candidates(flagged: DataFrame) -> DataFrame:
    """One row per exact level, as the gate may flag a level of a repeated grid twice."""
    rest = [c for c in flagged.columns if c not in ("pool_id", *PROFILE, "pres_adjusted")]
    return dedup(flagged, ["pool_id", *PROFILE, "pres_adjusted"], rest or ["pres_adjusted"])
