"""Features of a candidate from the grid around it."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.guards import refuse
from ..functions.keys import EVENT_KEY
from ..functions.runs import run_ends, whole_runs
from .grid import PROFILE

COARSE, FINE, CANDIDATE = range(3)


def _step(i: int) -> str:
    return f"m{-i}" if i < 0 else f"p{i}"


def window_features(candidates: DataFrame, coarse: DataFrame, fine: DataFrame, channels: Sequence[str],
                    half_width: int, coarse_width: float, fine_width: float) -> DataFrame:
    """One row per candidate. Per channel, for the grid bins `i` from `-half_width` to `half_width` around it:

    `<ch>_rel_i`       the coarse scaled residual minus the one at the level
    `<ch>_prof_i`      the coarse bin mean
    `<ch>_fine_dev_i`  the fine residual
    and over the coarse bins `<ch>_min_res`, `<ch>_max_res`, `<ch>_res_at_det`, `<ch>_res_abs_at_det`.

    A range join on pressure would pair every level of a profile with every candidate of it, a join on bins
    would make a row per candidate and offset. Candidates and both grids meet in one shuffle by profile
    instead, and a task looks the bins up in each sorted profile.
    """
    name = _step
    steps = range(-half_width, half_width + 1)
    ident = ["pool_id", "wmo", "cycle_number", "pres_adjusted", *EVENT_KEY]
    bin_of = lambda width: F.floor(F.col("pres_adjusted") / width)
    c_values = {**{f"r_{c}": f"{c}_scale_res_rob" for c in channels}, **{f"v_{c}": c for c in channels}}
    f_values = {f"d_{c}": f"{c}_res" for c in channels}

    def side(kind: int, grid: DataFrame, width: float, values: dict[str, str]) -> DataFrame:
        return (grid.select(F.lit(kind).alias("_kind"), *PROFILE, bin_of(width).alias("_bin"), *[F.col(c).alias(a) for a, c in values.items()])
                .dropna(subset=[*PROFILE, "_bin"]))

    asked = candidates.dropna(subset=ident).select(F.lit(CANDIDATE).alias("_kind"), *ident, bin_of(coarse_width).alias("_bin"), bin_of(fine_width).alias("_fine"))
    rows = (side(COARSE, coarse, coarse_width, c_values).unionByName(side(FINE, fine, fine_width, f_values), allowMissingColumns=True)
            .unionByName(asked, allowMissingColumns=True))
    type_of = {f.name: f.dataType for f in rows.schema.fields}
    found = [T.StructField(f"{a}_{name(i)}", type_of[a]) for a in (*c_values, *f_values) for i in steps]
    found += [T.StructField(f"low_{c}", type_of[f"r_{c}"]) for c in channels]
    out = (rows.repartition(*PROFILE).sortWithinPartitions(*PROFILE, "_kind", "_bin", *[c for c in ident if c not in PROFILE])
           .mapInArrow(whole_runs(PROFILE, _looked_up(ident, list(c_values), list(f_values), [f"r_{c}" for c in channels], steps)),
                       T.StructType([T.StructField(c, type_of[c]) for c in ident] + found)))
    at = lambda a, i: F.col(f"{a}_{name(i)}")
    highest = lambda c: F.greatest(*[at(f"r_{c}", i) for i in steps]) if half_width else at(f"r_{c}", 0)
    return out.select(
        *ident, *[x for c in channels for x in (
            *[(at(f"r_{c}", i) - at(f"r_{c}", 0)).alias(f"{c}_rel_{name(i)}") for i in steps],
            *[at(f"v_{c}", i).alias(f"{c}_prof_{name(i)}") for i in steps],
            F.col(f"low_{c}").alias(f"{c}_min_res"), highest(c).alias(f"{c}_max_res"), at(f"r_{c}", 0).alias(f"{c}_res_at_det"))],
        *[F.abs(at(f"r_{c}", 0)).alias(f"{c}_res_abs_at_det") for c in channels],
        *[at(f"d_{c}", i).alias(f"{c}_fine_dev_{name(i)}") for c in channels for i in steps])


def _one_a_bin(values: pa.Array, starts: np.ndarray, sizes: np.ndarray, least: bool) -> pa.Array:
    """The largest value (or the least) of the rows of each bin; NaN is the largest of all."""
    if (sizes == 1).all():
        return values
    rank = lambda v: (v != v, v)
    pick = min if least else max
    own = values.to_pylist()
    some = [[v for v in own[a:a + n] if v is not None] for a, n in zip(starts.tolist(), sizes.tolist())]
    return pa.array([pick(v, key=rank) if v else None for v in some], type=values.type)


def _looked_up(ident: list[str], c_values: list[str], f_values: list[str], lows: list[str], steps: range):
    """Whole profiles, each its coarse bins, its fine bins and its candidates -> the candidates with the values around them."""
    def work(rows: pa.RecordBatch, ends: np.ndarray) -> pa.RecordBatch:
        profile = np.repeat(np.arange(len(ends)), np.diff(np.r_[0, ends]))
        kind = rows.column("_kind").to_numpy()
        at = np.nonzero(kind == CANDIDATE)[0]
        asked = rows.take(pa.array(at))
        if len(at):                                     # a candidate is one row; copies lie side by side
            first = np.r_[0, run_ends(asked, ident)[:-1]]
            at, asked = at[first], asked.take(pa.array(first))
        columns = {c: asked.column(c) for c in ident}
        for code, names, own_bin in ((COARSE, c_values, "_bin"), (FINE, f_values, "_fine")):
            grid_at = np.nonzero(kind == code)[0]
            grid = rows.take(pa.array(grid_at))
            bins, place = np.unique(grid.column("_bin").to_numpy(zero_copy_only=False), return_inverse=True)
            keys, starts, sizes = np.unique(profile[grid_at] * (len(bins) + 1) + place, return_index=True, return_counts=True)
            most = {a: _one_a_bin(grid.column(a), starts, sizes, False) for a in names}
            least = {a: _one_a_bin(grid.column(a), starts, sizes, True) for a in names if a in lows}
            around = {a: [] for a in least}
            center = asked.column(own_bin).to_numpy(zero_copy_only=False).astype(np.int64)
            for i in steps:
                nth = np.searchsorted(bins, center + i)
                there = np.r_[bins, 0][nth] == center + i
                there &= nth < len(bins)
                key = profile[at] * (len(bins) + 1) + nth
                hit = np.searchsorted(keys, key)
                there &= np.r_[keys, -1][hit] == key
                take = pa.array(np.where(there, hit, 0), mask=~there)
                for a in names:
                    columns[f"{a}_{_step(i)}"] = most[a].take(take)
                for a in least:
                    around[a].append(least[a].take(take))
            for a in least:                             # nulls and NaNs are passed over, unless there is nothing else
                columns[f"low_{a[2:]}"] = pc.min_element_wise(*around[a])
        order = [*ident, *[f"{a}_{_step(i)}" for a in (*c_values, *f_values) for i in steps], *[f"low_{a[2:]}" for a in lows]]
        return pa.RecordBatch.from_arrays([columns[c] for c in order], names=order)
    return work


def require_covered(candidates: DataFrame, features: DataFrame) -> None:
    """Every candidate has a feature row."""
    key = ["pool_id", *EVENT_KEY]
    refuse(candidates.join(features.select(*key), key, "left_anti").groupBy("pool_id", "wmo").count(),
           "floats whose candidates have no features")


def first_floats(df: DataFrame, n: int) -> DataFrame:
    """A dry run's share: the rows of the first `n` floats."""
    return df.join(df.select("wmo").distinct().orderBy("wmo").limit(n), "wmo", "left_semi")
