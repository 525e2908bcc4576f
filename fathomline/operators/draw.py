"""The draw: clusters, one row per cluster, controls, the order of a sheet and its sittings.

All randomness is a hash of a seed and the row's own key, so a draw never depends on partitions.
A draw is bounded by the largest solvable size (20,000 rows); the frame it is drawn from is not.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.guards import Refused, refuse
from ..functions.hashing import unit
from ..functions.keys import EVENT_KEY
from ..functions.ordered import hash_ordered, ordered, smallest
from ..functions.staging import staged
from .allocation import POOL, STRATUM
from .rows import blind, dedup

# fixed values
TARGET, POS_CTRL, NEG_CTRL = "target", "pos_ctrl", "neg_ctrl"
MAX_SHEET_ROWS = 120            # one sitting
N_CONTROLS = 20                 # of either arm, per rate batch
NEG_SCORE_CAP = 0.5             # negatives the score calls likely are no controls
CELL_ORDER = ("cycle_number", "pres_adjusted")


def _chunk_rows(frame_n: str = "frame_n", draw_n: str = "draw_n") -> Column:
    """Most rows of one float a cluster may hold, so that no cluster is drawn with probability above 1."""
    return F.greatest(F.lit(1), F.floor(F.col(frame_n) / F.col(draw_n)))


def clusters(df: DataFrame, strata: DataFrame, by: Sequence[str] = (POOL, STRATUM)) -> DataFrame:
    """Adds `cluster`: the float, cut into chunks where it holds more than its share of the stratum."""
    placed = ordered(df, [*by, "wmo"], list(CELL_ORDER))
    sized = placed.drop("group_n").join(
        strata.select(*by, _chunk_rows().alias("_m")), list(by))
    chunk = F.floor(F.col("rank") / F.col("_m"))
    return sized.withColumn("cluster", F.concat_ws("#", F.col("wmo").cast("string"), chunk.cast("string"))).drop("rank", "_m")


def float_sizes(df: DataFrame, by: Sequence[str] = (POOL, STRATUM)) -> DataFrame:
    """Rows per float and stratum, written once: a draw reads them three times, and further draws from the same frame can share them."""
    return staged(df.groupBy(*by, "wmo").agg(F.count(F.lit(1)).alias("_c")), "float_sizes")


def cluster_sizes(per_float: DataFrame, strata: DataFrame, by: Sequence[str] = (POOL, STRATUM)) -> DataFrame:
    """The clusters without their rows: counts per float are enough to know every chunk's size."""
    drawn = strata.where(F.col("draw_n") > 0).select(*by, "frame_n", "draw_n", _chunk_rows().alias("_m"))
    t = per_float.join(drawn, list(by))
    t = t.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.ceil(F.col("_c") / F.col("_m")) - 1)))
    return t.withColumn("size", F.least(F.col("_m"), F.col("_c") - F.col("chunk") * F.col("_m"))).drop("_c")


def require_drawable(strata: DataFrame, by: Sequence[str] = (POOL, STRATUM)) -> None:
    refuse(strata.where(F.coalesce(F.col("draw_n") > F.col("frame_n"), F.lit(True)) | (F.col("draw_n") < 0))
           .select(*by, "frame_n", "draw_n"), "strata that hold fewer rows than are to be drawn")


def draw_one_per_cluster(df: DataFrame, strata: DataFrame, seed: int,
                         by: Sequence[str] = (POOL, STRATUM), per_float: DataFrame | None = None) -> DataFrame:
    """`draw_n` rows of every stratum, at most one per cluster, each with inclusion probability draw_n / frame_n.

    Systematic sampling along the clusters in hash order: with S the running size, n S / N grows by a
    cluster's selection probability, and the cluster is hit where ceil(n S / N - u) steps up. One place in each
    hit cluster is then drawn, and only the floats that were hit are sorted to find the row at that place.
    `per_float`: the frame's `float_sizes`, where they are known already.
    """
    by = list(by)
    require_drawable(strata, by)
    c = cluster_sizes(float_sizes(df, by) if per_float is None else per_float, strata, by)
    held = strata.select(*by, "frame_n", "draw_n").join(c.groupBy(*by).agg(F.sum("size").alias("rows")), by, "left")
    refuse(held.where((F.col("draw_n") > 0) & (F.coalesce("rows", F.lit(0)) != F.col("frame_n"))), "strata whose frame does not hold the rows they say")
    c = c.withColumn("_u", unit(seed, "cluster", *by, "wmo", "chunk"))
    c = hash_ordered(c, by, "_u", ["wmo", "chunk"], {"_s": F.col("size")})
    start = unit(seed, "start", *by)
    step = lambda s: F.ceil(F.col("draw_n") * s / F.col("frame_n") - start)
    hit = c.where(step(F.col("_s")) > step(F.col("_s") - F.col("size")))
    inside = F.floor(unit(seed, "place", *by, "wmo", "chunk") * F.col("size"))
    # at most draw_n rows per stratum
    hits = staged(hit.select(*by, "wmo", (F.col("chunk") * F.col("_m") + inside).alias("_place"),
                             (F.col("draw_n") / F.col("frame_n")).alias("inclusion_probability")), "hits")
    floats = hits.select(*by, "wmo").distinct()
    row = [*by, "wmo", *CELL_ORDER]
    places = ordered(df.select(*row).join(floats, [*by, "wmo"], "left_semi"), [*by, "wmo"], list(CELL_ORDER))
    chosen = (places.join(hits.withColumnRenamed("_place", "rank"), [*by, "wmo", "rank"])
              .select(*row, "inclusion_probability"))
    return df.join(staged(chosen, "chosen"), row)


def draw_controls(df: DataFrame, n: int, seed: int, tag: str = "control", by: Sequence[str] = (POOL,),
                  exclude_floats: DataFrame | None = None) -> DataFrame:
    """`n` random floats of each group (all, where there are fewer) and one random row of each."""
    if exclude_floats is not None:
        df = df.join(exclude_floats, [*by, "wmo"], "left_anti")
    # floats first: only rows of those drawn are looked at
    floats = smallest(df.select(*by, "wmo").distinct(), by, n, seed, f"{tag}-float", [*by, "wmo"]).select(*by, "wmo")
    rows = df.join(staged(floats, "control_floats"), [*by, "wmo"], "left_semi")
    return dedup(rows, [*by, "wmo"], [unit(seed, f"{tag}-row", *by, *EVENT_KEY), *EVENT_KEY])


def blind_controls(pos: DataFrame, neg: DataFrame, science: DataFrame, n: int, seed: int,
                   by: Sequence[str] = (POOL,)) -> DataFrame:
    """`n` positive and `n` negative controls per group; none is a science row, none serves twice."""
    key = [*by, *EVENT_KEY]
    p = draw_controls(pos.join(science.select(*key), key, "left_anti"), n, seed, "pos", by)
    p = staged(p, "positives")
    q = draw_controls(neg.join(science.select(*key).unionByName(p.select(*key)), key, "left_anti"), n, seed, "neg", by)
    return (p.withColumn("control_arm", F.lit(POS_CTRL))
            .unionByName(q.withColumn("control_arm", F.lit(NEG_CTRL)), allowMissingColumns=True)
            .withColumn("inclusion_probability", F.lit(None).cast("double"))
            .withColumn("previously_judged", F.lit(True)))


def draw_per_cell(df: DataFrame, sizes: DataFrame, seed: int, by: Sequence[str] = ("batch_id", "cell"),
                  key: Sequence[str] = ("sample_id",)) -> DataFrame:
    """`draw_n` rows of every cell without replacement; refuses a cell that holds fewer. Adds the probability."""
    by = list(by)
    t = df.join(sizes.select(*by, "draw_n"), by)
    have = sizes.select(*by, "draw_n").join(df.groupBy(*by).agg(F.count(F.lit(1)).alias("have")), by, "left")
    refuse(have.where(F.coalesce("have", F.lit(0)) < F.col("draw_n")), "cells that hold fewer rows than are to be drawn")
    out = smallest(t, by, F.col("draw_n"), seed, "cell", [*by, *key])
    return out.withColumn("inclusion_probability", F.col("draw_n") / F.col("group_n")).drop("rank", "group_n", "draw_n")


def exclude_keys(df: DataFrame, seen: DataFrame, key: Sequence[str] = EVENT_KEY) -> DataFrame:
    return df.join(seen.select(*key).distinct(), list(key), "left_anti")


def calibration_draw(df: DataFrame, tiers: Sequence[tuple[str, Column, int]], seed: int,
                     by: Sequence[str] = (POOL,)) -> DataFrame:
    """One draw per tier in turn, `(name, which rows, how many)`, no float in two of them.

    Every tier is at most a few dozen rows, so what is carried from tier to tier stays that small.
    """
    drawn = None
    for i, (tier, which, n) in enumerate(tiers):
        used = None if drawn is None else drawn.select(*by, "wmo").distinct()
        rows = staged(draw_controls(df.where(which), n, seed, f"tier{i}", by, used).withColumn("tier", F.lit(tier)), "tier")
        short = df.select(*by).distinct().join(rows.groupBy(*by).agg(F.count(F.lit(1)).alias("drawn")), list(by), "left")
        refuse(short.where(F.coalesce("drawn", F.lit(0)) < n), f"tier {tier}: fewer than {n} rows to draw")
        drawn = rows if drawn is None else drawn.unionByName(rows)
    return drawn


def require_tiers_full(drawn: DataFrame, wanted: int, by: Sequence[str] = (POOL,)) -> None:
    refuse(drawn.groupBy(*by).count().where(F.col("count") != wanted), f"a calibration set is {wanted} rows")


def slot(i: Column, phase: Column, n_rows: Column, n_controls: Column) -> Column:
    """The position of the i-th control: one every n_rows / n_controls rows from a random offset."""
    return F.least(F.floor((i + phase) * n_rows / n_controls), n_rows - 1).cast("bigint")


def control_slots(sheets: DataFrame, seed: int, by: Sequence[str] = ("batch_id",)) -> DataFrame:
    """The control positions of every sheet. `sheets(n_rows, n_controls)` per batch."""
    refuse(sheets.where(F.col("n_controls") > F.col("n_rows")), "more controls than rows")
    t = sheets.where(F.col("n_controls") > 0).withColumn("phase", unit(seed, "slots", *by))
    t = t.withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_controls") - 1)))
    return t.select(*by, "i", slot(F.col("i"), F.col("phase"), F.col("n_rows"), F.col("n_controls")).alias("slot"))


def interleave(df: DataFrame, seed: int, by: Sequence[str] = ("batch_id",), arm: str = "control_arm",
               key: Sequence[str] = EVENT_KEY) -> DataFrame:
    """Adds `sample_id`, the review order: controls evenly spaced, each arm spread over them, science in the gaps.

    Windows are over one batch, which is a draw and so at most 20,000 rows and its controls.
    """
    by = list(by)
    batch = Window.partitionBy(*by)
    is_ctrl = F.coalesce(F.col(arm).isin(POS_CTRL, NEG_CTRL), F.lit(False))
    t = df.withColumn("_ctrl", is_ctrl).withColumn("_arm", F.when(F.col("_ctrl"), F.col(arm)).otherwise(F.lit("")))
    t = t.withColumn("_h", unit(seed, "order", *by, *key))
    t = t.withColumn("_n", F.count(F.lit(1)).over(batch)).withColumn("_k", F.count_if(F.col("_ctrl")).over(batch))
    in_arm = Window.partitionBy(*by, "_arm")
    t = t.withColumn("_ladder", (F.row_number().over(in_arm.orderBy("_h", *key)) - 1 + unit(seed, "ladder", *by, "_arm"))
                     / F.count(F.lit(1)).over(in_arm))
    kind = Window.partitionBy(*by, "_ctrl")
    t = t.withColumn("_r", F.row_number().over(kind.orderBy("_ladder", "_arm", "_h", *key)) - 1)
    phase = unit(seed, "slots", *by)
    # the j-th control stands after slot_j - j science rows; a science row moves on by the controls before it
    gaps = F.when(F.col("_k") > 0, F.transform(
        F.sequence(F.lit(0).cast("bigint"), F.col("_k") - 1),
        lambda j: slot(j, F.col("_phase"), F.col("_n"), F.col("_k")) - j))
    t = t.withColumn("_phase", phase).withColumn("_gaps", gaps)
    before = F.coalesce(F.size(F.filter("_gaps", lambda g: g <= F.col("_r"))), F.lit(0))
    before = F.when(F.col("_k") > 0, before).otherwise(F.lit(0))
    place = F.when(F.col("_ctrl"), slot(F.col("_r"), F.col("_phase"), F.col("_n"), F.col("_k"))).otherwise(F.col("_r") + before)
    return (t.withColumn("sample_id", place.cast("bigint"))
            .drop("_ctrl", "_arm", "_h", "_n", "_k", "_ladder", "_r", "_phase", "_gaps"))


def assemble(science: DataFrame, controls: DataFrame, seed: int, by: Sequence[str] = ("batch_id",)) -> tuple[DataFrame, DataFrame]:
    """(the blind worksheet, the answer key), both carrying `sample_id`. A row that appears twice is refused."""
    s = science.withColumn("control_arm", F.lit(TARGET)).withColumn("src", F.col(STRATUM))
    c = controls.withColumn("src", F.col("control_arm")).withColumn(STRATUM, F.col("control_arm"))
    rows = staged(s.unionByName(c, allowMissingColumns=True), "batch")
    refuse(rows.groupBy(*by, *EVENT_KEY).count().where(F.col("count") > 1), "one batch would show a level twice")
    key = interleave(rows, seed, by)
    for c_name in ("latitude", "longitude"):
        if c_name not in key.columns:
            key = key.withColumn(c_name, F.lit(None).cast("double"))
    if "time" not in key.columns:
        key = key.withColumn("time", F.lit(None).cast("timestamp"))
    return blind(key), key


def session_of(rank: Column, n: Column, cap: int = MAX_SHEET_ROWS) -> Column:
    """Which sitting a row falls in (from 1): as few as the cap allows, sizes differing by one, longer ones first."""
    k = F.greatest(F.lit(1), F.ceil(n / F.lit(cap)))
    base = F.floor(n / k)
    longer = n - base * k
    cut = longer * (base + 1)
    return (F.when(rank < cut, F.floor(rank / (base + 1)))
            .otherwise(longer + F.floor((rank - cut) / base)) + 1).cast("bigint")


def split_sessions(df: DataFrame, cap: int = MAX_SHEET_ROWS, by: Sequence[str] = ("batch_id",),
                   position: str = "sample_id") -> DataFrame:
    """Adds `session`: consecutive stretches of the review order, one per sitting. The draw is untouched.

    Positions run from 0 without gaps, so a batch only has to be counted, not sorted.
    """
    n = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    return df.join(n, list(by)).withColumn("session", session_of(F.col(position), F.col("_n"), cap)).drop("_n")


def repass(key: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """A blind copy of a calibration set in a new order that depends on the copy's name only."""
    h = unit(name, "repass", *EVENT_KEY)
    out = hash_ordered(key.drop("sample_id").withColumn("_h", h).withColumn("batch_id", F.lit(name)),
                       ["batch_id"], "_h", list(EVENT_KEY))
    out = out.withColumn("sample_id", F.col("rank")).drop("_h", "rank", "group_n")
    return blind(out), out


def require_not_drawn(draws: DataFrame, batch_id: str) -> None:
    refuse(draws.where(F.col("batch_id") == batch_id).select("batch_id"), "this batch has been drawn already")


def draw_diagnostics(science: DataFrame, by: Sequence[str] = ("batch_id",)) -> DataFrame:
    per_float = science.groupBy(*by, "wmo").agg(F.count(F.lit(1)).alias("c"),
                                                F.count_if(F.col("previously_judged")).alias("j"))
    return per_float.groupBy(*by).agg(
        F.sum("c").alias("n_science"), F.count(F.lit(1)).alias("floats"),
        F.count_if(F.col("c") > 1).alias("floats_above_one"), F.max("c").alias("max_one_float"),
        (F.sum("c") / F.count(F.lit(1))).alias("panels_per_float"), F.sum("j").alias("previously_judged"))


def chunked_floats(df: DataFrame, strata: DataFrame, by: Sequence[str] = (POOL, STRATUM)) -> DataFrame:
    """How many floats of a stratum had to be cut into chunks."""
    t = df.groupBy(*by, "wmo").agg(F.count(F.lit(1)).alias("c")).join(
        strata.where(F.col("draw_n") > 0).select(*by, _chunk_rows().alias("m")), list(by))
    return t.groupBy(*by).agg(F.count_if(F.col("c") > F.col("m")).alias("floats_chunked"))
