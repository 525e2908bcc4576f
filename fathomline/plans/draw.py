"""A batch from plan to sheet: planned acceptance, size, draw, controls, order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.guards import Refused, refuse
from ..functions.keys import EVENT_KEY
from ..functions.staging import staged
from ..functions.stats import Z
from ..operators import allocation as A
from ..operators import draw as P

MAX_ROUNDS, SETTLED = 6, 0.005  # fixed values


def solve_with_design_effect(frame: DataFrame, strata: DataFrame, target: float, seed: int,
                             rho: float = A.RHO_FLOAT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Draws until the size and the design effect its own panels per float imply agree, at most six times.

    `strata` carry `p_plan`. Returns (science rows, strata with `draw_n`, one row per round and pool). A round
    hands on one number per pool; frame and strata are read as they are.
    """
    pools = staged(strata.groupBy("pool_id").agg(F.max("p_plan").alias("p_plan")).withColumn("deff", F.lit(1.0)), "deff")
    history, per_float = None, P.float_sizes(frame)
    for i in range(MAX_ROUNDS):
        v = (F.lit(target) * F.col("p_plan") / Z) ** 2 / F.col("deff")
        solved = staged(A.solve_n(strata.join(pools.drop("p_plan"), "pool_id"), v), "solved")
        science = staged(P.draw_one_per_cluster(frame, solved, seed + i, per_float=per_float), "science")
        per = science.groupBy("pool_id", "wmo").count().groupBy("pool_id").agg(
            F.sum("count").alias("n"), (F.sum("count") / F.count(F.lit(1))).alias("panels_per_float"))
        step = staged(per.join(pools, "pool_id").withColumn("round", F.lit(i + 1))
                      .withColumn("new_deff", 1 + (F.col("panels_per_float") - 1) * rho), "round")
        history = step if history is None else history.unionByName(step)
        if not step.where(F.abs(F.col("new_deff") - F.col("deff")) >= SETTLED).take(1):
            break
        pools = step.select("pool_id", "p_plan", F.col("new_deff").alias("deff"))
    return science, solved.drop("deff"), history.select("pool_id", "round", "n", "panels_per_float", F.col("new_deff").alias("deff"))


def _record(strata: DataFrame, role: str, batch_of) -> DataFrame:
    s = strata.withColumn("inclusion_probability", F.col("draw_n") / F.col("frame_n"))
    cols = ["design_stratum", "frame_n", "floats", "w", "p_planned", "draw_n", "inclusion_probability"]
    return s.groupBy("pool_id").agg(F.array_sort(F.collect_list(F.struct(*cols))).alias("strata"),
                                    F.sum("draw_n").alias("n_science")
                                    ).withColumns({"batch_id": batch_of, "role": F.lit(role)})


def _sheets(science: DataFrame, pos: DataFrame, neg: DataFrame, n_controls: int, seed: int, batch_of):
    ctrl = P.blind_controls(pos, neg, science, n_controls, seed).withColumn("batch_id", batch_of)
    return P.assemble(science.withColumn("batch_id", batch_of), ctrl, seed)


def rate_arm(frame: DataFrame, strata: DataFrame, target: float, seed: int, pos: DataFrame, neg: DataFrame,
             batch_of, n_controls: int = P.N_CONTROLS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A rate batch of every pool at once: (worksheet, answer key, draw record). The size is solved for the target."""
    science, solved, _ = solve_with_design_effect(frame, strata, target, seed)
    sheet, key = _sheets(science, pos, neg, n_controls, seed, batch_of)
    return sheet, key, _record(solved, "analysis", batch_of)


def held_arm(frame: DataFrame, strata: DataFrame, budget: int, seed: int, pos: DataFrame, neg: DataFrame,
             batch_of, n_controls: int = P.N_CONTROLS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """As `rate_arm`, over a region of its own and at a fixed budget."""
    given = staged(A.neyman(strata, budget), "given")
    science = staged(P.draw_one_per_cluster(frame, given, seed), "science")
    sheet, key = _sheets(science, pos, neg, n_controls, seed, batch_of)
    return sheet, key, _record(given, "analysis", batch_of)


def rejudge_arm(source: DataFrame, pool: DataFrame, sizes: DataFrame, cell: Sequence[str], seed: int, pos: DataFrame,
                neg: DataFrame, batch_of, n_controls: int = 10, seen: DataFrame | None = None
                ) -> tuple[DataFrame, DataFrame]:
    """A blind second look at decided science rows of labelled sheets: (worksheet, answer key).

    `source` rows are those of `labels.science_rows`; `sizes` say how many per cell. The key seals the first
    verdict, position and half. A row that is no longer in the pool is refused.
    """
    if not sizes.take(1):
        raise Refused("no cell to draw from")
    fresh = source if seen is None else P.exclude_keys(source, seen)
    drawn = staged(P.draw_per_cell(fresh, sizes, seed, cell, ("original_sample_id",)), "second-look")
    key = ["pool_id", *EVENT_KEY]
    refuse(drawn.join(pool, key, "left_anti").select(*key), "rows that are not in the pool any more")
    carried = [c for c in pool.columns if c not in drawn.columns]
    science = drawn.join(pool.select(*key, *carried), key).withColumn("previously_judged", F.lit(True))
    return _sheets(science, pos, neg, n_controls, seed, batch_of)
