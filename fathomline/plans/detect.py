"""From grids to candidate lists, all pools in one pass over the grids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..functions.keys import event_key, stamp
from ..functions.staging import staged
from ..operators import grid as G


def detect_study(grids: DataFrame, gates: Sequence[G.Gate], study_id: str, measures: Sequence[str] = ()) -> DataFrame:
    """Candidates of every pool: flagged, made unique, identified, and nested in their own parents."""
    spark = grids.sparkSession
    pools = spark.createDataFrame([(g.pool_id, g.parent, g.spec_id) for g in gates],
                                  "pool_id string, parent string, spec_id string")
    G.require_parents(pools)
    # the flagged levels are few and read three times; the grids are read once
    flagged = staged(event_key(G.unique_candidates(G.detect(grids, gates, measures))), "flagged")
    return stamp(G.nest(flagged, pools), study_id)
