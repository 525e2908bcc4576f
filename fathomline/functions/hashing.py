"""Reproducible randomness: a number in [0, 1) from a seed, a tag and a key.

Spark's `rand()` depends on how the rows are partitioned. These draws depend on the row's own key only,
so a draw is the same on one core or a thousand, and can be repeated outside Spark.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BITS = 52                       # what a double holds exactly
_HEX_DIGITS = BITS // 4


def unit(seed: int | str, tag: str, *key: Column | str) -> Column:
    """A uniform number in [0, 1) for the row with this key."""
    parts = [(F.col(k) if isinstance(k, str) else k).cast("string") for k in key]
    digest = F.sha2(F.concat_ws("|", F.lit(str(seed)), F.lit(tag), *parts), 256)
    return F.conv(F.substring(digest, 1, _HEX_DIGITS), 16, 10).cast("double") / F.lit(float(2 ** BITS))
