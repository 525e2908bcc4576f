"""The registered queries: a name, what runs it on Spark, and where it can be said, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
DECIMALS = 6


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six places: sums come in another order on every run."""
    return df.select(*[(F.round(F.col(f.name), DECIMALS) + F.lit(0.0)).alias(f.name)
                       if isinstance(f.dataType, DoubleType) else F.col(f.name) for f in df.schema.fields])


def query(name: str, oracle: str | None = None):
    """Register a query; `oracle` gives its result in SQL over the same tables."""
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: rounded(fn(spark, sf_dir))
        if oracle:
            ORACLES[name] = oracle
        return fn
    return add
