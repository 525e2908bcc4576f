"""Candidate lists: partitioned by pool, with a sidecar that says what each list must contain."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.guards import Refused, refuse, require_columns
from ..functions.keys import EVENT_KEY, content_hash, event_type
from ..functions.staging import staged


SIDECAR = ".sidecar"


def scan_candidates(spark: SparkSession, path: str, pool: str | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """One pool's list or all; the pool prunes partitions and the columns prune the scan."""
    df = spark.read.parquet(path)
    if pool is not None:
        df = df.where(F.col("pool_id") == pool)
    return df if columns is None else require_columns(df, columns, path).select(*columns)


def sidecar(df: DataFrame, source_digest: str | None = None) -> DataFrame:
    """Per pool: spec, rows, key-set digest, and the grid source the list was made from."""
    # rows are counted by (pool, spec), by hash: the least of a text per pool would sort all rows
    by_spec = staged(df.groupBy("pool_id", "spec_id").agg(F.count(F.lit(1)).alias("n")), "specs")
    counts = by_spec.groupBy("pool_id").agg(F.sum("n").alias("n_rows"), F.min("spec_id").alias("spec_id"), F.count("spec_id").alias("_specs"))
    refuse(counts.where(F.col("_specs") > 1), "a list written under more than one spec")
    return (counts.drop("_specs").join(content_hash(df).select("pool_id", "content_sha256"), "pool_id")
            .withColumn("source_digest", F.lit(source_digest).cast("string")))


def write_candidates(df: DataFrame, path: str, source_digest: str | None = None, files_per_pool: int | None = None) -> DataFrame:
    """Write the lists, then their sidecar beside them, and return the sidecar as it was written.

    Rows are range-partitioned on (pool, key): a pool of any size spreads over as many files as it needs,
    each sorted by key, so key filters skip files and row groups.
    """
    keys = ["pool_id", *EVENT_KEY]
    df = staged(df, "lists")                                   # the ranges are sampled before rows are dealt: what made the rows runs once
    parted = df.repartitionByRange(files_per_pool, *keys) if files_per_pool else df.repartitionByRange(*keys)
    (parted.sortWithinPartitions(*keys).write.mode("errorifexists").option("compression", "zstd")
     .partitionBy("pool_id").parquet(path))
    sidecar(df.sparkSession.read.schema(df.schema).parquet(path), source_digest).coalesce(1).write.mode("errorifexists").json(f"{path}{SIDECAR}")
    return read_sidecar(df.sparkSession, path)


def read_sidecar(spark: SparkSession, path: str) -> DataFrame:
    """What was recorded when the lists at `path` were written."""
    return spark.read.schema("pool_id string, n_rows long, spec_id string, content_sha256 string, source_digest string").json(f"{path}{SIDECAR}")


def changed_lists(df: DataFrame, recorded: DataFrame, pools: DataFrame, source_digest: str | None = None) -> DataFrame:
    """Where the lists differ from their sidecar: `pools(pool_id, spec_id)` says which specs are current."""
    live = sidecar(df, source_digest)
    r = recorded.select("pool_id", F.col("n_rows").alias("rows_recorded"), F.col("spec_id").alias("spec_recorded"),
                        F.col("content_sha256").alias("sha_recorded"), F.col("source_digest").alias("source_recorded"))
    t = r.join(live, "pool_id", "left").join(pools.select("pool_id", F.col("spec_id").alias("spec_now")), "pool_id", "left")
    why = F.array_compact(F.array(
        F.when(~F.col("spec_recorded").eqNullSafe(F.col("spec_now")), "written under another spec"),
        F.when(~F.col("source_recorded").eqNullSafe(F.lit(source_digest).cast("string")), "written from another source"),
        F.when(~F.col("sha_recorded").eqNullSafe(F.col("content_sha256")), "the keys moved"),
        F.when(~F.col("rows_recorded").eqNullSafe(F.col("n_rows")), "the row count moved")))
    return t.withColumn("why", F.array_join(why, ", ")).where(F.col("why") != "").select("pool_id", "why")


def scan_verified(spark: SparkSession, path: str, recorded: DataFrame, pools: DataFrame, pool: str,
                  columns: Sequence[str] | None = None, source_digest: str | None = None) -> DataFrame:
    """A list that a number may be computed from: checked against its sidecar before it is handed over."""
    df = scan_candidates(spark, path, pool)
    mine = recorded.where(F.col("pool_id") == pool)
    if not mine.take(1):
        raise Refused(f"{pool}: no sidecar")
    refuse(changed_lists(df, mine, pools, source_digest), f"{pool}: the saved list is not what its sidecar says")
    return df if columns is None else df.select(*columns)


def scan_pinned(spark: SparkSession, path: str, columns: Sequence[str], key: Sequence[str], digest: str) -> DataFrame:
    """A foreign table, pinned by the digest of its keys: if the table moved, nothing is read from it."""
    df = require_columns(spark.read.parquet(path), [*columns, *key], path)
    live = content_hash(df.withColumn("_all", F.lit(1)), ["_all"], key)
    refuse(live.where(F.col("content_sha256") != digest).select("n", "content_sha256"), f"{path} has moved")
    return df.select(*columns)


def pool_summary(df: DataFrame) -> DataFrame:
    return (df.groupBy("pool_id", "spec_id").agg(F.count(F.lit(1)).alias("n_rows"))
            .withColumn("event_type", event_type("pool_id")))
