"""The label table, worksheets, saved strata and reports: what is written once and never silently replaced."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.guards import Refused, refuse, require_columns
from ..operators.labels import compare_counts, require_rows_agree, require_unique

# fixed values: the membership of a drawn frame
STRATA_COLUMNS = ("pool_id", "k_wmo", "k_cycle", "k_pres", "design_stratum")


def append_reviews(existing: DataFrame, new: DataFrame, replace: bool = False) -> DataFrame:
    """The label table with new batches added. A batch already there may only be loaded again, with `replace`,
    from a sheet whose digest is the recorded one."""
    again = new.select("batch_id").distinct()
    old = existing.join(again, "batch_id", "left_semi").select("batch_id", "sheet_sha256").distinct()
    if not replace:
        refuse(old, "batches that are loaded already")
    else:
        refuse(old.join(new.select("batch_id", F.col("sheet_sha256").alias("new_sha256")).distinct(), "batch_id")
               .where(~F.col("sheet_sha256").eqNullSafe(F.col("new_sha256"))), "the sheet is not the one loaded before")
    return existing.join(again, "batch_id", "left_anti").unionByName(new, allowMissingColumns=True)


def write_reviews(batch: DataFrame, path: str) -> None:
    """Write the given batches' partitions, and no other."""
    (batch.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path))


def upsert_batch(batches: DataFrame, record: DataFrame) -> DataFrame:
    return (batches.join(record.select("batch_id").distinct(), "batch_id", "left_anti")
            .unionByName(record, allowMissingColumns=True))


def _exists(spark: SparkSession, path: str) -> bool:
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jpath))


def write_sheets(sheet: DataFrame, key: DataFrame, path: str) -> None:
    """The worksheet and its sealed key. A worksheet that already carries a verdict is never overwritten."""
    spark = sheet.sparkSession
    if _exists(spark, f"{path}/worksheet"):
        there = spark.read.option("recursiveFileLookup", "true").csv(f"{path}/worksheet", header=True)
        refuse(there.where(F.col("label").isNotNull()).limit(1), f"{path}: the worksheet carries verdicts")
    by = [c for c in ("batch_id", "session") if c in sheet.columns]
    for df, name in ((sheet, "worksheet"), (key, "answer_key")):
        flat = df.select(*[c for c, t in df.dtypes if not t.startswith(("array", "struct", "map"))])
        w = flat.repartition(*by).sortWithinPartitions("sample_id").write.mode("overwrite") if by else \
            flat.sortWithinPartitions("sample_id").write.mode("overwrite")
        (w.partitionBy(*by) if by else w).csv(f"{path}/{name}", header=True)


def read_sheets(sheet: DataFrame, key: DataFrame, by: Sequence[str] = ("batch_id",)) -> DataFrame:
    """The sheets of a draw joined in review order with their keys: rows agree, no position appears twice."""
    require_columns(sheet, ["label", "sample_id"], "worksheet")
    require_unique(sheet, *by, "sample_id", message="a position appears in two sheets of one draw")
    require_rows_agree(sheet, key, by)
    return key.drop("label").join(sheet.select(*by, "sample_id", "label"), [*by, "sample_id"])


def save_strata(frame: DataFrame, path: str) -> DataFrame:
    """Which level of a drawn frame belongs to which stratum, kept because it can never be recut. Writes the counts beside it and
    returns them as written."""
    require_columns(frame, STRATA_COLUMNS)
    spark = frame.sparkSession
    (frame.select(*STRATA_COLUMNS).write.mode("errorifexists").option("compression", "zstd").parquet(path))
    counts = strata_counts(spark.read.parquet(path))
    counts.coalesce(1).write.mode("errorifexists").json(f"{path}.sidecar")
    return spark.read.schema(counts.schema).json(f"{path}.sidecar")


def strata_counts(frame: DataFrame) -> DataFrame:
    return frame.groupBy("pool_id", "design_stratum").agg(F.count(F.lit(1)).alias("frame_n"))


def load_strata(spark: SparkSession, path: str, sidecar: DataFrame, draw_strata: DataFrame) -> DataFrame:
    """The saved membership, if its counts are those of its sidecar and of the draw record."""
    df = spark.read.parquet(path)
    if tuple(df.columns) != STRATA_COLUMNS:
        raise Refused(f"{path}: columns {df.columns}")
    live = strata_counts(df)
    for recorded, what in ((sidecar, "its sidecar"), (draw_strata, "the draw record")):
        refuse(compare_counts(live, recorded, ["pool_id", "design_stratum"]), f"the strata are not the ones of {what}")
    return df


def write_scores(df: DataFrame, path: str) -> DataFrame:
    """Scores or features by pool. Writes row and column counts per pool beside them and returns them as written."""
    df.write.mode("errorifexists").option("compression", "zstd").partitionBy("pool_id").parquet(path)
    back = df.sparkSession.read.parquet(path)
    counts = back.groupBy("pool_id").agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)))
    counts.coalesce(1).write.mode("errorifexists").json(f"{path}.sidecar")
    return df.sparkSession.read.schema(counts.schema).json(f"{path}.sidecar")


def write_report(df: DataFrame, path: str) -> None:
    """A rate report: one row per pool, as one readable file."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)
