"""Grid files: which float, kind and resolution a file is, which floats are complete, which source it is."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.guards import Refused, refuse
from ..functions.keys import id_line

# fixed value: <float>_<grid kind>_<resolution>.parquet
FILE_NAME = r"(\d+)_(.+)_(coarse|fine)\.parquet"
LISTED_FILES = 1_000_000


def scan_grids(spark: SparkSession, glob: str) -> DataFrame:
    """All grid files as one table; the float, kind and resolution come from the file name."""
    df = spark.read.option("mergeSchema", "true").parquet(glob)
    name = F.col("_metadata.file_name")
    part = lambda i: F.regexp_extract(name, FILE_NAME, i)
    return (df.select("*", part(1).try_cast("bigint").alias("wmo"), part(2).alias("grid_kind"), part(3).alias("resolution"),
                      name.alias("file_name")).where(F.col("wmo").isNotNull()))


def list_grids(spark: SparkSession, folder: str) -> DataFrame:
    """The grid files of a folder without opening them."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(folder)
             .select(F.element_at(F.split("path", "/"), -1).alias("file_name"), "path", F.col("length").alias("bytes")))
    part = lambda i: F.regexp_extract("file_name", FILE_NAME, i)
    return (files.where(F.col("file_name").rlike("^" + FILE_NAME + "$"))
            .select("file_name", "path", "bytes", part(1).try_cast("bigint").alias("wmo"), part(2).alias("grid_kind"),
                    part(3).alias("resolution")))


def paired_grids(grids: DataFrame) -> DataFrame:
    """Only floats that have both resolutions of a kind."""
    both = (grids.groupBy("wmo", "grid_kind").agg(F.count_distinct("resolution").alias("_r"))
            .where(F.col("_r") == 2).select("wmo", "grid_kind"))
    return grids.join(both, ["wmo", "grid_kind"], "left_semi")


def grid_kind_of(grids: DataFrame) -> DataFrame:
    """One kind per float: the first in alphabetical order."""
    return grids.groupBy("wmo").agg(F.min("grid_kind").alias("grid_kind"))


def kinds_supporting(kinds: DataFrame, needs: DataFrame) -> DataFrame:
    """The kinds that carry every channel a pool's gate needs. `kinds(grid_kind, channels)`, `needs(pool_id, need)`."""
    # both sides are the declared kinds and pools, a handful of rows each
    return (needs.join(kinds, F.size(F.array_except("need", "channels")) == 0).select("pool_id", "grid_kind"))


def source_fingerprint(files: DataFrame) -> DataFrame:
    """The number of fine grids and the sha256 of their sorted names; beside it an order-free digest of name and size."""
    fine = files.where(F.col("resolution") == "fine").select("file_name", "bytes").distinct()
    count = fine.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > LISTED_FILES)
    refuse(count, f"more than {LISTED_FILES} files have no listed digest")
    h = F.sha2(id_line("file_name", "bytes"), 256)
    return fine.agg(F.count(F.lit(1)).alias("n_files"),
                    F.sha2(F.array_join(F.array_sort(F.collect_list("file_name")), "\n"), 256).alias("names_sha256"),
                    F.sum(F.conv(F.substring(h, 1, 12), 16, 10).cast("decimal(20,0)")).cast("string").alias("content_digest"))


def require_bound(live: DataFrame, n_files: int, names_sha256: str) -> None:
    """Refuse a source that is not the one the lists are bound to."""
    refuse(live.where((F.col("n_files") != n_files) | (F.col("names_sha256") != names_sha256)).select("n_files", "names_sha256"),
           f"the source is not the bound one ({n_files} fine grids, {names_sha256[:16]})")


def probe_files(spark: SparkSession, files: DataFrame) -> DataFrame:
    """Which files do not open: every file's footer is read where the file is processed, and its error kept."""
    import pyarrow.parquet as pq
    from pyarrow import BufferReader

    def probe(batches):
        for pdf in batches:
            errors = []
            for content in pdf["content"]:
                try:
                    pq.ParquetFile(BufferReader(content)).schema_arrow
                    errors.append(None)
                except Exception as exc:
                    errors.append(f"{type(exc).__name__}: {exc}")
            yield pdf[["path"]].assign(error=errors)

    named = files.select("file_name", "path", "wmo", "grid_kind")
    # one string a folder; files are told apart by their whole path
    folders = [r[0] for r in named.select(F.regexp_replace("path", r"/[^/]+$", "").alias("d")).distinct().toLocalIterator()]
    if not folders:
        return named.withColumn("error", F.lit(None).cast("string"))
    content = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(folders).select("path", "content")
    errors = content.join(named.select("path"), "path", "left_semi").mapInPandas(probe, "path string, error string")
    # a listed file that is gone by now has failed too
    return named.join(errors.withColumn("probed", F.lit(True)), "path", "left").select(
        "file_name", "path", "wmo", "grid_kind", F.when(F.col("probed").isNull(), "the file is gone").otherwise(F.col("error")).alias("error"))


def split_failures(df: DataFrame, pool_id: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(what could be used, one row per failure with where it failed). `df` carries `error`, null where all went well."""
    pool = F.lit(pool_id) if "pool_id" not in df.columns else F.col("pool_id")
    stage = F.col("stage") if "stage" in df.columns else F.lit("read")
    failed = df.where(F.col("error").isNotNull()).select(pool.cast("string").alias("pool_id"), "wmo", "grid_kind", stage.alias("stage"), "error")
    return df.where(F.col("error").isNull()).drop("error"), failed


def require_no_failures(failures: DataFrame) -> None:
    """A run that lost a float writes nothing: the list would be quietly short."""
    refuse(failures, "floats that failed")


def scan_raw(frames: DataFrame, fleet: DataFrame, tier: int | None = None, limit: int | None = None,
             done: DataFrame | None = None) -> DataFrame:
    """The raw rows of the promised floats: one tier, the first `limit` floats, or those not built yet."""
    wanted = fleet if tier is None else fleet.where(F.col("tier") == tier)
    if done is not None:
        wanted = wanted.join(done.select("wmo").distinct(), "wmo", "left_anti")
    if limit is not None:
        if limit < 0:
            raise Refused("a limit cannot be negative")
        wanted = wanted.orderBy("wmo").limit(limit)
    return frames.join(wanted.select("wmo"), "wmo", "left_semi")
