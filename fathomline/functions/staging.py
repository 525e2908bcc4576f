"""Staged tables: where a plan is cut and its rows are written to the cluster's shared folder.

A staged table survives the loss of any executor, is read back with column pruning, and has a file size
the planner can see, so Spark itself decides whether a join side is small enough to broadcast.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from .guards import Refused

SETTING = "spark.checkpoint.dir"
_written: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder named by `spark.checkpoint.dir`. Where the session names none, a local session gets one of its own; on a
    cluster, where executors share no local folder, that is refused."""
    folder = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise Refused(f"{SETTING} must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set(SETTING, folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str = "staged") -> str:
    """A path of the shared folder that nothing has been written to."""
    path = f"{shared_folder(spark)}/fathomline/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def staged(df: DataFrame, name: str = "staged") -> DataFrame:
    """Write `df` once and read it back: later uses share the written rows instead of the plan behind them."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Delete what this process staged; call it once the results that read from it are written."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    n = 0
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        n += bool(path.getFileSystem(conf).delete(path, True))
    return n
