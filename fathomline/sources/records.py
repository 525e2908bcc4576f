"""Text tables and nested records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (ArrayType, BooleanType, DoubleType, LongType, MapType, StringType, StructField, StructType)

_s, _d, _l = StringType(), DoubleType(), LongType()

# one row per batch; strata and controls as nested records
SAMPLING = StructType([StructField(c, _s) for c in ("mode", "draw", "design", "frame", "strata", "allocation")])
STRATUM_RECORD = StructType([StructField("design_stratum", _s), StructField("frame_n", _l), StructField("floats", _l),
                             StructField("w", _d), StructField("p_planned", _d), StructField("draw_n", _l),
                             StructField("inclusion_probability", _d)])
BATCH = StructType([
    StructField("batch_id", _s), StructField("pool_id", _s), StructField("role", _s), StructField("decides", BooleanType()),
    StructField("criterion_version", _s), StructField("rejudges", _s), StructField("columns_kept", ArrayType(_s)),
    StructField("sampling", SAMPLING), StructField("strata", ArrayType(STRATUM_RECORD)),
    StructField("session", MapType(_s, StructType([StructField("n", _l), StructField("accepted", _l)])))])


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A comma-separated table with a header, under a declared schema; a malformed row fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").csv(path, header=True)


def read_records(spark: SparkSession, path: str, schema: StructType = BATCH) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def flatten(df: DataFrame, nested: str = "sampling") -> DataFrame:
    """`nested.x` becomes `nested_x`; every other struct or map is dropped."""
    kept = [f.name for f in df.schema.fields if not isinstance(f.dataType, (StructType, MapType))]
    inner = [f.name for f in df.schema[nested].dataType.fields]
    return df.select(*kept, *[F.col(f"{nested}.{c}").alias(f"{nested}_{c}") for c in inner])
