"""Helpers that the training-data operators share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word of the contracts: a run of anything but space, \t, \n, \v, \f and \r.
WORD = r"[^\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a temporary one in local mode; on a cluster that is an error, as machines don't share such folders."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        path = "file://" + os.path.join(tempfile.gettempdir(), "tracewarden-shared")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Spark's own setting: a query's shuffle files go when it ends.
_RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write_shared(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: df as a Parquet table in the shared folder, read again. Survives the loss of executors.

    The table stands in for what was shuffled to make it, so these shuffle files are removed as soon as it is written; a later job then never holds them beside its own.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    before = spark.conf.get(_RELEASE, None)
    spark.conf.set(_RELEASE, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_RELEASE)
        else:
            spark.conf.set(_RELEASE, before)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def narrow(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the operator's own names: extra columns and clashing names stay outside."""
    return df.select(*[F.col(f"`{column}`").alias(name) for name, column in columns.items()])


def fresh(df: DataFrame, name: str) -> str:
    """name, or name with underscores, so that no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def schema(**fields: str) -> T.StructType:
    kinds = {"long": T.LongType, "int": T.IntegerType, "double": T.DoubleType, "string": T.StringType, "boolean": T.BooleanType, "binary": T.BinaryType}
    return T.StructType([T.StructField(k, kinds[v]()) for k, v in fields.items()])


def as_bytes(column) -> list[bytes]:
    """The UTF-8 bytes of an Arrow string column, b"" for nulls; no decoding."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]
