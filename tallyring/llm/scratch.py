"""Shared working folder of a job: intermediate tables that cut lineage.

Tables go below ``spark.checkpoint.dir``, which driver and executors share. Where a
session in local mode does not name one, a local folder is made once; on a cluster that is an
error.
Every table is written with Spark's own writer and read back, so a lost executor costs
only the tasks that were running on it. Operators delete what they need no longer; what
their results still read stays until ``clear``, or until the folder goes.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def root(spark: SparkSession) -> str:
    """The shared folder as a URI without a trailing slash."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and spark.sparkContext.master.partition("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not named:
        app = spark.sparkContext.applicationId
        named = _LOCAL.setdefault(app, "file://" + tempfile.mkdtemp(prefix="tallyring-"))
    return named.rstrip("/")


def folder(spark: SparkSession, name: str) -> str:
    """A new path, unique to this call, below the shared folder."""
    return f"{root(spark)}/tallyring/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> None:
    """Delete all that this application has put there. Results that still read it end with that."""
    _delete(spark, f"{root(spark)}/tallyring/{spark.sparkContext.applicationId}")


def _delete(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def table(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write ``df`` once and return a DataFrame that reads the written files."""
    spark = df.sparkSession
    path = folder(spark, name)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path) if not partition_by else spark.read.parquet(path)
    out._scratch_path = path
    return out


def drop(df: DataFrame) -> None:
    """Delete the files behind a DataFrame made by :func:`table`; nothing may read it later."""
    path = getattr(df, "_scratch_path", None)
    if path:
        _delete(df.sparkSession, path)
