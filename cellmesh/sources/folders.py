"""Folders that driver and executors share, and tables kept in them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, what: str) -> str:
    """A folder that driver and executors share, under ``spark.checkpoint.dir`` where the cluster names it; an error where a cluster names none.

    It goes when the session's JVM ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="cellmesh-")
    uri = f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return uri


def kept(df: DataFrame, what: str) -> DataFrame:
    """``df`` written to a shared folder and read again: several readers, one computation."""
    uri = scratch(df.sparkSession, what)
    df.write.parquet(uri)
    return df.sparkSession.read.schema(df.schema).parquet(uri)
