"""Folders for tables that an operator writes and reads again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, which driver and executors share; a temporary folder only where it is unset and Spark is one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    own = spark.conf.get("docquarry.scratch", None)
    if own is None:
        own = "file://" + tempfile.mkdtemp(prefix="docquarry-")
        spark.conf.set("docquarry.scratch", own)
    return own


def path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/docquarry/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Written as Parquet and read back: a lost executor costs a re-read and not a recomputation."""
    at = path(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def delete(spark: SparkSession, at: str) -> None:
    """Delete a folder that nothing reads any more."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
