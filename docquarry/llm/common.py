"""Shared folder, scratch tables and Arrow helpers of the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows that go to a Python worker at once. Texts are kilobytes long, so a batch stays near a few megabytes.
ARROW_ROWS = 1000
#: Bytes after which a Python worker hands a batch back.
OUT_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where that is unset and Spark runs in one process (tests), a temporary
    folder is taken once per session; on a cluster an unset folder is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    own = spark.conf.get("docquarry.local.shared", None)
    if own is None:
        own = "file://" + tempfile.mkdtemp(prefix="docquarry-")
        spark.conf.set("docquarry.local.shared", own)
    return own


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/docquarry/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage: a lost executor costs a re-read and not a recomputation.
    """
    return materialise_at(df, name)[0]


def materialise_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Delete a scratch table that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """Scratch tables of one operator, deleted together once nothing reads them any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        out, path = materialise_at(df, name)
        self.paths.append(path)
        return out

    def clear(self) -> None:
        for path in self.paths:
            discard(self.spark, path)
        self.paths = []


def release() -> None:
    """Hand freed memory back to the system: reused Python workers would keep it from one stage to the next."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def released(batches: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for ``mapInArrow`` that releases its memory when its task ends."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from batches(found)
        finally:
            release()

    return run


def bounded_arrow(spark: SparkSession) -> None:
    """Lower the rows per Arrow batch to ``ARROW_ROWS`` so that long texts fit a worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def utf8(column: pa.Array) -> Iterator[bytes]:
    """UTF-8 bytes of each text; a null is empty."""
    for x in column.cast(pa.binary()).to_pylist():
        yield x or b""
