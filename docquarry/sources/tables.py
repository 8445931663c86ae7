"""Readers and writers: the standard tables, other file formats, and a file stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Formats of Spark's own readers and writers that are passed through.
FORMATS = ("parquet", "orc", "json", "csv", "text", "xml", "binaryFile")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A standard table; only the columns that a query uses are read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read(spark: SparkSession, path: str, fmt: str = "parquet", *, schema=None, **options) -> DataFrame:
    """A batch read. Give ``schema`` for json, csv and xml: inferring it reads the input twice."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}; one of {', '.join(FORMATS)}")
    reader = spark.read.format(fmt).options(**options)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def write(df: DataFrame, path: str, fmt: str = "parquet", *, partition_by: tuple[str, ...] = (), mode: str = "errorifexists", **options) -> None:
    """A batch write; ``partition_by`` columns become folders, so readers that filter on them skip files."""
    writer = df.write.format(fmt).mode(mode).options(**options)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def stream(spark: SparkSession, path: str, schema, fmt: str = "parquet", *, files_per_trigger: int | None = None) -> DataFrame:
    """A stream over the files that appear in a folder."""
    reader = spark.readStream.format(fmt).schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)
