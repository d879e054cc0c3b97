"""Stored logs, snapshots and state as files, read in batches or as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from evotrail import schemas


def read_log(spark: SparkSession, path: str, file_format: str = "parquet") -> DataFrame:
    """A stored log with the envelope columns."""
    return spark.read.schema(schemas.ENVELOPE).format(file_format).load(path)


def stream_log(
    spark: SparkSession,
    path: str,
    file_format: str = "parquet",
    max_files_per_trigger: int | None = None,
) -> DataFrame:
    """A folder of log files as a stream; new files are new records."""
    reader = spark.readStream.schema(schemas.ENVELOPE).format(file_format)
    if max_files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(path)


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """A registry snapshot, one row per environment and schema id."""
    return spark.read.schema(schemas.REGISTRY).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    context = spark.sparkContext
    folder = context._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(context._jsc.hadoopConfiguration()).exists(folder)


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A table that may not have been written yet: a missing one is empty."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)
