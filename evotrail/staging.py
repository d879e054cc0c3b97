"""Cutting lineage through the cluster's shared checkpoint folder."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the session names; make a private one only in local mode."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    named = spark.conf.get(CHECKPOINT_DIR, None)
    if named is None:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError(f"set {CHECKPOINT_DIR} to a folder all executors share")
        named = tempfile.mkdtemp(prefix="evotrail-checkpoint-")
    context.setCheckpointDir(named)


def staged(df: DataFrame) -> DataFrame:
    """The rows of ``df``, computed once and stored outside the executors.

    For rows that several later steps read whole. Storage is reliable, so losing an
    executor does not recompute the source; the files go once nothing refers to them.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def staged_table(df: DataFrame) -> DataFrame:
    """The rows of ``df``, written once as Parquet in the shared folder and read again.

    For wide rows that later steps read in part: they read only the columns they
    name, compressed. The table goes with ``drop_staged``, or when the application ends.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    context = spark.sparkContext
    folder = f"{context.getCheckpointDir()}/staged-{uuid4().hex}"
    df.write.parquet(folder)
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(path)
    stored = spark.read.schema(df.schema).parquet(folder)
    stored.staged_folder = folder
    return stored


def drop_staged(*frames: DataFrame) -> None:
    """Delete the folders of staged tables whose rows no later step reads.

    Only what ``staged_table`` returned has a folder; other frames are left alone.
    """
    for frame in frames:
        folder = getattr(frame, "staged_folder", None)
        if folder is not None:
            context = frame.sparkSession.sparkContext
            path = context._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of finished steps now.

    It follows the driver's garbage collection, which in a long job may come late.
    """
    spark.sparkContext._jvm.System.gc()
