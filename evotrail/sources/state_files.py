"""The deduplication state in a folder that survives restarts.

Batches are grouped into eras of a fixed length. Each batch adds its new keys to
its era under its id, and the last batch of an era writes the whole state as the base
of the next one, in buckets by key. A batch meets the base bucket by bucket, without
moving it, and what earlier batches of its era added, which is small. A batch that runs
again after a crash sees the same state as the first time. Eras before the current one
may be deleted.

A base is written to a folder of its own and counts once a record names it
(``sources.commits``), so no reader meets a half-written one.

With each base goes a Bloom filter of every bucket's keys (``operators.key_filters``), a
byte or two a key. ``load`` tests a batch's keys by it and opens only the buckets that may
hold one of them, so a batch of new keys reads none. A batch that meets half of the buckets
or more reads the base bucket by bucket instead, in place.

No key is forgotten unless the options say so; keys that are leave when an era ends.
"""

from __future__ import annotations

import hashlib
import re
from uuid import uuid4

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evotrail import schemas
from evotrail.operators import key_filters
from evotrail.operators.state import drop_old, prune_state
from evotrail.sources import commits
from evotrail.sources.files import exists, read_or_empty

#: Buckets of a base; at least as many as shuffle partitions, so that Spark moves the
#: batch to the state and not the state to the batch. Must not change for a folder.
BUCKETS = 256

_WITH_BATCH = T.StructType([*schemas.STATE.fields, T.StructField("batch_id", T.LongType())])


def _base_path(path: str, era: int, buckets: int) -> str:
    return f"{path}/base/buckets={buckets}/era={era}"


def _table_name(folder: str) -> str:
    return f"evotrail_state_{hashlib.md5(folder.encode()).hexdigest()}"


def _record_name(era: int, buckets: int) -> str:
    return f"base-{buckets}-{era}"


def _current(spark: SparkSession, path: str, era: int, buckets: int) -> tuple[str, str]:
    """The folders of an era's base and of its filter, as the base's record names them.

    Bases written before there were records lie in folders of the plain names.
    """
    name = _record_name(era, buckets)
    record = commits.read(spark, f"{path}/commits", [name]).get(name)
    base, made = _base_path(path, era, buckets), _filter_path(path, era, buckets)
    if record is None:
        return base, made
    return f"{base}/{record['attempt']}", f"{made}/{record['attempt']}"


def _base(spark: SparkSession, path: str, era: int, buckets: int) -> DataFrame:
    """The base of an era as a bucketed table; the session's catalog only names it."""
    folder, _ = _current(spark, path, era, buckets)
    if not exists(spark, folder):
        if era > 0:
            raise ValueError(f"{path} has no base for era {era}; was its era length changed?")
        return spark.createDataFrame([], schemas.STATE)
    return _bucketed(spark, folder, buckets)


def _bucketed(spark: SparkSession, folder: str, buckets: int) -> DataFrame:
    name = _table_name(folder)
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schemas.STATE)
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet"
        f" CLUSTERED BY (dedup_key) SORTED BY (dedup_key) INTO {buckets} BUCKETS"
        f" LOCATION '{folder}'"
    )
    return spark.table(name)


def _filter_path(path: str, era: int, buckets: int) -> str:
    return f"{path}/filters/buckets={buckets}/era={era}"


def _write_base(state: DataFrame, path: str, era: int, buckets: int) -> None:
    """Write the base and the filter made from it to folders of their own, then the record
    that names both. Attempts that the record does not name are deleted."""
    spark = state.sparkSession
    attempt = f"attempt-{uuid4().hex}"
    base, filters = _base_path(path, era, buckets), _filter_path(path, era, buckets)
    _write_buckets(state, f"{base}/{attempt}", buckets)
    keys = _bucketed(spark, f"{base}/{attempt}", buckets).select("dedup_key")
    blocks = key_filters.blocks_for(keys.count(), buckets)
    made = key_filters.key_filter(keys, "dedup_key", buckets, blocks)
    made.write.parquet(f"{filters}/{attempt}")
    commits.publish(spark, f"{path}/commits", _record_name(era, buckets), {"attempt": attempt})
    for folder in (base, filters):
        for name in commits.names_in(spark, folder):
            if name.startswith("attempt-") and name != attempt:
                commits.delete(spark, f"{folder}/{name}")


def buckets_met(spark: SparkSession, path: str, era: int, buckets: int, keys: DataFrame):
    """The buckets of a base that may hold one of the keys; None if that can't be told."""
    _, folder = _current(spark, path, era, buckets)
    if not exists(spark, f"{folder}/_SUCCESS"):
        return None
    filters = spark.read.parquet(folder)
    first = filters.select("blocks").first()
    if first is None:
        return []
    found = key_filters.may_hold(keys, "dedup_key", filters, buckets, first["blocks"])
    return sorted(row["bucket"] for row in found.select("bucket").distinct().collect())


def _met_base(spark: SparkSession, path: str, era: int, buckets: int, keys: DataFrame) -> DataFrame:
    """The base's buckets that may hold one of the keys."""
    whole = _base(spark, path, era, buckets)
    met = buckets_met(spark, path, era, buckets, keys) if _has_files(whole) else None
    if met is None or 2 * len(met) >= buckets:
        return whole
    files = [file for file in whole.inputFiles() if _bucket_number(file) in set(met)]
    if not files:
        return spark.createDataFrame([], schemas.STATE)
    return spark.read.schema(schemas.STATE).parquet(*files)


def _has_files(base: DataFrame) -> bool:
    return bool(base.inputFiles())


def _bucket_number(file: str) -> int:
    """Spark writes the bucket behind the last underscore of a file's name."""
    found = re.search(r"_(\d+)\.[^/_]*$", file)
    if found is None:
        raise ValueError(f"{file} is no file of a bucketed table")
    return int(found.group(1))


def _write_buckets(state: DataFrame, folder: str, buckets: int) -> None:
    (
        state.repartition(buckets, "dedup_key")
        .write.mode("overwrite")
        .bucketBy(buckets, "dedup_key")
        .sortBy("dedup_key")
        .option("path", folder)
        .saveAsTable(_table_name(folder))
    )


def _added(spark: SparkSession, path: str, era: int, before_batch: int) -> DataFrame:
    rows = read_or_empty(spark, f"{path}/added/era={era}", _WITH_BATCH)
    return rows.filter(F.col("batch_id") < before_batch).drop("batch_id")


def load(
    spark: SparkSession,
    path: str,
    batch_id: int,
    era_length: int,
    buckets: int = BUCKETS,
    keys: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The state as the batches before this one left it: the base, and what was added.

    No key is in both. With ``keys`` (dedup_key), what no key of theirs can be in may be
    left out of the base.
    """
    era = batch_id // era_length
    if keys is None:
        base = _base(spark, path, era, buckets)
    else:
        base = _met_base(spark, path, era, buckets, keys)
    return base, _added(spark, path, era, batch_id)


def add(rows: DataFrame, path: str, batch_id: int, era_length: int) -> None:
    """Store the keys a batch marked."""
    timestamp = F.col("timestamp").cast("timestamp").alias("timestamp")
    stored = rows.select("dedup_key", timestamp, "partition", "offset")
    era = batch_id // era_length
    stored.write.mode("overwrite").parquet(f"{path}/added/era={era}/batch_id={batch_id}")


def end_era(
    spark: SparkSession,
    path: str,
    batch_id: int,
    era_length: int,
    max_keys: int | None = None,
    ttl_days: int | None = None,
    buckets: int = BUCKETS,
) -> None:
    """After the last batch of an era, write the base of the next; else do nothing."""
    era, place = divmod(batch_id, era_length)
    if place != era_length - 1:
        return
    whole = _base(spark, path, era, buckets).unionByName(_added(spark, path, era, batch_id + 1))
    if ttl_days is not None:
        whole = drop_old(whole, ttl_days)
    if max_keys is not None:
        whole = prune_state(whole, max_keys)
    _write_base(whole, path, era + 1, buckets)


def keys_from_lines(spark: SparkSession, path: str) -> DataFrame:
    """Keys of files that hold one JSON string per line; of any size."""
    keys = spark.read.text(path).selectExpr(
        "get(from_json(concat('[', value, ']'), 'array<string>'), 0) AS dedup_key"
    )
    return keys.filter("dedup_key IS NOT NULL").distinct()


def keys_from_json(spark: SparkSession, path: str) -> DataFrame:
    """Keys of a file that holds one JSON array of strings.

    A missing or unreadable file gives no keys. One array can only be read as a whole,
    by one task: large states come as ``keys_from_lines``.
    """
    try:
        text = spark.read.text(path, wholetext=True)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        text = spark.createDataFrame([], "value string")
    keys = text.selectExpr("explode(from_json(value, 'array<string>')) AS dedup_key")
    return keys.filter("dedup_key IS NOT NULL").distinct()


def seed(keys: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Let a new state folder start from keys that were sent before its first batch.

    They count as older than any key of the log.
    """
    first = keys.selectExpr(
        "dedup_key",
        "CAST(null AS timestamp) AS timestamp",
        "CAST(null AS int) AS partition",
        "CAST(null AS bigint) AS offset",
    )
    _write_base(first, path, 0, buckets)
