"""Commit records: small files that name the folders of finished tables.

A writer puts its tables into folders of their own, never used before, and then publishes
one record that names them all. The record appears, or replaces an earlier one of its
name, by one atomic rename, so that a reader sees all of the tables or none, and never a
half-written one. Folders that no record names are left over from crashes.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from evotrail.sources.files import exists

_ENDING = ".json"

#: The partition column by which Spark reads several folders of a table at once.
_PART = "commit_part"


def new_folder(name: str) -> str:
    """A folder name of its own for one attempt to write ``name``."""
    return f"{_PART}={name}-{uuid4().hex}"


def folder_title(folder: str) -> str:
    """The name for which ``new_folder`` made a folder, and its attempt."""
    return folder.removeprefix(f"{_PART}=")


def _hadoop(spark: SparkSession, path: str):
    context = spark.sparkContext
    settings = context._jsc.hadoopConfiguration()
    made = context._jvm.org.apache.hadoop.fs.Path(path)
    system = made.getFileSystem(settings)
    return system, system.makeQualified(made), settings


def names_in(spark: SparkSession, folder: str) -> list[str]:
    """The names of what a folder holds; none if there is no such folder."""
    if not exists(spark, folder):
        return []
    system, path, _ = _hadoop(spark, folder)
    return sorted(status.getPath().getName() for status in system.listStatus(path))


def delete(spark: SparkSession, path: str) -> None:
    system, found, _ = _hadoop(spark, path)
    system.delete(found, True)


def publish(spark: SparkSession, folder: str, name: str, record: Mapping[str, object]) -> None:
    """Make a record visible under its name, in place of an earlier one, at once."""
    system, draft, settings = _hadoop(spark, f"{folder}/.{uuid4().hex}.draft")
    _, target, _ = _hadoop(spark, f"{folder}/{name}{_ENDING}")
    out = system.create(draft, True)
    out.write(bytearray(json.dumps(record).encode()))
    out.close()
    gateway, hadoop = spark.sparkContext._gateway, spark.sparkContext._jvm.org.apache.hadoop.fs
    kind = getattr(hadoop, "Options$Rename")
    how = gateway.new_array(kind, 1)
    how[0] = kind.OVERWRITE
    hadoop.FileContext.getFileContext(target.toUri(), settings).rename(draft, target, how)


def record_names(spark: SparkSession, folder: str) -> list[str]:
    names = [name for name in names_in(spark, folder) if not name.startswith(".")]
    return [name.removesuffix(_ENDING) for name in names if name.endswith(_ENDING)]


def read(spark: SparkSession, folder: str, names: Iterable[str]) -> dict[str, dict]:
    """Published records by name; a name without a record is left out."""
    there = sorted(set(names) & set(record_names(spark, folder)))
    if not there:
        return {}
    texts = spark.read.text([f"{folder}/{name}{_ENDING}" for name in there], wholetext=True)
    rows = texts.select("_metadata.file_name", "value").collect()
    return {row.file_name.removesuffix(_ENDING): json.loads(row.value) for row in rows}


def forget(spark: SparkSession, folder: str, names: Iterable[str]) -> None:
    """Take records away; their folders may be deleted after that."""
    for name in names:
        delete(spark, f"{folder}/{name}{_ENDING}")


def entry(folder: str, rows: DataFrame) -> dict[str, object]:
    """How a record names a table: its folder and its columns."""
    return {"folder": folder, "schema": rows.schema.jsonValue()}


def read_entries(spark: SparkSession, path: str, entries: list[dict]) -> DataFrame:
    """The rows of one table's folders below ``path``, with the columns of the last entry."""
    schema = T.StructType.fromJson(entries[-1]["schema"])
    reader = spark.read.schema(schema).option("basePath", path)
    return reader.parquet(*[f"{path}/{e['folder']}" for e in entries]).drop(_PART)
