"""Helpers shared by the operators: reading tables and working on Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Where the driver found the package; workers look there too.
HOME = str(Path(__file__).resolve().parents[2])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.sparkContext.environment.setdefault("PYTHONPATH", HOME)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_HELD: list = [None, None]


def held(name, make: Callable[[], object]):
    """What an operator keeps in a worker between batches, made when first asked for.

    Spark uses workers again: what another operator left is dropped first, so a worker
    holds the tables of one operator only.
    """
    if _HELD[0] != name:
        _HELD[:] = [None, None]
        _HELD[:] = [name, make()]
    return _HELD[1]


def map_batches(
    rows: DataFrame, work: Callable[[pa.RecordBatch], dict[str, list]], schema: str
) -> DataFrame:
    """``work`` on every Arrow batch of ``rows``; it gives the columns of ``schema``.

    Only what ``work`` keeps for itself outlives a batch, so memory is bounded by
    the session's bytes per batch.
    """
    kinds = arrow_schema(rows.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = work(batch)
            columns = [pa.array(found[field.name], field.type) for field in kinds]
            yield pa.RecordBatch.from_arrays(columns, schema=kinds)

    return rows.mapInArrow(run, schema)


def arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def learns_from(doc_id) -> F.Column:
    """True for the rows whose labels may be learned: crc32 of the id's text mod 5 is not 0.

    A null id has no remainder and is never learned from.
    """
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 != 0, F.lit(False))
