"""First-wins removal of duplicates, and the list of what it removed.

Positions give the log a total order (time, partition, offset). Among the
events of a key that would be sent, the first is sent. From then on every
event of the key is a duplicate, whether or not it is relevant.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evotrail.schemas import POSITION


def first_per_key(events: DataFrame) -> DataFrame:
    """The first event of each ``dedup_key``.

    Spark turns ``row_number() = 1`` into a group limit before the shuffle, so
    each task sends at most one row per key however often a key occurs.
    """
    in_order = W.partitionBy("dedup_key").orderBy(*POSITION)
    return (
        events.withColumn("_nth", F.row_number().over(in_order))
        .filter(F.col("_nth") == 1)
        .drop("_nth")
    )


def drop_known(events: DataFrame, state: DataFrame) -> DataFrame:
    """Without the events whose key is in the state.

    Apply it after ``first_per_key``: both work by key, so they share one
    shuffle, and a key that is hot in the log meets the state as one row.
    """
    return events.join(state.select("dedup_key"), "dedup_key", "left_anti")


def is_repeatable(methods: Sequence[str]) -> Column:
    """Whether an event's key could equal the key of an event with one of the methods.

    A key that was sent ends in ``:method:id``, and an id holds no colon. As
    long as no method holds one either, comparing that part of the key loses
    nothing, and it keeps the bulk of a mixed audit log out of later joins.
    """
    if any(":" in m for m in methods):
        return F.lit(True)
    method = F.substring_index(F.substring_index("dedup_key", ":", -2), ":", 1)
    return method.isin(*methods)


def known_keys(events: DataFrame, state: DataFrame) -> DataFrame:
    """The keys of the events that the state holds, each once.

    Each task sends a key once, however often it occurs; the state stays in place if
    it is bucketed by key.
    """
    return events.select("dedup_key").distinct().join(state, "dedup_key", "left_semi")


def marks(sent: DataFrame, known: Sequence[DataFrame] = ()) -> DataFrame:
    """Per marked key, the position ``_first`` from which it is marked.

    Keys that an earlier run sent are marked from the start: ``_first`` is null.
    Events meet these marks in a join on the key, one row per key on this side, whose
    partitions adaptive execution splits where a key is hot.
    """
    marked = sent.select("dedup_key", F.struct(*POSITION).alias("_first"))
    position = marked.schema["_first"].dataType
    for keys in known:
        earlier = keys.select("dedup_key", F.lit(None).cast(position).alias("_first"))
        marked = marked.unionByName(earlier)
    return marked


#: Whether an event joined with its key's mark came after the mark.
IS_AFTER_MARK = f"_first IS NULL OR struct({', '.join(f'`{n}`' for n in POSITION)}) > _first"
