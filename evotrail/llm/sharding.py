"""Sharding by weighted rendezvous hashing, with a gapless slot in every shard.

Every record key draws one number per shard and goes to the shard with the best
draw. A new shard only adds a draw, so the records that move all move into it, and
a shard of twice the weight gets twice the records.

Only DataFrame functions: the draws are the leading 52 bits of an MD5, so any SQL
engine can repeat them.

Defined results: a null key draws as the empty string; a null text has 0 bytes and
the CRC-32 of no bytes (0); equal keys share a shard and get different slots; an
empty table gives no rows; columns other than key and text are not looked at.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evotrail.staging import staged_table

#: Bytes every record costs beside its text.
RECORD_OVERHEAD = 16
DRAW_DIGITS = 13
#: Bits of a row's number within its partition, as Spark counts.
PLACE_BITS = 33


def key_text(key: str) -> Column:
    return F.coalesce(F.col(key).cast("string"), F.lit(""))


def draw(key: Column, shard: Column) -> Column:
    """A number in (0, 1) that only the key and the shard decide."""
    digits = F.substring(F.md5(F.concat(key, F.lit(":"), shard.cast("string"))), 1, DRAW_DIGITS)
    whole = F.conv(digits, 16, 10).cast("double")
    return (whole + F.lit(0.5)) / F.lit(float(16**DRAW_DIGITS))


def best_shard(key: Column, weights: Sequence[float]) -> Column:
    """The shard with the largest ln(draw) / weight; the smaller one of equal draws.

    A shard of weight 0 takes nothing.
    """
    heavy = [shard for shard, weight in enumerate(weights) if weight > 0]
    draws = F.transform(
        F.array(*[F.struct(F.lit(s).alias("s"), F.lit(float(weights[s])).alias("w")) for s in heavy]),
        lambda shard: F.struct(
            (F.ln(draw(key, shard["s"])) / shard["w"]).alias("score"), (-shard["s"]).alias("shard")
        ),
    )
    return -F.array_max(draws)["shard"]


def assign_shards(
    records: DataFrame,
    key: str,
    text: str,
    weights: Sequence[float],
    added_weight: float | None = None,
) -> DataFrame:
    """One row per record: key, size, text_crc32, law, shard, slot, grown_shard.

    ``grown_shard`` is the shard after one more of ``added_weight`` (default: the
    last shard's weight) joins. Slots number a shard's rows from 0 in the order of
    the MD5 of the key.

    Texts stay where they are read; only the narrow rows are stored and moved. They are
    dealt by ranges of the whole order, rows that are equal in it by the number they were
    stored with, so no task gets a whole shard or all rows of a key. A range's first slot
    is the number of the shard's rows in the ranges before it.
    """
    if not weights or min(weights) < 0 or max(weights) <= 0:
        raise ValueError("shard weights must be 0 or more, and one of them above 0")
    grown = [*weights, weights[-1] if added_weight is None else added_weight]
    whole = F.coalesce(F.col(text), F.lit("")).cast("binary")
    name = key_text(key)
    placed = staged_table(
        records.select(
            F.col(key),
            (F.length(whole) + F.lit(RECORD_OVERHEAD)).cast("long").alias("size"),
            F.crc32(whole).alias("text_crc32"),
            best_shard(name, weights).cast("int").alias("shard"),
            best_shard(name, grown).cast("int").alias("grown_shard"),
            F.md5(name.cast("binary")).alias("slot_order"),
            F.monotonically_increasing_id().alias("stored"),
        )
    )
    dealt = in_order(placed)
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(
        Window.unboundedPreceding, -1
    )
    # At most one row for each range and shard in it, whatever the table's size.
    firsts = (
        dealt.groupBy("shard", "part")
        .agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("start"))
        .select(
            "shard",
            "part",
            (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("start")).alias("first"),
        )
    )
    return dealt.join(F.broadcast(firsts), ["shard", "part"]).select(
        key,
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        (F.col("first") + F.col("place")).cast("long").alias("slot"),
        "grown_shard",
    )


def in_order(placed: DataFrame) -> DataFrame:
    """The stored rows with ``part``, their range of the order, and ``place`` within it."""
    ranges = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["shard", "slot_order", "text_crc32", "size", "stored"]
    dealt = placed.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    number = F.monotonically_increasing_id()
    numbered = staged_table(dealt.drop("slot_order", "stored").withColumn("number", number))
    return numbered.select(
        "*",
        F.shiftright("number", PLACE_BITS).alias("part"),
        F.col("number").bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).alias("place"),
    ).drop("number")
