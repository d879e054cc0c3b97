"""Bloom filters of a bucketed key set, as a table that Spark builds, merges and tests.

Each bucket of keys has blocks of ``BLOCK_BITS`` bits. A key sets ``HASHES`` bits of one
block, all from its hash, so testing a key reads one row. Blocks of two key sets with the
same number of blocks are merged by OR. A filter never denies a key it was built with; of
other keys it admits about one in a hundred.

Null keys are in no filter and admitted by none.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a bitmap of Spark's bitmap functions.
BLOCK_BITS = 32_768
BITS_PER_KEY, HASHES = 10, 4


def bucket_of(key: str, buckets: int) -> Column:
    """The bucket that Spark's bucketed tables put the key in."""
    return F.pmod(F.hash(key), F.lit(buckets))


def blocks_for(keys: int, buckets: int) -> int:
    """Blocks of each bucket, for about ``BITS_PER_KEY`` bits a key."""
    return max(1, -(-keys * BITS_PER_KEY // (buckets * BLOCK_BITS)))


def _placed(keys: DataFrame, key: str, buckets: int, blocks: int) -> DataFrame:
    """The keys with bucket, block and the positions of their bits."""
    positions = [
        F.pmod(F.xxhash64(key, F.lit(turn)), F.lit(BLOCK_BITS)).cast("int")
        for turn in range(1, HASHES + 1)
    ]
    return keys.where(F.col(key).isNotNull()).select(
        key,
        bucket_of(key, buckets).alias("bucket"),
        F.pmod(F.xxhash64(key, F.lit(0)), F.lit(blocks)).cast("int").alias("block"),
        F.array(*positions).alias("positions"),
    )


def key_filter(keys: DataFrame, key: str, buckets: int, blocks: int) -> DataFrame:
    """(bucket, block, blocks, bits) of the keys; blocks without a key have no row.

    Each task sends one bitmap for every block it meets, whatever its keys.
    """
    placed = _placed(keys, key, buckets, blocks)
    return (
        placed.select("bucket", "block", F.explode("positions").alias("position"))
        .groupBy("bucket", "block")
        .agg(F.bitmap_construct_agg("position").alias("bits"))
        .select("bucket", "block", F.lit(blocks).alias("blocks"), "bits")
    )


def merged(filters: DataFrame) -> DataFrame:
    """One filter of several key sets that have the same number of blocks."""
    return filters.groupBy("bucket", "block", "blocks").agg(F.bitmap_or_agg("bits").alias("bits"))


def _has(bits: Column, position: Column) -> Column:
    byte = F.substring(bits, F.shiftright(position, 3) + 1, F.lit(1))
    value = F.conv(F.hex(byte), 16, 10).cast("int")
    return F.get(F.array(*[value.bitwiseAND(F.lit(1 << n)) != 0 for n in range(8)]), position % 8)


def may_hold(keys: DataFrame, key: str, filters: DataFrame, buckets: int, blocks: int) -> DataFrame:
    """(key, bucket) of the distinct keys that the filter does not deny."""
    placed = _placed(keys.select(key).distinct(), key, buckets, blocks)
    all_set = reduce(
        and_, (_has(F.col("bits"), F.get("positions", F.lit(n))) for n in range(HASHES))
    )
    return (
        placed.join(filters.select("bucket", "block", "bits"), ["bucket", "block"])
        .where(all_set)
        .select(key, "bucket")
    )
