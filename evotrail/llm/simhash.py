"""SimHash near-duplicates by pigeonring filtering.

A text's fingerprint has 64 bits; bit i is set if it is set in over half of the hashes
of its word shingles. Two fingerprints link at ``radius`` or fewer differing bits.

The bits are cut into segments on a ring. If two fingerprints differ in at most r
bits, then from some segment on, every chain of l consecutive segments holds at most
l * r / m differences (m segments): the pigeonring principle. Where that budget is
below 1 the segments must be equal, so candidates share the exact part of a chain
(here 4 of 6 segments, about 43 bits) and are found by equality; the rest of the
chain's budgets then prunes pairs before the full Hamming check.

Scale: equal fingerprints are one row from the start. A bucket of up to
``pair_limit`` fingerprints is checked pair by pair; a larger one is never paired:
its members link to the values one bit away instead, which joins exactly those at two
bits or fewer, with a number of rows that grows with the members alone.

Defined results: words are split at ASCII white space of the text with A-Z in lower
case; a null or empty text has no word and fingerprint zero, and links like any other;
fewer words than a shingle make one shingle of all; texts of any length are read whole;
equal rows are linked; a null key joins the group of its fingerprint but is never its
smallest key; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from operator import and_, or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evotrail.llm.batches import map_batches
from evotrail.llm.components import connected_components
from evotrail.staging import staged, staged_table

BITS = 64
SEGMENTS = 6
HASH_SEED = 42
#: Members of a bucket up to which its pairs are checked one by one.
PAIR_LIMIT = 24
#: Shingles whose bits are counted at a time, which bounds memory for long texts.
CHUNK = 1 << 15


def fingerprint_of(data: bytes | None, shingle: int) -> int:
    """The unsigned fingerprint of one text in UTF-8."""
    import numpy as np
    from xxhash import xxh64_intdigest as digest

    words = (data or b"").lower().split()  # bytes: only ASCII letters and white space
    if not words:
        return 0
    span = min(shingle, len(words))
    joined = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    first, last = starts[: len(words) - span + 1].tolist(), ends[span - 1 :].tolist()
    total = np.zeros(BITS, np.int64)
    for at in range(0, len(first), CHUNK):
        some = zip(first[at : at + CHUNK], last[at : at + CHUNK])
        hashes = np.array([digest(joined[a:b], HASH_SEED) for a, b in some], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    majority = np.packbits(total * 2 > len(first), bitorder="little")
    return int(majority.view("<u8")[0])


def fingerprints(documents: DataFrame, key: str, text: str, shingle: int) -> DataFrame:
    """(key, fp): the fingerprint of each text as a signed long."""
    kind = documents.schema[key].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> dict[str, list]:
        found = [fingerprint_of(data.as_py(), shingle) for data in batch.column(1)]
        return {key: batch.column(0), "fp": [f - (f >> 63 << 64) for f in found]}

    rows = documents.select(F.col(key), F.col(text).cast("binary").alias("text_"))
    return map_batches(rows, work, f"`{key}` {kind}, fp long")


def segment_masks() -> list[int]:
    """The bits of each segment, as even as 64 bits allow."""
    edges = [BITS * part // SEGMENTS for part in range(SEGMENTS + 1)]
    return [(1 << high) - (1 << low) for low, high in zip(edges, edges[1:])]


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def bucket_masks(radius: int) -> list[int]:
    """The bits that candidates share: all segments but ``radius``, in every choice.

    The budgets of a chain leave at least so many of its segments without a
    difference, and over all starts of a chain each choice comes up.
    """
    masks = segment_masks()
    chosen = combinations(range(SEGMENTS), SEGMENTS - radius)
    return [sum(masks[part] for part in parts) for parts in chosen]


def chain_holds(differences: Column, radius: int) -> Column:
    """True if some start's chains all stay within their share of the budget."""
    masks = segment_masks()
    starts = []
    for start in range(SEGMENTS):
        kept, chain = [], 0
        for length in range(1, SEGMENTS):
            chain |= masks[(start + length - 1) % SEGMENTS]
            within = F.bit_count(differences.bitwiseAND(F.lit(signed(chain))))
            kept.append(within <= length * radius // SEGMENTS)
        starts.append(reduce(and_, kept))
    return reduce(or_, starts)


def fingerprint_links(classes: DataFrame, radius: int, pair_limit: int) -> DataFrame:
    """(u, v) links whose components over the distinct ``fp`` of ``classes`` are those of
    all pairs at ``radius`` or fewer bits.

    Buckets beyond ``pair_limit`` link through values one bit away from both ends,
    which is exact for a radius of 2.
    """
    if radius != 2:
        raise ValueError("the linking of large buckets is built for a radius of 2")
    masks = bucket_masks(radius)
    buckets = F.array(*[F.col("fp").bitwiseAND(F.lit(signed(mask))) for mask in masks])
    keyed = classes.select("fp", F.posexplode(buckets).alias("part", "bucket"))
    sizes = staged(
        keyed.groupBy("part", "bucket")
        .agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b"))
        .where("n > 1")
    )
    more = sizes.where("n > 2").select("part", "bucket", "n")
    members = staged(keyed.join(more, ["part", "bucket"]))
    small = members.where(F.col("n") <= pair_limit).drop("n")
    paired = small.withColumnRenamed("fp", "a").join(
        small.withColumnRenamed("fp", "b"), ["part", "bucket"]
    )
    pairs = (
        sizes.where("n = 2")
        .select("part", "a", "b")
        .union(paired.where("a < b").select("part", "a", "b"))
        .withColumn("differences", F.col("a").bitwiseXOR(F.col("b")))
        .where(is_first_part(F.col("differences"), F.col("part"), masks))
        .where(chain_holds(F.col("differences"), radius))
        .where(F.bit_count("differences") <= radius)
        .select(F.col("a").alias("u"), F.col("b").alias("v"))
    )
    crowded = members.where(F.col("n") > pair_limit).select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit(signed(1 << bit)) for bit in range(BITS)])
    # Two values are at two bits or fewer if some value is at one or none from both.
    # At most 65 members are so near to one value.
    near = (
        crowded.select("fp", F.explode(flips).alias("flip"))
        .groupBy(F.col("fp").bitwiseXOR(F.col("flip")).alias("middle"))
        .agg(F.collect_list("fp").alias("around"))
        .where(F.size("around") > 1)
        .select(F.explode("around").alias("u"), F.array_min("around").alias("v"))
    )
    return pairs.union(near)


def is_first_part(differences: Column, part: Column, masks: list[int]) -> Column:
    """True in the first part whose bits agree, so that a pair is checked once."""
    first = F.when(F.lit(False), F.lit(0))
    for place, mask in enumerate(masks):
        first = first.when(differences.bitwiseAND(F.lit(signed(mask))) == 0, F.lit(place))
    return first == part


def near_duplicates(
    documents: DataFrame,
    key: str,
    text: str,
    shingle: int = 3,
    radius: int = 2,
    pair_limit: int = PAIR_LIMIT,
) -> DataFrame:
    """One row per document: key, fingerprint (16 hex digits), component_id (the smallest
    key reachable by links, itself included)."""
    found = staged_table(fingerprints(documents, key, text, shingle))
    classes = staged(found.groupBy("fp").agg(F.min(key).alias("least")))
    roots = connected_components(fingerprint_links(classes, radius, pair_limit))
    rooted = classes.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = staged(rooted.join(smallest, "root").select("fp", "component_id"))
    return found.join(labels, "fp").select(
        key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
