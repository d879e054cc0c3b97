"""Groups of near copies: texts whose word shingles have a Jaccard similarity of
``SIMILAR`` or more, directly or through others.

Candidates are proposed twice and then all verified. Operator 4 proposes its groups.
Min-hashes propose the rest: ``ROWS`` minima over a text's shingles, under functions of
their own, make one of ``BANDS`` values, and texts that share a value are candidates. Two
texts of similarity s share a band with chance s ** ROWS, so a pair at 0.8 is missed with
chance (1 - 0.8 ** 7) ** 48 = 0.000012 and a closer one with less. A proposed pair links
only if the shingle sets themselves, compared by 64-bit hashes, are similar enough.

Scale: equal texts are one row from the start. A bucket of up to ``pair_limit`` texts is
compared pair by pair. The texts of larger ones are compared with ``PIVOTS`` of their
bucket, which links most of a group of copies; what is still apart is searched exactly,
among all such texts, by their rarest shingles, and a join keeps only pairs that sizes and
parities of the shingles leave possible (``across``). So neither a large group of
copies nor many texts around one long passage are compared with each other pair by pair;
only texts made up of frequent shingles alone, that are still not similar, can be.

Defined results: shingles and words are those of ``simhash``; texts without a word are
copies of each other, a null text too; texts of any length are read whole; repeated rows
and equal texts are one node; among equal choices the smaller hash wins; an empty table
gives no rows; columns other than the text, of whatever name, are not looked at.
"""

from __future__ import annotations

from functools import reduce
from operator import add

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evotrail.llm import simhash
from evotrail.llm.batches import map_batches
from evotrail.llm.components import connected_components
from evotrail.staging import drop_staged, staged_table

SIMILAR = 0.8
BANDS, ROWS = 48, 7
#: Shingles hashed at a time, which bounds memory for long texts.
CHUNK = 512
PAIR_LIMIT = simhash.PAIR_LIMIT
#: Texts of a crowded bucket that all its texts are compared with, twice.
PIVOTS = 8
#: Bits of a set's parities.
PARITIES = 1_024
#: Texts that a chunk of a frequent shingle's texts holds on average.
CHUNK_TEXTS = 64


def text_code(text: str) -> Column:
    """What equal texts share."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def shingle_hashes(data: bytes | None, shingle: int):
    """The distinct hashes of a text's word shingles, rising."""
    import numpy as np
    from xxhash import xxh64_intdigest as digest

    words = (data or b"").lower().split()
    span = min(shingle, len(words))
    found = {
        digest(b" ".join(words[at : at + span]), simhash.HASH_SEED)
        for at in range(len(words) - span + 1 if words else 0)
    }
    return np.sort(np.fromiter(found, np.uint64, len(found)))


def band_functions():
    """(masks, factors) of the min-hash functions: x -> (x ^ mask) * factor."""
    import numpy as np

    rng = np.random.default_rng(simhash.HASH_SEED)
    masks, factors = rng.integers(0, 1 << 64, (2, BANDS * ROWS), np.uint64, endpoint=False)
    return masks, factors | np.uint64(1)


def band_values(hashes, functions) -> list[int]:
    """The signed value of each band; one value for all texts without a shingle."""
    import numpy as np
    from xxhash import xxh64_intdigest as digest

    if not len(hashes):
        return [0]
    masks, factors = functions
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), CHUNK):
        mixed = hashes[at : at + CHUNK, None] ^ masks
        mixed *= factors
        np.minimum(least, mixed.min(axis=0), out=least)
    values = [digest(part.tobytes(), band) for band, part in enumerate(least.reshape(BANDS, ROWS))]
    return [value - (value >> 63 << 64) for value in values]


def sketches(texts: DataFrame, shingle: int) -> DataFrame:
    """(node, bands) of the rows (node, text)."""

    def work(batch: pa.RecordBatch) -> dict[str, list]:
        functions = band_functions()
        found = [
            band_values(shingle_hashes(data.as_py(), shingle), functions)
            for data in batch.column(1)
        ]
        return {"node": batch.column(0), "bands": found}

    rows = texts.select("node", F.col("text").cast("binary").alias("text_"))
    return map_batches(rows, work, "node long, bands array<long>")


def parity_bits(hashes):
    """For each of the last bits of a hash, whether an odd number of hashes end so.

    Two sets differ in at least as many hashes as their parities differ in bits.
    """
    import numpy as np

    places = (hashes % np.uint64(PARITIES)).astype(np.int64)
    odd = (np.bincount(places, minlength=PARITIES) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view("<i8")


def shingle_sets(texts: DataFrame, shingle: int) -> DataFrame:
    """(node, grams, bits): shingle hashes and their parities, of the rows (node, text)."""

    def work(batch: pa.RecordBatch) -> dict[str, list]:
        found = [shingle_hashes(data.as_py(), shingle) for data in batch.column(1)]
        return {
            "node": batch.column(0),
            "grams": [hashes.view("i8") for hashes in found],
            "bits": [parity_bits(hashes) for hashes in found],
        }

    rows = texts.select("node", F.col("text").cast("binary").alias("text_"))
    return map_batches(rows, work, "node long, grams array<long>, bits array<long>")


def may_be_similar(similar: float) -> Column:
    """False only for pairs whose sizes or parities show that they are not."""
    differing = reduce(
        add,
        (
            F.bit_count(F.get("bits_u", F.lit(i)).bitwiseXOR(F.get("bits_v", F.lit(i))))
            for i in range(PARITIES // 64)
        ),
    )
    most = (F.col("size_u") + F.col("size_v")) * F.lit((1 - similar) / (1 + similar))
    longer = F.greatest("size_u", "size_v") * F.lit(similar)
    return (F.least("size_u", "size_v") >= longer - F.lit(1e-9)) & (differing <= most + F.lit(1e-9))


def similar_pairs(pairs: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    """The pairs (u, v) whose shingle sets have at least the similarity."""
    shared = F.size(F.array_intersect("a", "b"))
    either = F.size("a") + F.size("b") - shared
    return (
        pairs.join(sets.select(F.col("node").alias("u"), F.col("grams").alias("a")), "u")
        .join(sets.select(F.col("node").alias("v"), F.col("grams").alias("b")), "v")
        .where((either == 0) | (shared >= F.lit(similar) * either))
        .select("u", "v")
    )


def ordered(pairs: DataFrame) -> DataFrame:
    return (
        pairs.where(F.col("u") != F.col("v"))
        .select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
        .distinct()
    )


def postings(grouped: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of the rows (node, root, grams): which texts each shingle is in, and for shingles of
    several groups in how many texts.

    A frequent shingle's texts are dealt to chunks, so that no row or task gets them all.
    """
    chunks_each = max(1, grouped.count() // CHUNK_TEXTS)
    chunks = staged_table(
        grouped.select("node", "root", F.explode("grams").alias("gram"))
        .groupBy("gram", F.pmod(F.xxhash64("node"), F.lit(chunks_each)).alias("chunk"))
        .agg(
            F.collect_list("node").alias("nodes"),
            F.min("root").alias("least"),
            F.max("root").alias("most"),
        )
    )
    shared = (
        chunks.groupBy("gram")
        .agg(F.sum(F.size("nodes")).alias("n"), F.min("least").alias("a"), F.max("most").alias("b"))
        .where("a < b")
        .select("gram", "n")
    )
    return chunks, shared


def pivots(crowded: DataFrame, sets: DataFrame) -> DataFrame:
    """(bucket, pivot): ``PIVOTS`` texts amid each bucket, whose shingles are the most
    frequent on average, and as many by hash, the same in buckets that share most texts."""
    chunks, shared = postings(
        crowded.select("node").join(sets, "node").select("node", F.col("node").alias("root"), "grams")
    )
    scores = (
        chunks.join(shared, "gram")
        .select(F.explode("nodes").alias("node"), "n")
        .groupBy("node")
        .agg(F.avg("n").alias("score"))
    )
    rated = crowded.join(scores, "node", "left").withColumn("code", F.xxhash64("node"))
    amid = W.partitionBy("bucket").orderBy(F.desc_nulls_last("score"), "code")
    any_ = W.partitionBy("bucket").orderBy("code")
    chosen = [
        rated.withColumn("place", F.row_number().over(order)).where(F.col("place") <= PIVOTS)
        for order in (amid, any_)
    ]
    found = staged_table(chosen[0].union(chosen[1]).select("bucket", F.col("node").alias("pivot")))
    drop_staged(chunks)
    return found.distinct()


def across(
    crowded: DataFrame, sets: DataFrame, roots: DataFrame, similar: float
) -> DataFrame:
    """The pairs (u, v) of crowded texts that may be similar but are in different groups.

    In one order of all shingles a similar pair shares one of the first few of both: of
    a share ``1 - similar`` of the larger text's, and of ``1 - 2 * similar / (1 + similar)``
    of the smaller one's. The order is by rarity, shingles of one group alone first, so
    texts with words of their own meet nobody, and groups meet where they touch.
    """
    grouped = staged_table(
        crowded.select("node")
        .join(roots, "node", "left")
        .select("node", F.coalesce("root", "node").alias("root"))
        .join(sets, "node")
    )
    chunks, shared = postings(grouped)
    by_node = (
        chunks.join(shared, "gram")
        .select(F.explode("nodes").alias("node"), F.struct("n", "gram").alias("one"))
        .groupBy("node")
        .agg(F.array_sort(F.collect_list("one")).alias("rarest"))
    )
    size = F.size("grams")

    def first(share: float) -> Column:
        """How many shingles come first in a prefix, less those of the group alone."""
        prefix = size - F.ceil(size * F.lit(share) - F.lit(1e-9)).cast("int") + 1
        return F.greatest(prefix - size + F.size("rarest"), F.lit(0))

    ranked = staged_table(
        grouped.join(by_node, "node").select(
            "node",
            "root",
            "bits",
            size.alias("size"),
            F.slice("rarest.gram", F.lit(1), first(similar)).alias("probes"),
            F.slice("rarest.gram", F.lit(1), first(2 * similar / (1 + similar))).alias("filed"),
        )
    )
    probes, filed = (
        ranked.select(
            F.explode(prefix).alias("gram"),
            *[F.col(name).alias(f"{name}_{side}") for name in ("node", "root", "size", "bits")],
        )
        for prefix, side in (("probes", "u"), ("filed", "v"))
    )
    found = staged_table(
        ordered(
            probes.join(
                filed,
                (probes["gram"] == filed["gram"])
                & (F.col("root_u") != F.col("root_v"))
                & (F.struct("size_u", "node_u") > F.struct("size_v", "node_v"))
                & may_be_similar(similar),
            ).select(F.col("node_u").alias("u"), F.col("node_v").alias("v"))
        )
    )
    drop_staged(grouped, chunks, ranked)
    return found


def copy_groups(
    documents: DataFrame,
    text: str,
    shingle: int,
    radius: int,
    similar: float = SIMILAR,
    pair_limit: int = PAIR_LIMIT,
) -> DataFrame:
    """(node, root): the group of each text that has near copies, texts named by
    ``text_code``; texts without near copies are not listed."""
    rows = documents.select(text_code(text).alias("node"), F.col(text).alias("text"))
    bands = staged_table(sketches(rows, shingle))
    proposed = simhash.near_duplicates(rows, "node", "text", shingle, radius).select(
        "node", F.xxhash64("component_id").alias("bucket")
    )
    members = (
        bands.dropDuplicates(["node"])
        .select("node", F.explode("bands").alias("bucket"))
        .union(proposed.distinct().select("node", "bucket"))
    )
    sizes = staged_table(
        members.groupBy("bucket")
        .agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("a"), F.max("node").alias("b"))
        .where("n > 1")
    )
    more = staged_table(members.join(sizes.where("n > 2").select("bucket", "n"), "bucket"))
    drop_staged(bands)
    small = more.where(F.col("n") <= pair_limit).select("bucket", "node")
    # Of the crowded buckets of a text the largest holds it; see ``across``.
    crowded = staged_table(
        more.where(F.col("n") > pair_limit)
        .groupBy("node")
        .agg(F.max_by("bucket", F.struct("n", "bucket")).alias("bucket"))
    )
    first = staged_table(
        ordered(
            sizes.where(F.col("n") <= pair_limit)
            .select(F.col("a").alias("u"), F.col("b").alias("v"))
            .union(
                small.withColumnRenamed("node", "u")
                .join(small.withColumnRenamed("node", "v"), "bucket")
                .where("u < v")
                .select("u", "v")
            )
        )
    )
    drop_staged(sizes, more)
    compared = first.select("u").union(first.select("v")).union(crowded.select("node")).distinct()
    chosen = rows.join(compared.withColumnRenamed("u", "node"), "node", "left_semi")
    sets = staged_table(shingle_sets(chosen.dropDuplicates(["node"]), shingle))
    links = staged_table(similar_pairs(first, sets, similar))
    drop_staged(first)
    if crowded.isEmpty():
        return connected_components(links)
    hubs = ordered(
        crowded.join(pivots(crowded, sets), "bucket").select(
            F.col("node").alias("u"), F.col("pivot").alias("v")
        )
    )
    links = staged_table(links.union(similar_pairs(hubs, sets, similar)))
    roots = connected_components(links)
    left = across(crowded, sets, roots, similar)
    drop_staged(crowded)
    more_links = staged_table(similar_pairs(left, sets, similar))
    drop_staged(left, sets)
    if more_links.isEmpty():
        return roots
    return connected_components(links.union(more_links))
