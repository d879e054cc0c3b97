"""Benchmark decontamination by spaced seeds, tolerant of substituted words.

A document overlaps a benchmark item if, at one alignment of the two, some window of
``WINDOW`` neighbouring words agrees in all but ``SUBSTITUTIONS`` places. Spaced seeds
find the alignments: fixed masks ignore some places of a stretch of ``SPAN`` words, and
the hash of the others is joined between documents and benchmark. The masks are chosen
so that whatever places of a window are substituted, one mask at one shift misses them
all (``tests/llm`` tries every choice), so no overlap is lost. Around a hit the aligned
words are then compared and all agreeing windows found.

Only DataFrame functions. The benchmark's seeds are broadcast in blocks of at most
``SEED_LIMIT`` rows, whatever the benchmark's size, and every block meets all documents
while they are scanned: documents are not shuffled. Equal items are one class, reported
under its smallest item id; ``item_classes`` gives the members.

Defined results: words are the runs of letters and digits of the lower-cased text; a
null or empty text, and an item or document shorter than the window, overlaps nothing;
whole texts of any length are compared; rows with equal keys are reported together, a
null key as null; a class whose items have no id is reported with a null item id, one row
for each class; an empty table gives no rows; other columns are not looked at. Words
are equal if their 64-bit hashes are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evotrail.staging import staged

WINDOW, SUBSTITUTIONS = 13, 2
#: Places that each mask looks at, of SPAN words.
MASKS = ((0, 1, 4, 7, 8, 9), (0, 2, 3, 4, 5, 9))
SPAN = 10
#: Seeds of one broadcast (about 60 bytes each).
SEED_LIMIT = 1_000_000


def word_hashes(text: str) -> Column:
    words = F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.transform(F.filter(words, lambda word: word != ""), lambda word: F.xxhash64(word))


def seeds(hashed: DataFrame, kept: list[str]) -> DataFrame:
    """Every place and mask of the arrays ``h``: the columns ``kept``, at, seed."""
    places = hashed.where(F.size("h") >= WINDOW).select(
        *kept, F.explode(F.sequence(F.lit(0), F.size("h") - SPAN)).alias("at")
    )
    codes = [
        F.xxhash64(F.lit(number), *[F.get("h", F.col("at") + place) for place in mask])
        for number, mask in enumerate(MASKS)
    ]
    return places.select(*kept, "at", F.explode(F.array(*codes)).alias("seed"))


def item_classes(benchmark: DataFrame, item: str, text: str) -> DataFrame:
    """(item_id, class_id): items with the same words are in the class of the smallest id."""
    hashed = benchmark.select(F.col(item).alias("item_id"), word_hashes(text).alias("h"))
    classes = hashed.groupBy("h").agg(F.min("item_id").alias("class_id"))
    return hashed.join(classes, "h").select("item_id", "class_id")


def overlaps(
    documents: DataFrame,
    key: str,
    text: str,
    benchmark: DataFrame,
    item: str,
    item_text: str,
    seed_limit: int = SEED_LIMIT,
) -> DataFrame:
    """One row per document and item class that overlap.

    key, item_id (the class), item_words, windows (agreeing windows at the best
    alignment), covered_words (item words in them), equal_words (those that agree).
    """
    items = staged(
        benchmark.select(F.col(item).alias("item_"), word_hashes(item_text).alias("h"))
        .where(F.size("h") >= WINDOW)
        .groupBy("h")
        .agg(F.min("item_").alias("item_id"))
        .withColumn("class_", F.xxhash64("h"))
    )
    sown = staged(
        seeds(items, ["class_", "h"]).select("class_", F.col("at").alias("item_at"), "seed")
    )
    blocks = max(-(-sown.count() // seed_limit), 1)
    hashed = documents.select(F.col(key).alias("key_"), word_hashes(text).alias("h"))
    found = [
        hits(hashed, sown.where(F.pmod(F.xxhash64("seed", "item_at"), F.lit(blocks)) == block), items)
        for block in range(blocks)
    ]
    return (
        verified(reduce(DataFrame.union, found).distinct())
        # Classes without an id are told apart by their words.
        .groupBy("key_", "item_id", F.when(F.col("item_id").isNull(), F.col("class_")))
        .agg(F.max(F.struct("windows", "covered_words", "equal_words", "item_words")).alias("best"))
        .select(
            F.col("key_").alias(key),
            "item_id",
            "best.item_words",
            "best.windows",
            "best.covered_words",
            "best.equal_words",
        )
    )


def hits(hashed: DataFrame, sown: DataFrame, items: DataFrame) -> DataFrame:
    """The alignments that seeds find: key_, the item's class, and the aligned words of both."""
    lengths = items.select("class_", F.size("h").alias("length"))
    shift = F.col("at") - F.col("item_at")
    first = F.greatest(shift, F.lit(0))
    last = F.least(shift + F.col("length"), F.size("h"))
    aligned = (
        seeds(hashed, ["key_", "h"])
        .join(F.broadcast(sown.join(lengths, "class_")), "seed")
        .select(
            "key_",
            "class_",
            (first - shift).alias("item_first"),
            F.slice("h", first + 1, F.greatest(last - first, F.lit(0))).alias("words"),
        )
        .distinct()
    )
    return aligned.join(items.withColumnRenamed("h", "item_h"), "class_").select(
        "key_",
        "class_",
        "item_id",
        F.size("item_h").alias("item_words"),
        "words",
        F.slice("item_h", F.col("item_first") + 1, F.size("words")).alias("item_part"),
        "item_first",
    )


def verified(aligned: DataFrame) -> DataFrame:
    """The alignments that hold an agreeing window, with their counts."""
    agree = F.zip_with(
        "words", "item_part", lambda a, b: F.when(a == b, F.lit(1)).otherwise(F.lit(0))
    )
    good = F.filter(
        F.sequence(F.lit(1), F.size("agree") - WINDOW + 1),
        lambda at: total(F.slice("agree", at, F.lit(WINDOW))) >= WINDOW - SUBSTITUTIONS,
    )
    covered = F.array_distinct(
        F.flatten(F.transform("good", lambda at: F.sequence(at, at + (WINDOW - 1))))
    )
    return (
        aligned.withColumn("agree", agree)
        .where(F.size("agree") >= WINDOW)
        .withColumn("good", good)
        .where(F.size("good") > 0)
        .withColumn("covered", covered)
        .select(
            "key_",
            "class_",
            "item_id",
            "item_words",
            F.size("good").alias("windows"),
            F.size("covered").alias("covered_words"),
            total(F.transform("covered", lambda at: F.get("agree", at - 1))).alias("equal_words"),
        )
    )


def total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda a, b: a + b)


def without_overlaps(
    documents: DataFrame,
    key: str,
    text: str,
    benchmark: DataFrame,
    item: str,
    item_text: str,
) -> DataFrame:
    """The documents, all columns, that overlap no item. Rows that share a key, or have
    none, are decided each by its own text."""
    code = F.xxhash64(F.col(key).cast("string"), F.col(text))
    rows = documents.select(F.struct("*").alias("doc"), code.alias("row_"))
    texts = rows.select("row_", F.col("doc")[text].alias("text_"))
    found = overlaps(texts, "row_", "text_", benchmark, item, item_text)
    leaks = found.select(F.col("row_").alias("leak_")).distinct()
    return rows.join(leaks, F.col("row_") == F.col("leak_"), "left_anti").select("doc.*")
