"""The stages of the corpus pipeline: documents in, documents out.

Every stage keeps the columns of its input, in order; a document here is a row. Rows that
share a doc_id, or have none, are decided each by its own text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evotrail.llm import decontamination, near_copies, piece_codec, substring_dedup, toxicity
from evotrail.llm.batches import table

TOXIC_FROM = 0.5
#: Words of a shingle, and differing bits of 64 at which operator 4 proposes near copies.
SHINGLE, RADIUS = 5, 2
WINDOW = 35
PIECE_BPE = "piece_bpe_32k.model"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the rows whose text scores as toxic; learned from ``labels``, texts of
    ``docs`` that may be learned from, and nothing else."""
    examples = toxicity.fit(docs, table(spark, sf_dir, "labels"), "doc_id", "text", "toxic")
    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = toxicity.toxicity_of(examples, spark, kind, TOXIC_FROM)
    judged = docs.select(F.struct("*").alias("doc"), scored(F.col("text")).alias("found"))
    return judged.where("found.predicted = 0").select("doc.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies: that with the smallest id.

    Operator 4 proposes groups by its fingerprints, min-hash bands (``near_copies``) the
    candidates that fingerprints of two differing bits can't reach; every link is verified
    by the similarity of the texts. A row without an id is kept only if no row of its
    group has one, and once.
    """
    named = docs.withColumn("node_", near_copies.text_code("text"))
    id_ = F.struct(F.col("doc_id").isNull().alias("lacks"), F.col("doc_id").alias("id"))
    ids = named.groupBy("node_").agg(F.min(id_).alias("least")).alias("t")
    roots = near_copies.copy_groups(docs, "text", SHINGLE, RADIUS).alias("r")
    kept = (
        ids.join(roots, F.col("t.node_") == F.col("r.node"), "left")
        .groupBy(F.coalesce("root", "node_").alias("group"))
        .agg(F.min(F.struct("least", "node_")).alias("kept"))
        .select(F.col("kept.least.id").alias("kept_id"), F.col("kept.node_").alias("kept_node"))
    )
    chosen = F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("node_") == F.col("kept_node"))
    once = named.join(kept, chosen, "left_semi").dropDuplicates(["doc_id", "node_"])
    return once.select(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove passages that repeat anywhere. Texts that lose nothing stay as they are;
    the words left of others are joined by one space, and n_chars follows."""
    found = substring_dedup.remove_repeats(docs, "doc_id", "text", WINDOW)
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("doc.text"))
    columns = {name: F.col("doc")[name] for name in docs.columns}
    columns["text"] = text
    if "n_chars" in columns:
        size = F.length(F.col("kept")).cast(docs.schema["n_chars"].dataType)
        columns["n_chars"] = F.when(F.col("n_removed") > 0, size).otherwise(columns["n_chars"])
    return found.select(*[column.alias(name) for name, column in columns.items()])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that overlap a benchmark item."""
    benchmark = table(spark, sf_dir, "benchmark")
    return decontamination.without_overlaps(docs, "doc_id", "text", benchmark, "item_id", "text")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The SentencePiece ids of every document: doc_id, ids, n_ids, round_trip."""
    return piece_codec.encode_texts(
        docs, "doc_id", "text", public_tokenizers.path(PIECE_BPE)
    )
