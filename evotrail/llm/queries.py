"""One query per operator, with production parameters, over the whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evotrail.llm.alignment import align_texts
from evotrail.llm.batches import table
from evotrail.llm.decontamination import overlaps
from evotrail.llm.oracle import ORACLE
from evotrail.llm.packing import pack_documents
from evotrail.llm.piece_codec import encode_texts
from evotrail.llm.quality import score_quality
from evotrail.llm.sharding import assign_shards
from evotrail.llm.simhash import near_duplicates
from evotrail.llm.substring_dedup import remove_repeats
from evotrail.llm.token_counts import count_tokens
from evotrail.llm.toxicity import score_toxicity
from evotrail.llm.url_filters import UrlRule, judge_urls
from evotrail.llm.vector_join import link_vectors
from evotrail.llm.whitening import whiten

__all__ = ["ORACLE", "QUERIES"]

SHARDS = 40
TOKEN_LIMIT = 512
PACK_LENGTH = 2_048
WINDOW = 35
COSINE = 0.95
TOXIC_FROM, QUALITY_FROM = 0.5, 0.3
COMPONENTS = 16
BYTE_BPE = "byte_bpe_50k.json"
END_OF_TEXT = 50_256
PIECE_BPE = "piece_bpe_32k.model"
URL_RULES = [
    UrlRule("allow", "org/"),
    UrlRule("block", "example.org/es/"),
    UrlRule("block", "example.org/en/1"),
    UrlRule("allow", "com/fr/"),
    UrlRule("block", "com/de/"),
]
#: What is kept out where no rule speaks: shops of spam, log-in forms, scripts, calendars.
URL_PATTERNS = [
    UrlRule("block", pattern)
    for pattern in (
        "cheap-pills.*/", "spam-farm.*/", "casino.*/", "*/wp-login.php", "*/wp-admin/",
        "*/cgi-bin/", "*/*/calendar/*/day/",
    )
]


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, benchmark = (table(spark, sf_dir, name) for name in ("documents", "benchmark"))
    return overlaps(documents, "doc_id", "text", benchmark, "item_id", "text")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    path = public_tokenizers.path(BYTE_BPE)
    return pack_documents(documents, "doc_id", "text", path, PACK_LENGTH, END_OF_TEXT, END_OF_TEXT)


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return encode_texts(documents, "doc_id", "text", public_tokenizers.path(PIECE_BPE))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), "doc_id", "text", 3, 2)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return count_tokens(
        documents, "doc_id", "text", public_tokenizers.path(BYTE_BPE), TOKEN_LIMIT
    )


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = (table(spark, sf_dir, name) for name in ("documents", "labels"))
    return score_toxicity(documents, labels, "doc_id", "text", "toxic", TOXIC_FROM)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = (table(spark, sf_dir, name) for name in ("documents", "labels"))
    return score_quality(documents, labels, "doc_id", "text", "quality", QUALITY_FROM)


def op8_vector_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", COSINE)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"), "doc_id", "text", WINDOW)
    digest = F.sha2(F.col("kept").cast("binary"), 256)
    return found.select("doc.doc_id", "n_words", "n_removed", digest.alias("kept_sha256"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents"), "doc_id", "text", [1.0] * SHARDS)


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = public_tokenizers.path(BYTE_BPE), public_tokenizers.path(PIECE_BPE)
    found = align_texts(table(spark, sf_dir, "documents"), "doc_id", "text", *paths)
    digest = F.when(F.col("n_groups") > 0, F.sha2("groups", 256)).otherwise("")
    return found.withColumn("groups_sha256", digest).drop("groups")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whiten(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", COMPONENTS)
    each = F.posexplode(F.arrays_zip("whitened", "explained")).alias("place", "one")
    return found.select("vec_id", "n", "deviation", "identity_error", each).select(
        "vec_id",
        (F.col("place") + 1).alias("component"),
        "n",
        "deviation",
        "one.whitened",
        "one.explained",
        "identity_error",
    )


def op13_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), "page_id", "url", URL_RULES, URL_PATTERNS)


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_packing": op2_packing,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_simhash": op4_simhash,
    "op5_token_counts": op5_token_counts,
    "op6_toxicity": op6_toxicity,
    "op7_quality": op7_quality,
    "op8_vector_join": op8_vector_join,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_sharding": op10_sharding,
    "op11_alignment": op11_alignment,
    "op12_whitening": op12_whitening,
    "op13_url_filters": op13_url_filters,
}
