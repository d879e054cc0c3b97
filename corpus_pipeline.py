"""From raw documents to token ids: five stages, each written and read again.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evotrail.llm import stages
from evotrail.llm.batches import table
from evotrail.staging import staged_table

STAGES = [
    ("toxicity", stages.drop_toxic),
    ("SimHash near-dedup", stages.drop_near_copies),
    ("substring dedup", stages.cut_repeats),
    ("benchmark decontamination", stages.drop_contaminated),
    ("SentencePiece encoding", stages.encode),
]

#: SQL can't express scores, fingerprints or token ids; tests/llm holds plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = staged_table(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
