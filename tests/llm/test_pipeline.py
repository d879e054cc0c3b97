from __future__ import annotations

from pyspark.sql import functions as F

import __spark_entry__ as contract
import corpus_pipeline
from evotrail.llm import stages
from evotrail.llm.batches import table
from evotrail.staging import staged_table
from tests.llm import brute
from tests.llm.test_near_copies import expected

FOLDER = "/root/testdata/sf0.01"


def test_each_stage_does_its_work(spark):
    docs = table(spark, FOLDER, "documents")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = staged_table(stage(spark, docs, FOLDER))
        kept[name] = docs.count()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
        if name == "SimHash near-dedup":
            rows = sorted((r.doc_id, r.text) for r in before.collect())
            assert {r.doc_id for r in docs.collect()} == expected(rows)
        if name == "substring dedup":
            rows = [(r.doc_id, r.text) for r in before.collect()]
            removed = {k: (n, digest) for k, _, n, digest in brute.substring(rows, 35)}
            texts = dict(rows)
            digest = F.sha2(F.col("text").cast("binary"), 256).alias("digest")
            for row in docs.select("*", digest).collect():
                n, plain = removed[row.doc_id]
                if n == 0:
                    assert row.text == texts[row.doc_id]
                else:
                    assert row.digest == plain and row.n_chars == len(row.text)
    assert docs.where("not round_trip").count() == 0
    assert kept["toxicity"] < 1000 and kept["SimHash near-dedup"] < kept["toxicity"]
    assert kept["substring dedup"] == kept["SimHash near-dedup"]
    assert kept["SentencePiece encoding"] == kept["benchmark decontamination"] > 500


def test_run_gives_the_last_stage(spark):
    query = contract.queries()["pipeline"]
    assert query is corpus_pipeline.run
    found = query(spark, "/root/testdata/sf0.001")
    assert found.columns == ["doc_id", "ids", "n_ids", "round_trip"] and found.count() > 50


def test_stages_take_odd_and_empty_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, doc string, who_ int"
    rows = [
        (1, None, None, None, None, "a", 1), (2, "", "en", "s", 0, "a", 1),
        (None, "words without an id", "en", "s", 19, "a", 1), (4, "same words here", "en", "s", 15, "a", 1),
        (4, "same words here", "en", "s", 15, "a", 1), (5, "same words here", "en", "s", 15, "a", 1),
    ]
    for some in (rows, []):
        docs = spark.createDataFrame(some, schema)
        for stage in (f for _, f in corpus_pipeline.STAGES[:-1]):
            docs = staged_table(stage(spark, docs, "/root/testdata/sf0.001"))
            assert docs.columns == [c.split()[0] for c in schema.split(", ")]
        found = stages.encode(spark, docs, "/root/testdata/sf0.001").collect()
        assert sorted(str(r.doc_id) for r in found) == (["1", "4", "None"] if some else [])


def test_rows_without_an_id_are_decided_too(spark):
    benchmark = table(spark, "/root/testdata/sf0.001", "benchmark")
    passage = max((r.text for r in benchmark.collect()), key=len)
    copied, own = "a text that is there with an id and without", "a text that has no id at all"
    rows = [(None, passage), (None, copied), (3, copied), (None, own), (None, own)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    once = stages.drop_near_copies(spark, docs, "")
    assert set(once.collect()) == {(None, passage), (3, copied), (None, own)}
    assert once.count() == 3
    clean = stages.drop_contaminated(spark, once, "/root/testdata/sf0.001")
    assert set(clean.collect()) == {(3, copied), (None, own)}


def test_rows_of_one_id_are_decided_by_their_own_text(spark):
    benchmark = table(spark, "/root/testdata/sf0.001", "benchmark")
    passage = max((r.text for r in benchmark.collect()), key=len)
    texts = ["first text of an id " * 3, "another text, of the same id, not alike", passage]
    rows = [(1, text) for text in texts] + [(1, texts[0]), (2, texts[1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    once = stages.drop_near_copies(spark, docs, "")
    assert sorted(map(tuple, once.collect())) == sorted((1, text) for text in texts)
    clean = stages.drop_contaminated(spark, docs, "/root/testdata/sf0.001")
    assert sorted(map(tuple, clean.collect())) == sorted(r for r in rows if r[1] != passage)
