from __future__ import annotations

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from evotrail.llm.batches import table
from evotrail.llm.token_counts import TokenCounter, count_tokens, proven_whole_tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = [
    " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", " ", "​", "a", "B", "é", "ß", "中", "٣",
    "²", "½", "Ⅷ", "'s", "'", '"', "!", "_", "-", "😀", "́", "<|endoftext|>", "<|", "hello", "  \n",
    "\r\n", "\x00",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_equals_library_on_documents(spark, library):
    documents = table(spark, "/root/testdata/sf0.01", "documents")
    found = {r.doc_id: r for r in count_tokens(documents, "doc_id", "text", PATH, 512).collect()}
    rows = documents.collect()
    codes = library.encode_batch([r.text for r in rows], add_special_tokens=False)
    for row, code in zip(rows, codes):
        one = found[row.doc_id]
        size = len(row.text.encode())
        assert (one.n_tokens, one.n_bytes) == (len(code.ids), size)
        assert one.over_limit == (one.n_tokens > 512)


def test_equals_library_on_odd_texts(library):
    rng = random.Random(1)
    texts = ["".join(rng.choices(PARTS, k=rng.randint(0, 14))) for _ in range(5000)]
    counter = TokenCounter(PATH, proven_whole_tokens(PATH))
    for text, code in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        assert counter.count(text) == len(code.ids), repr(text)


def test_whole_tokens_are_single_tokens(library):
    whole = sorted(proven_whole_tokens(PATH))
    assert len(whole) > 40_000
    some = random.Random(2).sample(whole, 500)
    library.encode_special_tokens = True
    assert all(len(library.encode(text, add_special_tokens=False)) == 1 for text in some)


def test_nulls_empty_long_repeated_and_clashing_columns(spark, library):
    long = "word and more, " * 60_000 + "x" * 5_000
    rows = [(1, None, 1), (2, "", 1), (None, "a b", 1), (3, long, 1), (3, long, 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    found = count_tokens(frame, "doc_id", "text", PATH, 512).collect()
    counts = sorted(((r.doc_id or 0), r.n_bytes, r.n_tokens) for r in found)
    n = len(Tokenizer.from_file(PATH).encode(long, add_special_tokens=False))
    assert counts == [(0, 3, 2), (1, 0, 0), (2, 0, 0), (3, len(long), n), (3, len(long), n)]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert count_tokens(empty, "doc_id", "text", PATH, 512).collect() == []
