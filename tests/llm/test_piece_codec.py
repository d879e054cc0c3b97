from __future__ import annotations

import random

import public_tokenizers
import pytest
import sentencepiece

from evotrail.llm import piece_codec
from evotrail.llm.batches import table
from evotrail.llm.piece_codec import Codec, decode_ids, encode_texts, load_vocabulary

PATH = public_tokenizers.path("piece_bpe_32k.model")
PARTS = [
    " ", "  ", "▁", "\n", "\t", "\xa0", "a", "B", "é", "ß", "中", "٣", "²", "the", "in", "ing", "___",
    "====", "....", "'", '"', "!", "-", "😀", "́", "<s>", "<0x0A>", "hello", "\r\n", "\x00", "꙳",
    "er", "t", "h",
]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def vocabulary():
    return load_vocabulary(PATH)


def test_equals_library_and_round_trip_on_documents(spark, library):
    documents = table(spark, "/root/testdata/sf0.01", "documents")
    encoded = encode_texts(documents, "doc_id", "text", PATH)
    texts = {r.doc_id: r.text for r in documents.collect()}
    rows = encoded.collect()
    assert all(r.round_trip and r.n_ids == len(r.ids) for r in rows)
    assert all(r.ids == library.encode(texts[r.doc_id]) for r in rows)
    assert {r.doc_id: r.text for r in decode_ids(encoded, "doc_id", "ids", PATH).collect()} == texts


@pytest.mark.parametrize("look_every", [1, 3, 256])
def test_equals_library_on_odd_texts_whatever_the_window(
    library, vocabulary, monkeypatch, look_every
):
    monkeypatch.setattr(piece_codec, "LOOK_EVERY", look_every)
    rng, codec = random.Random(look_every), Codec(vocabulary)
    for _ in range(3000):
        text = "".join(rng.choices(PARTS, k=rng.randint(0, 60)))
        assert codec.encode(text) == library.encode(text), repr(text)
        assert codec.decode(codec.encode(text)) == library.decode(library.encode(text))


def test_text_without_cuts_is_committed_in_a_bounded_window(library, vocabulary, monkeypatch):
    codec, windows = Codec(vocabulary), []
    found = codec.common_boundary
    monkeypatch.setattr(
        codec, "common_boundary", lambda last: windows.append(len(last)) or found(last)
    )
    text = "".join(random.Random(4).choices("abcdehinrt._=", k=30_000))
    assert codec.search("▁" + text) == library.encode(text)
    assert windows and max(windows) < 4 * piece_codec.LOOK_EVERY


def test_no_cut_vocabulary_gives_the_same_ids(library, vocabulary):
    whole = Codec(type(vocabulary)(**{**vocabulary.__dict__, "cuts_before_space": False}))
    for text in ("The quick  brown fox", " a b ", "x" * 700 + " y" * 700):
        assert whole.encode(text) == library.encode(text)


def test_decoding_odd_ids(vocabulary, library):
    codec = Codec(vocabulary)
    for ids in ([], [0], [1, 264, 2], [3 + 0xC3], [3 + 0xC3, 3 + 0xA9], [28705, 264]):
        assert codec.decode(ids).count("�") == library.decode(ids).count("�")
    assert codec.decode([3 + 0xC3, 3 + 0xA9]) == "é"


def test_nulls_empty_repeated_and_clashing_columns(spark):
    rows = [(1, None, "x"), (2, "", "x"), (None, "a b", "x"), (3, "a▁b", "x"), (3, "a▁b", "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    encoded = encode_texts(frame, "doc_id", "text", PATH)
    found = sorted(((r.doc_id or 0), r.n_ids, r.round_trip) for r in encoded.collect())
    assert found == [(0, 2, True), (1, 0, True), (2, 0, True), (3, 2, True), (3, 2, True)]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert encode_texts(empty, "doc_id", "text", PATH).collect() == []
    lists = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in decode_ids(lists, "doc_id", "ids", PATH).collect()} == {
        1: None, 2: "",
    }
