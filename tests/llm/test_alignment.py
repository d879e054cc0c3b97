from __future__ import annotations

import hashlib
import random
from collections import Counter
from itertools import accumulate

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from evotrail.llm import alignment
from evotrail.llm.alignment import Units, align_texts, aligned, bytes_of_a, bytes_of_b, most_pairs
from evotrail.llm.batches import table
from evotrail.llm.perfect_hash import PerfectHash
from evotrail.llm.queries import op11_alignment

A = public_tokenizers.path("byte_bpe_50k.json")
B = public_tokenizers.path("piece_bpe_32k.model")
FOLDER = "/root/testdata/sf0.01"
PARTS = [
    " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", " ", "​", "a", "B", "é", "ß", "中", "٣", "½", "Ⅷ",
    "'s", "'", '"', "!", "_", "-", "😀", "́", "<|endoftext|>", "hello", "  \n", "\r\n", "\x00", "<s>",
    "</s>", "<unk>", "<0x0A>", "▁", "ﬁ", "　",
]


@pytest.fixture(scope="module")
def plain():
    """Text to (n_a, n_b, groups, linked id pairs), by the libraries and the definition."""
    byte_bpe = Tokenizer.from_file(A)
    byte_bpe.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=B)
    bytes_a, bytes_b = bytes_of_a(A), bytes_of_b(B)

    def found(text):
        a = byte_bpe.encode(" " + (text or ""), add_special_tokens=False).ids
        b = pieces.encode(text or "")
        parts_a, parts_b = [bytes_a[n] for n in a], [bytes_b[n] for n in b]
        if not text or not b"".join(parts_a) == (" " + text).encode() == b"".join(parts_b):
            return 0, 0, "", []
        ends_a = {end: at for at, end in enumerate(accumulate(map(len, parts_a)), 1)}
        ends_b = {end: at for at, end in enumerate(accumulate(map(len, parts_b)), 1)}
        groups, links, i, j = [], [], 0, 0
        for end in sorted(ends_a.keys() & ends_b.keys()):
            p, q = ends_a[end], ends_b[end]
            groups.append(",".join(map(str, a[i:p])) + "|" + ",".join(map(str, b[j:q])))
            links.append((a[p - 1], b[q - 1]))
            i, j = p, q
        return len(a), len(b), ";".join(groups), links

    return found


def expected(plain, texts):
    found = [plain(text) for text in texts]
    counts = Counter(link for one in found for link in one[3])
    highest = {}
    for (_, b), n in counts.items():
        highest[b] = max(highest.get(b, 0), n)
    return [
        (
            n_a, n_b, len(links), len(links), sum(counts[x] == highest[x[1]] for x in links),
            sum(counts[x] for x in links), groups,
        )
        for n_a, n_b, groups, links in found
    ]


def test_query_equals_libraries_on_whole_table(spark, plain):
    rows = table(spark, FOLDER, "documents").collect()
    found = {r.doc_id: r for r in op11_alignment(spark, FOLDER).collect()}
    assert len(found) == len(rows)
    for row, one in zip(rows, expected(plain, [r.text for r in rows])):
        digest = hashlib.sha256(one[6].encode()).hexdigest() if one[6] else ""
        assert tuple(found[row.doc_id]) == (row.doc_id, *one[:6], digest)


def test_units_equal_libraries_on_odd_texts(plain):
    rng, units = random.Random(1), Units(A, B)
    for _ in range(4000):
        text = "".join(rng.choices(PARTS, k=rng.randint(0, 12)))
        got = (0, 0, "")
        (places,) = aligned(units, [text])
        if places is not None:
            sizes = units.since(0, 0)[0][places]
            groups = ";".join(units.groups[p] for p in places)
            got = (sum(s[0] for s in sizes), sum(s[1] for s in sizes), groups)
        assert got == plain(text)[:3], repr(text)


def test_odd_rows(spark, plain):
    long = "word and more, " * 40_000 + "x" * 3_000
    texts = [None, "", "a b", "a b", "a b c", "one ▁ mark", " \n ", long, "say <|endoftext|> now", "the a"]
    rows = [(i if i else None, text, 1, "x") for i, text in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, n_a int, groups string")
    want = expected(plain, texts)
    found = sorted(align_texts(frame, "doc_id", "text", A, B).collect(), key=lambda r: r[0] or 0)
    assert [tuple(r)[1:] for r in found] == want
    assert align_texts(frame.limit(0), "doc_id", "text", A, B).collect() == []


def test_units_together_equal_units_apart():
    texts = ["It's a naïve test of words — one by one, again.\nNew line", "x" * 50, "a b"]
    names = [unit for text in texts for unit in text.split(" ")]
    together, apart = Units(A, B), Units(A, B)
    together.add(list(dict.fromkeys(names)))
    for name in dict.fromkeys(names):
        apart.add([name])
    assert together.places == apart.places and together.groups == apart.groups
    assert all(np.array_equal(a, b) for a, b in zip(together.since(0, 0), apart.since(0, 0)))


def test_slices_of_texts_are_whole(monkeypatch):
    monkeypatch.setattr(alignment, "CHARACTERS", 20)
    texts = ["a" * 30, None, "", "b" * 15, "c" * 6, "d"]
    batch = pa.RecordBatch.from_pydict({"key": list(range(6)), "text": texts})
    found = list(alignment.chunks(iter([batch, batch.slice(0, 0)])))
    assert [t for _, some in found for t in some] == [t or "" for t in texts]
    assert [len(part) for part, _ in found] == [len(some) for _, some in found]


def test_vocabularies_bound_the_pairs(plain):
    bound = most_pairs(A, B)
    assert 100_000 < bound < alignment.PAIRS
    a, b = bytes_of_a(A), bytes_of_b(B)
    for p, q in plain("Some words, and their naïve endings…\nagain")[3]:
        assert a[p].endswith(b[q]) or b[q].endswith(a[p])


def test_perfect_hash_is_minimal_and_verified():
    rng = np.random.default_rng(4)
    for n in (0, 1, 2, 1000, 60_000):
        keys = np.unique(rng.integers(0, 1 << 63, n, np.uint64))
        table_ = PerfectHash.of(keys)
        assert sorted(table_.slots(keys).tolist()) == list(range(len(keys)))
        strange = np.setdiff1d(rng.integers(0, 1 << 63, 500, np.uint64), keys)
        assert (table_.slots(strange) == -1).all()
