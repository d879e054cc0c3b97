from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from evotrail.llm.batches import table
from evotrail.llm.packing import best_fit, pack_documents, unpacked, write_packed

PATH = public_tokenizers.path("byte_bpe_50k.json")


def plain_best_fit(sizes, length):
    rows = []
    for item in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        open_rows = [r for r in rows if r[0] >= sizes[item]]
        if open_rows:
            row = min(open_rows, key=lambda r: r[0])
        else:
            row = [length, []]
            rows.append(row)
        row[0] -= sizes[item]
        row[1].append(item)
    return rows


@pytest.mark.parametrize("length", [1, 7, 64, 100])
def test_best_fit_uses_as_few_rows_as_the_plain_search(length):
    rng = random.Random(length)
    sizes = [rng.randint(1, length) for _ in range(400)]
    rows = best_fit(sizes, length)
    assert sorted(i for row in rows for i in row) == list(range(400))
    assert all(sum(sizes[i] for i in row) <= length for row in rows)
    plain = plain_best_fit(sizes, length)
    assert sorted(sum(sizes[i] for i in row) for row in rows) == sorted(
        length - room for room, _ in plain
    )


@pytest.mark.parametrize("end_id", [None, 50256])
def test_documents_come_back_whole(spark, tmp_path, end_id):
    documents = table(spark, "/root/testdata/sf0.001", "documents")
    write_packed(pack_documents(documents, "doc_id", "text", PATH, 256, end_id), str(tmp_path / "p"))
    packs = spark.read.parquet(str(tmp_path / "p"))
    library = Tokenizer.from_file(PATH)
    library.encode_special_tokens = True
    end = [] if end_id is None else [end_id]
    expected = {
        r.doc_id: library.encode(r.text, add_special_tokens=False).ids + end
        for r in documents.collect()
    }
    assert {r.doc_id: r.ids for r in unpacked(packs, 256).collect()} == expected
    rows = packs.collect()
    assert len({r.pack_id for r in rows}) == len(rows)
    for row in rows:
        ids, places = (np.frombuffer(data, "<u2") for data in (row.ids, row.position_ids))
        assert len(ids) == len(places) == 256 and row.cu_seqlens[-1] == row.n_tokens
        for a, b in zip(row.cu_seqlens, row.cu_seqlens[1:]):
            assert (places[a:b] == np.arange(b - a)).all()
    assert sum(r.n_tokens for r in rows) / (256 * len(rows)) > 0.97


def test_nulls_empty_long_repeated_and_clashing_columns(spark):
    long = "many words here " * 20_000
    rows = [(1, None, 1), (2, "", 1), (None, "a b", 1), (3, long, 1), (4, "tie", 1), (4, "tie", 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, ids int").coalesce(1)
    packs = pack_documents(frame, "doc_id", "text", PATH, 128).collect()
    names = [name for pack in packs for name in pack.doc_ids]
    assert set(names) == {None, 3, 4} and names.count(4) == 2
    assert sum(p.n_tokens for p in packs) == sum(
        len(Tokenizer.from_file(PATH).encode(t or "", add_special_tokens=False)) for _, t, _ in rows
    )
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert pack_documents(empty, "doc_id", "text", PATH, 128).collect() == []
