"""Exact token counts for byte-level BPE vocabularies, without building token lists.

Whole-token shortcut: before the job, every vocabulary string is encoded alone; the
strings that come out as one token are proven whole tokens, and a word equal to one of
them counts 1 with no merges. Only other words are merged, once per distinct one in a
worker's table of bounded size.

Text is first cut at single spaces that touch no other white space: the vocabulary's
pattern attaches such a space to the word after it, so every cut piece splits the
same alone as within its text. Texts where a space touches other white space are
merged as a whole.

Defined results: a null or empty text has 0 bytes and 0 tokens; the string of an
added special token inside a text counts 1, as the library does by default; texts
are counted whole, of any length; equal rows give equal rows; an empty table gives
no rows; columns other than key and text are not looked at.
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evotrail.llm.batches import held, map_batches

#: Distinct words a worker keeps; more are merged again when they return.
KNOWN_WORDS = 400_000

# The split pattern and the byte alphabet of byte-level BPE files.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PRINTABLE_BYTES = (range(0x21, 0x7F), range(0xA1, 0xAD), range(0xAE, 0x100))


def byte_alphabet() -> dict[str, int]:
    """The byte each character of a vocabulary string stands for."""
    printable = [byte for part in PRINTABLE_BYTES for byte in part]
    others = [byte for byte in range(256) if byte not in set(printable)]
    return {chr(byte): byte for byte in printable} | {
        chr(256 + place): byte for place, byte in enumerate(others)
    }


def load(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def proven_whole_tokens(path: str) -> frozenset[str]:
    """The texts that the vocabulary file encodes alone as one token.

    Their number is bounded by the vocabulary. Byte strings that are no text by
    themselves (parts of a character) can't be a pre-token and are left out.
    """
    alphabet = byte_alphabet()
    encoder = load(path)
    encoder.encode_special_tokens = True
    texts = []
    for written in encoder.get_vocab(with_added_tokens=False):
        try:
            texts.append(bytes(alphabet[char] for char in written).decode())
        except (KeyError, UnicodeDecodeError):
            continue
    found = encoder.encode_batch(texts, add_special_tokens=False)
    return frozenset(text for text, coded in zip(texts, found) if len(coded.ids) == 1)


def read_ranks(path: str) -> tuple[dict[bytes, int], list[str]]:
    """(ranks of the byte strings, strings of special tokens) of a vocabulary file.

    The ids of the merged strings must rise in the order of the merges, so that they
    rank them.
    """
    with open(path, encoding="utf-8") as file:
        parts = json.load(file)
    alphabet, vocabulary = byte_alphabet(), parts["model"]["vocab"]
    special = [token["content"] for token in parts.get("added_tokens", [])]
    merges = [m.split(" ") if isinstance(m, str) else m for m in parts["model"]["merges"]]
    made = [vocabulary[left + right] for left, right in merges]
    if made != sorted(made):
        raise ValueError(f"{path}: the ids don't rank the merges")
    ranks = {
        bytes(alphabet[char] for char in written): number
        for written, number in vocabulary.items()
        if written not in special
    }
    return ranks, special


def merger(path: str):
    """(function from text to ids, strings of special tokens) for a vocabulary file."""
    import tiktoken

    ranks, special = read_ranks(path)
    encoding = tiktoken.Encoding(
        path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}
    )
    return encoding.encode_ordinary, special


#: A space beside other white space. Python's white space holds all of the pattern's.
UNEVEN = re.compile(r" \s|\s ").search


def cuts_at_spaces(text: str) -> bool:
    """True if every piece between the text's spaces splits alone as it does in the text."""
    return not (text[:1] == " " or text[-1:] == " " or UNEVEN(text))


class WordCounts(dict):
    """The number of tokens of a word with a space before it, merged when first asked for."""

    def __init__(self, merge, whole: frozenset[str]):
        super().__init__()
        self.merge = merge
        self.whole = {text[1:]: 1 for text in whole if text[:1] == " " and len(text) > 1}
        self.update(self.whole)

    def __missing__(self, word: str) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
            self.update(self.whole)
        count = self[word] = len(self.merge(" " + word))
        return count


class TokenCounter:
    """Counts tokens of texts for one vocabulary file; one lives in each worker."""

    def __init__(self, path: str, whole: frozenset[str]):
        self.merge, special = merger(path)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.words = WordCounts(self.merge, whole)

    def count(self, text: str) -> int:
        if self.special is not None and self.special.search(text):
            parts = self.special.split(text)
            return sum(map(self.count_plain, parts)) + len(parts) - 1
        return self.count_plain(text)

    def count_plain(self, text: str) -> int:
        if not cuts_at_spaces(text):
            return len(self.merge(text))
        first, *others = text.split(" ")
        return len(self.merge(first)) + sum(map(self.words.__getitem__, others))


def count_tokens(
    documents: DataFrame, key: str, text: str, path: str, limit: int
) -> DataFrame:
    """One row per document: key, n_bytes, n_tokens, over_limit (more than ``limit``).

    ``path`` names the vocabulary file on every machine. No shuffle: each task counts
    the texts it reads.
    """
    whole = documents.sparkSession.sparkContext.broadcast(proven_whole_tokens(path))
    kind = documents.schema[key].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> dict[str, list]:
        count = held(("counter", path), lambda: TokenCounter(path, whole.value)).count
        counts = [count(text.as_py() or "") for text in batch.column(1)]
        return {
            key: batch.column(0),
            "n_bytes": batch.column(2),
            "n_tokens": counts,
            "over_limit": [n > limit for n in counts],
        }

    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
    return map_batches(
        documents.select(F.col(key), F.col(text).alias("text_"), size.alias("size_")),
        work,
        f"`{key}` {kind}, n_bytes long, n_tokens long, over_limit boolean",
    )
