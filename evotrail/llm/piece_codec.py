"""SentencePiece encoding and decoding by a streaming Viterbi search.

The search goes over the text's positions and keeps, for each, the last piece of the
best segmentation up to there and so a pointer back. Only a window of the longest
piece's length can still be pointed at; whenever the paths from all positions of the
window run through one boundary, the pieces before it are committed and dropped, so
memory does not grow with the text.

The model file at hand scores by merges (BPE), where the best segmentation is the one
that the merges reach, not the one with the best sum. It can be told locally: pieces
follow each other in it exactly if merging the two pieces' characters gives those two
pieces again. With that test as the step of the search every position has one
surviving path, and the ids are the library's.

Known boundaries: no piece of such a vocabulary goes on into a space after another
character, so every path runs through the boundary before a run of spaces. Text is
cut there, and the ids of a cut unit are kept in a worker's table of bounded size. A
vocabulary with such pieces is searched without cuts.

Defined results: a null or empty text has no ids; characters outside the vocabulary
become their UTF-8 bytes; texts are encoded whole, of any length; equal texts have
equal ids; U+2581 in a text stands for a space, as in the library, and decodes to one;
decoding a null list gives null, an unknown id " \\u2047 ", a control id nothing, broken
UTF-8 the replacement character; an empty table gives no rows; columns other than key
and text are not looked at.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evotrail.llm.batches import held, map_batches

# Fixed values of the format: the mark for a space and the text of an unknown id.
SPACE = "▁"
UNKNOWN = " ⁇ "

#: Distinct units whose ids a worker keeps; more are searched again when they return.
KNOWN_UNITS = 400_000
#: Pairs of pieces whose test a worker remembers.
KNOWN_PAIRS = 500_000
# Marks in place of a piece: the beginning of the text, and no piece.
START, NONE = -1, -2
#: Characters of a beginning that is searched once, and beginnings a worker remembers.
HEAD, KNOWN_HEADS = 6, 200_000
#: Positions between two looks for a common boundary.
LOOK_EVERY = 256


@dataclass(frozen=True)
class Vocabulary:
    """What the search needs of a model file; its size is that of the vocabulary."""

    ids: dict[str, int]  # pieces that text can match
    ranks: dict[str, int]  # order of the merges; 0 for single characters
    halves: dict[str, tuple[str, str]]  # what the last merge of a piece joined
    byte_ids: tuple[int, ...]
    decoded: tuple[bytes, ...]  # by id
    longest: int
    cuts_before_space: bool


def load_vocabulary(path: str) -> Vocabulary:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids, byte_ids, decoded, scores = {}, {}, [], {}
    for number in range(model.get_piece_size()):
        piece = model.id_to_piece(number)
        if model.is_byte(number):
            byte_ids[int(piece[1:-1], 16)] = number
            decoded.append(bytes([int(piece[1:-1], 16)]))
        elif model.is_unknown(number):
            decoded.append(UNKNOWN.encode())
        elif model.is_control(number):
            decoded.append(b"")
        else:
            decoded.append(piece.replace(SPACE, " ").encode())
            ids[piece], scores[piece] = number, model.get_score(number)
    merged = sorted((p for p in ids if len(p) > 1), key=scores.__getitem__, reverse=True)
    ranks = {p: 0 for p in ids if len(p) == 1} | {p: r for r, p in enumerate(merged, 1)}
    halves = {}
    for piece in merged:
        if (last := last_merge(piece, ranks)) is not None:
            halves[piece] = last
    usable = {p: i for p, i in ids.items() if len(p) == 1 or p in halves}
    return Vocabulary(
        usable,
        ranks,
        halves,
        tuple(byte_ids[byte] for byte in range(256)),
        tuple(decoded),
        max(map(len, usable)),
        not any(SPACE in piece.lstrip(SPACE) for piece in usable),
    )


def merge(text: str, ranks: dict[str, int]) -> tuple[list[str], tuple[str, str] | None]:
    """The pieces that merges reach, and what the last merge joined; for short texts."""
    parts, last = list(text), None
    while len(parts) > 1:
        found = [ranks.get(a + b) or len(ranks) + 1 for a, b in zip(parts, parts[1:])]
        best = min(found)
        if best > len(ranks):
            break
        at = found.index(best)
        last = (parts[at], parts[at + 1])
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts, last


def last_merge(piece: str, ranks: dict[str, int]) -> tuple[str, str] | None:
    """What the last merge of ``piece`` joins; None if merges don't reach it."""
    parts, last = merge(piece, ranks)
    return last if parts == [piece] else None


class Codec:
    """Encodes and decodes with one vocabulary; one lives in each worker."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.known: dict[str, tuple[int, ...]] = {}
        self.pairs: dict[int, bool] = {}
        self.heads: dict[str, list[int]] = {}
        ids, self.width = vocabulary.ids, len(vocabulary.decoded)
        #: Ends of pieces, with the piece's id or -1 where more must come before.
        self.tails: dict[str, int] = {}
        for piece in ids:
            for first in range(1, len(piece)):
                self.tails.setdefault(piece[first:], -1)
            self.tails[piece] = ids[piece]
        self.sizes, self.ranks, self.left_half, self.right_half = (
            [0] * self.width for _ in range(4)
        )
        for piece, number in ids.items():
            self.sizes[number], self.ranks[number] = len(piece), vocabulary.ranks[piece]
            if piece in vocabulary.halves:
                left, right = vocabulary.halves[piece]
                self.left_half[number], self.right_half[number] = ids[left], ids[right]
        #: The rank of every merge of two pieces, by both ids.
        self.merges: dict[int, int] = {}
        for piece, rank in vocabulary.ranks.items():
            for cut in range(1, len(piece)):
                if (left := ids.get(piece[:cut])) is not None:
                    if (right := ids.get(piece[cut:])) is not None:
                        self.merges[left * self.width + right] = rank

    @cached_property
    def units(self):
        return re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        if not self.vocabulary.cuts_before_space:
            return self.search(SPACE + text.replace(" ", SPACE))
        if "  " in text or SPACE in text or text[0] == " " or text[-1] == " ":
            parts = self.units(SPACE + text.replace(" ", SPACE))
        else:
            parts = [SPACE + part for part in text.split(" ")]
        known, found = self.known, []
        for part in parts:
            numbers = known.get(part)
            if numbers is None:
                if len(known) >= KNOWN_UNITS:
                    known.clear()
                numbers = known[part] = tuple(self.search(part))
            found.append(numbers)
        return list(chain.from_iterable(found))

    def follows(self, left: int, right: int) -> bool:
        """True if merging the characters of both pieces gives the two pieces again.

        Undo the later of the merges beside the boundary, again and again: if the
        pieces on both sides would have merged across it earlier, they don't follow.
        """
        ranks, merges, width = self.ranks, self.merges, self.width
        bound = len(self.vocabulary.ranks) + 1
        while True:
            if merges.get(left * width + right, bound) < bound:
                return False
            rank_left, rank_right = ranks[left], ranks[right]
            if rank_left > rank_right:
                bound, left = rank_left, self.right_half[left]
            elif rank_right:  # of equal merges the left one comes first, maybe across
                bound, right = rank_right + 1, self.left_half[right]
            else:
                return True

    def search(self, text: str) -> list[int]:
        """The ids of ``text``, committed as soon as no path can change them."""
        size, done, start = len(text), [], 0  # all before start is committed
        # Last piece of the path up to start + index; START, or NONE for a character
        # without a piece. Many words begin alike: beginnings are searched once.
        if size > HEAD:
            head = text[:HEAD]
            if head not in self.heads:
                if len(self.heads) >= KNOWN_HEADS:
                    self.heads.clear()
                self.heads[head] = self.extended(head, [START], 0, HEAD)
            last = self.heads[head].copy()
        else:
            last = self.extended(text, [START], 0, size)
        while start + len(last) <= size:
            last = self.extended(text, last, start, min(start + len(last) + LOOK_EVERY, size))
            if start + len(last) > size:
                break
            boundary = self.common_boundary(last)
            done += self.committed(last, boundary, text, start)
            start += boundary
            last = last[boundary:]
        return done + self.committed(last, size - start, text, start)

    def extended(self, text: str, last: list[int], start: int, until: int) -> list[int]:
        """``last`` continued up to the position ``until``: the one step of the search.

        Exactly one piece ends the segmentation of every beginning of a text, so the
        first that may stand beside the path before it is the one.
        """
        tails, pairs, width = self.tails.get, self.pairs, self.width
        longest = self.vocabulary.longest
        for end in range(start + len(last), until + 1):
            found = NONE
            for first in range(end - 1, max(end - longest, start) - 1, -1):
                piece = tails(text[first:end])
                if piece is None:
                    break
                if piece < 0:
                    continue
                before = last[first - start]
                if before >= 0:
                    pair = before * width + piece
                    holds = pairs.get(pair)
                    if holds is None:
                        if len(pairs) >= KNOWN_PAIRS:
                            pairs.clear()
                        holds = pairs[pair] = self.follows(before, piece)
                    if not holds:
                        continue
                found = piece
                break
            last.append(found)
        return last

    def common_boundary(self, last: list[int]) -> int:
        """The last boundary that the paths to all positions of the window share."""
        sizes = self.sizes
        open_ends = set(range(max(len(last) - self.vocabulary.longest, 0), len(last)))
        while len(open_ends) > 1:
            latest = max(open_ends)
            open_ends.remove(latest)
            piece = last[latest]
            open_ends.add(max(latest - (sizes[piece] if piece >= 0 else 1), 0))
        return open_ends.pop()

    def committed(self, last: list[int], end: int, text: str, start: int) -> list[int]:
        """Ids of the path that ends at ``end``; a character without a piece as bytes."""
        sizes, byte_ids, found = self.sizes, self.vocabulary.byte_ids, []
        while end > 0:
            piece = last[end]
            if piece >= 0:
                found.append(piece)
                end -= sizes[piece]
            else:
                end -= 1
                code = text[start + end].encode(errors="replace")
                found.extend(byte_ids[byte] for byte in reversed(code))
        found.reverse()
        return found

    def decode(self, numbers) -> str:
        pieces = self.vocabulary.decoded
        text = b"".join([pieces[n] for n in numbers]).decode(errors="replace")
        return text[1:] if text[:1] == " " else text


def encode_texts(documents: DataFrame, key: str, text: str, path: str) -> DataFrame:
    """One row per document: key, ids, n_ids, round_trip.

    ``round_trip`` tells whether decoding the ids gives the text again (with spaces
    for U+2581). No shuffle: each task encodes the texts it reads.
    """
    vocabulary = documents.sparkSession.sparkContext.broadcast(load_vocabulary(path))
    kind = documents.schema[key].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> dict[str, list]:
        own = held(("codec", path), lambda: Codec(vocabulary.value))
        values, ends, same = [], [0], []
        for text in batch.column(1):
            text = text.as_py() or ""
            numbers = own.encode(text)
            values.append(np.array(numbers, np.int32))
            ends.append(ends[-1] + len(numbers))
            same.append(own.decode(numbers) == text.replace(SPACE, " "))
        flat = np.concatenate(values) if values else np.zeros(0, np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
        return {key: batch.column(0), "ids": lists, "n_ids": np.diff(ends), "round_trip": same}

    return map_batches(
        documents.select(F.col(key), F.col(text).alias("text_")),
        work,
        f"`{key}` {kind}, ids array<int>, n_ids long, round_trip boolean",
    )


def decode_ids(encoded: DataFrame, key: str, ids: str, path: str) -> DataFrame:
    """One row per list of ids: key, text."""
    vocabulary = encoded.sparkSession.sparkContext.broadcast(load_vocabulary(path))
    kind = encoded.schema[key].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> dict[str, list]:
        own = held(("codec", path), lambda: Codec(vocabulary.value))
        lists = (numbers.as_py() for numbers in batch.column(1))
        return {
            key: batch.column(0),
            "text": [None if numbers is None else own.decode(numbers) for numbers in lists],
        }

    return map_batches(encoded.select(key, F.col(ids).alias("ids_")), work, f"`{key}` {kind}, text string")
