"""Alignment of two tokenizers' tokens, with corpus-wide counts of aligned pairs.

A text is encoded twice, by a byte-level BPE file (A) with a space before the text and by
a SentencePiece model (B), which adds that space itself. Byte offsets where tokens of
both end cut them into groups; the two tokens that end there are linked.

Both vocabularies cut text before a single space between other characters: A's pattern
begins a new word there, and no piece of B goes on into a space. So a unit, a word with
the space before it, is encoded and aligned once for a worker, and a text's result is put
together from its units'. A model with pieces that go on into a space is refused.

Counting: the first pass gives the distinct pairs, and what every task counted of them.
A minimal perfect hash of the pairs turns that into dense vectors, summed over the tasks
as a tree; its table of keys verifies every look-up. The second pass aligns the documents
again and looks the counts up.

Two tokens that end together are suffixes of each other's bytes, so the vocabularies
alone bound the number of distinct pairs (``most_pairs``), whatever the corpus: the hash
and the counts are broadcast on that ground, and vocabularies beyond ``PAIRS`` refused.

Defined results: a null or empty text has no tokens; nor has one whose tokens' bytes are
not the space and the text again (U+2581 reads as a space in B), and it counts nowhere;
the strings of special tokens inside texts are plain text; texts are encoded whole, of
any length; equal texts have equal results and each of them counts; an empty table gives
no rows; columns other than key and text are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain, filterfalse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evotrail.llm.batches import arrow_schema, held
from evotrail.llm.perfect_hash import PerfectHash
from evotrail.llm.token_counts import cuts_at_spaces, merger, read_ranks
from evotrail.llm.vector_sums import slots, tree_sum, whole
from evotrail.staging import staged_table

#: The mark for a space in B's pieces, a fixed value of the format.
SPACE = "▁"
#: Units a worker keeps, and characters of text it splits at a time.
KNOWN_UNITS, CHARACTERS = 250_000, 1 << 20
#: Distinct pairs that may be broadcast; about 20 bytes each.
PAIRS = 20_000_000
#: Pairs of a task in one row.
ROW = 1 << 16

_CUT = re.compile(r"(?<=\S) (?=\S)")
_B_BITS = np.uint64(32)


def units_of(text: str) -> list[str]:
    """The text cut at single spaces between other characters, without those spaces."""
    return text.split(" ") if cuts_at_spaces(text) else _CUT.split(text)


def bytes_of_a(path: str) -> list[bytes]:
    """The bytes of every id; none for special tokens."""
    ranks, _ = read_ranks(path)
    found = [b""] * (max(ranks.values()) + 1)
    for data, number in ranks.items():
        found[number] = data
    return found


def bytes_of_b(path: str) -> list[bytes]:
    """The bytes of every piece that text can match; none for others."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = [b""] * model.get_piece_size()
    for number in range(len(found)):
        piece = model.id_to_piece(number)
        if model.is_byte(number):
            found[number] = bytes([int(piece[1:-1], 16)])
        elif not (model.is_control(number) or model.is_unknown(number)):
            if SPACE in piece.lstrip(SPACE):
                raise ValueError(f"{path}: the piece {piece!r} goes on into a space")
            found[number] = piece.replace(SPACE, " ").encode()
    return found


def most_pairs(path_a: str, path_b: str) -> int:
    """How many distinct pairs any corpus can link: one token's bytes end the other's."""
    a, b = (list(filter(None, tokens)) for tokens in (bytes_of_a(path_a), bytes_of_b(path_b)))

    def suffixes(tokens, others: list[bytes], shorter: int) -> int:
        counts: dict[bytes, int] = {}
        for other in others:
            counts[other] = counts.get(other, 0) + 1
        ends = (token[at:] for token in tokens for at in range(shorter, len(token)))
        return sum(counts.get(end, 0) for end in ends)

    return suffixes(a, b, 0) + suffixes(b, a, 1)


class Units:
    """Aligned units of two vocabularies; one lives in each worker.

    New units are joined by the spaces they were cut at, encoded together and aligned by
    the running sums of their tokens' bytes, all at once.
    """

    def __init__(self, path_a: str, path_b: str, with_groups: bool = True):
        import sentencepiece

        self.encode_a, _ = merger(path_a)
        self.encode_b = sentencepiece.SentencePieceProcessor(model_file=path_b).encode
        self.bytes_a, self.bytes_b = bytes_of_a(path_a), bytes_of_b(path_b)
        self.lengths_a, self.lengths_b = map(byte_lengths, (self.bytes_a, self.bytes_b))
        self.with_groups = with_groups
        if with_groups:
            self.inner_a, self.last_a = (written(self.bytes_a, after) for after in ",|")
            self.inner_b, self.last_b, self.end_b = (
                written(self.bytes_b, after) for after in ",;\n"
            )
        self.clear()

    def clear(self) -> None:
        self.places: dict[str, int] = {}
        self.groups: list[str] = []
        #: Tokens of A and of B, and links, of each unit.
        self.sizes: list[np.ndarray] = []
        self.keys: list[np.ndarray] = []  # of all units, one after the other
        self.broken: set[int] = set()  # units whose tokens have other bytes

    def places_of(self, units: list[str]) -> np.ndarray:
        """The places of known units in the table."""
        return np.fromiter(map(self.places.__getitem__, units), np.int64, len(units))

    def add(self, units: Iterable[str]) -> None:
        """Align those of the units that are not in the table."""
        new = list(dict.fromkeys(filterfalse(self.places.__contains__, units)))
        joined = new
        if not (all(new) and cuts_at_spaces(" ".join(new))):  # some begin or end with space
            joined = [unit for unit in new if unit and unit.strip() == unit]
        if joined and not self.align(joined):
            joined = []
        for unit in new if len(joined) < len(new) else ():
            if unit not in self.places and not self.align([unit]):
                self.broken.add(len(self.places))
                self.store([unit], np.zeros((1, 3), np.int64), np.zeros(0, np.uint64), [""])

    def align(self, units: list[str]) -> bool:
        """Add the units' alignments; False if their tokens' bytes are not theirs."""
        text = " ".join(units)
        data = (" " + text).encode()
        ids_a, ids_b = self.encode_a(" " + text), self.encode_b(text)
        for ids, known in ((ids_a, self.bytes_a), (ids_b, self.bytes_b)):
            if b"".join(map(known.__getitem__, ids)) != data:
                return False
        a, b = np.array(ids_a, np.int64), np.array(ids_b, np.int64)
        ends_a, ends_b = self.lengths_a[a].cumsum(), self.lengths_b[b].cumsum()
        ends = np.cumsum([len(unit.encode()) + 1 for unit in units])
        common = np.intersect1d(ends_a, ends_b, assume_unique=True)
        # Tokens and groups up to each end of a group, and of a unit.
        upto_a, upto_b = (np.searchsorted(e, common, "right") for e in (ends_a, ends_b))
        of_units = np.searchsorted(common, ends)
        if not np.array_equal(common[of_units], ends):
            return False
        counts = np.stack([upto_a[of_units], upto_b[of_units], of_units + 1], axis=1)
        keys = (a[upto_a - 1] << 32 | b[upto_b - 1]).astype(np.uint64)
        groups = self.written_groups(a, b, upto_a, upto_b, of_units) if self.with_groups else []
        self.store(units, np.diff(counts, axis=0, prepend=0), keys, groups)
        return True

    def written_groups(self, a, b, upto_a, upto_b, of_units) -> list[str]:
        """The units' groups as text: every token with the sign that comes after it."""
        text_a, text_b = self.inner_a[a], self.inner_b[b]
        text_a[upto_a - 1] = self.last_a[a[upto_a - 1]]
        text_b[upto_b - 1] = self.last_b[b[upto_b - 1]]
        lasts = upto_b[of_units] - 1
        text_b[lasts] = self.end_b[b[lasts]]
        # A group's tokens of A come before its tokens of B.
        group_a = np.repeat(np.arange(len(upto_a)), np.diff(upto_a, prepend=0))
        group_b = np.repeat(np.arange(len(upto_b)), np.diff(upto_b, prepend=0))
        whole_text = np.empty(len(a) + len(b), object)
        before_b = np.concatenate([[0], upto_b])
        whole_text[np.arange(len(a)) + before_b[group_a]] = text_a
        whole_text[np.arange(len(b)) + upto_a[group_b]] = text_b
        return "".join(whole_text.tolist()).split("\n")[:-1]

    def store(self, units: list[str], sizes: np.ndarray, keys: np.ndarray, groups: list[str]):
        first = len(self.places)
        self.places.update(zip(units, range(first, first + len(units))))
        self.sizes.append(sizes)
        self.keys.append(keys)
        self.groups.extend(groups)

    def since(self, units: int, keys: int) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and keys of the units after so many units with so many keys."""
        self.sizes = [np.concatenate(self.sizes)] if self.sizes else [np.zeros((0, 3), np.int64)]
        self.keys = [np.concatenate(self.keys)] if self.keys else [np.zeros(0, np.uint64)]
        return self.sizes[0][units:], self.keys[0][keys:]


def byte_lengths(known: list[bytes]) -> np.ndarray:
    return np.array(list(map(len, known)), np.int64)


def written(known: list[bytes], after: str) -> np.ndarray:
    """Every id as text with the sign after it."""
    return np.array([f"{number}{after}" for number in range(len(known))], object)


@dataclass(frozen=True)
class PairCounts:
    """What is broadcast: how often every pair is linked, by the pair's slot."""

    slots: PerfectHash
    counts: np.ndarray
    best: np.ndarray  # 1 if no pair of the B id has a higher count

    @staticmethod
    def of(pairs: PerfectHash, counts: np.ndarray) -> PairCounts:
        ids = (pairs.keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
        highest = np.zeros(int(ids.max(initial=-1)) + 1, np.int64)
        np.maximum.at(highest, ids, counts)
        return PairCounts(pairs, counts, (counts == highest[ids]).astype(np.int64))

    def of_units(self, links: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """(best links, sum of counts, pairs without a count) of units with so many links,
        from all their keys. A worker's table may hold units of another table's texts."""
        slot = self.slots.slots(keys)
        known = slot >= 0
        each = np.zeros((len(slot), 3), np.int64)
        each[known, 0], each[known, 1] = self.best[slot[known]], self.counts[slot[known]]
        each[~known, 2] = 1
        sums = np.zeros((len(slot) + 1, 3), np.int64)
        np.cumsum(each, axis=0, out=sums[1:])
        ends = np.cumsum(links)
        return sums[ends] - sums[ends - links]


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of the batches with their texts: up to ``CHARACTERS`` in several texts."""
    for batch in batches:
        first, size, texts = 0, 0, []
        for at, value in enumerate(batch.column(1)):
            text = value.as_py() or ""
            if texts and size + len(text) > CHARACTERS:
                yield batch.slice(first, at - first), texts
                first, size, texts = at, 0, []
            size += len(text)
            texts.append(text)
        if texts:
            yield batch.slice(first), texts


def aligned(units: Units, texts: list[str]) -> Iterator[np.ndarray | None]:
    """The places of every text's units; None for a text without tokens."""
    cut = [units_of(text) if text and SPACE not in text else None for text in texts]
    units.add(chain.from_iterable(filter(None, cut)))
    for found in cut:
        places = None if found is None else units.places_of(found)
        if units.broken and places is not None and not units.broken.isdisjoint(places.tolist()):
            places = None
        yield places


def counted_pairs(documents: DataFrame, text: str, path_a: str, path_b: str) -> DataFrame:
    """(keys, counts) arrays: what every task counts of the pairs it links."""
    schema = "keys array<long>, counts array<long>"
    arrow = arrow_schema(documents.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = held(("pairs", path_a, path_b), lambda: Units(path_a, path_b, False))
        totals: tuple[np.ndarray, np.ndarray] = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        seen = np.zeros(0, np.int64)  # how often each unit of the table occurred

        def fold() -> None:
            nonlocal totals, seen
            sizes, keys = units.since(0, 0)
            links = sizes[: len(seen), 2]
            keys, times = keys[: links.sum()], np.repeat(seen, links)
            keys = np.concatenate([totals[0], keys[times > 0]])
            times = np.concatenate([totals[1], times[times > 0]])
            distinct, place = np.unique(keys, return_inverse=True)
            sums = np.zeros(len(distinct), np.int64)
            np.add.at(sums, place, times)
            totals, seen = (distinct, sums), np.zeros(0, np.int64)

        for _, texts in chunks(batches):
            if len(units.places) > KNOWN_UNITS:
                fold()
                units.clear()
            found = [places for places in aligned(units, texts) if places is not None]
            if found:
                more = np.bincount(np.concatenate(found), minlength=len(units.places))
                more[: len(seen)] += seen
                seen = more
        fold()
        keys, counts = totals
        for at in range(0, len(keys), ROW):
            part = {"keys": [keys[at : at + ROW].view("i8")], "counts": [counts[at : at + ROW]]}
            yield pa.RecordBatch.from_pydict(part, arrow)

    rows = documents.select(F.lit(0).alias("key_"), F.col(text).alias("text_"))
    return rows.mapInArrow(run, schema)


def count_pairs(documents: DataFrame, text: str, path_a: str, path_b: str) -> PairCounts:
    """How often every pair is linked in all documents."""
    if (bound := most_pairs(path_a, path_b)) > PAIRS:
        raise ValueError(f"the vocabularies can link {bound} pairs, above {PAIRS}")
    counted = staged_table(counted_pairs(documents, text, path_a, path_b))
    distinct = counted.select(F.explode("keys").alias("key")).distinct().toPandas()["key"]
    pairs = PerfectHash.of(distinct.to_numpy(np.int64).view(np.uint64))
    size = len(pairs.keys)
    known = documents.sparkSession.sparkContext.broadcast(pairs)
    schema = "slot long, values array<long>"
    arrow = arrow_schema(documents.sparkSession, schema)

    def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            keys = batch.column(0).flatten().to_numpy().view(np.uint64)
            place = known.value.slots(keys)
            np.add.at(total, place, batch.column(1).flatten().to_numpy())
        for slot, values in enumerate(slots(total)):
            yield pa.RecordBatch.from_pydict({"slot": [slot], "values": [values]}, arrow)

    sums = tree_sum(counted.mapInArrow(dense, schema), "long")
    return PairCounts.of(pairs, whole(sums, size, np.int64))


def align_texts(
    documents: DataFrame, key: str, text: str, path_a: str, path_b: str
) -> DataFrame:
    """One row per document: key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups.

    ``groups`` lists the groups as decimal ids, ``a1,a2|b1;a3|b2``. ``n_best`` counts the
    links whose pair has its B id's highest count, ``count_sum`` adds up the links'
    counts. No row is moved; both passes read the documents' key and text only.
    """
    counts = documents.sparkSession.sparkContext.broadcast(
        count_pairs(documents, text, path_a, path_b)
    )
    kind = documents.schema[key].dataType.simpleString()
    numbers = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
    schema = f"`{key}` {kind}, {', '.join(f'{name} long' for name in numbers)}, groups string"
    arrow = arrow_schema(documents.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = held(("units", path_a, path_b), lambda: Units(path_a, path_b))
        table, used = np.zeros((0, 6), np.int64), 0  # of the units so far, and keys of them
        for batch, texts in chunks(batches):
            if len(units.places) > KNOWN_UNITS:
                units.clear()
                table, used = np.zeros((0, 6), np.int64), 0
            found = list(aligned(units, texts))
            if len(table) < len(units.places):
                sizes, keys = units.since(len(table), used)
                more = counts.value.of_units(sizes[:, 2], keys)
                table, used = np.vstack([table, np.hstack([sizes, more])]), used + len(keys)
            sums = np.zeros((len(texts), 6), np.int64)
            written = []
            for row, places in enumerate(found):
                if places is None:
                    written.append("")
                    continue
                sums[row] = table[places].sum(axis=0)
                written.append(";".join(map(units.groups.__getitem__, places.tolist())))
            n_a, n_b, links, best, total, unknown = sums.T
            if unknown.any():
                raise ValueError("a text links a pair that the first pass did not find")
            columns = [batch.column(0), n_a, n_b, links, links, best, total, written]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow
            )

    rows = documents.select(F.col(key), F.col(text).alias("text_"))
    return rows.mapInArrow(run, schema)
