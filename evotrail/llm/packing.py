"""Token ids packed into fixed-length rows by best-fit decreasing.

Texts become token ids; a document longer than a row is cut into whole rows and a rest,
losing nothing. The segments of a block of documents are placed longest first, each
into the open row with the least room that still holds it. A segment tree over the
possible amounts of room, whose nodes count the open rows below them, finds that room
in a number of steps that is the logarithm of the row's length.

Every packed row holds its ids (a fixed-length row of the id matrix, little endian,
unused places filled), the cumulative segment lengths, and position ids that start
again at 0 in every segment, so attention can be kept inside documents.

No shuffle: a task packs the documents it reads, in blocks of at most ``BLOCK_TOKENS``
tokens (or one document), so memory is bounded and only a block's last rows have room
left. ``unpacked`` gives every document's ids back. Which documents share a row, and
``pack_id``, depend on how the input is split into tasks; the ids of a document do not.

Defined results: a null or empty text has no tokens and is in no row (unless an end id
is given, which then is its only token); strings of special tokens in a text are
ordinary text; of any length, texts are encoded whole; equal rows are packed each; a
null key stays null; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evotrail.llm.batches import arrow_schema, held
from evotrail.llm.token_counts import cuts_at_spaces, merger, read_ranks

#: Tokens of a block that is packed at once.
BLOCK_TOKENS = 1 << 21
#: Distinct words a worker keeps; more are merged again when they return.
KNOWN_WORDS = 250_000


class WordIds(dict):
    """The ids of a word with a space before it, as the bytes of their numbers, merged when
    first asked for."""

    def __init__(self, merge, kind: np.dtype):
        super().__init__()
        self.merge, self.kind = merge, kind

    def __missing__(self, word: str) -> bytes:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        ids = self[word] = np.array(self.merge(" " + word), self.kind).tobytes()
        return ids


class TokenIds:
    """Encodes texts with one vocabulary file; one lives in each worker."""

    def __init__(self, path: str, kind: np.dtype):
        self.merge, _ = merger(path)
        self.kind, self.words = kind, WordIds(self.merge, kind)

    def ids(self, text: str) -> np.ndarray:
        if not cuts_at_spaces(text):
            return np.array(self.merge(text), self.kind)
        first, *others = text.split(" ")
        start = np.array(self.merge(first), self.kind).tobytes()
        return np.frombuffer(start + b"".join(map(self.words.__getitem__, others)), self.kind)


class RoomTree:
    """Open rows by the room they have left, as a segment tree of counts."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.counts = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        self.change(room, 1)

    def change(self, room: int, by: int) -> None:
        node = room + self.leaves
        while node:
            self.counts[node] += by
            node >>= 1

    def take(self, size: int) -> tuple[int, int] | None:
        """(room, row) of an open row with the least room of ``size`` or more."""
        node, counts = size + self.leaves, self.counts
        if not counts[node]:
            # Up to the first right neighbour that counts any, then down its left edge.
            while node & 1 or not counts[node + 1]:
                node >>= 1
                if node <= 1:
                    return None
            node += 1
            while node < self.leaves:
                node = 2 * node if counts[2 * node] else 2 * node + 1
        room = node - self.leaves
        self.change(room, -1)
        return room, self.rows[room].pop()


def best_fit(sizes: list[int], length: int) -> list[list[int]]:
    """Rows of item numbers, no row's sizes adding up to more than ``length``."""
    tree, rows = RoomTree(length), []
    for item in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        found = tree.take(sizes[item])
        if found is None:
            rows.append([])
            room, row = length, len(rows) - 1
        else:
            room, row = found
        rows[row].append(item)
        if room > sizes[item]:
            tree.add(room - sizes[item], row)
    return rows


def pack_documents(
    documents: DataFrame,
    key: str,
    text: str,
    path: str,
    length: int,
    end_id: int | None = None,
    fill_id: int = 0,
) -> DataFrame:
    """One row per packed row.

    pack_id, n_tokens, doc_ids and starts (by segment: its document and the first of its
    tokens), cu_seqlens (0 and the end of every segment), ids and position_ids (binary,
    ``length`` unsigned numbers of 2 bytes, or 4 where the vocabulary needs them).
    """
    kind = documents.schema[key].dataType.simpleString()
    schema = (
        f"pack_id long, n_tokens int, doc_ids array<{kind}>, starts array<long>,"
        " cu_seqlens array<int>, ids binary, position_ids binary"
    )
    kinds = arrow_schema(documents.sparkSession, schema)
    most = max(max(read_ranks(path)[0].values()), fill_id, end_id or 0, length)
    number = np.dtype("<u2" if most < 1 << 16 else "<u4")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = held(("ids", path, number.str), lambda: TokenIds(path, number))
        pack, waiting, tokens = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            for name, data in zip(batch.column(0), batch.column(1)):
                ids = encoder.ids(data.as_py() or "")
                if end_id is not None:
                    ids = np.append(ids, number.type(end_id))
                if waiting and tokens + len(ids) > BLOCK_TOKENS:
                    yield packed(waiting, pack)
                    pack, waiting, tokens = pack + tokens, [], 0
                if len(ids):
                    waiting.append((name.as_py(), ids))
                    tokens += len(ids)
        if waiting:
            yield packed(waiting, pack)

    def packed(waiting: list[tuple], pack: int) -> pa.RecordBatch:
        segments = [
            (name, at, ids[at : at + length])
            for name, ids in waiting
            for at in range(0, len(ids), length)
        ]
        rows = best_fit([len(s[2]) for s in segments], length)
        matrix = np.full((len(rows), length), fill_id, number)
        places = np.zeros((len(rows), length), number)
        names, starts, ends = [], [], []
        steps = np.arange(length, dtype=number)
        for at, row in enumerate(rows):
            edges = [0]
            for item in row:
                ids = segments[item][2]
                edge = edges[-1] + len(ids)
                matrix[at, edges[-1] : edge] = ids
                places[at, edges[-1] : edge] = steps[: len(ids)]
                edges.append(edge)
            names.append([segments[item][0] for item in row])
            starts.append([segments[item][1] for item in row])
            ends.append(edges)
        columns = {
            "pack_id": range(pack, pack + len(rows)),
            "n_tokens": [edges[-1] for edges in ends],
            "doc_ids": names,
            "starts": starts,
            "cu_seqlens": ends,
            "ids": [row.tobytes() for row in matrix],
            "position_ids": [row.tobytes() for row in places],
        }
        return pa.RecordBatch.from_arrays(
            [pa.array(columns[f.name], f.type) for f in kinds], schema=kinds
        )

    return documents.select(F.col(key), F.col(text).alias("text_")).mapInArrow(work, schema)


def write_packed(packs: DataFrame, folder: str) -> None:
    """Write packed rows; a run that repeats replaces what it wrote."""
    packs.write.mode("overwrite").parquet(folder)


def unpacked(packs: DataFrame, length: int) -> DataFrame:
    """(doc_id, ids): every packed document's ids again, for documents with a key of their own.

    A document's segments are gathered in one row, as its text was.
    """

    def segments(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            found = []
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], f"<u{len(row['ids']) // length}")
                edges = row["cu_seqlens"]
                for name, at, a, b in zip(row["doc_ids"], row["starts"], edges, edges[1:]):
                    found.append({"doc_id": name, "at": at, "part": ids[a:b].tolist()})
            yield pa.RecordBatch.from_pylist(found, schema=kinds)

    kind = packs.schema["doc_ids"].dataType.elementType.simpleString()
    schema = f"doc_id {kind}, at long, part array<int>"
    kinds = arrow_schema(packs.sparkSession, schema)
    parts = packs.select("doc_ids", "starts", "cu_seqlens", "ids").mapInArrow(segments, schema)
    gathered = parts.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("at", "part"))).alias("parts")
    )
    return gathered.select("doc_id", F.flatten("parts.part").alias("ids"))
