"""Removal of passages that repeat: every word covered by a repeated window of words.

Windows are found level by level; a window can only repeat if the shorter ones in it do,
so each level looks only at what repeated at half its length:

1. Anchors, half a window long. Of every ``window - anchor + 1`` neighbouring anchors
   only the one with the lowest hash is looked up. That loses nothing: equal windows
   hold equal anchors and so choose the same one. About one word in ten starts a
   chosen anchor; most of them occur once and end here.
2. Windows, twice as long: the windows that chose a repeated anchor. They lie side by
   side, and the words of all of them together are their context. Where a context
   occurs twice, all its windows repeat. Where contexts around equal anchors differ (at
   the ends of a passage), each distinct context gives its windows once, and a window
   counts as often as its contexts occur.

A passage that a third of all documents share is a few distinct contexts with counts:
sums made before rows are moved, never a list. Lists are kept for one document only.
Documents are told apart by a hash of key and text, so equal rows share one list.

Windows are equal if the 64-bit hash of their anchor and another of their own words are.

Defined results: a null or empty text has no words and keeps the empty text; a text
shorter than the window loses nothing; windows are judged on the input; repeats within
a document count; whole texts of any length are read; equal texts lose all words if
they have a window; rows with equal or null keys are documents of their own; an empty
table gives no rows; other columns are passed on, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evotrail.llm.batches import arrow_schema, held
from evotrail.staging import drop_staged, release, staged_table

#: Distinct words whose hash a worker keeps.
KNOWN_WORDS = 200_000
#: Anchors handed to Spark at a time.
ROWS_AT_ONCE = 100_000
# Odd multipliers of the two rolling hashes (any odd 64-bit numbers do).
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


class WordHashes(dict):
    """The 64-bit hash of a word, computed when first asked for."""

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh3_64_intdigest

        if len(self) >= KNOWN_WORDS:
            self.clear()
        code = self[word] = xxh3_64_intdigest(word)
        return code


def word_codes(data: bytes) -> np.ndarray:
    words = data.split()  # bytes: ASCII white space only
    hashes = held("word hashes", WordHashes)
    return np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))


def mixed(codes: np.ndarray) -> np.ndarray:
    """Spread the bits, so that low hashes and low bits are as good as random."""
    codes = (codes ^ (codes >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    codes = (codes ^ (codes >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return codes ^ (codes >> np.uint64(31))


def powers_of(multiplier: int, most: int) -> np.ndarray:
    powers = np.full(most + 1, multiplier & (2**64 - 1), np.uint64)
    powers[0] = 1
    return np.multiply.accumulate(powers)


#: Words hashed at a time, which bounds memory for long texts.
PART = 1 << 18
PLACE_BITS = np.uint64(20)
_POWERS = [powers_of(m, PART + 4096) for m in MULTIPLIERS]
_INVERSE = [powers_of(pow(m, -1, 1 << 64), PART + 4096) for m in MULTIPLIERS]


class Hasher:
    """Hashes of intervals of a part of a text's words, by differences of rolling sums."""

    def __init__(self, codes: np.ndarray):
        self.sums = []
        for powers in _POWERS:
            sums = np.zeros(len(codes) + 1, np.uint64)
            np.cumsum(codes * powers[: len(codes)], out=sums[1:])
            self.sums.append(sums)

    def of(self, starts: np.ndarray, ends: np.ndarray, which: int) -> np.ndarray:
        sums = self.sums[which]
        return mixed((sums[ends] - sums[starts]) * _INVERSE[which][starts])


def parts_of(codes: np.ndarray, window: int) -> Iterator[tuple[int, np.ndarray]]:
    """(start, codes) of parts that hold every window exactly once."""
    if window > 4000:
        raise ValueError("windows of more than 4000 words are not built for")
    for start in range(0, max(len(codes) - window + 1, 0), PART):
        yield start, codes[start : start + PART + window - 1]


def runs(codes: np.ndarray, window: int, anchor: int):
    """(first window, last window, hash of the anchor) of the runs of neighbouring windows
    that choose the same anchor, for the words of one part.

    A window chooses its leftmost anchor with the lowest hash, so equal windows choose
    equal anchors at the same distance, and no run holds equal windows.
    """
    starts = np.arange(len(codes) - anchor + 1)
    hashes = Hasher(codes).of(starts, starts + anchor, 0)
    low = (hashes >> PLACE_BITS << PLACE_BITS) | starts.astype(np.uint64)
    width, windows = window - anchor + 1, len(codes) - window + 1
    reach = 1
    while 2 * reach <= width:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    low = np.minimum(low[:windows], low[width - reach : width - reach + windows])
    first = np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1])))
    last = np.concatenate((first[1:], [windows])) - 1
    place = (low[first] & ((np.uint64(1) << PLACE_BITS) - np.uint64(1))).astype(np.int64)
    return first, last, hashes[place]


def anchor_rows(texts: DataFrame, window: int, anchor: int) -> DataFrame:
    """One row per run of windows in texts (who_, text_): who, first, n (windows), anchor."""
    schema = "who long, first long, n int, anchor long"
    kinds = arrow_schema(texts.sparkSession, schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for who, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                codes = word_codes(data.as_py() or b"")
                for start, part in parts_of(codes, window):
                    first, last, chosen = runs(part, window, anchor)
                    rows.append((np.full(len(first), who), first + start, last - first + 1, chosen))
                    size += len(first)
                if size >= ROWS_AT_ONCE:
                    yield flat(rows, kinds)
                    rows, size = [], 0
        if rows:
            yield flat(rows, kinds)

    return texts.mapInArrow(work, schema)


def flat(rows: list[tuple], kinds: pa.Schema) -> pa.RecordBatch:
    columns = [np.concatenate(parts) for parts in zip(*rows)]
    found = [
        pa.array(c.view(np.int64) if c.dtype == np.uint64 else c).cast(f.type)
        for c, f in zip(columns, kinds)
    ]
    return pa.RecordBatch.from_arrays(found, schema=kinds)


def window_rows(listed: DataFrame, window: int) -> DataFrame:
    """The windows of the listed runs of texts (who_, text_, runs_): one row per run."""
    schema = "who long, first long, n int, anchor long, context long, windows array<long>"
    kinds = arrow_schema(listed.sparkSession, schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for who, data, found in zip(
                batch.column(0).to_pylist(), batch.column(1), batch.column(2)
            ):
                codes = word_codes(data.as_py())
                chosen = sorted((r["first"], r["n"], r["anchor"]) for r in found.as_py())
                firsts, n, anchors = (np.array(c, np.int64) for c in zip(*chosen))
                part = firsts // PART
                for number in np.unique(part).tolist():
                    at, start = part == number, number * PART
                    hasher = Hasher(codes[start : start + PART + window - 1])
                    first, size = firsts[at] - start, n[at]
                    ends = np.cumsum(size)
                    each = np.repeat(first - ends + size, size) + np.arange(ends[-1])
                    windows = hasher.of(each, each + window, 1).view(np.int64)
                    context = hasher.of(first, first + size - 1 + window, 1).view(np.int64)
                    offsets = pa.array(np.concatenate(([0], ends)), pa.int32())
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(first), who), pa.int64()),
                            pa.array(firsts[at], pa.int64()),
                            pa.array(size, pa.int32()),
                            pa.array(anchors[at], pa.int64()),
                            pa.array(context, pa.int64()),
                            pa.ListArray.from_arrays(offsets, pa.array(windows, pa.int64())),
                        ],
                        schema=kinds,
                    )

    return listed.mapInArrow(work, schema)


def repeated_runs(texts: DataFrame, window: int, anchor: int) -> DataFrame:
    """First level: (who, runs_) with the runs of each text whose anchor occurs again.

    The runs are stored, narrow, so that texts are hashed once and both sides of the join
    are moved, where hot anchors can be split.
    """
    chosen = staged_table(anchor_rows(texts, window, anchor))
    repeated = staged_table(
        chosen.groupBy("anchor")
        .agg(F.count(F.lit(1)).alias("times"))
        .where("times > 1")
        .select("anchor")
    )
    found = staged_table(
        chosen.join(repeated, "anchor")
        .groupBy("who")
        .agg(F.collect_set(F.struct("first", "n", "anchor")).alias("runs_"))
    )
    drop_staged(chosen, repeated)
    return found


def repeated_intervals(found: DataFrame, window: int) -> DataFrame:
    """Second level: (who, cuts_), the words that repeated windows cover, as intervals."""
    # One occurrence stands for each context; both its columns come from one row.
    contexts = staged_table(
        found.groupBy("anchor", "context").agg(
            F.count(F.lit(1)).alias("times"),
            F.first("who").alias("who"),
            F.first("first").alias("first"),
        )
    )
    several = contexts.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    unlike = contexts.join(several, "anchor").select("anchor", "times", "who", "first")
    windows = staged_table(
        found.select("who", "first", "windows")
        .join(unlike, ["who", "first"])
        .select("who", "first", "anchor", "times", F.posexplode("windows").alias("place", "code"))
    )
    again = staged_table(
        windows.groupBy("anchor", "code")
        .agg(F.sum("times").alias("times"))
        .where("times > 1")
        .select("anchor", "code")
    )
    repeated = staged_table(contexts.where("times > 1").select("anchor", "context"))
    whole = (
        found.select("who", "first", "n", "anchor", "context")
        .join(repeated, ["anchor", "context"])
        .select("who", F.col("first").alias("start"), (F.col("first") + F.col("n") - 1).alias("at"))
    )
    # A context that occurs once has one row, which its windows lead back to.
    single = (
        windows.where("times = 1")
        .join(again, ["anchor", "code"])
        .select("who", (F.col("first") + F.col("place")).alias("start"))
        .withColumn("at", F.col("start"))
    )
    cuts = staged_table(
        whole.union(single)
        .select("who", F.struct("start", (F.col("at") + window).alias("stop")).alias("cut"))
        .groupBy("who")
        .agg(F.collect_set("cut").alias("cuts_"))
    )
    drop_staged(contexts, windows, again, repeated)
    return cuts


def without(texts: pa.Array, cuts: pa.Array) -> pa.Array:
    """The kept words of each text, their number and that of the words removed."""
    kept, total, removed = [], [], []
    for data, found in zip(texts, cuts):
        words = (data.as_py() or b"").split()
        found = found.as_py()
        total.append(len(words))
        if found:
            steps = np.zeros(len(words) + 1, np.int64)
            np.add.at(steps, [c["start"] for c in found], 1)
            np.subtract.at(steps, [c["stop"] for c in found], 1)
            left = np.cumsum(steps[:-1]) == 0
            words = [words[at] for at in np.flatnonzero(left).tolist()]
        kept.append(b" ".join(words))
        removed.append(total[-1] - len(words))
    return pa.StructArray.from_arrays(
        [
            pa.array(kept, pa.binary()).cast(pa.string()),
            pa.array(total, pa.int64()),
            pa.array(removed, pa.int64()),
        ],
        ["kept", "n_words", "n_removed"],
    )


def remove_repeats(documents: DataFrame, key: str, text: str, window: int) -> DataFrame:
    """One row per document: ``doc`` (all its columns), ``kept`` (the words left, joined by
    one space), ``n_words`` and ``n_removed``."""
    anchor = -(-window // 2)
    # A null adds nothing to a hash; the flag tells a null key from a null text.
    rows = documents.select(
        F.struct("*").alias("doc"),
        F.xxhash64(F.col(key).isNull(), F.col(key).cast("string"), F.col(text)).alias("who_"),
        F.col(text).cast("binary").alias("text_"),
    )
    texts = rows.select("who_", "text_")
    first = repeated_runs(texts, window, anchor)
    release(documents.sparkSession)
    listed = texts.join(first, F.col("who_") == F.col("who")).select("who_", "text_", "runs_")
    second = staged_table(window_rows(listed, window))
    drop_staged(first)
    release(documents.sparkSession)
    cuts = repeated_intervals(second, window)
    drop_staged(second)
    release(documents.sparkSession)
    cut = F.arrow_udf(without, "kept string, n_words long, n_removed long")
    return (
        rows.join(cuts, F.col("who_") == F.col("who"), "left")
        .select("doc", cut("text_", "cuts_").alias("left_"))
        .select("doc", "left_.kept", "left_.n_words", "left_.n_removed")
    )
