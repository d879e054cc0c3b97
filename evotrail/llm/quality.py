"""Quality scores from gradient-boosted trees over document statistics.

The trees are grown on histograms of the statistics (logistic loss, leaf by leaf
levels) from a bounded sample of labelled rows, then flattened into arrays: feature,
cut, left child and value of every node. A task computes the statistics of its
documents and walks all trees at once with numpy indexing, a level at a time.

Labels are learned only from rows that ``batches.learns_from`` allows. The sample is
the only bounded thing: at most ``sample_rows`` labelled rows, chosen by a hash of the
key, meet on the driver as statistics (``len(FEATURES)`` numbers each, never texts).

Defined results: a null or empty text has all statistics 0 and is scored by the same
trees; texts are read whole; equal texts have equal scores; without any usable label
(or with one class only) the score is the share of label 1, 0.5 if there is none; rows
with a null label are not learned from; if a key has several labels or texts, each
combination is learned; a null key is scored and is not held out; other columns are
never inputs.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evotrail.llm.batches import learns_from, map_batches

SAMPLE_ROWS = 20_000
TREES, DEPTH, RATE, BINS = 120, 4, 0.15, 64
LEAF_ROWS, RIDGE = 20, 1.0

FEATURES = (
    "bytes_log", "words_log", "mean_word", "long_words", "upper_share", "digit_share",
    "space_share", "mark_share", "symbol_share", "high_share", "line_mean", "lines_log",
    "repeated_lines", "distinct_words", "top_word", "top_pair", "repeated_triples",
    "one_letter_words", "marked_words", "capital_words", "ending_lines", "pipe_share",
    "bang_share", "packed_share", "byte_entropy", "letter_pairs",
)

_CLASS = np.zeros(256, np.int64)
for _kind, _bytes in enumerate(
    (range(65, 91), range(97, 123), range(48, 58), (32, 9, 11, 12, 13), (10,), (46, 44, 59, 58),
     (33,), (124,), range(128, 256)), 1,
):
    _CLASS[list(_bytes)] = _kind
#: Bytes compressed at a time to measure how packed a text is.
PACKED_BLOCK = 1 << 20


def statistics(data: bytes) -> list[float]:
    """The numbers in ``FEATURES`` for one text in UTF-8."""
    size = len(data)
    words = data.split()
    if not words:
        return [0.0] * len(FEATURES)
    raw = np.frombuffer(data, np.uint8)
    bytes_seen = np.bincount(raw, minlength=256)
    kinds = np.bincount(_CLASS, weights=bytes_seen, minlength=10)
    other, upper, lower, digit, space, newline, mark, bang, pipe, high = kinds.tolist()
    n = len(words)
    lengths = np.fromiter(map(len, words), np.int64, n)
    numbers: dict[bytes, int] = {}
    codes = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, n)
    pairs = codes[:-1] * len(numbers) + codes[1:]
    triples = pairs[:-1] * 1_000_003 + codes[2:]
    lines = [line for line in data.split(b"\n") if line.strip()]
    seen_lines = len(set(lines))
    shares = bytes_seen[bytes_seen > 0] / size
    packed = sum(
        len(zlib.compress(data[at : at + PACKED_BLOCK], 1)) for at in range(0, size, PACKED_BLOCK)
    )
    letters = max(upper + lower + high, 1.0)
    firsts = [w[0] for w in words]
    lasts = [w[-1] for w in words]
    marks = sum(not (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c > 127) for c in lasts)
    return [
        np.log1p(size), np.log1p(n), float(lengths.mean()), float((lengths > 14).mean()),
        upper / letters, digit / size, (space + newline) / size, mark / size, other / size,
        high / size, size / max(len(lines), 1), np.log1p(len(lines)),
        1 - seen_lines / max(len(lines), 1), len(numbers) / n,
        float(np.bincount(codes).max()) / n, top_share(pairs), repeated_share(triples),
        float((lengths == 1).mean()), marks / n, sum(65 <= c <= 90 for c in firsts) / n,
        sum(line[-1:] in b".!?" for line in lines) / max(len(lines), 1), pipe / size,
        bang / size, packed / size, float(-(shares * np.log2(shares)).sum()),
        float(np.count_nonzero(raw[1:] == raw[:-1])) / size,
    ]


def top_share(codes: np.ndarray) -> float:
    if not len(codes):
        return 0.0
    return float(np.unique(codes, return_counts=True)[1].max()) / len(codes)


def repeated_share(codes: np.ndarray) -> float:
    return 1 - len(np.unique(codes)) / len(codes) if len(codes) else 0.0


@dataclass(frozen=True)
class Trees:
    """All trees as arrays: row t is tree t, node k has children 2k+1 and 2k+2."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    base: float

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """The probability of label 1 for rows of statistics."""
        margin = np.full(len(rows), self.base)
        number = np.arange(len(rows))
        for feature, cut, value in zip(self.feature, self.cut, self.value):
            node = np.zeros(len(rows), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (rows[number, feature[node]] > cut[node])
            margin += value[node]
        return 1 / (1 + np.exp(-margin))


def grow(rows: np.ndarray, labels: np.ndarray) -> Trees:
    """Boosted trees for 0/1 ``labels``; a split needs ``LEAF_ROWS`` rows on both sides."""
    nodes = 2 ** (DEPTH + 1) - 1
    positive = labels.mean() if len(labels) else 0.5
    if not len(labels) or not 0 < positive < 1:
        margin = float(np.log((positive + 1e-9) / (1 - positive + 1e-9)))
        return Trees(*np.zeros((3, 0, nodes)), base=margin)
    base = float(np.log(positive / (1 - positive)))
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in rows.T]
    binned = np.stack([np.searchsorted(c, column) for c, column in zip(cuts, rows.T)], axis=1)
    margin = np.full(len(rows), base)
    features, limits, values = [], [], []
    for _ in range(TREES):
        chance = 1 / (1 + np.exp(-margin))
        slope, curve = labels - chance, chance * (1 - chance)
        feature, limit = np.zeros(nodes, np.int64), np.full(nodes, np.inf)
        node = np.zeros(len(rows), np.int64)
        for level in range(DEPTH):
            first, width = 2**level - 1, 2**level
            best = best_splits(binned, node - first, width, slope, curve)
            for place, (gain, column, at) in enumerate(best):
                if gain > 1e-6:
                    feature[first + place], limit[first + place] = column, cuts[column][at]
            node = 2 * node + 1 + (rows[np.arange(len(rows)), feature[node]] > limit[node])
        leaf = node - (2**DEPTH - 1)
        ups = np.bincount(leaf, slope, 2**DEPTH)
        downs = np.bincount(leaf, curve, 2**DEPTH)
        value = np.concatenate((np.zeros(2**DEPTH - 1), RATE * ups / (downs + RIDGE)))
        margin += value[node]
        features.append(feature), limits.append(limit), values.append(value)
    return Trees(np.array(features), np.array(limits), np.array(values), base)


def best_splits(binned, place, width, slope, curve) -> list[tuple[float, int, int]]:
    """(gain, feature, cut) of the best split of each node of a level."""
    best = [(0.0, 0, 0)] * width
    for column in range(binned.shape[1]):
        cell = place * BINS + binned[:, column]
        g, h, c = (
            np.bincount(cell, weight, width * BINS).reshape(width, BINS).cumsum(axis=1)
            for weight in (slope, curve, None)
        )
        total_g, total_h, total_c = g[:, -1:], h[:, -1:], c[:, -1:]
        gain = (
            g**2 / (h + RIDGE)
            + (total_g - g) ** 2 / (total_h - h + RIDGE)
            - total_g**2 / (total_h + RIDGE)
        )
        gain[(c < LEAF_ROWS) | (total_c - c < LEAF_ROWS)] = 0
        at = gain.argmax(axis=1)
        for node in range(width):
            if gain[node, at[node]] > best[node][0]:
                best[node] = (float(gain[node, at[node]]), column, int(at[node]))
    return best


def labelled_sample(
    documents: DataFrame, labels: DataFrame, key: str, text: str, label: str, rows: int
) -> DataFrame:
    """(key, text_, label_): at most ``rows`` rows that may be learned from.

    The first rows by a hash of the key; their number bounds the broadcast.
    """
    chosen = (
        labels.where(learns_from(key) & F.col(label).isin(0, 1))
        .select(F.col(key).alias("key_"), F.col(label).cast("int").alias("label_"))
        .orderBy(F.xxhash64("key_"), "key_", "label_")
        .limit(rows)
    )
    texts = documents.select(F.col(key).alias("key_"), F.col(text).cast("binary").alias("text_"))
    return texts.join(F.broadcast(chosen), "key_")


def fit(documents: DataFrame, labels: DataFrame, key: str, text: str, label: str,
        sample_rows: int = SAMPLE_ROWS) -> Trees:
    """Trees grown on the statistics of a bounded sample of labelled rows."""
    sample = labelled_sample(documents, labels, key, text, label, sample_rows)

    def work(batch: pa.RecordBatch) -> dict[str, list]:
        found = [statistics(data.as_py() or b"") for data in batch.column(0)]
        return {"numbers": found, "label_": batch.column(1)}

    learned = map_batches(
        sample.select("text_", "label_"), work, "numbers array<double>, label_ int"
    ).toPandas()
    # Rows come in any order; sums of floats must not depend on it.
    learned = learned.iloc[sorted(range(len(learned)), key=lambda i: (
        tuple(learned["numbers"].iloc[i]), learned["label_"].iloc[i]))]
    rows = np.array(learned["numbers"].tolist(), float).reshape(-1, len(FEATURES))
    return grow(rows, learned["label_"].to_numpy(float))


def score_quality(
    documents: DataFrame, labels: DataFrame, key: str, text: str, label: str,
    threshold: float, sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """One row per document: key, held_out, score, predicted (1 from ``threshold`` on)."""
    spark = documents.sparkSession
    trees = spark.sparkContext.broadcast(
        fit(documents, labels, key, text, label, sample_rows)
    )
    kind = documents.schema[key].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> dict[str, list]:
        rows = np.array([statistics(data.as_py() or b"") for data in batch.column(2)], float)
        scores = trees.value.scores(rows.reshape(-1, len(FEATURES)))
        return {
            key: batch.column(0),
            "held_out": batch.column(1),
            "score": scores,
            "predicted": (scores >= threshold).astype(np.int32),
        }

    rows = documents.select(
        F.col(key),
        (F.col(key).isNotNull() & ~learns_from(key)).alias("held_out"),
        F.col(text).cast("binary").alias("text_"),
    )
    return map_batches(
        rows, work, f"`{key}` {kind}, held_out boolean, score double, predicted int"
    )
