"""Toxicity scores from the nearest labelled examples by exact TF-IDF cosine.

Terms are the words of a text and the word beginnings of five letters (for inflected
forms). From a bounded sample of labelled rows, equal texts once, the terms that best
tell the classes apart are kept (chi-square over the sample); their document frequencies
are counted over all documents. Examples and documents are TF-IDF vectors over these terms.
A document's counts of kept terms are stored when first seen; scoring reads only them.

The examples form a block-max inverted index: postings by term, cut into blocks of
consecutive examples, with the largest weight of each term in each block. The postings of
a term in a block are a tile, one weight for every example of the block. Examples are
numbered by halving them again and again along the direction in which they differ most,
so a block holds alike ones and its bounds are sharp. For a
document the sum of these largest weights bounds the cosine of every example in a
block; blocks are scored in falling order of the bound until the k-th best cosine
reaches the next bound, so the k nearest are exact.

The nearest examples vote with the square of their cosine; class weights undo the
sampling, and a monotone map from vote to share of label 1, fitted on the examples'
own votes (each without itself), makes the score a probability. The nearest examples
are the evidence.

Labels are learned only from rows that ``batches.learns_from`` allows. At most
``sample_rows`` labelled rows of each class are learned from, chosen by a hash of the
key; only their term counts, over at most ``max_terms`` terms, meet on the driver.

Defined results: a text without any kept term (a null or empty one too) has no
neighbours and gets the share of label 1 among such examples; texts are read whole;
equal texts have equal scores; of equal cosines the example with the smaller number
comes first; without usable labels every score is 0; rows with a null label are not
learned from; a null key is scored and is not held out; other columns are never inputs.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evotrail.llm.batches import arrow_schema, learns_from, map_batches
from evotrail.staging import drop_staged, staged_table

SAMPLE_ROWS = 3_000
MAX_TERMS = 2_000
NEAREST = 15
BLOCK = 16
#: Blocks scored at first; each further look takes twice as many, up to so many tiles.
WALK, MOST_TILES = 32, 16_384
#: Rows scored by one task, more where that would make too many tasks.
ROWS_A_TASK, MOST_TASKS = 10_000, 20_000
#: Letters of a word that stand for its inflected forms.
STEM = 5
#: A term must be in so many examples to be kept, whatever their number.
LEAST_EXAMPLES = 4
WORDS = re.compile(r"[^\W\d_]+")


def term_counts(text: str) -> Counter:
    """How often each word, and each beginning of a longer word, is in the text."""
    words = Counter(WORDS.findall(text.lower()))
    stems: Counter = Counter()
    for word, n in words.items():
        if len(word) > STEM:
            stems[word[:STEM] + "*"] += n
    words.update(stems)
    return words


def kept_counts(text: str, numbers: dict[str, int]) -> dict[int, int]:
    """The counts of the kept terms only, by term number."""
    found: dict[int, int] = {}
    words = Counter(WORDS.findall(text.lower()))
    for word in words.keys() & numbers.keys():
        found[numbers[word]] = words[word]
    # Most texts hold no kept beginning, which one look at all of them tells.
    if {word[:STEM] + "*" for word in words} & numbers.keys():
        for word, n in words.items():
            if len(word) > STEM and (number := numbers.get(word[:STEM] + "*")) is not None:
                found[number] = found.get(number, 0) + n
    return found


@dataclass(frozen=True)
class Examples:
    """The labelled examples as a block-max inverted index, and the map from votes."""

    terms: dict[str, int]
    idf: np.ndarray
    keys: list
    labels: np.ndarray
    weights: np.ndarray  # of an example's vote
    tile_of: np.ndarray  # (terms, blocks): the tile of a term's postings; 0 if it has none
    tiles: np.ndarray  # (tiles, BLOCK): TF-IDF weights of a block's examples; the first is empty
    largest: np.ndarray  # (terms, blocks)
    limits: np.ndarray  # votes where the map steps up
    chances: np.ndarray
    without: float  # score of a text without any kept term

    def nearest(self, counts: dict[int, int], skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """(numbers, cosines) of the ``NEAREST`` best examples, best first, exactly."""
        terms, weights = vector(counts, self.idf)
        if not len(terms):
            return np.zeros(0, np.int64), np.zeros(0)
        bounds = weights @ self.largest[terms]
        order = np.argsort(-bounds, kind="stable")
        numbers, cosines = np.zeros(0, np.int64), np.zeros(0)
        tile_of = self.tile_of[terms]
        start, size = 0, WALK
        while True:
            size = max(1, min(size, MOST_TILES // len(terms)))
            blocks = order[start : start + size]
            blocks = blocks[bounds[blocks] > 0]
            if len(cosines) >= NEAREST:
                # Sums in another order may differ in the last digits.
                blocks = blocks[bounds[blocks] >= cosines[NEAREST - 1] - 1e-9]
            if not len(blocks):
                break
            start, size = start + size, 2 * size
            # All tiles of the document's terms in these blocks, summed term by term.
            found = self.tiles.take(tile_of[:, blocks], 0)
            found *= weights[:, None, None]
            found = found.sum(0)
            if skip >= 0:
                found[blocks == skip // BLOCK, skip % BLOCK] = 0
            block, place = np.nonzero(found)
            numbers = np.concatenate((numbers, blocks[block] * BLOCK + place))
            cosines = np.concatenate((cosines, found[block, place]))
            if len(cosines) > NEAREST:
                able = cosines >= np.partition(cosines, -NEAREST)[-NEAREST]
                numbers, cosines = numbers[able], cosines[able]
            best = np.lexsort((numbers, -cosines))[:NEAREST]
            numbers, cosines = numbers[best], cosines[best]
        return numbers, cosines

    def vote(self, numbers: np.ndarray, cosines: np.ndarray) -> float:
        """The weighted share of label 1 among the nearest."""
        votes = cosines**2 * self.weights[numbers]
        return float((votes * self.labels[numbers]).sum() / votes.sum())

    def score(self, counts: dict[int, int]) -> tuple[float, list[tuple]]:
        """The chance of label 1, and (key, cosine, label) of the nearest examples."""
        numbers, cosines = self.nearest(counts)
        if not len(numbers):
            return self.without, []
        place = np.searchsorted(self.limits, self.vote(numbers, cosines), side="right") - 1
        evidence = [
            (self.keys[n], float(c), int(self.labels[n])) for n, c in zip(numbers.tolist(), cosines)
        ]
        return float(self.chances[max(place, 0)]), evidence


def vector(counts: dict[int, int], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Term numbers in rising order and unit TF-IDF weights."""
    terms = np.array(sorted(counts), np.int64)
    if not len(terms):
        return terms, np.zeros(0)
    weights = (1 + np.log([counts[t] for t in terms.tolist()])) * idf[terms]
    return terms, weights / np.sqrt((weights**2).sum())


def rising(votes: np.ndarray, labels: np.ndarray, weights: np.ndarray):
    """(limits, chances) of the best rising step function (pool adjacent violators)."""
    steps, place = np.unique(votes, return_inverse=True)
    ones = np.bincount(place, weights * labels, len(steps))
    totals = np.bincount(place, weights, len(steps))
    pools: list[list[float]] = []  # vote, weight of label 1, weight
    for step in zip(steps.tolist(), ones.tolist(), totals.tolist()):
        pools.append(list(step))
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            _, more, total = pools.pop()
            pools[-1][1] += more
            pools[-1][2] += total
    table = np.array(pools).reshape(-1, 3)
    return table[:, 0], table[:, 1] / table[:, 2]


def alike_order(vectors: list[tuple[np.ndarray, np.ndarray]], terms: int) -> list[int]:
    """The vectors' numbers, alike ones side by side: halved along the direction of largest
    spread, found by a few power steps, down to one block.

    Bounded by the sample: 4 bytes a vector and term.
    """
    dense = np.zeros((len(vectors), terms), np.float32)
    for number, (at, weights) in enumerate(vectors):
        dense[number, at] = weights
    waiting, order = [np.arange(len(vectors))], []
    while waiting:
        part = waiting.pop()
        if len(part) <= BLOCK:
            order.extend(part.tolist())
            continue
        rows = dense[part]
        middle = rows.mean(0)
        way = np.random.default_rng(0).normal(size=terms).astype(np.float32)
        for _ in range(8):
            along = rows @ way - middle @ way
            way = along @ rows - along.sum() * middle
            length = np.linalg.norm(way)
            if length < 1e-6:
                break
            way /= length
        sides = part[np.argsort(rows @ way, kind="stable")]
        half = len(part) // 2 // BLOCK * BLOCK or BLOCK
        waiting += [sides[half:], sides[:half]]
    return order


def build(
    terms: list[str],
    frequencies: np.ndarray,
    documents: int,
    examples: list[tuple],
    class_weights: tuple[float, float],
) -> Examples:
    """The index of ``examples``: (key, label, {term number: count}) each."""
    idf = np.log((1 + documents) / (1 + frequencies)) + 1
    examples = sorted(examples, key=lambda e: (e[1], str(e[0])))
    order = alike_order([vector(e[2], idf) for e in examples], len(terms))
    examples = [examples[number] for number in order]
    labels = np.array([e[1] for e in examples], np.int64)
    weights = np.array([class_weights[label] for label in labels.tolist()], float)
    blocks = -(-len(examples) // BLOCK)
    vectors = [vector(e[2], idf) for e in examples]
    term_of = np.concatenate([v[0] for v in vectors]) if vectors else np.zeros(0, np.int64)
    value_of = np.concatenate([v[1] for v in vectors]) if vectors else np.zeros(0)
    owner = np.repeat(np.arange(len(examples)), [len(v[0]) for v in vectors])
    cells, place = np.unique(term_of * blocks + owner // BLOCK, return_inverse=True)
    tiles = np.zeros((len(cells) + 1, BLOCK))
    tiles[place + 1, owner % BLOCK] = value_of
    tile_of = np.zeros(len(terms) * blocks, np.int32)
    tile_of[cells] = np.arange(1, len(tiles))
    largest = tiles.max(1)[tile_of]
    bare = np.array([not e[2] for e in examples], bool)
    index = Examples(
        {term: number for number, term in enumerate(terms)},
        idf,
        [e[0] for e in examples],
        labels,
        weights,
        tile_of.reshape(len(terms), blocks),
        tiles,
        largest.reshape(len(terms), blocks),
        np.zeros(1),
        np.zeros(1),
        float(np.average(labels[bare], weights=weights[bare])) if bare.any() else 0.0,
    )
    votes, known = [], []
    for number, (_, _, counts) in enumerate(examples):
        found = index.nearest(counts, skip=number)
        if len(found[0]):
            votes.append(index.vote(*found))
            known.append(number)
    if known:
        limits, chances = rising(np.array(votes), labels[known], weights[known])
        index = Examples(**{**index.__dict__, "limits": limits, "chances": chances})
    return index


def labelled_terms(
    documents: DataFrame, labels: DataFrame, key: str, text: str, label: str, rows: int
) -> DataFrame:
    """(key_, label_, terms, counts) of at most ``rows`` labelled rows of each class."""
    usable = labels.where(learns_from(key) & F.col(label).isin(0, 1)).select(
        F.col(key).alias("key_"), F.col(label).cast("int").alias("label_")
    )
    parts = [
        usable.where(F.col("label_") == side).orderBy(F.xxhash64("key_"), "key_").limit(rows)
        for side in (0, 1)
    ]
    texts = documents.select(F.col(key).alias("key_"), F.col(text).alias("text_"))
    sample = texts.join(F.broadcast(parts[0].union(parts[1])), "key_")
    kind = documents.schema[key].dataType.simpleString()
    # Copies of a text are one example: the one with the smallest key.
    first = sample.groupBy("label_", F.xxhash64("text_").alias("code")).agg(
        F.min_by(F.struct("key_", "text_"), "key_").alias("one")
    )
    sample = first.where("one IS NOT NULL").select("one.*", "label_")

    def work(batch: pa.RecordBatch) -> dict[str, list]:
        found = [term_counts(text.as_py() or "") for text in batch.column(2)]
        return {
            "key_": batch.column(0),
            "label_": batch.column(1),
            "terms": [list(f) for f in found],
            "counts": [list(f.values()) for f in found],
        }

    return staged_table(
        map_batches(
            sample.select("key_", "label_", "text_"),
            work,
            f"key_ {kind}, label_ int, terms array<string>, counts array<int>",
        )
    )


def telling_terms(sample: DataFrame, ones: int, zeros: int, most: int) -> list[str]:
    """The terms with the largest chi-square between the classes, at most ``most``."""
    seen = (
        sample.select("label_", F.explode("terms").alias("term"))
        .groupBy("term")
        .agg(F.sum("label_").alias("a"), F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= LEAST_EXAMPLES)
    )
    total = float(ones + zeros)
    gap = F.col("a") * F.lit(float(zeros)) - (F.col("n") - F.col("a")) * F.lit(float(ones))
    spread = F.col("n") * (F.lit(total) - F.col("n")) * F.lit(max(float(ones * zeros), 1.0))
    # A term in every example tells nothing.
    strength = F.when(F.col("n") < total, F.lit(total) * gap * gap / spread).otherwise(0.0)
    told = seen.select("term", strength.alias("strength")).orderBy(F.desc("strength"), "term")
    rows = told.limit(most).select("term").collect()
    return [row[0] for row in rows]


def stored_counts(documents: DataFrame, key: str, text: str, terms: list[str]) -> DataFrame:
    """(key_, at, of): every row's kept terms by number, and their counts, stored."""
    numbers = documents.sparkSession.sparkContext.broadcast(
        {term: number for number, term in enumerate(terms)}
    )
    kind = documents.schema[key].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> dict[str, list]:
        found = [kept_counts(text.as_py() or "", numbers.value) for text in batch.column(1)]
        return {
            "key_": batch.column(0),
            "at": [list(f) for f in found],
            "of": [list(f.values()) for f in found],
        }

    return staged_table(
        map_batches(
            documents.select(F.col(key).alias("key_"), F.col(text).alias("text_")),
            work,
            f"key_ {kind}, at array<int>, of array<int>",
        )
    )


def document_frequencies(counted: DataFrame, terms: int) -> tuple[int, np.ndarray]:
    """(rows, rows with each term) of ``stored_counts``, over all of them: one row a task
    and term is moved."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(terms, np.int64)
        for batch in batches:
            found = batch.column(0).flatten().to_numpy(zero_copy_only=False)
            seen += np.bincount(found, minlength=terms)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at, kinds[0].type), seen[at]], schema=kinds)

    schema = "at int, n long"
    kinds = arrow_schema(counted.sparkSession, schema)
    sums = counted.select("at").mapInArrow(work, schema).groupBy("at").agg(F.sum("n"))
    frequencies = np.zeros(terms)
    for number, n in sums.collect():  # at most one per term
        frequencies[number] = n
    return counted.count(), frequencies


def fit(
    documents: DataFrame,
    labels: DataFrame,
    key: str,
    text: str,
    label: str,
    sample_rows: int = SAMPLE_ROWS,
    max_terms: int = MAX_TERMS,
) -> Examples:
    examples, counted = fit_and_count(documents, labels, key, text, label, sample_rows, max_terms)
    drop_staged(counted)
    return examples


def fit_and_count(
    documents: DataFrame,
    labels: DataFrame,
    key: str,
    text: str,
    label: str,
    sample_rows: int = SAMPLE_ROWS,
    max_terms: int = MAX_TERMS,
) -> tuple[Examples, DataFrame]:
    """The examples, and every document's counts of their terms (``stored_counts``)."""
    sides = dict(
        labels.where(learns_from(key) & F.col(label).isin(0, 1))
        .groupBy(F.col(label).cast("int"))
        .count()
        .collect()
    )
    sample = labelled_terms(documents, labels, key, text, label, sample_rows)
    drawn = dict(sample.groupBy("label_").count().collect())
    terms = telling_terms(sample, drawn.get(1, 0), drawn.get(0, 0), max_terms)
    counted = stored_counts(documents, key, text, terms)
    rows, frequencies = document_frequencies(counted, len(terms))
    numbers = {term: number for number, term in enumerate(terms)}
    # Only kept terms travel to the driver.
    slim = sample.select(
        "key_",
        "label_",
        F.filter(F.arrays_zip("terms", "counts"), lambda p: p["terms"].isin(terms)).alias("found"),
    )
    examples = [
        (row["key_"], row["label_"], {numbers[p["terms"]]: p["counts"] for p in row["found"]})
        for row in slim.collect()
    ]
    drop_staged(sample)
    share = [sides.get(side, 0) / max(drawn.get(side, 0), 1) for side in (0, 1)]
    return build(terms, frequencies, rows, examples, (share[0], share[1])), counted


def verdicts(examples: Examples, spark, key_kind: str, threshold: float):
    """(function from an iterable of counts to a struct array, its type): score, predicted
    (1 from ``threshold`` on) and evidence, the nearest examples' keys, cosines and labels,
    best first."""
    shared = spark.sparkContext.broadcast(examples)
    near = f"array<struct<key:{key_kind},cosine:double,label:int>>"
    kind = f"struct<score:double,predicted:int,evidence:{near}>"
    found_type = arrow_schema(spark, f"found {kind}").field("found").type

    def judged(texts, counts_of: Callable) -> pa.Array:
        known: dict = {}  # equal texts of a batch are scored once
        found = []
        for text in texts:
            if text not in known:
                score, evidence = shared.value.score(counts_of(text, shared.value.terms))
                known[text] = {
                    "score": score,
                    "predicted": int(score >= threshold),
                    "evidence": [{"key": k, "cosine": c, "label": n} for k, c, n in evidence],
                }
            found.append(known[text])
        return pa.array(found, found_type)

    return judged, kind


def toxicity_of(examples: Examples, spark, key_kind: str, threshold: float = 0.5):
    """A function of a text column: score, predicted and evidence (``verdicts``)."""
    judged, kind = verdicts(examples, spark, key_kind, threshold)

    def scored(texts: pa.Array) -> pa.Array:
        return judged((text.as_py() or "" for text in texts), kept_counts)

    return F.arrow_udf(scored, kind)


def toxicity_of_counts(examples: Examples, spark, key_kind: str, threshold: float = 0.5):
    """The same of the columns at and of of ``stored_counts``."""
    judged, kind = verdicts(examples, spark, key_kind, threshold)

    def scored(at: pa.Array, of: pa.Array) -> pa.Array:
        pairs = zip(at.to_pylist(), of.to_pylist())
        rows = (tuple(sorted(zip(terms, counts))) for terms, counts in pairs)
        return judged(rows, lambda row, _: dict(row))

    return F.arrow_udf(scored, kind)


def score_toxicity(
    documents: DataFrame,
    labels: DataFrame,
    key: str,
    text: str,
    label: str,
    threshold: float = 0.5,
    sample_rows: int = SAMPLE_ROWS,
    max_terms: int = MAX_TERMS,
) -> DataFrame:
    """One row per document: key, held_out, score, predicted, evidence."""
    examples, counted = fit_and_count(documents, labels, key, text, label, sample_rows, max_terms)
    kind = documents.schema[key].dataType.simpleString()
    scored = toxicity_of_counts(examples, documents.sparkSession, kind, threshold)
    # The counts are small and slow to score: tasks of equal numbers of rows.
    tasks = min(counted.count() // ROWS_A_TASK + 1, MOST_TASKS)
    return counted.repartition(tasks).select(
        F.col("key_").alias(key),
        (F.col("key_").isNotNull() & ~learns_from("key_")).alias("held_out"),
        scored("at", "of").alias("found"),
    ).select(key, "held_out", "found.score", "found.predicted", "found.evidence")
