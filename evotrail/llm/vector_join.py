"""Near-duplicate vectors by an epsilon grid order join.

Unit vectors have a cosine of c or more exactly if their distance is at most
``sqrt(2 - 2c)``, the epsilon. They are turned onto principal directions and sorted by
the grid cells (of width epsilon) of the leading ones: the epsilon grid order. The
sorted sequence is cut into blocks with bounding boxes. Blocks further apart than
epsilon can't hold a link; the others are joined, and inside a pair of blocks both
intervals are halved again and again, skipping halves whose boxes are too far apart.
What remains is compared in double precision.

A turn keeps all distances, so the directions may be fitted on a bounded sample (at
most ``SAMPLE`` vectors) without losing a link: any directions give exact results, good
ones skip more.

Scale: equal vectors are one row from the start, with a count. Links are counted where
blocks meet and never written out: a pair of blocks gives one count per vector and the
edges of a spanning forest, however dense it is. Block boxes (one row per ``BLOCK``
vectors) find their partners by an equality join on cells.

Defined results: a vector that is null, empty, all zero, or holds a null or a
non-finite number links with nothing and is its own component; vectors of different
lengths don't link; equal vectors link with each other (their cosine is 1); ties at the
threshold link; rows with equal ids are vectors of their own; a null id is never the
smallest of a component; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evotrail.llm.batches import arrow_schema
from evotrail.llm.components import connected_components
from evotrail.staging import staged, staged_table

LEADING = 8
SAMPLE = 4_000
#: Vectors of a block, and of the smallest interval that is halved no more.
BLOCK, LEAF = 2_048, 256
#: Rounding may not part what is at the threshold.
SLACK = 1e-9


def usable(vector) -> F.Column:
    """True for vectors that can link."""
    finite = F.forall(
        vector,
        lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))),
    )
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def principal_directions(classes: DataFrame) -> dict[int, np.ndarray]:
    """By length of vector: orthonormal directions, the leading ones first, from a sample."""
    sample = classes.orderBy("code").limit(SAMPLE).select("vector").collect()
    by_length: dict[int, list] = {}
    for row in sample:
        by_length.setdefault(len(row[0]), []).append(row[0])
    found = {}
    for length, vectors in by_length.items():
        units = unit_rows(np.array(vectors, float))
        moved = units - units.mean(axis=0)
        found[length] = np.linalg.eigh(moved.T @ moved)[1][:, ::-1]
    return found


def unit_rows(rows: np.ndarray) -> np.ndarray:
    # Scaled first, so that squares of very large or small numbers stay finite.
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def led(units: np.ndarray, directions: np.ndarray | None) -> np.ndarray:
    """The leading coordinates; lengths that the sample lacked keep their own axes."""
    turned = units[:, :LEADING] if directions is None else units @ directions[:, :LEADING]
    missing = LEADING - turned.shape[1]
    return np.pad(turned, ((0, 0), (0, missing))) if missing > 0 else turned


def grid_rows(classes: DataFrame, epsilon: float, directions) -> DataFrame:
    """(code, times, length, cells, vector as doubles) of every distinct vector."""
    schema = "code long, times long, length int, cells array<int>, vector binary"
    kinds = arrow_schema(classes.sparkSession, schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = [np.array(v.as_py(), float) for v in batch.column(2)]
            cells = []
            for vector in vectors:
                lead = led(unit_rows(vector[None]), directions.value.get(len(vector)))
                cells.append(np.floor(lead[0] / epsilon).astype(int).tolist())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([len(v) for v in vectors], pa.int32()),
                    pa.array(cells, pa.list_(pa.int32())).cast(kinds.field("cells").type),
                    pa.array([v.tobytes() for v in vectors], pa.binary()),
                ],
                schema=kinds,
            )

    return classes.select("code", "times", "vector").mapInArrow(work, schema)


def blocks_of(sorted_rows: DataFrame, directions) -> DataFrame:
    """One row per run of up to ``BLOCK`` neighbours of the sorted rows."""
    schema = (
        "block long, length int, low array<double>, high array<double>,"
        " codes array<long>, times array<long>, vectors binary"
    )
    kinds = arrow_schema(sorted_rows.sparkSession, schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if held and (len(held) == BLOCK or row["length"] != held[0]["length"]):
                    yield block(held, number)
                    held, number = [], number + 1
                held.append(row)
        if held:
            yield block(held, number)

    def block(held: list[dict], number: int) -> pa.RecordBatch:
        length = held[0]["length"]
        vectors = b"".join(row["vector"] for row in held)
        rows = unit_rows(np.frombuffer(vectors).reshape(-1, length))
        lead = led(rows, directions.value.get(length))
        columns = {
            "block": [number],
            "length": [length],
            "low": [lead.min(axis=0)],
            "high": [lead.max(axis=0)],
            "codes": [[row["code"] for row in held]],
            "times": [[row["times"] for row in held]],
            "vectors": [vectors],
        }
        return pa.RecordBatch.from_arrays(
            [pa.array(columns[f.name], f.type) for f in kinds], schema=kinds
        )

    columns = ["code", "times", "length", "vector"]
    return sorted_rows.select(*columns).mapInArrow(work, schema)


def block_pairs(blocks: DataFrame, epsilon: float) -> DataFrame:
    """(a, b), a <= b: blocks whose boxes are at most epsilon apart.

    Partners have leading cells at most one apart in each of the first two directions,
    so they meet in an equality join on cells.
    """
    boxes = blocks.select("block", "length", "low", "high")

    def cells(axis: int, more: int) -> F.Column:
        first = F.floor(F.col("low")[axis] / epsilon) - more
        last = F.floor(F.col("high")[axis] / epsilon) + more
        return F.explode(F.sequence(first, last))

    def placed(more: int, suffix: str) -> DataFrame:
        spread = boxes.withColumn("x", cells(0, more)).withColumn("y", cells(1, more))
        return spread.select(
            "length", "x", "y", *[F.col(c).alias(c + suffix) for c in ("block", "low", "high")]
        )

    gaps = F.zip_with(
        F.zip_with("low_a", "high_b", lambda low, high: low - high),
        F.zip_with("low_b", "high_a", lambda low, high: low - high),
        lambda one, other: F.pow(F.greatest(one, other, F.lit(0.0)), F.lit(2.0)),
    )
    distance = F.sqrt(F.aggregate(gaps, F.lit(0.0), lambda total, gap: total + gap))
    return (
        placed(0, "_a")
        .join(placed(1, "_b"), ["length", "x", "y"])
        .where((F.col("block_a") <= F.col("block_b")) & (distance <= epsilon + SLACK))
        .select(F.col("block_a").alias("a"), F.col("block_b").alias("b"))
        .distinct()
    )


class PairJoin:
    """The links between two blocks (or inside one): counts, and edges of a forest."""

    def __init__(self, left, right, threshold: float, epsilon: float, directions):
        self.same = left["block"] == right["block"]
        self.threshold, self.epsilon = threshold, epsilon + SLACK
        self.sides = []
        for side in (left, right):
            rows = unit_rows(np.frombuffer(side["vectors"]).reshape(-1, side["length"]))
            lead = led(rows, directions.get(side["length"]))
            codes, times = (np.array(side[name], np.int64) for name in ("codes", "times"))
            self.sides.append((rows, lead, codes, times, np.zeros(len(rows), np.int64)))
        if self.same:
            self.sides[1] = self.sides[0]
        self.edges: set[tuple[int, int]] = set()

    def join(self, a: int, b: int, c: int, d: int) -> None:
        """Join rows a to b of the left side with rows c to d of the right side."""
        if self.same and d <= a:
            return
        left, right = self.sides[0][1][a:b], self.sides[1][1][c:d]
        gap = np.maximum(left.min(axis=0) - right.max(axis=0), right.min(axis=0) - left.max(axis=0))
        if (np.maximum(gap, 0) ** 2).sum() > self.epsilon**2:
            return
        if b - a <= LEAF and d - c <= LEAF:
            self.compare(a, b, c, d)
        elif b - a >= d - c:
            middle = (a + b) // 2
            self.join(a, middle, c, d)
            self.join(middle, b, c, d)
        else:
            middle = (c + d) // 2
            self.join(a, b, c, middle)
            self.join(a, b, middle, d)

    def compare(self, a: int, b: int, c: int, d: int) -> None:
        (rows, _, codes, times, counts), (others, _, other_codes, other_times, other_counts) = (
            self.sides
        )
        hits = rows[a:b] @ others[c:d].T >= self.threshold
        if self.same:  # each pair once
            hits &= np.arange(a, b)[:, None] < np.arange(c, d)[None, :]
        if not hits.any():
            return
        counts[a:b] += hits @ other_times[c:d]
        other_counts[c:d] += times[a:b] @ hits
        # The smallest place reachable inside these rows and columns.
        label = np.arange(b - a + d - c)
        side, none = b - a, b - a + d - c
        while True:
            before = label.copy()
            label[:side] = np.minimum(
                label[:side], np.where(hits, label[None, side:], none).min(axis=1)
            )
            label[side:] = np.minimum(
                label[side:], np.where(hits, label[:side, None], none).min(axis=0)
            )
            if (before == label).all():
                break
        code = np.concatenate((codes[a:b], other_codes[c:d]))
        moved = np.flatnonzero(label != np.arange(none))
        self.edges.update(zip(code[moved].tolist(), code[label[moved]].tolist()))


def joined(pairs: DataFrame, threshold: float, epsilon: float, directions) -> DataFrame:
    """(u, v, n): n links of the vector u where u = v, else an edge."""
    schema = "u long, v long, n long"
    kinds = arrow_schema(pairs.sparkSession, schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                left, right = (c.as_py() for c in (batch.column(0)[at], batch.column(1)[at]))
                pair = PairJoin(left, right, threshold, epsilon, directions.value)
                sizes = [len(side[0]) for side in pair.sides]
                pair.join(0, sizes[0], 0, sizes[1])
                found = [(u, v, 0) for u, v in pair.edges if u != v]
                for _, _, codes, _, counts in pair.sides[: 1 if pair.same else 2]:
                    hit = np.flatnonzero(counts)
                    found += zip(codes[hit].tolist(), codes[hit].tolist(), counts[hit].tolist())
                columns = list(zip(*found)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in columns], schema=kinds
                )

    return pairs.mapInArrow(work, schema)


def link_vectors(vectors: DataFrame, key: str, vector: str, threshold: float) -> DataFrame:
    """One row per vector: key, n_links (other vectors linked directly), component_id (the
    smallest key reachable, itself included), kept (key = component_id)."""
    epsilon = float(np.sqrt(max(2 - 2 * threshold, SLACK)))
    rows = vectors.select(
        F.col(key).alias("id_"), F.col(vector).cast("array<double>").alias("vector")
    ).withColumn("code", F.when(usable("vector"), F.xxhash64("vector")))
    classes = staged_table(
        rows.where("code is not null")
        .groupBy("code", "vector")
        .agg(F.count(F.lit(1)).alias("times"), F.min("id_").alias("least"))
    )
    context = vectors.sparkSession.sparkContext
    directions = context.broadcast(principal_directions(classes))
    order = ["length", *[F.col("cells")[axis] for axis in range(LEADING)], "code"]
    blocks = staged_table(
        blocks_of(
            grid_rows(classes, epsilon, directions)
            .repartitionByRange(*order)
            .sortWithinPartitions(*order),
            directions,
        )
    )
    whole = F.struct("block", "length", "codes", "times", "vectors")
    pairs = (
        block_pairs(blocks, epsilon)
        .join(blocks.select(F.col("block").alias("a"), whole.alias("left_")), "a")
        .join(blocks.select(F.col("block").alias("b"), whole.alias("right_")), "b")
        .select("left_", "right_")
    )
    found = staged_table(joined(pairs, threshold, epsilon, directions))
    links = found.where("u = v").groupBy("u").agg(F.sum("n").alias("links"))
    roots = connected_components(found.where("u != v").select("u", "v"))
    rooted = (
        classes.select("code", "times", "least")
        .join(links.withColumnRenamed("u", "code"), "code", "left")
        .join(roots.withColumnRenamed("node", "code"), "code", "left")
        .select(
            "code",
            "least",
            (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("links"),
            F.coalesce("root", "code").alias("root"),
        )
    )
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component"))
    labels = staged(rooted.join(smallest, "root").select("code", "links", "component"))
    return rows.join(labels, "code", "left").select(
        F.col("id_").alias(key),
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "id_").alias("component_id"),
        F.coalesce(F.col("component") == F.col("id_"), F.col("code").isNull()).alias("kept"),
    )
