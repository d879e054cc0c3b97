"""Whitening of embeddings: leading principal components scaled to unit variance.

Entries are first rounded to whole 64ths, so that sums and deviations are exact. The fit
list holds every distinct rounded vector once, so copies, however many, weigh as one. Its
mean and covariance are summed over all tasks as a tree; the components come from the
covariance by contour integration (``feast``), with inertia counts that prove that none
is missed; then every row is projected where it is read.

Scale: distinct vectors are reduced in the map tasks before they are moved; after that
only sums move, of the square of the dimensions for each task. The driver holds matrices
of that size, never rows.

Defined results: vectors that are null or hold null or non-finite entries are left out;
entries beyond 2**34 count as that; vectors of different lengths are whitened apart,
those of each length among themselves; components whose variance is rounding error are
not returned, so a single distinct vector or an empty one has none; of equal variances
the order and the directions are any, the same for all rows; a deviation beyond a long is
null; equal rows give equal rows; an empty table gives none; other columns are not
looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evotrail.llm.batches import arrow_schema
from evotrail.llm.feast import largest_pairs
from evotrail.llm.vector_sums import slots, tree_sum, whole
from evotrail.staging import staged_table

#: Steps of a rounded entry, and what is added to make usual ones positive.
STEPS, OFFSET = 64, 1_000_000
LARGEST = float(1 << 40)
#: Sums are kept in two parts of this many bits, so that they stay exact.
LOW_BITS = 20
LONG = 1 << 63


@dataclass(frozen=True)
class Whitening:
    """What was fitted on the distinct vectors of one length."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray  # falling variances of the components
    vectors: np.ndarray  # components as columns
    trace: float
    identity_error: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        base, rest = self._mean
        return (x - base) - rest / self.n

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.vectors / np.sqrt(self.values))

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The sums of (n * x - S) ** 2, exact."""
        base, rest = self._mean
        steps = x - base
        bound = self.n * (int(np.abs(steps).max(initial=0)) + 1)
        if bound * bound * max(x.shape[1], 1) < LONG:
            return ((self.n * steps - rest) ** 2).sum(axis=1).tolist()
        exact = (steps.astype(object) * self.n - rest.astype(object)) ** 2
        return [total if total < LONG else None for total in exact.sum(axis=1)]

    @property
    def _mean(self) -> tuple[np.ndarray, np.ndarray]:
        """Whole part and rest, in n-ths, of the mean."""
        pairs = [divmod(total, self.n) for total in self.sums]
        return (
            np.array([whole_part for whole_part, _ in pairs], np.int64),
            np.array([rest for _, rest in pairs], np.int64),
        )


def rounded(vector: str) -> Column:
    """The vector's entries in whole steps; null if it can't be used."""

    def is_finite(entry: Column) -> Column:
        return entry.isNotNull() & ~F.isnan(entry) & (F.abs(entry) < F.lit(float("inf")))

    def steps(entry: Column) -> Column:
        scaled = F.least(F.greatest(entry * STEPS, F.lit(-LARGEST)), F.lit(LARGEST))
        return F.floor(scaled) + F.lit(OFFSET)

    entries = F.transform(F.col(vector), lambda entry: entry.cast("double"))
    return F.when(F.forall(entries, is_finite), F.transform(entries, steps))


def matrix_of(column: pa.ListArray) -> np.ndarray:
    """The vectors of one length as rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def summed(
    vectors: DataFrame, work: Callable[[np.ndarray], np.ndarray], size: int, kind: str
) -> np.ndarray:
    """The sum over all batches of the vector that ``work`` makes of one."""
    dtype = np.int64 if kind == "long" else np.float64
    schema = f"slot long, values array<{kind}>"
    arrow = arrow_schema(vectors.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype)
        for batch in batches:
            if batch.num_rows:
                total += work(matrix_of(batch.column(0)))
        for slot, values in enumerate(slots(total)):
            yield pa.RecordBatch.from_pydict({"slot": [slot], "values": [values]}, arrow)

    return whole(tree_sum(vectors.mapInArrow(run, schema), kind), size, dtype)


def fitted(fit_list: DataFrame, n: int, size: int, components: int) -> Whitening:
    """The whitening of ``n`` distinct vectors (column x) with ``size`` entries each."""

    def parts(x: np.ndarray) -> np.ndarray:
        return np.concatenate([(x >> LOW_BITS).sum(axis=0), (x & (1 << LOW_BITS) - 1).sum(axis=0)])

    found = summed(fit_list, parts, 2 * size, "long")
    sums = tuple((int(h) << LOW_BITS) + int(low) for h, low in zip(found[:size], found[size:]))
    mean = Whitening(n, sums, np.zeros(0), np.zeros((size, 0)), 0.0, 0.0)

    def products(x: np.ndarray) -> np.ndarray:
        centred = mean.centred(x)
        return (centred.T @ centred).ravel()

    covariance = summed(fit_list, products, size * size, "double").reshape(size, size) / n
    covariance = (covariance + covariance.T) / 2
    values, vectors = largest_pairs(covariance, components)
    own = Whitening(n, sums, values, vectors, float(np.trace(covariance)), 0.0)
    if not len(values):
        return own

    def whitened_products(x: np.ndarray) -> np.ndarray:
        z = own.whitened(x)
        return np.concatenate([z.sum(axis=0), (z.T @ z).ravel()])

    count = len(values)
    checked = summed(fit_list, whitened_products, count + count * count, "double") / n
    left = checked[count:].reshape(count, count) - np.outer(checked[:count], checked[:count])
    error = float(np.abs(left - np.eye(count)).max())
    return Whitening(n, sums, values, vectors, own.trace, error)


def fit_whitening(rows: DataFrame, vector: str, components: int) -> dict[int, Whitening]:
    """What is fitted, by the length of the vectors."""
    used = rows.select(rounded(vector).alias("x")).where("size(x) > 0")
    fit_list = staged_table(used.distinct())
    counts = fit_list.groupBy(F.size("x").alias("size")).count().collect()
    return {
        size: fitted(fit_list.where(F.size("x") == size), n, size, components)
        for size, n in counts
    }


def whiten(rows: DataFrame, key: str, vector: str, components: int) -> DataFrame:
    """One row per usable vector: key, n, deviation, whitened, explained, identity_error.

    ``whitened`` holds the projections on the components, by falling variance, and
    ``explained`` the components' shares of all variance; n is the size of the fit list
    and identity_error how far the whitened list's covariance is from the identity.
    """
    models = rows.sparkSession.sparkContext.broadcast(fit_whitening(rows, vector, components))
    kind = rows.schema[key].dataType.simpleString()
    schema = (
        f"`{key}` {kind}, n long, deviation long, whitened array<double>,"
        " explained array<double>, identity_error double"
    )
    arrow = arrow_schema(rows.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
            for size in np.unique(lengths):
                own = models.value[int(size)]
                part = batch.filter(pa.array(lengths == size))
                x = matrix_of(part.column(1))
                found = {
                    key: part.column(0),
                    "n": [own.n] * len(x),
                    "deviation": own.deviations(x),
                    "whitened": list(own.whitened(x)),
                    "explained": [own.values / own.trace if own.trace else []] * len(x),
                    "identity_error": [own.identity_error] * len(x),
                }
                columns = [pa.array(found[field.name], field.type) for field in arrow]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    used = rows.select(F.col(key), rounded(vector).alias("x")).where("size(x) > 0")
    return used.mapInArrow(run, schema)
