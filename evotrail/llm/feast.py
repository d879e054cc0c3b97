"""The largest eigenpairs of a symmetric matrix by contour integration (FEAST).

The resolvent's integral around an interval of the real line projects any block of
vectors onto the eigenvectors whose values lie inside. The integral is taken by
Gauss-Legendre quadrature on a half circle, one complex shifted solve for each node (the
other half is the conjugate); Rayleigh-Ritz extracts the pairs from the projected block,
which is projected again until the residuals are at rounding error. The inertia of the
shifted matrix counts the values above a shift, so the number inside every interval is
known beforehand and a run that misses one is repeated with a larger block.

The matrix has the size of one vector's dimensions, apart from the number of vectors.
"""

from __future__ import annotations

import numpy as np

NODES = 8
#: Values of an interval, unless more are closer together than rounding error.
PER_INTERVAL = 8
ROUNDS = 12
SEED = 12
#: The share of the matrix's norm that counts as rounding error.
ROUNDING = np.finfo(float).eps
# Fixed value of the pivoting rule: from where on a 1 by 1 pivot is stable.
ONE_BY_ONE = (1 + np.sqrt(17)) / 8


def count_above(matrix: np.ndarray, shift: float) -> int:
    """How many eigenvalues are above the shift: the inertia of an LDL factoring with
    symmetric pivots of one or two rows (Sylvester's law, Bunch and Kaufman's pivots)."""
    rest = matrix - shift * np.eye(len(matrix))
    positive = 0
    while len(rest) > 1:
        beside = np.abs(rest[1:, 0])
        other = 1 + int(beside.argmax())
        largest, own, pair = beside[other - 1], abs(rest[0, 0]), False
        if own < ONE_BY_ONE * largest:
            column = np.abs(rest[:, other])
            diagonal, column[other] = column[other], 0
            next_largest = column.max()
            if own * next_largest < ONE_BY_ONE * largest**2:
                pair = diagonal < ONE_BY_ONE * next_largest
                swap(rest, 1 if pair else 0, other)
        if pair:  # one value is positive, one negative
            block, sides = rest[:2, :2], rest[2:, :2]
            positive += 1
            rest = rest[2:, 2:] - sides @ np.linalg.solve(block, sides.T)
        else:
            positive += int(rest[0, 0] > 0)
            if rest[0, 0]:
                rest = rest[1:, 1:] - np.outer(rest[1:, 0], rest[0, 1:] / rest[0, 0])
            else:
                rest = rest[1:, 1:]
    return positive + int(len(rest) and rest[0, 0] > 0)


def swap(matrix: np.ndarray, a: int, b: int) -> None:
    """Exchange two rows and the columns of the same places."""
    matrix[[a, b]] = matrix[[b, a]]
    matrix[:, [a, b]] = matrix[:, [b, a]]


def border(matrix: np.ndarray, wanted: int, high: float) -> tuple[float, int]:
    """A shift with at least ``wanted`` values above it, amid the gap below the last of
    them, and their number; more than wanted only where values are one within rounding."""
    size = len(matrix)
    norm = np.linalg.norm(matrix)
    low, above = -norm * 1e-3, size  # all values are above
    if wanted >= size:
        return low, size
    least = 64 * size * ROUNDING * norm
    while above != wanted and high - low > least:
        middle = (low + high) / 2
        found = count_above(matrix, middle)
        if found >= wanted:
            low, above = middle, found
        else:
            high = middle
    if above != wanted:
        return low, above
    bottom, top = low, low  # stretch the gap found to both sides
    under, over = -norm * 1e-3, high
    for _ in range(6):
        middle = (bottom + under) / 2
        if count_above(matrix, middle) == wanted:
            bottom = middle
        else:
            under = middle
        middle = (top + over) / 2
        if count_above(matrix, middle) == wanted:
            top = middle
        else:
            over = middle
    return (bottom + top) / 2, wanted


def projected(matrix: np.ndarray, block: np.ndarray, low: float, high: float) -> np.ndarray:
    """The block's part in the eigenvectors of values between low and high, by quadrature."""
    points, weights = np.polynomial.legendre.leggauss(NODES)
    middle, radius = (low + high) / 2, (high - low) / 2
    found = np.zeros_like(block)
    for point, weight in zip(points, weights):
        turn = np.exp(0.5j * np.pi * (1 - point))
        shifted = (middle + radius * turn) * np.eye(len(matrix)) - matrix
        found += 0.5 * weight * np.real(radius * turn * np.linalg.solve(shifted, block))
    return found


def ritz(matrix: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rayleigh-Ritz: the values and unit vectors of the matrix within the block's span."""
    basis, _ = np.linalg.qr(block)
    reduced = basis.T @ matrix @ basis
    values, turned = np.linalg.eigh((reduced + reduced.T) / 2)
    return values, basis @ turned


def in_interval(
    matrix: np.ndarray, low: float, high: float, count: int
) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` pairs with values between low and high."""
    size = len(matrix)
    small = 16 * size * ROUNDING * np.linalg.norm(matrix)
    width = min(size, count + max(4, count // 2))
    rng = np.random.default_rng(SEED)
    while True:
        block = rng.standard_normal((size, width))
        for _ in range(ROUNDS):
            values, vectors = ritz(matrix, projected(matrix, block, low, high))
            inside = (values > low) & (values <= high)
            if inside.sum() == count:
                values_in, vectors_in = values[inside], vectors[:, inside]
                residuals = np.linalg.norm(matrix @ vectors_in - vectors_in * values_in, axis=0)
                if residuals.max(initial=0) <= small:
                    return values_in, vectors_in
            block = vectors
        if width == size:  # the block spans everything: the best count by order
            order = np.argsort(-np.abs(inside), kind="stable")[:count]
            return values[order], vectors[:, order]
        width = min(size, 2 * width)


def largest_pairs(matrix: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """(values falling, unit vectors as columns) of the ``wanted`` largest eigenvalues of
    a matrix without negative ones; fewer where only rounding error is left of others.

    A vector's largest entry is positive, so equal input gives equal signs.
    """
    size, norm = len(matrix), np.linalg.norm(matrix)
    if not norm:
        return np.zeros(0), np.zeros((size, 0))
    floor = 8 * size * ROUNDING * norm
    wanted = min(wanted, count_above(matrix, floor))
    high, taken, found = norm * (1 + 1e-9), 0, []
    while taken < wanted:
        low, above = border(matrix, min(taken + PER_INTERVAL, wanted), high)
        found.append(in_interval(matrix, low, high, above - taken))
        high, taken = low, above
    # One more extraction over all intervals makes vectors of neighbouring ones orthogonal.
    values, vectors = ritz(matrix, np.hstack([vectors for _, vectors in found]))
    order = np.argsort(-values)[:wanted]
    values, vectors = values[order], vectors[:, order]
    largest = np.abs(vectors).argmax(axis=0)
    return values, vectors * np.sign(vectors[largest, np.arange(len(order))])
