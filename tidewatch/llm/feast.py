"""The greatest eigenvalues of a symmetric matrix, and their vectors, by contour integration (FEAST).

Inertia counts (the signs of a factorization's pivots) tell how many eigenvalues lie above a number. By
bisection they give numbers in the gaps between eigenvalues, hence intervals of a few wanted ones each. For an
interval, the integral of the resolvent along a circle around it projects a block of vectors onto the
eigenvectors within: a Gauss-Legendre quadrature of complex shifted solves. A Rayleigh-Ritz step on the
projected block gives values and vectors, and starts the next round until the residuals are as small as
rounding allows. That there are as many values in the interval as its ends' inertias say shows that none is
missed; if not, the block grows.

The solves of all intervals and nodes are independent and go to the function `solve` at once.
"""

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

NODES = 8
_EPS = np.finfo(float).eps
_PIVOT = (1 + 17 ** 0.5) / 8


@dataclass(frozen=True)
class Node:
    """Solve `(shift * I - matrix) X = block` and give the real part of `weight * X`."""

    interval: int
    place: int
    shift: complex
    weight: complex
    block: np.ndarray


#: Takes nodes and gives the sum over the nodes of each interval.
Solve = Callable[[list[Node]], dict[int, np.ndarray]]


def term(matrix: np.ndarray, node: Node) -> np.ndarray:
    shifted = node.shift * np.eye(len(matrix)) - matrix
    return (node.weight * np.linalg.solve(shifted, node.block.astype(complex))).real


def inertia(matrix: np.ndarray) -> tuple[int, int, int]:
    """How many eigenvalues are negative, zero and positive: pivots of one or two rows, each the greatest
    there is (Bunch and Parlett), have the signs of the eigenvalues."""
    a = matrix.astype(float).copy()
    negative = zero = positive = 0
    while len(a):
        diagonal, off = np.abs(np.diag(a)), np.abs(a - np.diag(np.diag(a)))
        one, two = diagonal.max(), off.max()
        if one == 0 and two == 0:
            zero += len(a)
            break
        if one >= _PIVOT * two:
            rows = [int(diagonal.argmax())]
            negative, positive = (negative + 1, positive) if a[rows[0], rows[0]] < 0 else (
                negative, positive + 1)
        else:  # such a pair of rows has one eigenvalue of either sign
            rows = list(np.unravel_index(int(off.argmax()), off.shape))
            negative, positive = negative + 1, positive + 1
        rest = np.setdiff1d(np.arange(len(a)), rows)
        side = a[np.ix_(rest, rows)]
        a = a[np.ix_(rest, rest)] - side @ np.linalg.solve(a[np.ix_(rows, rows)], side.T)
        a = (a + a.T) / 2
    return negative, zero, positive


def above(matrix: np.ndarray, bound: float) -> int:
    """How many eigenvalues are greater than `bound`."""
    return inertia(matrix - bound * np.eye(len(matrix)))[2]


def gap(matrix: np.ndarray, rank: int, scale: float) -> tuple[float | None, int]:
    """A number with `rank` eigenvalues above it, well between two of them, and `rank`. Where the two next
    to it are equal but for rounding: None, and how many there are down to the last of these."""
    more, fewer, lower = -scale, scale, len(matrix)  # more and fewer than `rank` eigenvalues above
    while fewer - more > 16 * _EPS * scale:
        middle = (more + fewer) / 2
        n = above(matrix, middle)
        if n == rank:
            low = high = middle
            for _ in range(6):  # halve what may lie between the gap's ends and what is known of it
                a, b = (more + low) / 2, (fewer + high) / 2
                more, low = (more, a) if above(matrix, a) == rank else (a, low)
                fewer, high = (fewer, b) if above(matrix, b) == rank else (b, high)
            return (low + high) / 2, rank
        if n > rank:
            more, lower = middle, n
        else:
            fewer = middle
    return None, lower


def intervals(matrix: np.ndarray, wanted: int, most: int, scale: float) -> list[tuple[float, float, int]]:
    """From the top down: both ends and the count of intervals that hold the `wanted` greatest
    eigenvalues, with those that equal the last one. Each holds `most`, and more where they are equal."""
    size, out, rank, high = len(matrix), [], 0, gap(matrix, 0, scale)[0]
    while rank < wanted:
        low, aim = None, min(rank + most, wanted)
        while low is None and aim < size:
            low, aim = gap(matrix, aim, scale)
        out.append((-scale if low is None else low, high, aim - rank))
        rank, high = aim, low
    return out


def nodes(interval: int, low: float, high: float, block: np.ndarray) -> list[Node]:
    """The quadrature over the upper half of the circle; the matrix is real, so the lower half adds the
    conjugate."""
    middle, radius = (low + high) / 2, (high - low) / 2
    places, weights = np.polynomial.legendre.leggauss(NODES)
    turns = radius * np.exp(1j * np.pi / 2 * (1 + places))
    return [Node(interval, i, complex(middle + t), complex(w * t / 2), block)
            for i, (t, w) in enumerate(zip(turns, weights))]


def _orthonormal(block: np.ndarray) -> np.ndarray:
    left, sizes, _ = np.linalg.svd(block, full_matrices=False)
    return left[:, sizes > sizes.max(initial=0) * len(block) * _EPS]


def _ritz(matrix: np.ndarray, basis: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    values, turn = np.linalg.eigh(basis.T @ matrix @ basis)
    return values[::-1], (basis @ turn)[:, ::-1]


def greatest(matrix: np.ndarray, wanted: int, solve: Solve, most: int = 8,
             rounds: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """The `wanted` greatest eigenvalues, falling, and their vectors as columns. Fewer where the matrix is
    smaller. Equal values have some orthonormal vectors of their space."""
    size = len(matrix)
    wanted = min(wanted, size)
    scale = float(np.abs(matrix).sum(axis=1).max(initial=0)) * (1 + 1e-9)
    if not wanted or not scale:
        return np.zeros(wanted), np.eye(size)[:, :wanted]
    cuts = intervals(matrix, wanted, most, scale)
    random = np.random.default_rng(11)
    blocks = {i: random.normal(size=(size, min(size, n + max(4, n // 2))))
              for i, (_, _, n) in enumerate(cuts)}
    found: dict[int, np.ndarray] = {}
    before = {i: np.inf for i in blocks}
    for turn in range(rounds):
        sums = solve([node for i, block in blocks.items() if i not in found
                      for node in nodes(i, *cuts[i][:2], block)])
        for i, total in sums.items():
            low, high, count = cuts[i]
            values, vectors = _ritz(matrix, _orthonormal(total))
            inside = (values > low) & (values < high)
            error = np.abs(matrix @ vectors - vectors * values)[:, inside].max(initial=0)
            small = error <= size * _EPS * scale and error >= before[i] / 2  # and falls no further
            before[i] = error
            if inside.sum() == count and (error <= _EPS * scale or small):
                found[i] = vectors[:, inside]
            elif turn % 8 == 7 and blocks[i].shape[1] < size:
                more = random.normal(size=(size, min(size - blocks[i].shape[1], blocks[i].shape[1])))
                blocks[i] = np.hstack([vectors, more])
            else:
                blocks[i] = vectors
        if len(found) == len(cuts):
            # One step over all intervals makes vectors of neighbouring ones orthogonal as well.
            values, vectors = _ritz(matrix, _orthonormal(np.hstack([found[i] for i in sorted(found)])))
            return values[:wanted], vectors[:, :wanted]
    raise ArithmeticError(f"no convergence in {rounds} rounds")
