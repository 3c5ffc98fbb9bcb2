"""Octonion algebra over eight components, for Columns, numbers and numpy arrays alike.

Basis products follow the Cayley-Dickson table: e_a e_b = e_c for each oriented line (a, b, c) and its rotations.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product as pairs
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Oriented lines of the Fano plane. Fixed values.
LINES = ((1, 2, 3), (1, 4, 5), (1, 7, 6), (2, 4, 6), (2, 5, 7), (3, 4, 7), (3, 6, 5))
AXES = tuple(f"e{i}" for i in range(8))


def basis_product(i: int, j: int) -> tuple[int, int]:
    """(sign, k) with e_i e_j = sign e_k."""
    if i == 0 or j == 0:
        return 1, i + j
    if i == j:
        return -1, 0
    for line in LINES:
        if i in line and j in line:
            k = next(p for p in line if p not in (i, j))
            return (1 if line[(line.index(i) + 1) % 3] == j else -1), k
    raise ValueError((i, j))


STRUCTURE = tuple((i, j, *basis_product(i, j)) for i, j in pairs(range(8), repeat=2))


def multiply(x: Sequence[Any], y: Sequence[Any]) -> list[Any]:
    out: list[Any] = [None] * 8
    for i, j, sign, k in STRUCTURE:
        term = x[i] * y[j]
        out[k] = (term if sign > 0 else -term) if out[k] is None else (out[k] + term if sign > 0 else out[k] - term)
    return out


def line_terms(x: Sequence[Any], y: Sequence[Any]) -> list[tuple[Any, Any, Any]]:
    """Per line (a, b, c): the antisymmetric terms on c, a and b; the commutator is twice their sum over the lines."""

    def wedge(i: int, j: int) -> Any:
        return x[i] * y[j] - x[j] * y[i]

    return [(wedge(a, b), wedge(b, c), wedge(c, a)) for a, b, c in LINES]


def commutator(x: Sequence[Any], y: Sequence[Any]) -> list[Any]:
    """x y - y x, without its scalar part, which is always 0: seven components for e1..e7."""
    out: list[Any] = [None] * 8
    for (a, b, c), (on_c, on_a, on_b) in zip(LINES, line_terms(x, y)):
        for axis, term in ((c, on_c), (a, on_a), (b, on_b)):
            out[axis] = term if out[axis] is None else out[axis] + term
    return [2.0 * v for v in out[1:]]


def associator(x: Sequence[Any], y: Sequence[Any], z: Sequence[Any]) -> list[Any]:
    """(x y) z - x (y z). In queries bind the two inner products to columns first: see operators.trajectory."""
    left, right = multiply(multiply(x, y), z), multiply(x, multiply(y, z))
    return [a - b for a, b in zip(left, right)]


def conjugate(x: Sequence[Any]) -> list[Any]:
    return [x[0], *[-v for v in x[1:]]]


def squared_norm(x: Sequence[Any]) -> Any:
    total = x[0] * x[0]
    for v in x[1:]:
        total = total + v * v
    return total


def add(x: Sequence[Any], y: Sequence[Any]) -> list[Any]:
    return [a + b for a, b in zip(x, y)]


def subtract(x: Sequence[Any], y: Sequence[Any]) -> list[Any]:
    return [a - b for a, b in zip(x, y)]


def scaled(x: Sequence[Any], factor: Any) -> list[Any]:
    return [v * factor for v in x]


def divided(x: Sequence[Any], divisor: Any) -> list[Any]:
    """x over a number; dividing by 0 is an error, for Columns when the row is computed."""
    if isinstance(divisor, Column):
        checked = F.when(divisor == 0, F.raise_error(F.lit("division of an octonion by 0")).cast("double")).otherwise(divisor)
        return [v / checked for v in x]
    if divisor == 0:
        raise ZeroDivisionError("division of an octonion by 0")
    return [v / divisor for v in x]


def cross(x: Sequence[Any], y: Sequence[Any]) -> list[Any]:
    """The seven-dimensional cross product of the parts on e1..e7: half their commutator."""
    return [v / 2.0 for v in commutator(x, y)]
