"""Tables and checks of the algebra: multiplication table, operator matrices, automorphisms, validation."""

from __future__ import annotations

from itertools import combinations, permutations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from octolake.functions import octonion as O


def multiplication_table(spark: SparkSession) -> DataFrame:
    """(left, right, sign, basis): the 64 products of basis elements."""
    return spark.createDataFrame([list(s) for s in O.STRUCTURE], "left int, right int, sign int, basis int")


def plane_incidence(spark: SparkSession) -> DataFrame:
    """(line, point, place): the 21 incidences of seven lines and seven points."""
    return spark.createDataFrame([("(" + ",".join(map(str, line)) + ")", p, i) for line in O.LINES for i, p in enumerate(line)], "line string, point int, place int")


def plane_pairs(spark: SparkSession) -> DataFrame:
    """(left, right, sign, third, line): the 42 ordered pairs of points, with the third point of their line."""
    line_of = {frozenset(p): line for line in O.LINES for p in combinations(line, 2)}
    rows = []
    for i, j in permutations(range(1, 8), 2):
        sign, k = O.basis_product(i, j)
        rows.append((i, j, sign, k, "(" + ",".join(map(str, line_of[frozenset((i, j))])) + ")"))
    return spark.createDataFrame(rows, "left int, right int, sign int, third int, line string")


def left_matrix(x) -> np.ndarray:
    """L with L y = x y."""
    m = np.zeros((8, 8))
    for i, j, sign, k in O.STRUCTURE:
        m[k, j] += sign * x[i]
    return m


def right_matrix(y) -> np.ndarray:
    """R with R x = x y."""
    m = np.zeros((8, 8))
    for i, j, sign, k in O.STRUCTURE:
        m[k, i] += sign * y[j]
    return m


def automorphisms(cyclic: bool = True) -> list[tuple[int, ...]]:
    """Permutations of e1..e7 that map oriented lines to oriented lines; ``cyclic`` takes rotations of a line as equal."""

    def rotations(line):
        return [line, line[1:] + line[:1], line[2:] + line[:2]] if cyclic else [line]

    known = {r for line in O.LINES for r in rotations(line)}
    return [p for p in permutations(range(1, 8)) if all(tuple(p[i - 1] for i in line) in known for line in O.LINES)]


def validation_report(spark: SparkSession, tolerance: float = 1e-12) -> DataFrame:
    """(check_name, passed): squares, oriented products and their reverses, units, operators, alternativity, norms."""
    e = np.eye(8)
    mul = lambda x, y: np.array(O.multiply(x, y))
    near = lambda x, y: bool(np.allclose(x, y, atol=tolerance, rtol=0))
    rows = [(f"square e{i}", near(mul(e[i], e[i]), -e[0])) for i in range(1, 8)]
    for line in O.LINES:
        for r in range(3):
            a, b, c = line[r:] + line[:r]
            rows += [(f"oriented e{a} e{b}", near(mul(e[a], e[b]), e[c])), (f"reversed e{b} e{a}", near(mul(e[b], e[a]), -e[c]))]
    for i in range(8):
        rows += [(f"unit e0 e{i}", near(mul(e[0], e[i]), e[i])), (f"unit e{i} e0", near(mul(e[i], e[0]), e[i]))]
    x, y, z = np.random.default_rng(0).normal(size=(3, 8))
    loose = lambda a, b: bool(np.allclose(a, b, atol=max(tolerance, 1e-9)))
    rows += [("left operator", loose(left_matrix(x) @ y, mul(x, y))), ("right operator", loose(right_matrix(y) @ x, mul(x, y)))]
    rows += [("left alternative", loose(O.associator(x, x, y), np.zeros(8))), ("right alternative", loose(O.associator(x, y, y), np.zeros(8))), ("flexible", loose(O.associator(x, y, x), np.zeros(8)))]
    rows += [("associator alternates", loose(O.associator(x, y, z), -np.array(O.associator(y, x, z)))), ("norm multiplies", loose(np.linalg.norm(mul(x, y)), np.linalg.norm(x) * np.linalg.norm(y)))]
    return spark.createDataFrame(rows, "check_name string, passed boolean")
