"""Helpers of the registered queries: reading, rounding, and algebra as SQL text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from octolake.functions import octonion as O

#: Added before rounding: products of six-decimal values lie on a grid of 1e-12, and this moves them off all ties.
NUDGE = 3.7e-13
DIGITS = 6
WINDOW_KEYS, WINDOW_POSITION, WINDOW_ID = ["sequence_id", "axis_scheme_id"], "position", "window_id"
CODON_KEYS, CODON_POSITION, CODON_ID = ["sequence_id", "frame"], "codon_index", "codon_row_id"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def r6(c: Column | str, name: str | None = None) -> Column:
    column = F.col(c) if isinstance(c, str) else c
    return F.round(column + NUDGE, DIGITS).alias(name or c)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """The DataFrame with its DOUBLE columns (or those named) rounded for comparison."""
    wanted = set(columns) or {c for c, t in df.dtypes if t == "double"}
    return df.select(*[r6(c) if c in wanted else F.col(c) for c in df.columns])


def sql6(expression: str, name: str) -> str:
    return f"round(({expression}) + {NUDGE}, {DIGITS}) AS {name}"


class Sql:
    """SQL text that arithmetic extends, so the algebra's formulas can be written out for the comparison."""

    def __init__(self, text: str) -> None:
        self.text = text

    def _with(self, sign: str, other) -> Sql:
        return Sql(f"({self.text} {sign} {other.text if isinstance(other, Sql) else other})")

    def __add__(self, other) -> Sql:
        return self._with("+", other)

    def __sub__(self, other) -> Sql:
        return self._with("-", other)

    def __mul__(self, other) -> Sql:
        return self._with("*", other)

    def __rmul__(self, other) -> Sql:
        return Sql(f"({other} * {self.text})")

    def __neg__(self) -> Sql:
        return Sql(f"(-{self.text})")


def quaternion(a: list[Sql], b: list[Sql]) -> list[Sql]:
    """Hamilton's product."""
    (p, q, r, s), (t, u, v, w) = a, b
    return [p * t - q * u - r * v - s * w, p * u + q * t + r * w - s * v, p * v - q * w + r * t + s * u, p * w + q * v - r * u + s * t]


def doubled(x: list[Sql], y: list[Sql]) -> list[Sql]:
    """The octonion product by doubling quaternions: (a, b)(c, d) = (a c - d* b, d a + b c*). Statements use it instead of
    the library's table of signs, so that a wrong sign there can't be wrong on both sides."""
    bar = lambda q: [q[0], -q[1], -q[2], -q[3]]
    (a, b), (c, d) = (x[:4], x[4:]), (y[:4], y[4:])
    left = [m - n for m, n in zip(quaternion(a, c), quaternion(bar(d), b))]
    return left + [m + n for m, n in zip(quaternion(d, a), quaternion(b, bar(c)))]


def turned(x: list[Sql], y: list[Sql]) -> list[Sql]:
    """The seven components of x y - y x."""
    return [m - n for m, n in zip(doubled(x, y), doubled(y, x))][1:]


#: Lines of the plane, written out once more for the statements. Fixed values.
PLANE = ((1, 2, 3), (1, 4, 5), (1, 7, 6), (2, 4, 6), (2, 5, 7), (3, 4, 7), (3, 6, 5))


def wedges(x: list[Sql], y: list[Sql]) -> list[tuple[Sql, Sql, Sql]]:
    return [(x[a] * y[b] - x[b] * y[a], x[b] * y[c] - x[c] * y[b], x[c] * y[a] - x[a] * y[c]) for a, b, c in PLANE]


def parts(alias: str, prefix: str = "e") -> list[Sql]:
    return [Sql(f"{alias}.{prefix}{i}") for i in range(8)]


def norm(x: list[Sql]) -> str:
    return f"sqrt({' + '.join(f'{v.text} * {v.text}' for v in x)})"


def units_sql(source: str, keys: list[str], position: str, row_id: str) -> str:
    """Complete units, each position once."""
    whole = " AND ".join(f"{c} IS NOT NULL" for c in [*keys, position, *O.AXES])
    return (
        f"SELECT {', '.join(keys)}, {position} AS pos, {', '.join(f'arg_min({e}, {row_id}) AS {e}' for e in O.AXES)} "
        f"FROM (SELECT DISTINCT {row_id}, {', '.join(keys)}, {position}, {', '.join(O.AXES)} FROM {source} WHERE {whole}) GROUP BY {', '.join(keys)}, {position}"
    )


def neighbours_sql(keys: list[str], n: int = 1) -> str:
    """FROM clause over ``u``: a unit x with its next y (and z)."""
    same = lambda a, b: " AND ".join(f"{a}.{k} = {b}.{k}" for k in keys)
    text = f"FROM u x JOIN u y ON {same('x', 'y')} AND y.pos = x.pos + 1"
    return text + (f" JOIN u z ON {same('x', 'z')} AND z.pos = x.pos + 2" if n > 1 else "")
