"""Queries over the window and codon trajectories."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from octolake.functions import octonion as O
from octolake.operators import trajectory as T
from octolake.plans.common import CODON_ID, CODON_KEYS, CODON_POSITION, WINDOW_ID, WINDOW_KEYS, WINDOW_POSITION, doubled, neighbours_sql, norm, parts, r6, rounded, sql6, table, turned, units_sql, wedges

W = (WINDOW_KEYS, WINDOW_POSITION, WINDOW_ID)
C = (CODON_KEYS, CODON_POSITION, CODON_ID)
THRESHOLD, TOP = 1.0, 1000
PROBS = (0.25, 0.5, 0.75)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

LINE_NAMES = ["line_" + "_".join(map(str, line)) for line in O.LINES]


def _add(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


def _units(source: str, spec: tuple) -> str:
    return f"WITH u AS ({units_sql(source, *spec)})"


def _products_sql(source: str, spec: tuple, tail: str = "") -> str:
    keys, position, _ = spec
    x, y = parts("x"), parts("y")
    p = doubled(x, y)
    cols = [f"x.{k}" for k in keys] + [f"x.pos AS {position}"] + [sql6(v.text, f"p{i}") for i, v in enumerate(p)]
    cols += [sql6(norm(p), "product_norm"), sql6(norm(turned(x, y)), "transition_score")]
    return f"{_units(source, spec)} SELECT {', '.join(cols)} {neighbours_sql(keys)}{tail}"


def _triplets_sql(source: str, spec: tuple) -> str:
    keys, position, _ = spec
    x, y, z = parts("x"), parts("y"), parts("z")
    inner = [f"x.{k}" for k in keys] + [f"x.pos AS {position}"]
    inner += [f"{v.text} AS l{i}" for i, v in enumerate(doubled(x, y))] + [f"{v.text} AS r{i}" for i, v in enumerate(doubled(y, z))]
    inner += [f"x.e{i} AS x{i}, z.e{i} AS z{i}" for i in range(8)]
    left, right = doubled(parts("t", "l"), parts("t", "z")), doubled(parts("t", "x"), parts("t", "r"))
    a = [f"({p.text}) - ({q.text})" for p, q in zip(left, right)]
    cols = [*keys, position, *[sql6(v, f"a{i}") for i, v in enumerate(a)], sql6("sqrt(" + " + ".join(f"power({v}, 2)" for v in a) + ")", "associator_score")]
    return f"{_units(source, spec)} SELECT {', '.join(cols)} FROM (SELECT {', '.join(inner)} {neighbours_sql(keys, 2)}) t"


def _summary_sql(source: str, spec: tuple) -> str:
    keys = spec[0]
    k = ", ".join(keys)
    on = lambda b: " AND ".join(f"n.{c} = {b}.{c}" for c in keys)
    stats = ", ".join(f"avg({e}) AS mean_{e}, stddev_pop({e}) AS std_{e}" for e in O.AXES)
    move = norm(turned(parts("x"), parts("y")))
    triplets = _triplets_sql(source, spec)
    unrounded = triplets.replace(_units(source, spec), "")
    out = ", ".join([*[f"n.{c}" for c in keys], "n_units", *[sql6(f"{s}_{e}", f"{s}_{e}") for e in O.AXES for s in ("mean", "std")], *[sql6(f"coalesce({c}, 0)", c) for c in ("mean_transition", "max_transition", "mean_associator", "max_associator")]])
    return (
        f"{_units(source, spec)}, n AS (SELECT {k}, count(*) AS n_units, {stats} FROM u GROUP BY {k}), "
        f"m AS (SELECT {', '.join('x.' + c for c in keys)}, avg({move}) AS mean_transition, max({move}) AS max_transition {neighbours_sql(keys)} GROUP BY {', '.join('x.' + c for c in keys)}), "
        f"a AS (SELECT {k}, avg(associator_score) AS mean_associator, max(associator_score) AS max_associator FROM ({_exact(unrounded)}) GROUP BY {k}) "
        f"SELECT {out} FROM n LEFT JOIN m ON {on('m')} LEFT JOIN a ON {on('a')}"
    )


def _exact(text: str) -> str:
    """A statement of this module without its rounding."""
    import re

    return re.sub(r"round\((.*?) \+ 3\.7e-13, 6\) AS (\w+)", r"\1 AS \2", text)


@_add("window_products", _products_sql("window_octonions", W))
def window_products(spark, folder):
    return rounded(T.adjacent_products(table(spark, folder, "window_octonions"), *W).drop("x", "y"))


@_add("codon_products", _products_sql("codon_octonions", C))
def codon_products(spark, folder):
    return rounded(T.adjacent_products(table(spark, folder, "codon_octonions"), *C).drop("x", "y"))


@_add("window_triplets", _triplets_sql("window_octonions", W))
def window_triplets(spark, folder):
    return rounded(T.adjacent_triplets(table(spark, folder, "window_octonions"), *W))


@_add("codon_triplets", _triplets_sql("codon_octonions", C))
def codon_triplets(spark, folder):
    return rounded(T.adjacent_triplets(table(spark, folder, "codon_octonions"), *C))


_BLIND = _products_sql("window_octonions", W)
_BLIND = _BLIND.replace(_units("window_octonions", W), f"WITH v AS ({units_sql('window_octonions', *W)}), u AS (SELECT * EXCLUDE (pos), row_number() OVER (PARTITION BY {', '.join(WINDOW_KEYS)} ORDER BY pos) - 1 AS pos FROM v)").replace("x.pos AS position", 'x.pos AS "index"')


@_add("window_products_gap_blind", _BLIND)
def window_products_gap_blind(spark, folder):
    return rounded(T.gap_blind_products(table(spark, folder, "window_octonions"), *W).drop("x", "y"))


@_add("transition_threshold", f"SELECT sequence_id, axis_scheme_id, position, transition_score FROM ({_products_sql('window_octonions', W)}) WHERE transition_score >= {THRESHOLD}")
def transition_threshold(spark, folder):
    rows = T.adjacent_products(table(spark, folder, "window_octonions"), *W)
    return rows.select(*WINDOW_KEYS, WINDOW_POSITION, r6("transition_score")).where(F.col("transition_score") >= THRESHOLD)


@_add("transition_topk", f"SELECT sequence_id, axis_scheme_id, position, transition_score FROM ({_products_sql('window_octonions', W)}) ORDER BY transition_score DESC, sequence_id, axis_scheme_id, position LIMIT {TOP}")
def transition_topk(spark, folder):
    rows = T.adjacent_products(table(spark, folder, "window_octonions"), *W).select(*WINDOW_KEYS, WINDOW_POSITION, r6("transition_score"))
    return T.strongest(rows, WINDOW_KEYS, WINDOW_POSITION, TOP)


def _attribution_sql() -> str:
    terms = wedges(parts("x"), parts("y"))
    keys = "x.sequence_id, x.axis_scheme_id, x.pos AS position"
    one = [
        f"SELECT {keys}, '({a},{b},{c})' AS fano_line, {sql6(t[0].text, 'term_c')}, {sql6(t[1].text, 'term_a')}, {sql6(t[2].text, 'term_b')}, {sql6(norm(list(t)), 'line_norm')} {neighbours_sql(WINDOW_KEYS)}"
        for (a, b, c), t in zip(O.LINES, terms)
    ]
    return f"{_units('window_octonions', W)} {' UNION ALL '.join(one)}"


@_add("fano_attribution", _attribution_sql())
def fano_attribution(spark, folder):
    return rounded(T.line_attribution(T.adjacent_products(table(spark, folder, "window_octonions"), *W), WINDOW_KEYS, WINDOW_POSITION))


def _line_features_sql() -> str:
    k = ", ".join(WINDOW_KEYS)
    norms = ", ".join(f"{norm(list(t))} AS {n}" for n, t in zip(LINE_NAMES, wedges(parts("x"), parts("y"))))
    agg = ", ".join(f"sum({n}) AS {n}_total, avg({n}) AS {n}_mean, max({n}) AS {n}_max" for n in LINE_NAMES)
    total = " + ".join(f"{n}_total" for n in LINE_NAMES)
    shares = ", ".join(f"CASE WHEN total > 0 THEN {n}_total / total ELSE 0 END AS {n}_share" for n in LINE_NAMES)
    bits = " + ".join(f"CASE WHEN {n}_share > 0 THEN -{n}_share * ln({n}_share) ELSE 0 END" for n in LINE_NAMES)
    top = f"greatest({', '.join(f'{n}_share' for n in LINE_NAMES)})"
    dominant = "CASE " + " ".join(f"WHEN round({n}_share, 12) = round({top}, 12) THEN '{n}'" for n in LINE_NAMES) + " END"
    doubles = [f"{n}_{s}" for n in LINE_NAMES for s in ("total", "mean", "max", "share")]
    return (
        f"{_units('window_octonions', W)}, r AS (SELECT {', '.join('x.' + c for c in WINDOW_KEYS)}, {norms} {neighbours_sql(WINDOW_KEYS)}), "
        f"g AS (SELECT {k}, count(*) AS n_pairs, {agg} FROM r GROUP BY {k}), t AS (SELECT *, {total} AS total FROM g), s AS (SELECT *, {shares} FROM t) "
        f"SELECT {k}, n_pairs, {sql6('total', 'total')}, {', '.join(sql6(d, d) for d in doubles)}, {sql6(f'({bits}) / ln(7)', 'line_entropy')}, "
        f"{sql6('sqrt(' + ' + '.join(f'{n}_share * {n}_share' for n in LINE_NAMES) + ')', 'line_concentration')}, CASE WHEN total > 0 THEN {dominant} END AS dominant_line, {sql6(top, 'dominant_share')} FROM s"
    )


@_add("fano_line_features", _line_features_sql())
def fano_line_features(spark, folder):
    return rounded(T.line_features(T.adjacent_products(table(spark, folder, "window_octonions"), *W), WINDOW_KEYS))


@_add("window_summary", _summary_sql("window_octonions", W))
def window_summary(spark, folder):
    return rounded(T.trajectory_summary(table(spark, folder, "window_octonions"), *W))


@_add("codon_trajectory_summary", _summary_sql("codon_octonions", C))
def codon_trajectory_summary(spark, folder):
    return rounded(T.trajectory_summary(table(spark, folder, "codon_octonions"), *C))


def _quantile_sql() -> str:
    one = [
        f"SELECT sequence_id, '{e}' AS component, " + ", ".join(sql6(f"quantile_cont({e}, {p})", f"q{i}") for i, p in enumerate(PROBS)) + f" FROM (SELECT DISTINCT window_id, sequence_id, {e} FROM window_octonions) WHERE sequence_id IS NOT NULL AND {e} IS NOT NULL GROUP BY sequence_id"
        for e in O.AXES
    ]
    return " UNION ALL ".join(one)


@_add("component_quantiles", _quantile_sql())
def component_quantiles(spark, folder):
    rows = table(spark, folder, "window_octonions").where(F.col("sequence_id").isNotNull()).select("window_id", "sequence_id", *O.AXES).dropDuplicates(["window_id"])
    long = rows.select("sequence_id", F.explode(F.array(*[F.struct(F.lit(e).alias("component"), F.col(e).alias("v")) for e in O.AXES])).alias("s")).select("sequence_id", "s.component", "s.v")
    return rounded(T.group_quantiles(long, ["sequence_id", "component"], "v", list(PROBS)))


_INVERSE = ", ".join(sql6(f"CASE WHEN q > 0 THEN {'' if i == 0 else '-'}e{i} / q END", f"i{i}") for i in range(8))


@_add("window_inverses", f"SELECT window_id, {sql6('sqrt(q)', 'norm')}, {_INVERSE} FROM (SELECT DISTINCT window_id, {', '.join(O.AXES)}, {' + '.join(f'{e} * {e}' for e in O.AXES)} AS q FROM window_octonions WHERE window_id IS NOT NULL)")
def window_inverses(spark, folder):
    """Norm and inverse (conjugate over squared norm) of every window; null for windows with a null or zero norm."""
    rows = table(spark, folder, "window_octonions").where(F.col("window_id").isNotNull()).select("window_id", *O.AXES).dropDuplicates(["window_id"])
    e = [F.col(a) for a in O.AXES]
    q = O.squared_norm(e)
    return rows.select("window_id", r6(F.sqrt(q), "norm"), *[r6(F.when(q > 0, c / F.when(q > 0, q)), f"i{i}") for i, c in enumerate(O.conjugate(e))])


@_add("tensor_products", _products_sql("codon_octonions", C))
def tensor_products(spark, folder):
    """codon_products through the structure constants as data: per component a fold over its eight (i, j, sign)."""
    pairs = T.adjacent_products(table(spark, folder, "codon_octonions"), *C)
    unit = lambda n: F.array(*[F.col(f"{n}.{e}") for e in O.AXES])
    rows = pairs.select(*CODON_KEYS, CODON_POSITION, "transition_score", unit("x").alias("x"), unit("y").alias("y"))

    def component(k: int) -> Column:
        constants = F.array(*[F.struct(F.lit(i + 1).alias("i"), F.lit(j + 1).alias("j"), F.lit(float(sign)).alias("s")) for i, j, sign, to in O.STRUCTURE if to == k])
        return F.aggregate(constants, F.lit(0.0), lambda t, c: t + F.element_at("x", c["i"]) * F.element_at("y", c["j"]) * c["s"])

    sums = rows.select(*CODON_KEYS, CODON_POSITION, "transition_score", *[component(k).alias(f"p{k}") for k in range(8)])
    return rounded(sums.withColumn("product_norm", F.sqrt(O.squared_norm([F.col(f"p{k}") for k in range(8)]))))
