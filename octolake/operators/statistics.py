"""Information, ranks, bins, tests and quality of features."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from octolake.operators.skew import running_totals, skew_join
from octolake.operators.trajectory import group_quantiles


def information(df: DataFrame, x: str, y: str, z: str) -> DataFrame:
    """One row of plug-in entropies of three columns in bits, with mutual, conditional and interaction information.

    Rows with a null in any of the three are left out; without rows all results are null. The table is counted once;
    the seven marginals come from grouping sets over the counts. Interaction is I(x;y) - I(x;y|z).
    """
    counts = df.select(F.col(x).alias("x"), F.col(y).alias("y"), F.col(z).alias("z")).dropna().groupBy("x", "y", "z").agg(F.count(F.lit(1)).alias("n"))
    c = {k: F.col(k) for k in "xyz"}
    sets = [[c["x"]], [c["y"]], [c["z"]], [c["x"], c["y"]], [c["x"], c["z"]], [c["y"], c["z"]], [c["x"], c["y"], c["z"]]]
    cells = counts.groupingSets(sets, *c.values()).agg(F.grouping_id().alias("g"), F.sum("n").alias("n"))
    h = cells.groupBy("g").agg((F.log2(F.sum("n").cast("double")) - F.sum(F.col("n") * F.log2(F.col("n").cast("double"))) / F.sum("n")).alias("h"))
    # a bit of grouping_id is set where the column is rolled up: x is 4, y is 2, z is 1
    names = {3: "h_x", 5: "h_y", 6: "h_z", 1: "h_xy", 2: "h_xz", 4: "h_yz", 0: "h_xyz"}
    row = h.agg(*[F.max(F.when(F.col("g") == g, F.col("h"))).alias(n) for g, n in names.items()])
    mi = F.col("h_x") + F.col("h_y") - F.col("h_xy")
    cmi = F.col("h_xz") + F.col("h_yz") - F.col("h_z") - F.col("h_xyz")
    return row.select("*", mi.alias("mi_xy"), cmi.alias("cmi_xy_z"), (mi - cmi).alias("interaction"), (F.col("h_x") + F.col("h_y") + F.col("h_z") - F.col("h_xyz")).alias("total_correlation"))


def quantile_bins(df: DataFrame, value: str, bins: int, name: str = "bin") -> DataFrame:
    """The rows with the number of inner quantile edges below the value: right-closed bins with equal edges merged.

    Null and NaN values have a null bin; a constant column has one bin.
    """
    probs = [i / bins for i in range(1, bins)]
    edges = group_quantiles(df.select(F.lit(0).alias("_k"), value), ["_k"], value, probs).drop("_k").first()  # bins - 1 numbers
    cuts = sorted(set(edges)) if edges else []
    lowest = df.agg(F.min(value)).first()[0]
    cuts = [c for c in cuts if lowest is None or c > lowest or len(cuts) == 1]
    v = F.col(value)
    n = sum(((v > c).cast("int") for c in cuts), F.lit(0))
    return df.withColumn(name, F.when(v.isNotNull() & ~F.isnan(v), n))


def average_ranks(df: DataFrame, value: str) -> DataFrame:
    """(value, rank) of the different values: equal ones share their mean rank, from 1.

    Values are counted and ordered in ranges; no task orders the table, wherever the values lie.
    """
    counts = df.where(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(F.col(value).cast("double").alias("value")).agg(F.count(F.lit(1)).alias("_n"))
    return running_totals(counts, [], "value", ["_n"]).select("value", (F.col("before__n") + (F.col("_n") + 1) / 2).alias("rank"))


def correlation(a: str, b: str) -> Column:
    """Pearson's correlation as an aggregate; null where a column is constant or there is no row."""
    spread = F.var_pop(a) * F.var_pop(b)
    return F.when(spread > 0, F.covar_pop(a, b) / F.sqrt(F.when(spread > 0, spread)))


def rank_correlation(df: DataFrame, row_id: str, x: str, y: str) -> DataFrame:
    """(n, spearman) of two columns over the rows that have both."""
    rows = df.select(row_id, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna().dropDuplicates([row_id])
    for c in ("x", "y"):
        rows = skew_join(rows, average_ranks(rows, c).withColumnsRenamed({"value": c, "rank": f"r_{c}"}), [c])
    return rows.agg(F.count(F.lit(1)).alias("n"), correlation("r_x", "r_y").alias("spearman"))


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_a, column_b, correlation) of all pairs of the columns from one aggregation; null for constant columns."""
    pairs = list(combinations(columns, 2))
    n = F.count(F.lit(1))
    sums = df.select(*columns).dropna().agg(n.alias("_n"), *[correlation(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.array(*[F.struct(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"), F.col(f"c{i}").alias("correlation")) for i, (a, b) in enumerate(pairs)])
    return sums.select(F.explode(rows).alias("r")).select("r.*")


def column_quality(df: DataFrame, columns: list[str], least: float = 1e-10) -> DataFrame:
    """(column, n, n_null, mean, variance, constant) of each column: population variance, constant below ``least``."""
    agg = df.agg(*[f.alias(f"{c}__{s}") for c in columns for s, f in (("n", F.count(c)), ("all", F.count(F.lit(1))), ("mean", F.avg(c)), ("var", F.var_pop(c)))])
    rows = [
        F.struct(F.lit(c).alias("column"), F.col(f"{c}__n").alias("n"), (F.col(f"{c}__all") - F.col(f"{c}__n")).alias("n_null"), F.col(f"{c}__mean").alias("mean"), F.col(f"{c}__var").alias("variance"), (F.coalesce(F.col(f"{c}__var"), F.lit(0.0)) < least).alias("constant"))
        for c in columns
    ]
    return agg.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def normal_tail(z: Column) -> Column:
    """Two-sided tail of the normal distribution by a logistic approximation (error below 0.0002)."""
    a = F.abs(z)
    return F.least(F.lit(1.0), 2.0 / (1.0 + F.exp(F.least(0.07056 * a * a * a + 1.5976 * a, F.lit(700.0)))))


def benjamini_hochberg(df: DataFrame, p: str, key: str) -> DataFrame:
    """The tests with their adjusted p value, for tables of tests (one row a feature, not a record).

    q is the least p n / rank from a row on, at most 1. Rows without p get none.
    """
    tests = df.where(F.col(p).isNotNull())
    n = F.count(F.lit(1)).over(W.partitionBy())
    rank = F.row_number().over(W.orderBy(p, key))
    scaled = tests.withColumn("_raw", F.col(p) * n / rank).withColumn("_rank", rank)
    return scaled.withColumn("q", F.least(F.lit(1.0), F.min("_raw").over(W.orderBy("_rank").rowsBetween(W.currentRow, W.unboundedFollowing)))).drop("_raw", "_rank")


def mean_tests(df: DataFrame, group: str, first: str, second: str, columns: list[str]) -> DataFrame:
    """(column, mean_first, mean_second, z, p, q): Welch's z of each column between two groups, adjusted over columns."""
    def side(g: str, c: str) -> tuple[Column, ...]:
        v = F.when(F.col(group) == g, F.col(c))
        return F.count(v), F.avg(v), F.var_samp(v)

    agg = df.where(F.col(group).isin(first, second)).agg(*[f.alias(f"{c}__{g}{s}") for c in columns for g, name in (("a", first), ("b", second)) for s, f in zip("nmv", side(name, c))])
    rows = []
    for c in columns:
        va, vb = F.col(f"{c}__av") / F.col(f"{c}__an"), F.col(f"{c}__bv") / F.col(f"{c}__bn")
        z = F.when(va + vb > 0, (F.col(f"{c}__am") - F.col(f"{c}__bm")) / F.sqrt(F.when(va + vb > 0, va + vb)))
        rows.append(F.struct(F.lit(c).alias("column"), F.col(f"{c}__am").alias("mean_first"), F.col(f"{c}__bm").alias("mean_second"), z.alias("z"), normal_tail(z).alias("p")))
    return benjamini_hochberg(agg.select(F.explode(F.array(*rows)).alias("r")).select("r.*"), "p", "column")


def projection_weights(n: int, to: int, seed: int = 0) -> np.ndarray:
    """Seeded Gaussian weights over sqrt(n), as an n x to matrix."""
    return np.random.default_rng(seed).normal(size=(n, to)) / np.sqrt(n)


def project(df: DataFrame, keys: list[str], columns: list[str], to: int, seed: int = 0) -> DataFrame:
    """keys and proj_0, ...: a random projection of the columns; nulls count as 0."""
    w = projection_weights(len(columns), to, seed)
    filled = [F.coalesce(F.col(c), F.lit(0.0)) for c in columns]
    return df.select(*keys, *[sum((float(w[i, j]) * v for i, v in enumerate(filled[1:], 1)), float(w[0, j]) * filled[0]).alias(f"proj_{j}") for j in range(to)])


def value_summary(df: DataFrame, keys: list[str], columns: list[str], name: str) -> DataFrame:
    """(keys, name, n, mean, median, least, greatest) of every column, one row a column; nulls are left out.

    Medians are exact: equal values are counted in every split, so what is held for a key are its different values.
    """
    rows = df.select(*keys, F.explode(F.array(*[F.struct(F.lit(c).alias(name), F.col(c).cast("double").alias("v")) for c in columns])).alias("x")).select(*keys, "x.*")
    return rows.groupBy(*keys, name).agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.percentile("v", 0.5).alias("median"), F.min("v").alias("least"), F.max("v").alias("greatest"))


def gram(df: DataFrame, keys: list[str], columns: list[str], centred: bool = False) -> DataFrame:
    """keys, n and the sums of the products of all pairs of columns, as one array row by row; rows with a null are left out.

    One aggregation; with ``centred`` the means are taken out of the sums.
    """
    rows = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns]).dropna()
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    sums = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(a) * F.col(b)).alias(f"_{i}") for i, (a, b) in enumerate(pairs)], *[F.sum(c).alias(f"_s{i}") for i, c in enumerate(columns)])
    at = {p: i for i, p in enumerate(pairs)}
    place = {c: i for i, c in enumerate(columns)}

    def cell(a: str, b: str) -> Column:
        v = F.col(f"_{at[(a, b)] if (a, b) in at else at[(b, a)]}")
        return v - F.col(f"_s{place[a]}") * F.col(f"_s{place[b]}") / F.col("n") if centred else v

    return sums.select(*keys, "n", F.array(*[cell(a, b) for a in columns for b in columns]).alias("gram"))


def singular_values(df: DataFrame, keys: list[str], columns: list[str], centred: bool = False, tolerance: float = 1e-7) -> DataFrame:
    """(keys, n, index, singular_value, rank, condition, first_share, effective_dimension) of the matrix of the columns of each key.

    The values are the roots of the eigenvalues of the sums of products, which are columns squared numbers a key, so
    only those pass Python; values below a ten-millionth of the greatest are lost in rounding. rank counts values beyond ``tolerance`` of the greatest; condition is the greatest over the
    least of these; first_share is the first squared value's share; effective_dimension is the exponential of the
    entropy of these shares. A key without rows gives none.
    """
    width = len(columns)

    def solve(batches):
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                values = np.sqrt(np.clip(np.linalg.eigvalsh(np.array(row["gram"], float).reshape(width, width)), 0.0, None))[::-1]
                kept = values[values > tolerance * max(values[0], 1e-300)] if values[0] > 0 else values[:0]
                share = values**2 / (values**2).sum() if values[0] > 0 else np.zeros(width)
                bits = -(share[share > 0] * np.log(share[share > 0])).sum()
                fields = {"n": row["n"], "rank": len(kept), "condition": float(kept[0] / kept[-1]) if len(kept) else None, "first_share": float(share[0]), "effective_dimension": float(np.exp(bits)) if len(kept) else 0.0}
                out += [{**{k: row[k] for k in keys}, **fields, "index": i, "singular_value": float(v)} for i, v in enumerate(values)]
            yield pd.DataFrame(out, columns=[*keys, "n", "index", "singular_value", "rank", "condition", "first_share", "effective_dimension"])

    sums = gram(df, keys, columns, centred)
    kinds = dict(sums.dtypes)
    ddl = ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], "n long", "index int", "singular_value double", "rank int", "condition double", "first_share double", "effective_dimension double"])
    return sums.mapInPandas(solve, ddl)


def redundancy(df: DataFrame, keys: list[str], columns: list[str], target: str) -> DataFrame:
    """(keys, n, rank, condition, first_share, mean_abs_correlation, linear_r2) of columns: how much of them says the same.

    linear_r2 is that of ``target``, one more column, by least squares on all others, solved from the sums of products.
    Constant columns have correlation 0; r2 is null for a constant target.
    """
    width = len(columns) + 1

    def solve(batches):
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                g = np.array(row["gram"], float).reshape(width, width)
                x, xy, yy = g[:-1, :-1], g[:-1, -1], g[-1, -1]
                values = np.sqrt(np.clip(np.linalg.eigvalsh(x), 0.0, None))[::-1]
                kept = values[values > 1e-7 * max(values[0], 1e-300)] if values[0] > 0 else values[:0]
                d = np.sqrt(np.clip(np.diag(x), 0.0, None))
                scale = np.outer(d, d)
                r = np.where(scale > 1e-12, x / np.where(scale > 1e-12, scale, 1.0), 0.0)
                above = np.abs(r[np.triu_indices(width - 1, 1)])
                r2 = float(np.clip(xy @ np.linalg.pinv(x, rcond=1e-10, hermitian=True) @ xy / yy, 0, 1)) if yy > 1e-12 else None
                out.append({**{k: row[k] for k in keys}, "n": row["n"], "rank": len(kept), "condition": float(kept[0] / kept[-1]) if len(kept) else None, "first_share": float(values[0] ** 2 / (values**2).sum()) if len(kept) else 0.0, "mean_abs_correlation": float(above.mean()) if len(above) else 0.0, "linear_r2": r2})
            yield pd.DataFrame(out, columns=[*keys, "n", "rank", "condition", "first_share", "mean_abs_correlation", "linear_r2"])

    sums = gram(df, keys, [*columns, target], centred=True)
    kinds = dict(sums.dtypes)
    return sums.mapInPandas(solve, ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], "n long", "rank int", "condition double", "first_share double", "mean_abs_correlation double", "linear_r2 double"]))


def equal_columns(df: DataFrame, columns: list[str], least: float = 1 - 1e-9) -> DataFrame:
    """(column_a, column_b, duplicate, collinear) of all pairs: equal in every row, nulls too; or correlated by at least ``least``, either sign."""
    pairs = list(combinations(columns, 2))
    agg = df.agg(*[F.sum((~F.col(a).eqNullSafe(F.col(b))).cast("long")).alias(f"d{i}") for i, (a, b) in enumerate(pairs)], *[F.corr(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.array(*[F.struct(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"), (F.coalesce(F.col(f"d{i}"), F.lit(0)) == 0).alias("duplicate"), F.coalesce(F.abs(f"r{i}") >= least, F.lit(False)).alias("collinear")) for i, (a, b) in enumerate(pairs)])
    return agg.select(F.explode(rows).alias("r")).select("r.*")


def pair_information(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_a, column_b, n, h_a, h_b, mutual, normalised) in bits of all pairs of columns; normalised by the root of both entropies.

    Rows with a null in any of the columns are left out. The table is counted once; all pairs come from the counts.
    """
    counts = df.select(*columns).dropna().groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
    both = F.array(*[F.struct(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"), F.col(a).cast("string").alias("x"), F.col(b).cast("string").alias("y")) for a, b in combinations(columns, 2)])
    cells = counts.select("n", F.explode(both).alias("p")).select("n", "p.*").groupBy("column_a", "column_b", "x", "y").agg(F.sum("n").alias("n"))
    nlogn = lambda c: F.sum(F.col(c) * F.log2(F.col(c).cast("double")))
    row = cells.groupBy("column_a", "column_b").agg(F.sum("n").alias("n"), nlogn("n").alias("s"))
    for side, name in (("x", "a"), ("y", "b")):
        one = cells.groupBy("column_a", "column_b", side).agg(F.sum("n").alias("n")).groupBy("column_a", "column_b").agg(nlogn("n").alias(f"s_{name}"))
        row = row.join(one, ["column_a", "column_b"])
    total = F.col("n").cast("double")
    h = {k: F.log2(total) - F.col(c) / total for k, c in (("ab", "s"), ("a", "s_a"), ("b", "s_b"))}
    mutual = h["a"] + h["b"] - h["ab"]
    scale = F.sqrt(F.greatest(F.lit(0.0), h["a"] * h["b"]))
    return row.select("column_a", "column_b", "n", h["a"].alias("h_a"), h["b"].alias("h_b"), mutual.alias("mutual"), F.when(scale > 1e-9, mutual / F.when(scale > 1e-9, scale)).otherwise(0.0).alias("normalised"))


def numeric_by_key(df: DataFrame, key: str, leave_out: tuple[str, ...] = ()) -> DataFrame:
    """key, and mean_<c> and max_<c> of every numeric column but the key and those left out; null keys form no row."""
    kinds = ("tinyint", "smallint", "int", "bigint", "float", "double")
    columns = [c for c, t in df.dtypes if t in kinds and c != key and c not in leave_out]
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(*[f(c).cast("double").alias(f"{s}_{c}") for c in columns for s, f in (("mean", F.avg), ("max", F.max))])


def table_digest(df: DataFrame, columns: list[str]) -> DataFrame:
    """(rows, digest): an order-free digest of a table's rows: the sum of the first 15 hexadecimal digits of their md5.

    Values are read as text, nulls as an own sign; two tables with the same rows, in any order and partitioning, agree.
    """
    text = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns])
    part = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(part), F.lit(0)).cast("string").alias("digest"))
