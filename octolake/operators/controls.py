"""Null controls: shuffled sequences, changed axes, and distances to references."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from octolake.functions import octonion as O
from octolake.operators import trajectory as T
from octolake.operators.codon import FAMILY

#: References that rows are compared with at most; they are broadcast.
MOST_REFERENCES = 2000


def _seed(seed: int, name: str) -> np.random.Generator:
    import hashlib

    return np.random.default_rng(int.from_bytes(hashlib.blake2b(f"{seed}|{name}".encode(), digest_size=8).digest(), "little"))


def dinucleotide_shuffle(text: str, rng: np.random.Generator) -> str:
    """A random text with the same first and last symbol and the same counts of neighbouring pairs.

    A random walk from every symbol to the last one gives a tree of last exits; all other exits are shuffled, and the
    walk through them uses every pair once.
    """
    if len(text) < 3:
        return text
    exits: dict[str, list[str]] = {}
    for a, b in zip(text, text[1:]):
        exits.setdefault(a, []).append(b)
    last = text[-1]
    final: dict[str, str] = {}
    tree = {last}
    for start in sorted(exits):
        at = start
        while at not in tree:  # a walk that forgets its loops, for an exit taken again replaces the one before
            final[at] = exits[at][int(rng.integers(len(exits[at])))]
            at = final[at]
        at = start
        while at not in tree:
            tree.add(at)
            at = final[at]
    for a, b in exits.items():
        rest = list(b)
        if a != last:
            rest.remove(final[a])
        rng.shuffle(rest)
        exits[a] = (rest + [final[a]] if a != last else rest)[::-1]
    out, at = [text[0]], text[0]
    for _ in range(len(text) - 1):
        at = exits[at].pop()
        out.append(at)
    return "".join(out)


def shuffled(df: DataFrame, key: str, text: str, kind: str = "dinucleotide", seed: int = 7) -> DataFrame:
    """The rows with ``text`` shuffled: symbols, codons (frame 0, a rest stays last) or neighbouring pairs are kept in number.

    ``synonymous`` shuffles codons among the places of their residue, which keeps the protein as well.

    Each row has its own seed from ``key``, so results don't depend on the partitioning. Null texts stay null.
    """
    if kind not in ("symbols", "codons", "dinucleotide", "synonymous"):
        raise ValueError(kind)

    def one(name: str, s: str) -> str:
        rng = _seed(seed, name)
        if kind == "dinucleotide":
            return dinucleotide_shuffle(s, rng)
        width = 1 if kind == "symbols" else 3
        end = len(s) - len(s) % width
        units = [s[i : i + width] for i in range(0, end, width)]
        if kind == "synonymous":  # codons change places within their residue, so the protein and the usage stay
            places: dict[str, list[int]] = {}
            for i, codon in enumerate(units):
                places.setdefault(FAMILY.get(codon, codon), []).append(i)
            moved = list(units)
            for at in places.values():
                for i, j in zip(at, rng.permutation(at)):
                    moved[i] = units[j]
            return "".join(moved) + s[end:]
        return "".join(units[i] for i in rng.permutation(len(units))) + s[end:]

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            pdf[text] = [one(str(n), s) if isinstance(s, str) else None for n, s in zip(pdf[key], pdf[text])]
            yield pdf

    return df.mapInPandas(run, df.schema)


def axis_controls(n: int, seed: int = 0) -> list[tuple[str, list[int], list[int]]]:
    """(name, source axis of e1..e7, sign of each): the unchanged axes and n random signed permutations."""
    rng = np.random.default_rng(seed)
    out = [("canonical", list(range(1, 8)), [1] * 7)]
    for i in range(n):
        out.append((f"signed_{i}", [int(x) + 1 for x in rng.permutation(7)], [int(s) for s in rng.choice([-1, 1], 7)]))
    return out


def control_transitions(df: DataFrame, keys: list[str], position: str, row_id: str, controls: list[tuple[str, list[int], list[int]]]) -> DataFrame:
    """(control, n_pairs, mean_score, max_score): transition scores of all neighbours under changed axes, in one pass."""
    pairs = T.adjacent_products(df, keys, position, row_id).select(*[F.array(*[F.col(f"{u}.{e}") for e in O.AXES]).alias(f"_{u}") for u in "xy"])
    table = F.broadcast(df.sparkSession.createDataFrame(controls, "control string, _p array<int>, _s array<int>"))  # a row a control
    rows = pairs.crossJoin(table)
    moved = {u: [F.col(f"_{u}")[0], *[F.element_at(F.col(f"_{u}"), F.col("_p")[i] + 1) * F.col("_s")[i] for i in range(7)]] for u in "xy"}
    # the moved units are bound to columns before the commutator takes each of them several times
    rows = rows.select("control", *[c.alias(f"{u}{i}") for u in "xy" for i, c in enumerate(moved[u])])
    x, y = ([F.col(f"{u}{i}") for i in range(8)] for u in "xy")
    scores = rows.select("control", F.sqrt(O.squared_norm(O.commutator(x, y))).alias("v"))
    return scores.groupBy("control").agg(F.count(F.lit(1)).alias("n_pairs"), F.avg("v").alias("mean_score"), F.max("v").alias("max_score"))


def orthogonal_matrices(n: int, seed: int = 0) -> list[tuple[str, list[list[float]]]]:
    """(name, rows) of n random orthogonal 7 x 7 matrices, uniform over rotations and reflections."""
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        q, r = np.linalg.qr(rng.normal(size=(7, 7)))
        out.append((f"orthogonal_{i}", (q * np.sign(np.diag(r))).tolist()))
    return out


def orthogonal_transitions(df: DataFrame, keys: list[str], position: str, row_id: str, matrices: list[tuple[str, list[list[float]]]]) -> DataFrame:
    """(control, n_pairs, mean_score, max_score): transition scores of all neighbours with e1..e7 turned by each matrix."""
    pairs = T.adjacent_products(df, keys, position, row_id)
    columns = []
    for k, (_, rows) in enumerate(matrices):
        for u in "xy":
            columns += [sum((F.col(f"{u}.e{j + 2}") * v for j, v in enumerate(row[1:])), F.col(f"{u}.e1") * row[0]).alias(f"{u}{k}_{i + 1}") for i, row in enumerate(rows)]
    turned = pairs.select(*columns)  # bound to columns before the commutator takes each several times
    zero = F.lit(0.0)
    scores = turned.select(*[F.sqrt(O.squared_norm(O.commutator(*[[zero, *[F.col(f"{u}{k}_{i}") for i in range(1, 8)]] for u in "xy"]))).alias(f"_{k}") for k in range(len(matrices))])
    agg = scores.agg(F.count(F.lit(1)).alias("n_pairs"), *[f(f"_{k}").alias(f"{s}_{k}") for k in range(len(matrices)) for s, f in (("mean", F.avg), ("max", F.max))])
    rows = F.array(*[F.struct(F.lit(name).alias("control"), F.col("n_pairs"), F.col(f"mean_{k}").alias("mean_score"), F.col(f"max_{k}").alias("max_score")) for k, (name, _) in enumerate(matrices)])
    return agg.select(F.explode(rows).alias("r")).select("r.*")


def reference_distances(df: DataFrame, row_id: str, references: DataFrame, reference_id: str, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """(by, row_id, reference_id, euclidean, manhattan, cosine, correlation) of every row and every reference of the same ``by``.

    References (say, the centroid of each label) are at most MOST_REFERENCES and are broadcast; pairs of rows are left
    to the nearest-vector index. Nulls count as 0; a zero vector has cosine and correlation distance 1.
    """
    x = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns]
    by = by or []
    refs = references.select(*by, reference_id, F.array(*x).alias("_r")).dropDuplicates([*by, reference_id])
    if refs.limit(MOST_REFERENCES + 1).count() > MOST_REFERENCES:
        raise ValueError(f"more than {MOST_REFERENCES} references")
    rows = df.select(*by, row_id, F.array(*x).alias("_x"))
    rows = rows.join(F.broadcast(refs), by) if by else rows.crossJoin(F.broadcast(refs))
    both = F.arrays_zip(F.col("_x").alias("a"), F.col("_r").alias("b"))

    def total(f) -> Column:
        return F.aggregate(both, F.lit(0.0), lambda t, p: t + f(p["a"], p["b"]))

    def angle(a: Column, b: Column, ab: Column) -> Column:
        return F.when((a > 0) & (b > 0), 1 - ab / F.sqrt(F.when((a > 0) & (b > 0), a * b))).otherwise(1.0)

    n = float(len(columns))
    rows = rows.select(
        *by, row_id, reference_id, F.sqrt(total(lambda a, b: (a - b) * (a - b))).alias("euclidean"), total(lambda a, b: F.abs(a - b)).alias("manhattan"),
        total(lambda a, b: a * a).alias("aa"), total(lambda a, b: b * b).alias("bb"), total(lambda a, b: a * b).alias("ab"), total(lambda a, b: a).alias("sa"), total(lambda a, b: b).alias("sb"),
    )
    va, vb, vab = F.col("aa") - F.col("sa") * F.col("sa") / n, F.col("bb") - F.col("sb") * F.col("sb") / n, F.col("ab") - F.col("sa") * F.col("sb") / n
    flat = (va < 1e-12) | (vb < 1e-12)
    return rows.select(*by, row_id, reference_id, "euclidean", "manhattan", angle(F.col("aa"), F.col("bb"), F.col("ab")).alias("cosine"), F.when(flat, 1.0).otherwise(angle(va, vb, vab)).alias("correlation"))
