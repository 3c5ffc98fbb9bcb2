from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from octolake.functions import checks
from octolake.functions import octonion as O
from octolake.operators import codon as D
from octolake.operators import controls as N
from octolake.operators import models as M


def test_algebra_tables(spark):
    assert checks.multiplication_table(spark).count() == 64
    assert checks.plane_incidence(spark).count() == 21 and checks.plane_pairs(spark).count() == 42
    report = checks.validation_report(spark).collect()
    assert all(r["passed"] for r in report) and len(report) == 7 + 42 + 16 + 2 + 5
    assert len(checks.automorphisms()) == 21
    assert checks.automorphisms(cyclic=False) == [tuple(range(1, 8))]
    x, y = np.random.default_rng(0).normal(size=(2, 8))
    assert np.allclose(checks.left_matrix(x) @ y, O.multiply(x, y)) and np.allclose(checks.right_matrix(y) @ x, O.multiply(x, y))


@pytest.mark.parametrize("text", ["", "A", "AC", "AAAA", "ACGT", "ACACAC", "GATTACAGATTACA", "ABCABD" * 30])
def test_shuffles_keep_their_counts(spark, text):
    pairs = lambda s: Counter(zip(s, s[1:]))
    for seed in range(10):
        got = N.dinucleotide_shuffle(text, np.random.default_rng(seed))
        assert pairs(got) == pairs(text) and got[:1] == text[:1] and got[-1:] == text[-1:]


def test_shuffled_tables(spark):
    df = spark.createDataFrame([("a", "ACGTTGCA" * 20, 1), ("b", None, 2), ("c", "ACGTA", 3)], "k string, s string, other int")
    for kind in ("symbols", "codons", "dinucleotide"):
        got = {r["k"]: r["s"] for r in N.shuffled(df, "k", "s", kind).collect()}
        assert Counter(got["a"]) == Counter("ACGTTGCA" * 20) and got["b"] is None
        assert got == {r["k"]: r["s"] for r in N.shuffled(df.repartition(3), "k", "s", kind).collect()}
    assert got["a"] != "ACGTTGCA" * 20
    with pytest.raises(ValueError):
        N.shuffled(df, "k", "s", "words")


def test_reference_distances(spark):
    rng = np.random.default_rng(0)
    x, r = rng.normal(size=(5, 4)), rng.normal(size=(2, 4))
    x[0] = 0
    x[1] = 3
    cols = ["a", "b", "c", "d"]
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "id int, a double, b double, c double, d double")
    refs = spark.createDataFrame([(f"r{i}", *map(float, v)) for i, v in enumerate(r)], "ref string, a double, b double, c double, d double")
    for row in N.reference_distances(df, "id", refs, "ref", cols).collect():
        u, v = x[row["id"]], r[int(row["ref"][1])]
        assert np.isclose(row["euclidean"], np.linalg.norm(u - v)) and np.isclose(row["manhattan"], np.abs(u - v).sum())
        assert np.isclose(row["cosine"], 1 - u @ v / (np.linalg.norm(u) * np.linalg.norm(v)) if u.any() else 1.0)
        assert np.isclose(row["correlation"], 1 - np.corrcoef(u, v)[0, 1] if u.std() > 0 else 1.0)


def test_code_tables():
    assert len(D.dyadic_shifts()) == 63 and max(D.dyadic_shifts(), key=lambda s: s[1])[:2] == (2, 0.9375)
    assert sum(strong for _, _, strong in D.root_degeneracy()) == 8


def frame(spark):
    rng = np.random.default_rng(1)
    rows = [(i, "ab"[i % 2], i % 3, float(rng.normal() + 5 * (i % 2)), None if i == 7 else float(rng.normal()), 1.0) for i in range(120)]
    return spark.createDataFrame([*rows, (500, None, 0, 0.0, 0.0, 1.0)], "id long, label string, fold int, x double, y double, flat double")


@pytest.mark.parametrize("model", sorted(M.MODELS))
def test_models(spark, model):
    if model == "forest":
        pytest.skip("as the tree, but slow")
    rows = M.cross_validated(frame(spark), "id", "label", "fold", ["x", "y", "flat"], model).collect()
    assert len(rows) == 120 and sum(r["label"] == r["predicted"] for r in rows) > 110


def test_clusters_and_agreement(spark):
    df = frame(spark).dropna()
    found = M.clustered(df, "id", ["x", "flat"], 2).join(df.select("id", "label"), "id")
    r = M.agreement(found, "cluster", "label").collect()[0]
    assert r["ari"] > 0.8 and r["nmi"] > 0.7
    same = df.select("label", F.col("label").alias("copy"))
    r = M.agreement(same, "label", "copy").collect()[0]
    assert np.isclose(r["ari"], 1) and np.isclose(r["nmi"], 1)


def test_auc(spark):
    df = spark.createDataFrame([(0.1, 0), (0.4, 0), (0.4, 1), (0.8, 1), (None, 1)], "s double, y int")
    r = M.rank_auc(df, "s", "y").collect()[0]
    assert (r["n_pos"], r["n_neg"]) == (2, 2) and np.isclose(r["auc"], 3.5 / 4)
    assert M.rank_auc(df.where("y = 1"), "s", "y").collect()[0]["auc"] is None


def test_too_many_labels_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(M, "MOST_LABELS", 1)
    with pytest.raises(ValueError, match="labels"):
        M.cross_validated(frame(spark), "id", "label", "fold", ["x", "y", "flat"], "tree")
