import numpy as np
import pytest
from pyspark.sql import functions as F

from octolake.functions import octonion as O
from octolake.operators import trajectory as T

SCHEMA = "k string, pos long, id long, " + ", ".join(f"{e} double" for e in O.AXES)
KEYS = (["k"], "pos", "id")


def rows_of(n, key="a", seed=0, skip=()):
    x = np.random.default_rng(seed).normal(size=(n, 8)).round(3)
    return [(key, p, p + 1000 * seed, *map(float, x[p])) for p in range(n) if p not in skip], x


def test_products_respect_gaps_nulls_and_repeats(spark):
    rows, x = rows_of(10, skip=(4,))
    rows += [rows[0], rows[0]]  # delivered again
    rows.append(("a", 10, 99, *[None] * 8))  # a skipped unit
    rows.append((None, 1, 7, *[1.0] * 8))
    df = spark.createDataFrame(rows, SCHEMA).withColumn("x", F.lit("clash")).withColumn("y", F.lit(1)).withColumn("chunk", F.lit(2))
    got = {r["pos"]: r for r in T.adjacent_products(df, *KEYS).collect()}
    assert sorted(got) == [0, 1, 2, 5, 6, 7, 8]
    for p, r in got.items():
        assert np.allclose([r[f"p{i}"] for i in range(8)], O.multiply(x[p], x[p + 1]))
        assert np.isclose(r["transition_score"], np.linalg.norm(O.commutator(x[p], x[p + 1])))
    assert sorted(r["pos"] for r in T.adjacent_triplets(df, *KEYS).collect()) == [0, 1, 5, 6, 7]


@pytest.mark.parametrize("chunk", [3, 4, 100])
def test_chunks_change_nothing(spark, monkeypatch, chunk):
    monkeypatch.setattr(T, "CHUNK", chunk)
    rows, x = rows_of(23)
    more, _ = rows_of(2, "b", 1)
    df = spark.createDataFrame(rows + more, SCHEMA)
    w, _ = T.in_chunks(df, *KEYS, halo=2, chunk=chunk)
    assert w.where("not halo_row").count() == 25
    dense = T.dense_positions(df.where("pos % 5 <> 3"), *KEYS, chunk=chunk).where("k = 'a'").orderBy("pos").collect()
    assert [r["index"] for r in dense] == list(range(len(dense)))
    spread = lambda n: T._neighbours(df, *KEYS, n)
    assert spread(1).count() == 22 + 1 and spread(2).count() == 21


def test_summary_and_lines(spark):
    rows, x = rows_of(6)
    one, _ = rows_of(1, "b", 3)
    df = spark.createDataFrame(rows + one, SCHEMA)
    got = {r["k"]: r for r in T.trajectory_summary(df, *KEYS).collect()}
    moves = [np.linalg.norm(O.commutator(x[p], x[p + 1])) for p in range(5)]
    turns = [np.linalg.norm(O.associator(x[p], x[p + 1], x[p + 2])) for p in range(4)]
    assert np.isclose(got["a"]["mean_transition"], np.mean(moves)) and np.isclose(got["a"]["max_transition"], max(moves))
    assert np.isclose(got["a"]["mean_associator"], np.mean(turns)) and np.isclose(got["a"]["std_e3"], x[:, 3].std())
    assert got["b"]["n_units"] == 1 and got["b"]["max_transition"] == 0.0 and got["b"]["mean_associator"] == 0.0
    products = T.adjacent_products(df, *KEYS)
    attribution = T.line_attribution(products, ["k"], "pos")
    assert attribution.count() == 7 * products.count()
    f = T.line_features(products, ["k"]).collect()[0]
    assert np.isclose(sum(f["line_" + "_".join(map(str, line)) + "_share"] for line in O.LINES), 1.0)
    assert 0 <= f["line_entropy"] <= 1 + 1e-9


def test_equal_neighbours_have_no_lines(spark):
    df = spark.createDataFrame([("a", p, p, *[1.0] * 8) for p in range(3)], SCHEMA)
    f = T.line_features(T.adjacent_products(df, *KEYS), ["k"]).collect()[0]
    assert f["total"] == 0 and f["dominant_line"] is None and f["line_entropy"] == 0


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    for out in (T.adjacent_products(df, *KEYS), T.adjacent_triplets(df, *KEYS), T.trajectory_summary(df, *KEYS), T.gap_blind_products(df, *KEYS), T.group_quantiles(df, ["k"], "e0", [0.5])):
        assert out.count() == 0


@pytest.mark.parametrize("held", [10, 10**6])
def test_quantiles(spark, monkeypatch, held):
    monkeypatch.setattr(T, "MOST_HELD", held)
    rng = np.random.default_rng(1)
    groups = {"a": rng.normal(size=500), "b": np.repeat(2.0, 40), "c": np.array([1.0]), "d": rng.integers(0, 3, 77).astype(float), "o": np.append(rng.normal(size=300), 1e12)}
    rows = [(k, float(v)) for k, x in groups.items() for v in x] + [("a", None), ("e", None), ("a", float("nan"))]
    got = {r["k"]: r for r in T.group_quantiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", [0.0, 0.25, 0.5, 1.0]).collect()}
    assert set(got) == set(groups)
    for k, x in groups.items():
        assert np.allclose([got[k][f"q{i}"] for i in range(4)], np.quantile(x, [0.0, 0.25, 0.5, 1.0]))
