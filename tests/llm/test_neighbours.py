import numpy as np
import pytest
from pyspark.sql import functions as F

from octolake.llm import neighbours as N

AXES = ["e0", "e1", "e2", "e3"]


def table(spark, x, schemes):
    rows = [(i, s, *map(float, v)) for i, (v, s) in enumerate(zip(x, schemes))]
    rows += rows[:20] + [(9000, "a", None, 0.0, 0.0, 0.0), (9001, "a", float("nan"), 0.0, 0.0, 0.0), (None, "a", 0.0, 0.0, 0.0, 0.0), (9002, None, 0.0, 0.0, 0.0, 0.0)]
    return spark.createDataFrame(rows, "id long, s string, e0 double, e1 double, e2 double, e3 double").withColumn("cell", F.lit("clash")).withColumn("scheme", F.lit(1))


def brute(x, schemes, q, k):
    d = np.sqrt(((x - x[q]) ** 2).sum(1))
    d[[i for i, s in enumerate(schemes) if s != schemes[q] or i == q]] = np.inf
    order = np.lexsort((np.arange(len(x)), d))[:k]
    return [(int(i), float(d[i])) for i in order if np.isfinite(d[i])]


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c, 0.3, (400, 4)) for c in range(4)] + [np.repeat([[0.5, 0.5, 0.5, 0.5]], 300, 0)])
    return x, ["a" if i % 9 else "b" for i in range(len(x))]


@pytest.mark.parametrize("few", [True, False])
def test_exact_search(spark, data, monkeypatch, few):
    if not few:
        monkeypatch.setattr(N, "FEW_QUERIES", 1)
    x, schemes = data
    q = list(range(0, 1600, 97)) + [9000, 123456]
    got = {}
    for r in N.nearest(table(spark, x, schemes), spark.createDataFrame([(i,) for i in q + q], "id long"), "id", "s", AXES, 5, candidates=20, exact=True).collect():
        got.setdefault(r["query"], {})[r["rank"]] = (r["neighbour"], r["distance"])
    assert set(got) == {i for i in q if i < 1900}
    for i, found in got.items():
        expected = brute(x, schemes, i, 5)
        assert np.allclose([found[r][1] for r in sorted(found)], [d for _, d in expected])
        assert len({found[r][0] for r in found}) == 5 and i not in {found[r][0] for r in found}


@pytest.mark.parametrize("few", [True, False])
def test_recall_and_both_ways(spark, data, monkeypatch, few):
    x, schemes = data
    if not few:
        monkeypatch.setattr(N, "FEW_QUERIES", 1)
        monkeypatch.setattr(N, "PART_ROWS", 50)
        monkeypatch.setattr(N, "PART_QUERIES", 7)
    df = table(spark, x, schemes)
    got = {}
    for r in N.nearest(df, df.where("id % 20 = 0").select("id"), "id", "s", AXES, 5, candidates=300).collect():
        got.setdefault(r["query"], []).append(r["distance"])
    hits = total = 0
    for i in range(0, len(x), 20):
        far = brute(x, schemes, i, 5)[-1][1]
        hits += sum(d <= far + 1e-12 for d in got[i])
        total += 5
        assert len(got[i]) == 5
    assert hits / total >= 0.9


@pytest.mark.parametrize("few", [True, False])
def test_one_row_delivered_thousands_of_times(spark, monkeypatch, few):
    if not few:
        monkeypatch.setattr(N, "FEW_QUERIES", 1)
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(c, 0.3, (300, 4)) for c in range(4)])
    df = table(spark, x, ["a"] * len(x))
    many = df.unionByName(df.where("id = 7").limit(1).crossJoin(spark.range(5000).select()))
    index, held = N.build_index(many, "id", "s", AXES)
    assert held.count() == len(x) and index.size["a"].sum() == len(x)
    queries = [7, 8, 100, 900]
    got = {}
    for r in N.nearest(many, spark.createDataFrame([(i,) for i in queries], "id long"), "id", "s", AXES, 5, candidates=300).collect():
        got.setdefault(r["query"], set()).add(r["neighbour"])
    assert set(got) == set(queries) and all(len(v) == 5 and q not in v for q, v in got.items())
    same = {}
    for r in N.nearest(df, spark.createDataFrame([(i,) for i in queries], "id long"), "id", "s", AXES, 5, candidates=300).collect():
        same.setdefault(r["query"], set()).add(r["neighbour"])
    assert got == same


def test_small_and_empty(spark):
    df = table(spark, np.zeros((3, 4)), ["a", "a", "z"])
    got = sorted((r["query"], r["neighbour"], r["distance"]) for r in N.nearest(df, df.select("id"), "id", "s", AXES, 5, exact=True).collect())
    assert got == [(0, 1, 0.0), (1, 0, 0.0)]
    assert N.nearest(df.limit(0), df.select("id"), "id", "s", AXES).count() == 0
    assert N.nearest(df, df.select("id").limit(0), "id", "s", AXES, exact=True).count() == 0


def test_walk_is_in_order():
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=(6, 2)), rng.normal(size=(5, 2))
    index = N.MultiIndex({"a": (a, b)})
    index.size["a"] = np.ones(30, np.int32)
    q = rng.normal(size=4)
    sums = [((q[:2] - a[c // 5]) ** 2).sum() + ((q[2:] - b[c % 5]) ** 2).sum() for c in index.traverse("a", q, 10**9)]
    assert len(sums) == 30 and np.all(np.diff(sums) >= -1e-12)
    assert len(index.traverse("a", q, 7)) == 7


def test_query_against_sql(same_as_sql):
    from octolake.llm import queries

    same_as_sql(queries.p4_found, queries.SQL["p4_found"])


def test_bounds_leave_no_near_cell_out():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 4))
    index = N.MultiIndex({"a": (N.kmeans(x[:, :2], 9), N.kmeans(x[:, 2:], 7))})
    import pandas as pd

    cell = index.cells("a", x)
    frame = pd.DataFrame(x, columns=AXES).assign(scheme="a", cell=cell, a=cell // 7, b=cell % 7)
    halves = []
    for side, names in (("a", AXES[:2]), ("b", AXES[2:])):
        g = frame.groupby(["scheme", side])[names].agg(["min", "max"])
        g.columns = [f"{'lo' if s == 'min' else 'hi'}_{e}" for e, s in g.columns]
        halves.append(g.reset_index().rename(columns={side: "half"}))
    index.fill(frame.groupby(["scheme", "cell"]).size().reset_index(name="n"), halves, AXES)
    for q in rng.normal(size=(40, 4)):
        d = ((x - q) ** 2).sum(1)
        for far in (0.05, 0.4, np.inf):
            assert set(cell[d <= far]) <= set(index.within("a", q, far))
