import numpy as np
from pyspark.sql import functions as F

from octolake.operators import benchmark as B
from octolake.operators import context as X
from octolake.operators import statistics as ST


def test_xor_has_no_pair_information(spark):
    df = spark.createDataFrame([(x, y, x ^ y) for x in (0, 1) for y in (0, 1)] + [(None, 1, 1)], "x int, y int, z int")
    r = ST.information(df, "x", "y", "z").collect()[0]
    assert np.isclose(r["h_x"], 1) and np.isclose(r["mi_xy"], 0) and np.isclose(r["cmi_xy_z"], 1) and np.isclose(r["interaction"], -1) and np.isclose(r["total_correlation"], 1)
    assert ST.information(df.limit(0), "x", "y", "z").collect()[0]["h_x"] is None


def test_bins_and_ranks(spark):
    x = np.array([1.0, 1.0, 1.0, 2.0, 3.0, 4.0, 5.0])
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)] + [(100, None)], "id long, v double")
    bins = {r["id"]: r["bin"] for r in ST.quantile_bins(df, "v", 3).collect()}
    assert bins[100] is None and bins[0] == 0 and bins[6] == max(b for b in bins.values() if b is not None)
    flat = ST.quantile_bins(df.withColumn("v", F.lit(2.0)), "v", 3)
    assert {r["bin"] for r in flat.collect()} == {0}
    ranks = {r["value"]: r["rank"] for r in ST.average_ranks(df, "v").collect()}
    assert ranks == {1.0: 2.0, 2.0: 4.0, 3.0: 5.0, 4.0: 6.0, 5.0: 7.0}
    both = df.withColumn("w", -F.col("v"))
    r = ST.rank_correlation(both, "id", "v", "w").collect()[0]
    assert r["n"] == 7 and np.isclose(r["spearman"], -1)


def test_adjusted_p(spark):
    p = [0.01, 0.04, 0.03, 0.5, None]
    df = spark.createDataFrame([(f"f{i}", v) for i, v in enumerate(p)], "k string, p double")
    got = {r["k"]: r["q"] for r in ST.benjamini_hochberg(df, "p", "k").collect()}
    assert np.allclose([got[f"f{i}"] for i in range(4)], [0.04, 0.04 * 4 / 3, 0.04 * 4 / 3, 0.5]) and "f4" not in got


def test_quality_and_projection(spark):
    df = spark.createDataFrame([(1, 1.0, None), (2, 1.0, 3.0)], "id int, a double, b double")
    got = {r["column"]: r for r in ST.column_quality(df, ["a", "b"]).collect()}
    assert got["a"]["constant"] and got["b"]["n_null"] == 1
    w = ST.projection_weights(2, 3)
    r = ST.project(df, ["id"], ["a", "b"], 3).where("id = 1").collect()[0]
    assert np.allclose([r[f"proj_{j}"] for j in range(3)], w[0])
    c = spark.createDataFrame([(1.0, 2.0, 0.0), (2.0, 4.0, 0.0), (3.0, 6.0, 0.0)], "a double, b double, z double")
    got = {(r["column_a"], r["column_b"]): r["correlation"] for r in ST.correlations(c, ["a", "b", "z"]).collect()}
    assert np.isclose(got[("a", "b")], 1.0) and got[("a", "z")] is None


def test_centroids_leave_their_fold_out(spark):
    rng = np.random.default_rng(0)
    rows = [(i, "ab"[i % 2], i % 3, float(rng.normal() + 6 * (i % 2)), float(rng.normal())) for i in range(90)] + [(200, None, 0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "id long, label string, fold int, x double, y double")
    p = B.centroid_predictions(df, "id", "label", "fold", ["x", "y"])
    got = {r["id"]: r["predicted"] for r in p.collect()}
    for i, label, fold, x, y in rows[:90]:
        cents = {name: np.mean([r[3:5] for r in rows if r[1] == name and r[2] != fold], axis=0) for name in "ab"}
        assert got[i] == min("ab", key=lambda n: (((np.array([x, y]) - cents[n]) ** 2).sum(), n))
    m = B.fold_metrics(p, "label", "fold").collect()
    assert len(m) == 3 and all(r["balanced_accuracy"] > 0.9 and r["n"] == 30 for r in m)
    s = B.metric_summary(B.fold_metrics(p, "label", "fold"), ["accuracy"]).collect()[0]
    assert s["n_folds"] == 3 and s["sd"] >= 0
    assert B.centroid_predictions(df.limit(0), "id", "label", "fold", ["x", "y"]).count() == 0


def test_clusters_and_leakage(spark):
    meta = spark.createDataFrame([("a",), ("b",), ("c",), ("a",), (None,)], "sequence_id string")
    clusters = spark.createDataFrame([("a", "h1"), ("a", "h1"), ("b", "h2"), ("b", "h1"), ("z", "h9"), ("c", None)], "sequence_id string, homology_cluster string")
    got = {r["sequence_id"]: (r["homology_cluster"], r["assigned"], r["conflicts"]) for r in X.assigned_clusters(meta, clusters).collect()}
    assert got == {"a": ("h1", True, False), "b": ("h1", True, True), "c": ("singleton__c", False, False)}
    splits = spark.createDataFrame([("d", "g", "a", "Train "), ("d", "g", "b", "val"), ("d", "k", "c", "test"), ("d", "g", "e", None)], "dataset_id string, split_group string, sequence_id string, split string")
    assert [tuple(r) for r in X.group_leakage(splits).collect()] == [("d", "g", 2, 2)]
