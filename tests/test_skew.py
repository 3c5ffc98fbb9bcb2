import numpy as np
from pyspark.sql import functions as F

from octolake.operators import skew


def table(spark, rows):
    return spark.createDataFrame(rows, "id long, k string, v double, other string")


def test_profile_against_numpy(spark):
    rng = np.random.default_rng(0)
    rows = [(i, "hot" if i % 3 == 0 else f"k{i % 40}" if i % 41 else None, None if i % 17 == 0 else float(rng.normal()), "x") for i in range(4000)]
    df = table(spark, rows + rows[:500])
    got = {r["k"]: r for r in skew.key_profile(df, "id", "k", ["v"]).collect()}
    for key in {r[1] for r in rows}:
        values = [r[2] for r in rows if r[1] == key]
        some = np.array([v for v in values if v is not None])
        assert got[key]["n_rows"] == len(values)
        assert np.isclose(got[key]["mean_v"], some.mean()) and np.isclose(got[key]["std_v"], some.std())
    hot = skew.hot_keys(df, "id", "k", 0.03).collect()
    assert {r["k"]: r["n_rows"] for r in hot} == {k: n for k in {r[1] for r in rows} - {None} if (n := sum(r[1] == k for r in rows)) >= 0.03 * 4000}


def test_blocks_and_empty_values(spark):
    df = table(spark, [(1, "a", None, None), (2, "a", float("nan"), None), (3, None, 1.0, None)])
    got = {r["k"]: r for r in skew.dense_key_sums(df, "k", ["v"], blocks=3).collect()}
    assert got["a"]["n"] == 2 and got["a"]["v_n"] == 0 and got[None]["v_sum"] == 1.0
    assert {r["k"]: r["mean_v"] for r in skew.key_profile(df, "id", "k", ["v"]).collect()}["a"] is None
    assert skew.dense_key_sums(df.limit(0), "k", ["v"]).count() == 0
    assert skew.hot_keys(df.limit(0), "id", "k", 0.03).count() == 0


def test_rows_without_id_are_kept(spark):
    df = table(spark, [(None, "a", 1.0, None), (None, "a", 1.0, None), (5, "a", 1.0, None), (5, "a", 1.0, None)])
    assert skew.key_profile(df, "id", "k", []).collect()[0]["n_rows"] == 3


def test_skew_join(spark):
    left = spark.range(3000).select(F.when(F.col("id") % 2 == 0, "hot").when(F.col("id") % 7 == 0, None).otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"), "id")
    right = left.where("k is not null and k <> 'k3'").select("k").distinct().withColumn("w", F.length("k"))
    for how in ("inner", "left"):
        plain = sorted(left.join(right, ["k"], how).collect(), key=repr)
        assert sorted(skew.skew_join(left, right, ["k"], how, least=100).select("k", "id", "w").collect(), key=repr) == sorted(plain, key=repr)


def test_deviations_of_values_far_from_zero(spark):
    rng = np.random.default_rng(1)
    rows = [(i, f"k{i % 3}", 1e9 + float(rng.normal()), "x") for i in range(3000)]
    got = {r["k"]: r for r in skew.key_profile(table(spark, rows).repartition(7), "id", "k", ["v"]).collect()}
    for k in got:
        some = np.array([r[2] for r in rows if r[1] == k])
        assert np.isclose(got[k]["std_v"], some.std(), rtol=1e-5) and np.isclose(got[k]["mean_v"], some.mean(), rtol=1e-12)


def test_heavy_keys(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 400, "a").when(F.col("id") < 500, None).otherwise(F.col("id").cast("string")).alias("k"))
    assert [r["k"] for r in skew.heavy_keys(df, ["k"], 50)] == ["a"] and skew.heavy_keys(df, ["k"], 500) == [] and skew.heavy_keys(df.limit(0), ["k"], 1) == []
