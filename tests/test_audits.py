import numpy as np
import pytest
from pyspark.sql import functions as F

from octolake.functions import octonion as O
from octolake.functions import sequence as S
from octolake.operators import benchmark as B
from octolake.operators import context as X
from octolake.operators import controls as N
from octolake.operators import models as M
from octolake.operators import sequences as Q
from octolake.operators import statistics as ST


def test_octonion_arithmetic(spark):
    x, y = np.random.default_rng(0).normal(size=(2, 8))
    assert np.allclose(O.add(x, y), x + y) and np.allclose(O.subtract(x, y), x - y) and np.allclose(O.scaled(x, 3.0), 3 * x) and np.allclose(O.divided(x, 2.0), x / 2)
    with pytest.raises(ZeroDivisionError):
        O.divided(x, 0)
    c = np.array([0.0, *O.cross(x, y)])
    assert abs(c[1:] @ x[1:]) < 1e-9 and abs(c[1:] @ y[1:]) < 1e-9  # at right angles to both
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 0.0)], "a double, b double")
    assert df.where("b > 0").select(O.divided([F.col("a")], F.col("b"))[0]).first()[0] == 0.5
    with pytest.raises(Exception, match="octonion by 0"):
        df.select(O.divided([F.col("a")], F.col("b"))[0]).collect()


def test_codes_and_places(spark):
    with pytest.raises(ValueError):
        S.genetic_code("klingon")
    assert S.genetic_code(2) == S.genetic_code("vertebrate_mitochondrial") and len(S.genetic_code(4)[0]) == 64
    df = spark.createDataFrame([("TGA", "A", "G"), ("AGA", "A", "C"), ("NNN", "N", "A"), ("ATT", "A", "A")], "c string, a string, b string")
    rows = df.select("c", S.amino_acid(F.col("c"), 2).alias("m"), S.is_start(F.col("c"), 2).alias("s"), S.substitution_type(F.col("a"), F.col("b")).alias("k"), *[v.alias(n) for n, v in zip(("row", "col"), S.codon_cell(F.col("c")))]).collect()
    assert [(r["m"], r["s"], r["k"]) for r in rows] == [("W", False, "transition"), ("*", False, "transversion"), ("X", False, None), ("I", True, None)]
    assert [(r["row"], r["col"]) for r in rows] == [(7, 0), (1, 0), (None, None), (1, 7)]
    at = spark.createDataFrame([(0, 5), (4, 5), (-1, 5), (0, 1)], "p int, n int").select(S.position_fraction(F.col("p"), F.col("n")).alias("f")).collect()
    assert [at[0]["f"], at[1]["f"]] == [0.0, 1.0] and np.isnan(at[2]["f"]) and np.isnan(at[3]["f"])


def test_partial_codons_and_copies(spark):
    df = spark.createDataFrame([("a", "ATGAC"), ("b", "A"), ("c", "ATG")], "sequence_id string, sequence string")
    got = sorted((r["sequence_id"], r["codon"], r["is_start"]) for r in Q.codons(df, partial=True).collect())
    assert got == [("a", "ACN", False), ("a", "ATG", True), ("b", "ANN", False), ("c", "ATG", True)]
    copies = df.union(df).union(spark.createDataFrame([("0", "ATG"), ("z", None)], df.schema))
    assert sorted(r["sequence_id"] for r in Q.deduplicated(copies, "sequence", ["sequence_id"]).collect()) == ["0", "a", "b"]
    e = {r["sequence_id"]: r["entropy"] for r in Q.kmer_entropies(df, 2).collect()}
    assert e["b"] == 0 and np.isclose(e["a"], 2 / 4)
    with pytest.raises(ValueError):
        Q.kmer_entropies(df, 0)


def test_unsound_data_sets_are_refused(spark):
    schema = "sequence_id string, label string, g string, p string"
    records = spark.createDataFrame([("a", "AC"), ("b", "GT")], "sequence_id string, sequence string")
    good = [("a", "x", None, "p1"), ("b", "y", "g1", None)]
    rows = X.labelled_dataset(spark.createDataFrame(good, schema), records, "label", "g", "p").collect()
    assert sorted((r["sequence_id"], r["label"], r["group"]) for r in rows) == [("a", "x", "p1"), ("b", "y", "g1")]
    for bad, match in (([], "empty"), (good + good[:1], "twice"), (good + [("c", "x", "g", "p")], "without a sequence"), ([("a", None, "g", "p")], "labels"), ([("a", "x", None, None)], "groups"), ([(None, "x", "g", "p")], "without an id")):
        with pytest.raises(ValueError, match=match):
            X.labelled_dataset(spark.createDataFrame(bad, schema), records, "label", "g", "p")
    with pytest.raises(ValueError, match="records"):
        X.labelled_dataset(spark.createDataFrame(good, schema), records.union(records), "label", "g", "p")


def test_contexts_and_tracks(spark):
    schema = "sequence_id string, genome_build string, chromosome string, start_pos int, end_pos int, strand string, feature_type string"
    good = ("a", "b", "1", 0, 5, "+", "gene")
    assert X.validated_context(spark.createDataFrame([good], schema)).count() == 1
    for bad in ([good, good], [("a", None, "1", 0, 5, "+", "gene")], [("a", "b", "1", 5, 5, "+", "gene")], [("a", "b", "1", -1, 5, "+", "gene")], [("a", "b", "1", 0, 5, "?", "gene")]):
        with pytest.raises(ValueError):
            X.validated_context(spark.createDataFrame(bad, schema))
    tracks = spark.createDataFrame([(1, "x", 1.0), (1, "y", 2.0)], "k int, track string, v double")
    assert X.validated_tracks(tracks, ["k"], "track", "v").count() == 2
    for extra in ((1, "x", 3.0), (2, "x", None), (2, "x", float("inf")), (2, "x", float("nan"))):
        with pytest.raises(ValueError):
            X.validated_tracks(tracks.union(spark.createDataFrame([extra], tracks.schema)), ["k"], "track", "v")
    wide = spark.createDataFrame([(1, 2, None, "t")], "k int, a int, b double, s string")
    assert list(X.packed_tracks(wide, ["k"], ["a", "b"]).first())[1:] == [2.0] + [0.0] * 7
    for columns in (["a"] * 9, ["s"]):
        with pytest.raises(ValueError):
            X.packed_tracks(wide, ["k"], columns)


def test_spectra_against_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 4))
    x[:, 3] = x[:, 0] + x[:, 1]
    df = spark.createDataFrame([("k", *map(float, r), float(r[0] * 2 + r[2])) for r in x] + [("k", None, 1.0, 1.0, 1.0, 1.0)], "k string, a double, b double, c double, d double, t double")
    rows = sorted(ST.singular_values(df, ["k"], list("abcd")).collect(), key=lambda r: r["index"])
    want = np.linalg.svd(x, compute_uv=False)
    assert np.allclose([r["singular_value"] for r in rows], want, atol=1e-6) and rows[0]["rank"] == 3 and np.isclose(rows[0]["condition"], want[0] / want[2])
    r = ST.redundancy(df, ["k"], list("abcd"), "t").first()
    corr = np.corrcoef(x.T)
    assert r["n"] == 60 and r["rank"] == 3 and np.isclose(r["mean_abs_correlation"], np.abs(corr[np.triu_indices(4, 1)]).mean()) and np.isclose(r["linear_r2"], 1.0)
    pairs = {(r["column_a"], r["column_b"]): (r["duplicate"], r["collinear"]) for r in ST.equal_columns(df.withColumn("e", F.col("a")).withColumn("m", -F.col("a")), ["a", "e", "m", "b"]).collect()}
    assert pairs[("a", "e")] == (True, True) and pairs[("a", "m")] == (False, True) and pairs[("a", "b")] == (False, False)


def test_digests_and_numbers(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (2, "b")], "n int, s string")
    one = ST.table_digest(df, ["n", "s"]).first()
    assert one == ST.table_digest(df.orderBy(F.desc("n")).repartition(3), ["n", "s"]).first() and one["rows"] == 3
    assert one["digest"] != ST.table_digest(df.where("n = 2"), ["n", "s"]).first()["digest"]
    r = {x["n"]: (x["mean_v"], x["max_v"]) for x in ST.numeric_by_key(df.withColumn("v", F.col("n") * 2.0), "n").collect()}
    assert r == {1: (2.0, 2.0), 2: (4.0, 4.0)}
    s = {x["kind"]: (x["n"], x["median"]) for x in ST.value_summary(df.withColumn("v", F.col("n") * 1.0), [], ["n", "v"], "kind").collect()}
    assert s == {"n": (3, 2.0), "v": (3, 2.0)}


def test_folds_keep_groups_and_labels(spark):
    rows = [(f"r{i}", f"g{i // 3}", "xy"[(i // 3) % 2], "d") for i in range(300)]
    df = spark.createDataFrame(rows, "id string, g string, label string, d string")
    got = B.stratified_group_folds(df, ["d"], "id", "g", "label", 5).collect()
    by_group, counts = {}, {}
    for r in got:
        by_group.setdefault(r["g"], set()).add(r["fold"])
        counts[r["fold"], r["label"]] = counts.get((r["fold"], r["label"]), 0) + 1
    assert len(got) == 300 and all(len(f) == 1 for f in by_group.values()) and set(counts.values()) == {30}
    with pytest.raises(ValueError, match="fewer groups"):
        B.stratified_group_folds(df, ["d"], "id", "g", "label", 60)
    nulls = B.permuted_labels(df, ["d"], "id", "label", 3).collect()
    assert sum(r["label"] == "x" for r in nulls) == 150 and any(r["label"] != want[2] for r, want in zip(sorted(nulls), sorted(rows)))
    few = B.balanced_sample(df, ["d"], "label", "id", 7)
    assert {r["label"]: r["count"] for r in few.groupBy("label").count().collect()} == {"x": 7, "y": 7}


def test_metrics_against_formulas(spark):
    rng = np.random.default_rng(3)
    truth, said = rng.integers(0, 3, 200), rng.integers(0, 3, 200)
    said = np.where(rng.random(200) < 0.5, truth, said)
    df = spark.createDataFrame([(0, str(t), str(p)) for t, p in zip(truth, said)], "fold int, label string, predicted string")
    m = B.fold_metrics(df, "label", "fold").first()
    one, two = np.eye(3)[truth], np.eye(3)[said]
    cov = lambda a, b: ((a - a.mean(0)) * (b - b.mean(0))).sum()
    assert np.isclose(m["mcc"], cov(one, two) / np.sqrt(cov(one, one) * cov(two, two)))
    y = rng.normal(size=50)
    p = y + rng.normal(size=50) / 3
    r = B.regression_metrics(spark.createDataFrame([(float(a), float(b)) for a, b in zip(y, p)] + [(None, 1.0)], "y double, p double"), [], "y", "p").first()
    assert r["n"] == 50 and np.isclose(r["r2"], 1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum()) and np.isclose(r["rmse"], np.sqrt(((y - p) ** 2).mean())) and np.isclose(r["mae"], np.abs(y - p).mean())
    s, good = np.round(rng.normal(size=100), 1), rng.random(100) < 0.4
    s = np.where(good, s + 0.7, s).round(1)
    r = B.ranking_scores(spark.createDataFrame([("k", float(a), bool(b)) for a, b in zip(s, good)], "k string, s double, y boolean"), ["k"], "s", "y").first()
    auc = np.mean([(a > b) + (a == b) / 2 for a in s[good] for b in s[~good]])
    ap = sum((good[s == t].sum() / good.sum()) * good[s >= t].mean() for t in np.unique(s))
    assert np.isclose(r["roc_auc"], auc) and np.isclose(r["pr_auc"], ap)


def test_paired_comparison(spark):
    rows = [("d", i, 0.8 + i / 100, 0.5 + (i % 3) / 100) for i in range(10)]
    df = spark.createDataFrame(rows, "d string, fold int, a double, b double")
    r = B.paired_comparison(df.select("d", "fold", F.col("a").alias("m")), df.select("d", "fold", F.col("b").alias("m")), ["d"], "fold", "m", 400).first()
    diff = np.array([x[2] - x[3] for x in rows])
    assert r["n"] == 10 and np.isclose(r["mean_difference"], diff.mean()) and np.isclose(r["dz"], diff.mean() / diff.std(ddof=1)) and r["p_sign"] < 0.02 and r["low"] < diff.mean() < r["high"]
    same = B.paired_comparison(df.select("d", "fold", F.col("a").alias("m")), df.select("d", "fold", F.col("a").alias("m")), ["d"], "fold", "m", 50).first()
    assert same["p_sign"] == 1.0 and same["dz"] is None


def numbers(spark):
    rng = np.random.default_rng(1)
    return spark.createDataFrame([("ab"[i % 2], i, i % 3, float(i), float(rng.normal()), 2.0 * i + (i % 2)) for i in range(60)], "d string, id int, fold int, x double, z double, y double")


@pytest.mark.parametrize("model", ["ridge", "gbt"])
def test_regressors(spark, model):
    rows = M.cross_validated_values(numbers(spark), "id", "y", "fold", ["x", "z"], model, by=["d"])
    r2 = {r["d"]: r["r2"] for r in B.regression_metrics(rows, ["d"], "y", "predicted").collect()}
    assert set(r2) == {"a", "b"} and min(r2.values()) > 0.9
    line = B.regression_metrics(M.line_predictions(numbers(spark), "id", "y", "fold", "x", ["d"]), ["d"], "y", "predicted").collect()
    assert all(r["r2"] > 0.999 and r["n"] == 30 for r in line)


def test_nested_choice_by_value(spark):
    df = numbers(spark).withColumn("label", F.when(F.col("x") > 30, "hi").otherwise("lo"))
    rows = M.cross_validated(df, "id", "label", "fold", ["x", "z"], "logistic", by=["d"], nested=True).collect()
    assert len(rows) == 60 and sum(r["label"] == r["predicted"] for r in rows) >= 52


def test_turned_axes_and_synonyms(spark):
    (_, m), = N.orthogonal_matrices(1)
    assert np.allclose(np.array(m) @ np.array(m).T, np.eye(7))
    df = spark.createDataFrame([("a", "ATGTTATTGCTTAAATGA" * 5 + "AC")], "k string, s string")
    text = N.shuffled(df, "k", "s", "synonymous").first()["s"]
    from octolake.operators.codon import amino

    triplets = lambda t: [t[i : i + 3] for i in range(0, len(t) - 2, 3)]
    before = df.first()["s"]
    assert text != before and text[-2:] == "AC" and list(map(amino, triplets(text))) == list(map(amino, triplets(before))) and sorted(triplets(text)) == sorted(triplets(before))
