import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from octolake.functions import sequence as S
from octolake.operators import codon as D
from octolake.operators import sequences as Q


def frame(spark, *texts):
    return spark.createDataFrame([(f"s{i}", t) for i, t in enumerate(texts)], "sequence_id string, sequence string")


def test_records(spark):
    df = frame(spark, "ac gt\n", "ACGT", None, "", "  ", "MKV").union(frame(spark, "ACGT"))
    assert sorted((r[0], r[1]) for r in Q.records(df, "dna").collect()) == [("s0", "ACGT"), ("s1", "ACGT")]
    assert [r[1] for r in Q.records(df, "protein").collect()] == ["MKV"]


@pytest.mark.parametrize("width,step,piece", [(5, 1, 7), (6, 3, 9), (4, 4, 100), (3, 3, 3)])
def test_units_over_pieces(spark, width, step, piece, monkeypatch):
    text = "".join(np.random.default_rng(2).choice(list("ACGT"), 61))
    monkeypatch.setattr(Q.pieces, "__defaults__", (1, piece))
    got = sorted((r["start"], r["unit"]) for r in Q.units(frame(spark, text, "AC", ""), width, step).collect())
    assert got == [(i, text[i : i + width]) for i in range(0, len(text) - width + 1, step)]


def test_descriptors(spark):
    got = {r["position"]: r for r in Q.window_descriptors(frame(spark, "ACGTACGTAC" + "N" * 10 + "GGGGGGGGGG"), 10, 10).collect()}
    assert sorted(got) == [0, 2]  # the window of unknown bases is skipped, its position is not
    assert got[0]["gc_content"] == 0.5 and got[0]["purine_balance"] == 0.0
    assert got[2]["base_entropy"] == 0.0 and got[2]["gc_skew"] == 1.0
    row = Q.sequence_features(frame(spark, "AACGTT")).collect()[0]
    assert row["mirror_similarity"] == 1.0 and row["length"] == 6


def test_kmers_and_chaos_game(spark):
    got = {r["kmer"]: r["n"] for r in Q.kmer_counts(frame(spark, "AACNAAC"), 2).collect()}
    assert got == {"AA": 2, "AC": 2}
    cells = {(r["x"], r["y"]): r["frequency"] for r in Q.fcgr(frame(spark, "ACGT"), 1).collect()}
    assert cells == {(0, 0): 0.25, (0, 1): 0.25, (1, 1): 0.25, (1, 0): 0.25}
    wide = Q.kmer_matrix(frame(spark, "AAAA", "N"), 1).orderBy("sequence_id").collect()
    assert wide[0]["kmer_A"] == 1.0 and wide[1]["kmer_A"] == 0.0


def test_translation(spark):
    rows = Q.codons(frame(spark, "ATGTAANNNGC"), (0, 1)).collect()
    first = sorted((r["codon_index"], r["amino_acid"]) for r in rows if r["frame"] == 0)
    assert first == [(0, "M"), (1, "*"), (2, "X")]
    assert sum(r["frame"] == 1 for r in rows) == 3
    table = spark.createDataFrame([(c,) for c in D.CODONS], "c string").select("c", S.amino_acid(F.col("c")).alias("a"))
    assert all(D.FAMILY[r["c"]] == r["a"] for r in table.collect())
    assert sum(a == "*" for a in D.FAMILY.values()) == 3 and D.FAMILY_SIZE["L"] == 6


def test_context(spark):
    rows = sorted((r["position"], r["base"], r["previous"], r["c_A"], r["p_A"]) for r in Q.base_context(frame(spark, "ACC")).collect())
    assert rows == [(0, "A", "N", 1, 0), (1, "C", "A", 0, 1), (2, "C", "C", 0, 0)]


CODON_SCHEMA = "codon_row_id long, sequence_id string, frame int, codon_index long, codon string, amino_acid string, is_stop boolean, gc1 double, gc2 double, gc3 double, codon_associator_score double, " + ", ".join(f"e{i} double" for i in range(8))


def codon_table(spark, *codons):
    rows = [(i, "s", 0, i, c, D.FAMILY.get(c, "X"), D.FAMILY.get(c) == "*", 1.0, 0.0, 1.0, float(i), *[float(i)] * 8) for i, c in enumerate(codons)]
    return spark.createDataFrame(rows + rows[:1] + [(99, None, 0, 0, "AAA", "K", False, *[0.0] * 12)], CODON_SCHEMA)


def test_usage(spark):
    df = codon_table(spark, "TTA", "TTA", "TTG", "TAA", "NNN")
    got = {r["codon"]: r for r in D.codon_usage(df, "separate").collect()}
    assert len(got) == 64 and got["TTA"]["n"] == 2 and np.isclose(got["TTA"]["rscu"], 2 * 6 / 3) and np.isclose(got["TTA"]["frequency"], 0.4)
    assert got["TAA"]["rscu"] == 3.0 and got["AAA"]["rscu"] == 0.0
    assert len(D.codon_usage(df, "exclude").collect()) == 61
    assert {r["codon"]: r["rscu"] for r in D.codon_usage(df, "pooled").collect()}["TAA"] is None
    s = D.codon_summary(df).collect()[0]
    assert s["n_codons"] == 5 and s["n_stops"] == 1 and np.isclose(s["codon_entropy"] * 6, -(0.4 * np.log2(0.4) + 3 * 0.2 * np.log2(0.2)))
    with pytest.raises(ValueError):
        D.codon_usage(df, "other")


def test_substitutions_and_collisions(spark):
    got = D.substitutions(codon_table(spark, "ATG", "TGG")).collect()[0]
    assert (got["substitutions"], got["synonymous"], got["to_stop"]) == (18, 0, 2)
    df = codon_table(spark, "AAA", "CCC").withColumn("e0", F.lit(1.0))
    for i in range(1, 8):
        df = df.withColumn(f"e{i}", F.lit(0.0))
    assert [r["codons"] for r in D.collisions(df).collect()] == ["AAA CCC"]
    assert D.codon_usage(df.limit(0)).count() == 0 and D.codon_pairs(df.limit(0)).count() == 0


def test_long_record_takes_linear_time(spark):
    """Windows, k-mers and mirrors of one record of five million bases, and of half of it."""
    from time import perf_counter

    text = "".join(np.random.default_rng(5).choice(list("ACGT"), 5_000_000))
    seconds = []
    for length in (100_000, 2_500_000, 5_000_000):
        df = frame(spark, text[:length]).cache()
        df.count()
        start = perf_counter()
        row = Q.sequence_features(df).collect()[0]
        assert Q.window_descriptors(df, 60, 30).agg(F.count("*"), F.sum("mirror_similarity")).first()[0] == (length - 60) // 30 + 1
        assert Q.kmer_counts(df, 4).agg(F.sum("n")).first()[0] == length - 3
        seconds.append(perf_counter() - start)
        df.unpersist()
    half = text[:1000]
    assert 0.2 < row["mirror_similarity"] < 0.3 and S.mirrored_places(*S.symbols(pa.array([half, "é", None, "ACGT", "xA"]))).tolist()[1:] == [1, 0, 4, 0]
    assert seconds[2] < 60 and seconds[2] < 3 * seconds[1] + 5


def test_mirror_against_brute_force():
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("ACGTNé"), n)) for n in rng.integers(0, 40, 60)]
    turned = str.maketrans("ACGT", "TGCA")
    want = [sum(a == b for a, b in zip(t, t[::-1].translate(turned))) for t in texts]
    assert S.mirrored_places(*S.symbols(pa.array(texts))).tolist() == want
    old, S.MIRROR_SYMBOLS = S.MIRROR_SYMBOLS, 7
    try:
        assert S.mirrored_places(*S.symbols(pa.array(texts).slice(5, 30))).tolist() == want[5:35]
    finally:
        S.MIRROR_SYMBOLS = old


def test_words_longer_than_a_number(spark):
    text = "".join(np.random.default_rng(4).choice(list("ACGT"), 200))
    for k in (31, 40):
        assert {r["kmer"]: r["n"] for r in Q.kmer_counts(frame(spark, text + "N" + text[:50]), k).collect()}[text[:k]] == 2


def test_positional_identity(spark):
    rng = np.random.default_rng(6)
    pairs = [("".join(rng.choice(list("ACé"), n)), "".join(rng.choice(list("ACé"), m))) for n, m in rng.integers(0, 30, (50, 2))]
    want = [sum(a == b for a, b in zip(x, y)) / max(len(x), len(y)) if x or y else 1.0 for x, y in pairs]
    rows = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate([*pairs, (None, "A"), ("", "")])], "i int, x string, y string")
    got = [r["v"] for r in rows.select("i", S.positional_identity(F.col("x"), F.col("y")).alias("v")).orderBy("i").collect()]
    assert np.allclose(got[:50], want) and got[50] is None and got[51] == 1.0
    old, S.MIRROR_SYMBOLS = S.MIRROR_SYMBOLS, 9
    try:
        assert S.equal_places(*(pa.array([p[i] for p in pairs]) for i in (0, 1))).tolist() == [sum(a == b for a, b in zip(x, y)) for x, y in pairs]
    finally:
        S.MIRROR_SYMBOLS = old
