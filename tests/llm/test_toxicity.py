import numpy as np
import pytest
from pyspark.sql import functions as F

from octolake.llm import toxicity as T

BAD = ["you are a stupid {w} and a fool", "shut up you {w} idiot", "those people are {w} vermin all of them"]
RUDE = ["worthless", "filthy", "brainless", "useless"]
NOUNS = [a + b for a in ("gal", "mor", "vex", "tri", "lum", "per") for b in ("ton", "eity", "form", "oid", "ance", "ive", "al")]


def text(rng, bad=None, length=80):
    w = [str(rng.choice(NOUNS)) for _ in range(length)]
    for i in range(0, length, 9):
        w[i] = "the"
    if bad:
        at = int(rng.integers(0, length))
        w[at:at] = bad.split()
    return " ".join(w)


def corpus(n, seed=0, share=0.2):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        bad = rng.choice(BAD).format(w=rng.choice(RUDE)) if rng.random() < share else None
        if bad and rng.random() < 0.3:
            bad = bad.replace("stupid", "s t u p i d").replace("vermin", "v3rm1n").replace("idiot", "idi{}ot")
        out.append((i, bad is not None, text(rng, bad)))
    return out


def test_disguises():
    plain = T.word_features("shit")
    for form in ("shiiiiit", "sh1t", "$hit"):
        raw = T.spelled(T.tokens(form))
        assert set(T.word_features(raw[0])) & set(plain), form
    assert T.spelled(T.tokens("such a f-o-o-l x")) [1:] != [] and "afoolx" in T.spelled(T.tokens("such a f-o-o-l x"))
    assert T.tokens("fo{}ol fo\\-ol \\textbf{fo}ol") == ["fool"] * 3
    assert T.tokens("fооl") == ["fool"]  # two letters of another script
    assert T.tokens("") == [] and T.spelled([]) == []


def test_windows_reach_the_end():
    for n in range(1, 40):
        starts = T._windows(n, 4)
        assert starts[0] == 0 and (n <= T.WINDOW or starts[-1] == n - T.WINDOW)


def steps(z):
    z = z[np.isfinite(z)]
    return np.bincount(np.floor((np.clip(z, -T.FARTHEST, T.FARTHEST) + T.FARTHEST) / T.STEP).astype(int), minlength=int(2 * T.FARTHEST / T.STEP) + 1)


def test_held_out_accuracy():
    rows = corpus(900)
    model = T.train([t for _, y, t in rows[:600] if y], [t for _, _, t in rows[:600]])
    z = T.doc_scores(model, [t for _, _, t in rows[600:]])
    y = np.array([b for _, b, _ in rows[600:]])
    flag, share = T.best_share(steps(z), steps(z[y]))
    said = z >= np.quantile(z, 1 - flag)
    assert (said & y).sum() / y.sum() >= 0.9 and (said & y).sum() / said.sum() >= 0.9
    assert abs(share - y.mean()) < 0.05 and 0.005 < model.prior < 0.1


def test_a_document_scores_as_its_worst_window():
    rows = corpus(700)
    model = T.train([t for _, y, t in rows if y], [t for _, _, t in rows])
    rng = np.random.default_rng(9)
    bad = "you are a stupid filthy and a fool"
    long = text(rng, None, 20_000) + " " + bad
    scores = T.doc_scores(model, [bad, long, text(rng), "", "word"])
    assert scores[0] > scores[2] + 1 and scores[1] > scores[2] + 1 and scores[3] == -np.inf


def test_share_to_flag():
    """With clear scores the share to flag and the share of toxic documents are those of the corpus, whatever they are."""
    rng = np.random.default_rng(0)
    for share in (0.005, 0.03, 0.4):
        toxic = rng.normal(4, 1, 300)
        corpus_z = np.where(rng.random(40_000) < share, rng.normal(4, 1, 40_000), rng.normal(-4, 1, 40_000))
        flag, found = T.best_share(steps(corpus_z), steps(toxic))
        assert abs(flag - share) < 0.1 * share + 0.001 and abs(found - share) < 0.1 * share + 0.001
    assert T.best_share(np.zeros(5), np.zeros(5)) == (0.0, 0.0)


@pytest.fixture(scope="module")
def tables(spark):
    rows = corpus(700, 1)
    docs = [(i, t, ["s1", "s2", None][i % 3]) for i, _, t in rows] + [(10_000, None, "s1"), (10_001, "", "s1"), (None, "x", "s1")]
    labels = []
    for i, bad, _ in rows[:500]:
        votes = ["abuse" if bad else "none"] * (1 + i % 2) + ([None] if i % 5 == 0 else [])
        labels += [(len(labels) + k, i, v, "r", None) for k, v in enumerate(votes)]
    labels += labels[:20] + [(99_999, None, "abuse", "r", None), (99_998, 123_456, "hate", "r", None)]
    return (
        spark.createDataFrame(docs, "doc_id long, text string, source string").withColumn("score", F.lit("clash")),
        spark.createDataFrame(labels, "label_id long, doc_id long, category string, annotator string, labelled_at timestamp"),
        {i: bad for i, bad, _ in rows},
    )


def test_votes(spark, tables):
    got = {r["doc_id"]: (r["toxic"], r["clear"]) for r in T.votes(tables[1]).collect()}
    assert None not in got and all((c > 0) != tables[2].get(i, True) for i, (t, c) in got.items() if t + c)


def test_scores_and_rates(spark, tables):
    docs, labels, truth = tables
    got = {r["doc_id"]: r for r in T.score_documents(docs, labels).collect()}
    assert len(got) == 702 and got[10_000]["score"] == 0 and not got[10_001]["flagged"]
    said = {i for i, r in got.items() if r["flagged"]}
    toxic = {i for i, b in truth.items() if b}
    # either half has some fifty confirmed texts here, so the share to flag is a rough one
    assert len(said & toxic) >= 0.85 * len(toxic) and len(said & toxic) >= 0.85 * len(said)
    rates = {r["source"]: r for r in T.source_rates(docs, labels).collect()}
    assert set(rates) == {"s1", "s2", None} and sum(r["documents"] for r in rates.values()) == 702
    assert sum(r["flagged"] for r in rates.values()) == len(said)


def test_without_examples_nothing_is_flagged(spark, tables):
    docs, labels, _ = tables
    assert T.score_documents(docs, labels.limit(0)).where("flagged").count() == 0
    assert T.score_documents(docs.limit(0), labels).count() == 0
