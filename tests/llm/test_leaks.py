import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from octolake.llm import leaks
from octolake.llm.words import words


def test_words():
    assert words(r"A \emph{quick} \textbf{br}own~fox") == ["a", "quick", "brown", "fox"]
    assert words("see \\cite[p. 3]{key1} and \\ref{eq:x} in \\input{sec/one} %% Comment_word 12") == ["see", "and", "in", "comment", "word", "12"]
    assert words(r"\newcommand{\rev}{some text}") == ["some", "text"]
    assert words(r"gal\-axy caf\'e Café {\it it} x{}y a}{b") == ["galaxy", "cafe", "cafe", "it", "xy", "a", "b"]
    assert words("") == [] and words("\\") == [] and words("%{}~") == []


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 10_000), st.integers(0, leaks.RADIUS))
def test_no_near_fingerprint_is_missed(seed, flips):
    rng = np.random.default_rng(seed)
    items = rng.integers(0, 2**63, 300, dtype=np.uint64)
    index = leaks.HammingIndex(items)
    probe = items[:50].copy()
    for b in rng.choice(64, flips, replace=False):
        probe ^= np.uint64(1) << np.uint64(b)
    at, j = index.near(probe)
    assert {(i, i) for i in range(50)} <= set(zip(at.tolist(), j.tolist()))
    assert np.all(np.bitwise_count(probe[at] ^ items[j]) <= leaks.RADIUS)


def test_near_passages_are_found():
    """Whole passages with one or two changed, dropped, added or swapped words: at least nine of ten are found."""
    rng = np.random.default_rng(4)
    vocabulary = ["".join(rng.choice(list("abcdefghij"), n)) for n in rng.integers(2, 11, 3000)]
    passages = [list(rng.choice(vocabulary, n)) for n in rng.integers(35, 60, 400)]
    index = leaks.PassageIndex([(i, " ".join(p)) for i, p in enumerate(passages)])
    code = leaks._Words()

    def changed(p, kind):
        p = list(p)
        for _ in range(2 if kind == "two" else 1):
            at = int(rng.integers(0, len(p) - 1))
            if kind == "dropped":
                del p[at]
            elif kind == "added":
                p.insert(at, "zzz")
            elif kind == "swapped":
                p[at], p[at + 1] = p[at + 1], p[at]
            else:
                p[at] = "changedword"
        return p

    for kind in ("one", "two", "dropped", "added", "swapped"):
        texts = [list(rng.choice(vocabulary, 50)) + changed(p, kind) + list(rng.choice(vocabulary, 50)) for p in passages]
        coded = [code.coded(" ".join(t)) for t in texts]
        out = index.search(np.concatenate(coded), np.repeat(np.arange(len(coded)), [len(c) for c in coded]))
        hits = out[out["similarity"] >= leaks.SIMILARITY]
        found = {(d, i) for d, i in zip(hits["doc"], hits["item"]) if d == i}
        assert len(found) >= 0.9 * len(passages), (kind, len(found))
        assert len(hits) == len(found)


PASSAGE = " ".join(f"word{i}" for i in range(30))


def tables(spark):
    w = PASSAGE.split()
    filler = " ".join(f"other{i}" for i in range(40))
    docs = [
        (1, f"{filler} {PASSAGE.upper()} {filler}"), (2, f"{filler} {' '.join(w[5:17])} {filler}"), (3, f"{filler} {' '.join(w[5:16])} {filler}"),
        (4, " ".join(x + " then" * (i % 4 == 0) for i, x in enumerate(w))), (5, "% " + "\n% ".join(r"\emph{" + x + "}" for x in w)), (6, None), (7, ""), (8, filler),
        (9, " ".join(w[:8])), (10, " ".join(w[20:])), (11, (filler + " ") * 3000 + PASSAGE), (1, f"{filler} {PASSAGE.upper()} {filler}"), (None, PASSAGE),
    ]
    items = [(100, "s", PASSAGE), (101, "s", PASSAGE), (102, "s", "a short one"), (103, "t", None), (104, "t", ""), (100, "s", PASSAGE), (None, "t", PASSAGE)]
    return spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash")), spark.createDataFrame(items, "item_id long, suite string, passage string")


def test_leaks(spark, monkeypatch):
    docs, items = tables(spark)
    expected = {(d, i) for d in (1, 2, 5, 11) for i in (100, 101)}
    for chars in (leaks.BLOCK_CHARS, 200):  # one index, and several
        monkeypatch.setattr(leaks, "BLOCK_CHARS", chars)
        got = leaks.find_leaks(docs, items).collect()
        assert {(r["doc_id"], r["item_id"]) for r in got if r["words_run"] >= 12} == expected
        runs = {r["doc_id"]: r["words_run"] for r in got if r["item_id"] == 100}
        assert runs[1] == 30 and runs[2] == 12 and runs[5] == 30
    monkeypatch.setattr(leaks, "CHUNK_WORDS", 100)
    assert {(r["doc_id"], r["item_id"]) for r in leaks.find_leaks(docs, items).where("words_run >= 12").collect()} == expected


def test_short_items_and_report(spark):
    docs = spark.createDataFrame([(1, "this is A short, one indeed")], "doc_id long, text string")
    _, items = tables(spark)
    got = leaks.find_leaks(docs, items).collect()
    assert [(r["item_id"], r["words_run"], r["similarity"]) for r in got] == [(102, 3, 1.0)]
    report = {r["item_id"]: r["leaking_documents"] for r in leaks.item_report(*tables(spark)).collect()}
    assert report == {100: 4, 101: 4, 102: 0, 103: 0, 104: 0}


def test_empty(spark):
    docs, items = tables(spark)
    assert leaks.find_leaks(docs.limit(0), items).count() == 0
    assert leaks.find_leaks(docs, items.limit(0)).count() == 0


def test_query_against_brute_force(spark):
    from octolake.llm import queries
    from tests.conftest import DATA

    index: dict = {}
    for item, passage in spark.read.parquet(f"{DATA}/eval_passages.parquet").select("item_id", "passage").collect():
        w = words(passage)
        for k in range(len(w) - 11):
            index.setdefault(tuple(w[k : k + 12]), set()).add(item)
    expected = set()
    for doc, text in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").where("text is not null").collect():
        w = words(text)
        for k in range(len(w) - 11):
            expected |= {(doc, i) for i in index.get(tuple(w[k : k + 12]), ())}
    assert {tuple(r) for r in queries.p7_found(spark, DATA).collect()} == expected
