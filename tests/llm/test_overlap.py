import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from octolake.llm import overlap


def identity(a, b):
    return sum(x == y for x, y in zip(a, b)) / max(len(a), len(b))


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 300), st.sampled_from([0.9, 0.92, 0.95, 0.98, 0.8, 1.0]), st.integers(0, 10_000))
def test_linked_texts_share_a_span(length, threshold, seed):
    rng = np.random.default_rng(seed)
    a = rng.choice(list("ACGT"), length)
    unequal = int(np.floor((1 - threshold) * length + 1e-9))
    cut = int(rng.integers(0, unequal + 1))
    b = a[: length - cut].copy()
    for i in rng.integers(0, max(1, len(b)), unequal - cut):
        if len(b):
            b[i] = "N"
    a, b = "".join(a), "".join(b)
    if b and identity(a, b) >= threshold:
        n, short = max(len(a), len(b)), min(len(a), len(b))
        span, extra = overlap.least_span(n, threshold)
        mine, theirs = dict(overlap.grids_of(len(a), threshold)), dict(overlap.grids_of(len(b), threshold))
        assert max(mine[span], theirs[span]) <= extra
        assert sum(a[p : p + span] == b[p : p + span] for p in range(0, short - span + 1, span)) > extra


def tables(spark, seqs, sides, threshold=0.9):
    return (
        spark.createDataFrame(seqs, "sequence_id string, sequence string"),
        spark.createDataFrame(sides, "sequence_id string, dataset_id string, split string"),
        spark.createDataFrame([("d", threshold), ("e", 0.95), ("n", None)], "dataset_id string, sequence_similarity_threshold double"),
    )


def brute(seqs, sides, threshold):
    key = {"train": "t", "validation": "h", "val": "h", "test": "h"}
    out = set()
    for ds, least in (("d", threshold), ("e", 0.95)):
        mine = {(s, key["".join(x.lower().split())]) for s, d, x in sides if d == ds and x and "".join(x.lower().split()) in key}
        texts = {}
        for s, t in seqs:
            if s and t and "".join(t.split()):
                texts.setdefault(s, set()).add("".join(t.split()).upper())
        for a, _ in [m for m in mine if m[1] == "t"]:
            for b, _ in [m for m in mine if m[1] == "h"]:
                if a != b and any(identity(x, y) >= least for x in texts.get(a, ()) for y in texts.get(b, ())):
                    out.add(tuple(sorted((a, b))))
    return out


@pytest.mark.parametrize("chunk", [2, 1000])
def test_against_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(overlap, "CHUNK", chunk)
    rng = np.random.default_rng(5)
    base = ["".join(rng.choice(list("ACGT"), n)) for n in (60, 60, 200, 31, 7)]
    seqs, sides = [], []
    for i in range(70):
        t = list(base[i % 5])
        for p in rng.integers(0, len(t), int(rng.integers(0, len(t) // 8 + 1))):
            t[p] = rng.choice(list("ACGT"))
        t = "".join(t)[: len(t) - int(rng.integers(0, 3))]
        seqs.append((f"r{i:02d}", " ".join((t[:5], t[5:].lower()))))
        sides.append((f"r{i:02d}", "de"[i % 2], ("train", " TRAIN", "val", "Test ", None, "other")[int(rng.integers(0, 6))]))
    seqs += [seqs[0], (None, "ACGT"), ("x", None), ("y", "  "), ("r03", base[0])]
    sides += [sides[0], ("r01", "d", "train"), ("x", "d", "train"), ("y", "d", "test"), ("r02", "n", "train"), ("r03", None, "test")]
    got = sorted(map(tuple, overlap.overlap_pairs(*tables(spark, seqs, sides)).collect()))
    assert got == sorted(brute(seqs, sides, 0.9)) and got


def test_copies_are_one_class(spark):
    seqs = [(f"a{i}", "ACGTACGTACGT" * 5) for i in range(40)]
    sides = [(f"a{i}", "d", "train" if i % 2 else "test") for i in range(40)]
    links, members, _ = overlap.split_overlaps(*tables(spark, seqs, sides))
    assert links.count() == 1 and members.count() == 40
    assert overlap.overlap_pairs(*tables(spark, seqs, sides)).count() == 400


def test_report_and_empty(spark):
    seqs, sides = [("a", "ACGT" * 20), ("b", "ACGT" * 20), ("c", "TTTT" * 20)], [("a", "d", "train"), ("b", "d", "val"), ("c", "d", "test"), ("a", "d", "test")]
    who = spark.createDataFrame([("b", "s1"), ("c", None), ("b", "s1")], "sequence_id string, species_or_subject string")
    got = {(r["split"], r["subject"]): (r["records"], r["overlapping"]) for r in overlap.overlap_report(*tables(spark, seqs, sides), who).collect()}
    assert got == {("validation", "s1"): (1, 1), ("test", None): (2, 0)}
    s, p, c = tables(spark, seqs, sides)
    assert overlap.overlap_pairs(s.limit(0), p, c).count() == 0 and overlap.overlap_pairs(s, p.limit(0), c).count() == 0


def test_query_against_sql(same_as_sql):
    from octolake.llm import queries

    same_as_sql(queries.p5_found, queries.SQL["p5_found"])


def test_shared_anywhere(spark):
    """A shifted copy, a verbatim part and a copy with one symbol changed are all reported, only the last by identity."""
    rng = np.random.default_rng(1)
    text = "".join(rng.choice(list("ACGT"), 400))
    other = "".join(rng.choice(list("ACGT"), 400))
    seqs = [("t", text), ("shift", text[1:] + "A"), ("part", other[:100] + text[100:300] + other[100:200]), ("near", text[:50] + "N" + text[51:]), ("none", other[200:])]
    sides = [("t", "d", "train"), *[(s, "d", "test") for s in ("shift", "part", "near", "none")]]
    who = spark.createDataFrame([(s, s) for s, _ in seqs], "sequence_id string, species_or_subject string")
    got = {r["subject"]: r for r in overlap.overlap_report(*tables(spark, seqs, sides), who).collect()}
    assert {s: (r["overlapping"], r["sharing"]) for s, r in got.items()} == {"shift": (0, 1), "part": (0, 1), "near": (1, 1), "none": (0, 0)}
    assert got["shift"]["highest_covered"] > 0.95 and 0.45 < got["part"]["highest_covered"] <= 0.5


def test_picked_suffixes_meet():
    """Any shared span of LEAST + NEAR - 1 symbols has a picked suffix in both texts that goes on for LEAST symbols."""
    rng = np.random.default_rng(8)
    size = overlap.LEAST + overlap.NEAR - 1
    for _ in range(200):
        span = rng.integers(65, 69, size).astype(np.uint8)
        texts = [np.concatenate([rng.integers(65, 69, n), span, rng.integers(65, 69, 30)]).astype(np.uint8) for n in rng.integers(0, 40, 2)]
        edges = np.array([0, len(texts[0]), len(texts[0]) + len(texts[1])])
        starts = overlap.sampled(np.concatenate(texts), edges)
        places = [{int(s) - int(edges[i]) - (len(t) - size - 30) for s in starts if edges[i] <= s < edges[i + 1]} for i, t in enumerate(texts)]
        assert any(0 <= p <= overlap.NEAR - 1 for p in places[0] & places[1])


@pytest.mark.parametrize("hot", [3, 10**9])
def test_hot_blocks_lose_nothing(spark, monkeypatch, hot):
    """All texts begin alike; the block they share is left out or met in chunks, and no pair is lost."""
    monkeypatch.setattr(overlap, "HOT", hot)
    monkeypatch.setattr(overlap, "CHUNK", 4)
    rng = np.random.default_rng(2)
    start = "".join(rng.choice(list("ACGT"), 45))
    seqs, sides = [], []
    for i in range(120):
        t = start + "".join(rng.choice(list("ACGT"), 60)) if i % 3 else start + "ACGGT" * 12
        t = list(t)
        for p in rng.integers(45, 105, 4):
            t[p] = rng.choice(list("ACGT"))
        seqs.append((f"r{i}", "".join(t)))
        sides.append((f"r{i}", "d", "train" if i % 2 else "test"))
    got = sorted(map(tuple, overlap.overlap_pairs(*tables(spark, seqs, sides)).collect()))
    assert got == sorted(brute(seqs, sides, 0.9)) and len(got) > 100
    _, _, classes = overlap.split_overlaps(*tables(spark, seqs, sides))
    covered = {r["class_id"]: r["covered"] for r in overlap.shared_anywhere(classes).collect()}
    assert len(covered) == classes.where("held").count() and min(covered.values()) >= overlap.LEAST
