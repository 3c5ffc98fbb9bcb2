from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from octolake.llm import packing

TIERS = {"short": 16, "medium": 32, "long": 64}


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=120))
def test_plan_places_every_item_once(sizes):
    histogram = dict(Counter(sizes))
    segments, opened = packing.plan_containers(histogram, [16, 32, 64])
    size_of = {}
    for tier, first, n in opened.itertuples(index=False):
        for c in range(first, first + n):
            assert c not in size_of
            size_of[c] = tier
    used: dict = {}
    ranks: dict = {}
    for s in segments.itertuples(index=False):
        assert s.n % s.per_container == 0
        for i in range(s.n):
            c, at = s.container + i // s.per_container, s.offset + (i % s.per_container) * s.size
            used.setdefault(c, []).append((at, at + s.size))
            ranks.setdefault(s.size, []).append(s.first_rank + i)
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(n)) for k, n in histogram.items()}
    assert set(used) == set(size_of)
    for c, spans in used.items():
        spans.sort()
        assert spans[-1][1] <= size_of[c] and all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))


def check(rows, counts, capacities):
    kinds = {r["pack_kind"] for r in rows} - {None}
    assert kinds <= set(capacities)
    by_doc, by_container = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        if r["container_id"] is not None:
            by_container.setdefault(r["container_id"], []).append(r)
    assert set(by_doc) == set(counts)
    most = max(capacities.values())
    for d, n in counts.items():
        parts = sorted(by_doc[d], key=lambda r: r["piece"])
        assert sum(r["n_tokens"] for r in parts) == n
        assert len(parts) == max(1, -(-n // most))
        assert [r["first_token"] for r in parts] == [i * most for i in range(len(parts))]
    for some in by_container.values():
        assert len({(r["pack_kind"], r["step_group"]) for r in some}) == 1
        spans = sorted((r["start"], r["start"] + r["n_tokens"]) for r in some)
        assert spans[-1][1] <= capacities[some[0]["pack_kind"]] and all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
    return by_container


@pytest.mark.parametrize("rank_rows", [50_000, 20])
def test_packing(spark, monkeypatch, rank_rows):
    monkeypatch.setattr(packing, "RANK_ROWS", rank_rows)
    rng = np.random.default_rng(0)
    counts = {i: int(n) for i, n in enumerate(np.concatenate([rng.geometric(0.06, 600), np.repeat(13, 300), [0, 64, 65, 128, 640, 16, 32]]))}
    df = spark.createDataFrame(list(counts.items()), "doc_id long, n_tokens long").repartition(5)
    containers = check(packing.pack(df, TIERS, step_containers=4).collect(), counts, TIERS)
    filled = sum(r["n_tokens"] for some in containers.values() for r in some) / sum(TIERS[some[0]["pack_kind"]] for some in containers.values())
    assert filled > 0.9
    per_step = Counter((some[0]["pack_kind"], some[0]["step_group"]) for some in containers.values())
    for kind in TIERS:
        n = [v for (k, _), v in per_step.items() if k == kind]
        assert not n or max(n) - min(n) <= 1
    one = packing.pack(df, {"only": 64}).collect()
    check(one, counts, {"only": 64})


def test_tokens_and_queries(spark):
    docs = spark.createDataFrame([(1, "Hello world", "x"), (2, None, "x"), (3, "", "x"), (4, "word " * 30_000, "x"), (None, "a", "x"), (1, "Hello world", "x")], "doc_id long, text string, size string")
    counts = {r["doc_id"]: r["n_tokens"] for r in packing.token_counts(docs).collect()}
    assert counts[1] == 2 and counts[2] == counts[3] == 0 and counts[4] >= 30_000
    caps = spark.createDataFrame([("a", 1024), ("b", 8192), (None, 5), ("b", 4096)], "pack_kind string, capacity_tokens int")
    rows = packing.pack_tiers(docs, caps).collect()
    check(rows, counts, {"a": 1024, "b": 8192})
    assert {r["pack_kind"] for r in packing.pack_each(docs, caps).collect() if r["container_id"] is not None} == {"a", "b"}
    report = packing.fill_report(packing.pack_tiers(docs, caps), caps).collect()
    assert all(0 < r["fill"] <= 1 for r in report)


def test_empty_and_bad(spark):
    df = spark.createDataFrame([], "doc_id long, n_tokens long")
    assert packing.pack(df, TIERS).count() == 0
    with pytest.raises(ValueError):
        packing.pack(df, {})
    with pytest.raises(ValueError):
        packing.pack(df, {"x": 0})
    assert packing.pack(df.unionByName(spark.createDataFrame([(1, 0)], "doc_id long, n_tokens long")), TIERS).where(F.col("container_id").isNull()).count() == 1


def test_kinds_of_one_capacity_take_turns(spark):
    counts = spark.createDataFrame([(i, 10) for i in range(90)], "doc_id long, n_tokens long")
    rows = packing.pack(counts, {"a": 30, "b": 30, "c": 30}).collect()
    kinds = {}
    for r in rows:
        kinds.setdefault(r["pack_kind"], set()).add(r["container_id"])
    assert {k: len(v) for k, v in kinds.items()} == {"a": 10, "b": 10, "c": 10}
    table = spark.createDataFrame([("a", 30), ("b", 30), ("c", 30)], "pack_kind string, capacity_tokens int")
    assert tuple(packing.pack_check(packing.pack(counts, {"a": 30, "b": 30, "c": 30}), table).first()) == (90, 0, 0, 0)


def test_too_many_kinds_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(packing, "MOST_KINDS", 1)
    with pytest.raises(ValueError, match="kinds"):
        packing.capacities_of(spark.createDataFrame([("a", 30), ("b", 30)], "pack_kind string, capacity_tokens int"))


def test_check_against_sql(same_as_sql):
    from octolake.llm import queries

    same_as_sql(queries.p6_check, queries.SQL["p6_check"])
    same_as_sql(queries.p2_check, queries.SQL["p2_check"])
