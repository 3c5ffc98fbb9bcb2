import numpy as np
import pytest
from pyspark.sql import functions as F

from octolake.llm import splits
from tests.conftest import DATA

META = "sequence_id string, label string, species_or_subject string, dataset_id string"
CONFIG = [("d", "species_or_subject, homology_cluster", 0.7, 0.1, 0.2), ("e", "homology_cluster", 0.5, 0.25, 0.25)]
CONFIG_SCHEMA = "dataset_id string, group_column string, train_share double, validation_share double, test_share double"


def tables(spark, meta, clusters):
    return (
        spark.createDataFrame(meta, META).withColumn("key", F.lit("clash")).withColumn("node", F.lit(1)),
        spark.createDataFrame(clusters, "sequence_id string, homology_cluster string"),
        spark.createDataFrame(CONFIG, CONFIG_SCHEMA),
    )


def components(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("seed", range(3))
def test_components_against_union_find(spark, seed):
    rng = np.random.default_rng(seed)
    n = 120
    pairs = [(f"n{a:03d}", f"n{b:03d}") for a, b in rng.integers(0, n, (90, 2)) if a != b]
    pairs += [(f"p{i:02d}", f"p{i + 1:02d}") for i in range(40)]  # a long path
    got = {r["node"]: r["component"] for r in splits.hash_to_min(spark.createDataFrame(pairs + pairs[:5], "a string, b string")).collect()}
    expected = components(pairs)
    low = {}
    for x, root in expected.items():
        low[root] = min(low.get(root, x), x)
    assert got == {x: low[root] for x, root in expected.items()}


def test_spellings_and_blanks(spark):
    meta = [
        ("a", "x", "Donor-1 b", "d"), ("b", "x", " donor_1B\t", "d"), ("c", "x", "n/a", "d"), ("f", "x", "NA ", "d"), ("g", None, None, "d"), ("h", "x", "", "d"),
        ("i", "x", "Donor 1 b", "e"), (None, "x", "Donor 1 b", "d"), ("a", "x", "Donor-1 b", "d"), ("j", "x", "s", None),
    ]
    clusters = [("b", "h1"), ("c", "h1"), ("c", "h2"), ("f", "h2"), ("i", "h1"), ("zz", "h2"), ("g", None), (None, "h1")]
    got = sorted(map(tuple, splits.linked_pairs(*tables(spark, meta, clusters)).collect()))
    assert got == [("a", "b"), ("a", "c"), ("a", "f")]
    groups = {r["sequence_id"]: r["group_id"] for r in splits.record_groups(*tables(spark, meta, clusters)).collect()}
    assert groups["g"] == "g" and groups["i"] == "i" and set(groups) == set("abcfghij")


def test_empty(spark):
    assert splits.linked_pairs(*tables(spark, [], [])).count() == 0
    assert splits.group_splits(*tables(spark, [], [])).count() == 0


def test_groups_stay_whole_and_shares_hold(spark):
    meta = [(f"s{i:05d}", "x", f"subject {i // 3}", "d") for i in range(6000)]
    rows = splits.group_splits(*tables(spark, meta, [])).collect()
    by_group = {}
    for r in rows:
        by_group.setdefault(r["group_id"], set()).add(r["split"])
    assert len(rows) == 6000 and all(len(v) == 1 for v in by_group.values())
    for name, share in (("train", 0.7), ("validation", 0.1), ("test", 0.2)):
        assert abs(sum(r["split"] == name for r in rows) / 6000 - share) < 0.03


def test_hot_key_gives_a_star(spark):
    members = spark.range(2000).select(F.lit("k").alias("key"), F.format_string("r%05d", "id").alias("node"))
    links = splits.star_links(members)
    assert links.count() < 2000 + splits.PARTS
    assert splits.hash_to_min(links).where("component = 'r00000'").count() == 2000


def test_query_against_sql(same_as_sql):
    from octolake.llm import queries

    same_as_sql(queries.p1_found, queries.SQL["p1_found"])
    assert DATA


def test_heavy_nodes_are_joined_apart(spark, monkeypatch):
    monkeypatch.setattr(splits, "HEAVY_LINKS", 5)
    pairs = [("hub", f"x{i:02d}") for i in range(30)] + [("x03", "y1"), ("y1", "a0"), ("q1", "q2")]
    got = {r["node"]: r["component"] for r in splits.hash_to_min(spark.createDataFrame(pairs, "a string, b string")).collect()}
    assert {got[n] for n in got if n[0] != "q"} == {"a0"} and got["q2"] == "q1" and len(got) == 35


def test_shares_hold_with_skewed_groups(spark):
    """Groups of very different size: each split within two points of its share, or half the largest group."""
    sizes = [400, 300, 250, 120, 80, 60] + [20] * 20 + [1 + i % 5 for i in range(500)]
    meta = [(f"g{g:04d}_{i:04d}", "x", f"subject {g}", "d") for g, n in enumerate(sizes) for i in range(n)] + [(f"e{i}", "x", f"own {i}", "zz") for i in range(9)]
    rows = splits.group_splits(*tables(spark, meta, []))
    report = {(r["dataset_id"], r["split"]): r for r in splits.split_report(rows, tables(spark, meta, [])[2]).collect()}
    for name, share in (("train", 0.7), ("validation", 0.1), ("test", 0.2)):
        assert abs(report["d", name]["share"] - share) < 0.02 and report["d", name]["target_share"] == share
    assert report["zz", None]["records"] == 9
    check = {r["dataset_id"]: r for r in splits.split_check(rows, tables(spark, meta, [])[2]).collect()}
    assert check["d"]["groups"] == len(sizes) and check["d"]["broken_groups"] == 0 and check["d"]["far_splits"] == 0


def test_check_against_sql(same_as_sql):
    from octolake.llm import queries

    same_as_sql(queries.p1_check, queries.SQL["p1_check"])
