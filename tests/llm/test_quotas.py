from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from octolake.llm import quotas

ROWS = "sequence_id string, label string, chromosome string, gc_bin int"
TARGETS = "target_id int, request_id int, sample_size long, label string, chromosome string, gc_bin int, target_share double, min_rows long"


def case(spark):
    rows = [(f"s{i}", ("Coding ", "non-coding", "CODING")[i % 3], ("chr1", "1 ", "Chr 2")[i % 3], i % 5) for i in range(900)]
    rows += rows[:50] + [(None, "coding", "1", 1), ("n1", None, "1", 1), ("n2", "coding", None, None)]
    targets = [
        (1, 1, 100, "coding", None, None, 0.5, 0), (2, 1, 100, "noncoding", None, None, 0.5, 70), (3, 2, 1000, None, "1", 2, 0.5, 0),
        (4, 2, 1000, "pseudogene", None, None, 0.001, 1), (5, 3, 10, None, None, None, 1.0, 0), (5, 3, 10, None, None, None, 1.0, 0), (6, 3, 0, None, "MT", None, 0.0, 0),
    ]
    return spark.createDataFrame(rows, ROWS).withColumn("u", F.lit("clash")).withColumn("target_id", F.lit(9)), spark.createDataFrame(targets, TARGETS)


def test_plan(spark):
    rows, targets = case(spark)
    got = {r["target_id"]: r for r in quotas.quota_plan(rows, targets).collect()}
    assert len(got) == 6
    assert got[1]["available"] == 601 and got[1]["drawn"] == 30 and not got[1]["short"]
    assert got[2]["wanted"] == 70 and got[3]["available"] == 120 and got[3]["short"] and got[3]["deficit"] == 380
    assert got[4]["available"] == 0 and got[4]["short"] and got[4]["deficit"] == 1 and not got[6]["short"] and got[5]["available"] == 902


def test_sample_is_exact_and_repeats_itself(spark, monkeypatch):
    rows, targets = case(spark)
    one = sorted(map(tuple, quotas.quota_sample(rows, targets).collect()))
    counts = Counter(t for t, _, _ in one)
    assert counts == {1: 30, 2: 70, 3: 120, 5: 10} and len(set(one)) == len(one)
    assert one == sorted(map(tuple, quotas.quota_sample(rows.repartition(7), targets).collect()))
    monkeypatch.setattr(quotas, "STEP_ROWS", 3)
    assert one == sorted(map(tuple, quotas.quota_sample(rows, targets).collect()))
    monkeypatch.setattr(quotas, "BROADCAST_TARGETS", 0)
    assert one == sorted(map(tuple, quotas.quota_sample(rows, targets).collect()))


def test_too_few_accepted_are_topped_up(spark, monkeypatch):
    monkeypatch.setattr(quotas, "OVERSAMPLE", -0.9)
    monkeypatch.setattr(quotas, "DEVIATIONS", 0.0)
    rows, targets = case(spark)
    assert Counter(r["target_id"] for r in quotas.quota_sample(rows, targets).collect()) == {1: 30, 2: 70, 3: 120, 5: 10}


def test_empty(spark):
    rows, targets = case(spark)
    assert quotas.quota_sample(rows.limit(0), targets).count() == 0
    assert quotas.quota_sample(rows, targets.limit(0)).count() == 0
    assert quotas.quota_report(rows.limit(0), targets).where("short").count() == 5


def test_queries_against_sql(same_as_sql):
    from octolake.llm import queries

    same_as_sql(queries.p2_found, queries.SQL["p2_found"])
    same_as_sql(queries.p2_report, queries.SQL["p2_report"])


def test_requests_add_up(spark):
    """Least rows are paid for and deficits taken up by the request's other targets, in proportion to their shares."""
    rng = np.random.default_rng(6)
    plan, size = [], {}
    for request in range(30):
        n = int(rng.integers(1, 9))
        share = rng.dirichlet(np.ones(n)) * (rng.random(n) > 0.1)
        size[request] = int(rng.integers(0, 2000))
        for i in range(n):
            plan.append((request * 100 + i, request, size[request], float(share[i]), int(rng.integers(0, 60)), int(rng.integers(0, 800))))
    df = spark.createDataFrame(plan, "target_id int, request_id int, sample_size long, target_share double, min_rows long, available long")
    got = {r["target_id"]: r["drawn"] for r in quotas.balanced(df).collect()}
    assert len(got) == len(plan)
    for request in size:
        mine = [p for p in plan if p[1] == request]
        low = [min(m, a) for *_, m, a in mine]
        high = [a if s > 0 and size[request] > 0 else lo for (*_, s, _, a), lo in zip(mine, low)]
        drawn = [got[p[0]] for p in mine]
        assert sum(drawn) == max(sum(low), min(size[request], sum(high))), request
        assert all(lo <= d <= hi for lo, d, hi in zip(low, drawn, high))
        free = [d / (p[3] * size[request]) for p, d, lo, hi in zip(mine, drawn, low, high) if lo + 1 < d < hi - 1]
        slack = max([2 / (p[3] * size[request]) for p, d, lo, hi in zip(mine, drawn, low, high) if lo + 1 < d < hi - 1], default=0)
        assert not free or max(free) - min(free) <= slack


def test_report_shares(spark):
    rows, targets = case(spark)
    got = {r["target_id"]: (r["sampled"], r["reached_share"]) for r in quotas.quota_report(rows, targets).collect()}
    assert got[1] == (30, 0.3) and got[2] == (70, 0.7) and got[3] == (120, 1.0) and got[4] == (0, 0.0)
