"""Blocked products give what a scan pair by pair gives: with copies, rows without a vector, groups and blocks of queries."""

import numpy as np
import pytest

from marketloom.operators import memory, scan


@pytest.fixture(scope="module")
def sides(spark):
    rng = np.random.default_rng(4)
    points = rng.normal(size=(40, 6)).round(2)
    rows = [(i, points[i % 40].tolist(), i % 3, float(i % 5)) for i in range(400)]  # ten copies of each
    rows += [(1000, None, 0, 1.0), (1001, [1.0], 1, 1.0), (1002, [None] * 6, 2, 1.0)]
    asked = [(i, points[i].tolist(), i % 3) for i in range(12)] + [(50, None, 1)]
    return spark.createDataFrame(rows, "id long, v array<double>, symbol int, compound double").repartition(5).cache(), spark.createDataFrame(asked, "qid long, q array<double>, symbol int").cache(), rows, asked


def brute(rows, asked, k, metric):
    out = set()
    for qid, q, _ in asked:
        scored = []
        for i, v, *_ in rows:
            whole = q and v and len(v) == len(q) and None not in v
            s = 0.0
            for a, b in zip(v or [], q or []) if whole else ():
                s += (a - b) * (a - b) if metric == "l2" else a * b
            scored.append((0, s if metric == "l2" else -s, i) if whole else (1, 0.0, i))
        out |= {(qid, i, None if blank else abs(s), r) for r, (blank, s, i) in enumerate(sorted(scored)[:k], 1)}
    return out


@pytest.mark.parametrize("metric,k", [("l2", 7), ("dot", 7), ("l2", 402)])
def test_nearest_is_a_scan(sides, monkeypatch, metric, k):
    store, queries, rows, asked = sides
    monkeypatch.setattr(scan, "BLOCK", 5)
    got = {(r.qid, r.id, None if r.score is None else abs(r.score), r["rank"]) for r in memory.nearest(store, queries, k, metric).collect()}
    assert got == brute(rows, asked, k, metric)


def test_pairs_never_become_rows(sides):
    store, queries, *_ = sides
    for df in (memory.nearest(store, queries), memory.recall(store.selectExpr("id", "v", "compound AS importance", "id AS days"), queries.select("qid", "q")), memory.nearest_in_group(store, queries)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "NestedLoop" not in plan and "HashJoin" not in plan


def test_recall_is_a_loop(sides):
    store, queries, rows, asked = sides
    got = memory.recall(store.selectExpr("id", "v", "compound AS importance", "id % 7 AS days"), queries.select("qid", "q"), 9, 0.3).collect()
    want = set()
    for qid, q, _ in asked[:-1]:
        scored = []
        for i, v, _, c in rows[:400]:
            near = np.dot(v, q) / np.sqrt(np.dot(v, v) * np.dot(q, q))
            scored += [(round(-(near + c * 0.95 ** (i % 7)), 9), i)] if near >= 0.3 else []
        want |= {(qid, i, -s, r) for r, (s, i) in enumerate(sorted(scored)[:9], 1)}
    assert {(r.qid, r.id, round(r.score, 9), r["rank"]) for r in got} == want


def test_length_is_taken_once(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0])], "id int, v array<float>").withColumn("v", memory.normalised("v"))
    assert [r.v for r in df.orderBy("id").collect()] == [[3.0 / 5, 4.0 / 5], [0.0, 0.0]]
    # the sum of squares stands outside the function of an element
    assert df._jdf.queryExecution().analyzed().toString().count("aggregate(") == 1
