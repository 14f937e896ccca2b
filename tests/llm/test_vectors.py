"""Vector searches against brute force."""

from collections import Counter

import numpy as np
import pytest

from liftloom.llm.ann_graph import GraphSettings, build_graph, nearest, search_graph
from liftloom.llm.impact_topk import ImpactSettings, build_index, exact_top, search_index

SCHEMA = "vec_id long, embedding array<float>, score string, rank string, cid string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, "clash", "clash", "clash") for i, v in rows], SCHEMA)


def brute(rows, k, measure, zero):
    usable = {(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and (zero or any(v))}
    out = []
    for q, v in usable:
        if q % 20 == 0:
            scored = sorted((-measure(np.array(v, np.float32), np.array(w, np.float32)), i) for i, w in usable if i != q and len(w) == len(v))
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def rows_of(seed, count, size=8, copies=0):
    random = np.random.default_rng(seed)
    rows = [(n, random.normal(0, 1, size).astype(np.float32).tolist()) for n in range(count)]
    rows += [(count + n, rows[20][1]) for n in range(copies)]
    odd = [(900, None), (920, []), (940, [float("nan")] * size), (901, [None] * size), (None, [1.0] * size), (960, [0.0] * size), (902, [1.0, 2.0]), (980, [2.0, 1.0])]
    return rows + odd + rows[:3]


def whole(a, b):
    return int((np.floor(64 * a.astype(float)) * np.floor(64 * b.astype(float))).sum())


def test_exact_top(spark):
    rows = rows_of(1, 60, copies=45)
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in exact_top(table(spark, rows)).collect())
    assert got == brute(rows, 20, whole, True)
    assert exact_top(table(spark, [])).isEmpty()


@pytest.mark.parametrize("scale", [1, 1000, 2**40])
def test_index_stops_only_on_proof(scale):
    random = np.random.default_rng(4)
    vectors = np.floor(random.normal(0, 8, (3000, 16)) ** 3 / 20) * scale
    queries = vectors[:40]
    settings = ImpactSettings(few=60)
    found, scores = search_index(build_index(vectors), queries, settings)
    exact = queries.astype(object) @ vectors.astype(object).T
    for row in range(len(queries)):
        real = sorted(exact[row], reverse=True)[: settings.k + 1]
        held = sorted((int(s) for i, s in zip(found[row], scores[row]) if i >= 0), reverse=True)[: settings.k + 1]
        # products of 2**40 leave 64 bits and are held at the largest number
        assert held == [min(int(s), 2**63 - 1) for s in real]


def test_postings_are_left_out():
    """Few large components: most postings are never added up, and queries settle one by one."""
    random = np.random.default_rng(5)
    vectors = np.floor(random.normal(0, 2, (4000, 32)) + 400 * (random.random((4000, 32)) < 0.04))
    queries, work = vectors[:64], Counter()
    found, scores = search_index(build_index(vectors), queries, ImpactSettings(few=300), work)
    exact = np.sort(queries @ vectors.T, axis=1)[:, ::-1][:, :21]
    for row in range(len(queries)):
        assert sorted(scores[row][found[row] >= 0], reverse=True)[:21] == exact[row].tolist()
    assert 0 < work["postings"] < 0.6 * work["all_postings"] and work["rescored"] <= 64 * 300


def test_several_shards(spark):
    """Every shard is searched for every query; the exact search stays exact and the graph keeps its recall."""
    rows = rows_of(7, 700, copies=45)
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in exact_top(table(spark, rows), ImpactSettings(shard_rows=90, few=25)).collect())
    assert got == brute(rows, 20, whole, True)
    near = {(r.query_id, r["rank"]): r.vec_id for r in nearest(table(spark, rows), GraphSettings(shard_rows=90)).collect()}
    expected = brute(rows, 20, lambda a, b: float(a.astype(float) @ b.astype(float)), False)
    assert set(near) == {(q, n) for q, n, _, _ in expected}
    assert sum(near[q, n] == i for q, n, i, _ in expected) >= 0.9 * len(expected)


def test_graph_recall(spark):
    random = np.random.default_rng(3)
    vectors = random.normal(0, 1, (3000, 24)) * random.uniform(0.5, 1.5, (3000, 1))
    settings = GraphSettings()
    queries = vectors[:100]
    found, scores = search_graph(build_graph(vectors, settings), queries, settings)
    exact = np.argsort(-(queries @ vectors.T), axis=1)[:, : settings.k]
    assert np.mean([len(set(a) & set(b)) / settings.k for a, b in zip(found, exact)]) >= 0.9
    assert np.allclose(scores, np.take_along_axis(queries @ vectors.T, found, axis=1))


def test_nearest_on_odd_rows(spark):
    rows = rows_of(2, 50, copies=30)
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in nearest(table(spark, rows)).collect()}
    expected = brute(rows, 20, lambda a, b: float(a.astype(float) @ b.astype(float)), False)
    assert set(got) == {(q, n) for q, n, _, _ in expected}
    hits = sum(got[q, n][0] == i for q, n, i, _ in expected)
    assert hits >= 0.9 * len(expected)
    assert all(abs(got[q, n][1] - s) < 1e-9 for q, n, i, s in expected if got[q, n][0] == i)
    assert nearest(table(spark, [])).isEmpty()
