import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.llm import vectors

SCHEMA = "vec_id long, embedding array<float>, label int, __row long, n int"


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(2)
    base = rng.normal(size=(12, 8))
    rows = []
    for i in range(300):
        v = base[i % 12] + rng.normal(size=8) * (0.05 if i % 3 else 1.0)
        rows.append([i, v.astype(np.float32).tolist(), i % 2, 1, 1])
    rows[5][1] = rows[17][1] = rows[29][1]
    for i, v in ((30, None), (31, [0.0] * 8), (32, [1.0] * 7 + [float("nan")]), (33, [1.0] * 7 + [None]), (34, []), (35, [1.0, 2.0]), (36, [float("inf")] * 8)):
        rows[i][1] = v
    rows[40][2] = None
    rows.append(list(rows[50]))
    return [tuple(r) for r in rows]


def whole(v):
    return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v)


def test_linked(spark, data):
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    n, up = {}, list(range(len(data)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ok = [whole(r[1]) and any(r[1]) and r[2] is not None for r in data]
    unit = [np.array(r[1]) / np.linalg.norm(r[1]) if k else None for r, k in zip(data, ok, strict=True)]
    for a in range(len(data)):
        for b in range(a):
            if ok[a] and ok[b] and data[a][2] == data[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.98:
                n[a] = n.get(a, 0) + 1
                n[b] = n.get(b, 0) + 1
                x, y = sorted((root(a), root(b)))
                up[y] = x
    least = {}
    for a, r in enumerate(data):
        least[root(a)] = min(least.get(root(a), 10**9), r[0])
    want = sorted((r[0], n.get(a, 0), least[root(a)], r[0] == least[root(a)]) for a, r in enumerate(data))
    assert sorted(map(tuple, vectors.linked_vectors(df).drop("audited_recall", "audited_links").collect())) == want
    small = vectors.GraphSettings(shard_rows=30, query_shards=2)
    assert sorted(map(tuple, vectors.linked_vectors(df, small).drop("audited_recall", "audited_links").collect())) == want
    assert vectors.linked_vectors(df.limit(0)).count() == 0


@pytest.mark.parametrize("scale", [1.0, 1e9])
def test_top_k(spark, data, scale):
    data = [(r[0], None if r[1] is None else [None if x is None else x * scale for x in r[1]], *r[2:]) for r in data[:120]]
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    q = {i: [int(np.floor(64 * np.float64(np.float32(x)))) for x in r[1]] for i, r in enumerate(data) if whole(r[1])}
    want = []
    for i, a in q.items():
        if data[i][0] % 20 == 0:
            scores = sorted((-max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(a, b, strict=True)))), data[j][0]) for j, b in q.items() if j != i and len(a) == len(b))
            want += [(data[i][0], r + 1, v, -s) for r, (s, v) in enumerate(scores[:20])]
    s = vectors.TopSettings(shard_rows=25, query_block=3, leaf=4)
    got = vectors.top_k(df, F.col("vec_id") % 20 == 0, s).collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert vectors.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_descent_is_best_first(monkeypatch):
    """Exact on clustered points, and most nodes are never opened, without any score to beat at the start."""
    rng = np.random.default_rng(3)
    points = np.floor(64 * (rng.normal(size=(64, 8)) * 4).repeat(64, axis=0) + 8 * rng.normal(size=(4096, 8)))
    ids, s = rng.permutation(4096), vectors.TopSettings(leaf=16)
    opened, above = [], vectors.BallTree.above
    monkeypatch.setattr(vectors.BallTree, "above", lambda self, q, norm, node: opened.append(len(node)) or above(self, q, norm, node))
    q_rows = np.arange(0, 4096, 41)
    who, near, score = vectors.top_scores(ids, np.arange(4096), points, q_rows, points[q_rows], np.full(len(q_rows), -np.inf), s)
    for k, row in enumerate(q_rows.tolist()):
        full = sorted((-v, int(i)) for j, (v, i) in enumerate(zip(points @ points[row], ids, strict=True)) if j != row)[:20]
        assert sorted((-v, int(i)) for v, i in zip(score[who == k], near[who == k], strict=True)) == full
    assert sum(opened) < 0.3 * len(q_rows) * len(vectors.BallTree(points, s.leaf).left)


def test_graph_recall():
    rng = np.random.default_rng(5)
    x = vectors.unit_rows(rng.normal(size=(1500, 16)))
    x[700:] = vectors.unit_rows(x[:800] + 0.02 * rng.normal(size=(800, 16)))
    g = vectors.Graph(x, vectors.GraphSettings())
    true = found = 0
    for i in random.Random(1).sample(range(1500), 200):
        exact = set(np.flatnonzero(x @ x[i] >= 0.98).tolist())
        true += len(exact)
        found += len(exact & set(g.near(x[i].astype(np.float32), 48).tolist()))
    assert found >= 0.98 * true


def test_links_across_shards(spark):
    """Planted groups of 64 dimensions, dealt over many shards: every link is found, and the audit says so."""
    rng = np.random.default_rng(5)
    base = rng.normal(size=(500, 64))
    near = base[:60].repeat(3, axis=0) + rng.normal(size=(180, 64)) * 0.02
    x = np.concatenate([base, near])
    df = spark.createDataFrame([(i, i % 2 if i < 500 else ((i - 500) // 3) % 2, [float(y) for y in v]) for i, v in enumerate(x)], "vec_id long, label int, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([i % 2 if i < 500 else ((i - 500) // 3) % 2 for i in range(len(x))])
    hit = (u @ u.T >= 0.98) & (label[:, None] == label)
    out = {r.vec_id: r for r in vectors.linked_vectors(df, vectors.GraphSettings(shard_rows=50, query_shards=2)).collect()}
    assert [out[i].n_links for i in range(len(x))] == (hit.sum(1) - 1).tolist() and hit.sum() > len(x) + 500
    assert {r.audited_recall for r in out.values()} == {1.0} and min(r.audited_links for r in out.values()) > 0


def test_an_audit_without_links_says_so(spark):
    """Vectors that are near no other: nothing was measured, so the recall is null."""
    rows = [(i, 0, [float(i == j) for j in range(80)]) for i in range(80)]
    out = vectors.linked_vectors(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")).collect()
    assert {(r.n_links, r.audited_recall, r.audited_links) for r in out} == {(0, None, 0)}
