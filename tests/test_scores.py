"""Scores and communities of a random graph of 40 nodes against plain Python and numpy."""

import numpy as np
import pytest
from test_more import around, cores
from test_scale import between_by_hand, bfs, tangle

from pyspark.sql import functions as F

from brindle.operators import communities, graph


@pytest.fixture(scope="module")
def web(spark):
    edges = tangle(9, 40, 130)
    nodes = sorted({x for e in edges for x in e})
    a = np.zeros((len(nodes), len(nodes)))
    for x, y in edges:
        a[nodes.index(x), nodes.index(y)] = 1
    return spark.createDataFrame(edges, "src long, dst long").withColumn("weight", F.lit(1)), edges, nodes, a


def by_hand(edges, nodes, a):
    n = len(nodes)
    rank = np.full(n, 1 / n)
    out = a.sum(axis=1, keepdims=True)
    for _ in range(20):
        got = np.divide(a, out, out=np.zeros_like(a), where=out > 0).T @ rank
        rank = 0.15 / n + 0.85 * (got + (1 - got.sum()) / n)
    x = np.full(n, n**-0.5)
    for _ in range(100):
        new = x + a.T @ x
        new /= np.linalg.norm(new)
        stop = np.abs(new - x).sum() < n * 1e-6
        x = new
        if stop:
            break
    between = between_by_hand(edges, nodes)
    back = [(y, x_) for x_, y in edges]
    close = []
    for v in nodes:
        d = bfs(back, v)
        total = sum(d.values())
        close.append((len(d) - 1) ** 2 / (total * (n - 1)) if total else 0.0)
    near = around(edges)
    core = cores(near)
    degree = a.sum(axis=0) + a.sum(axis=1)
    return {
        "rank": rank, "centrality": x, "betweenness": np.array([sum(between[s][v] for s in nodes) for v in nodes]) / ((n - 1) * (n - 2)),
        "closeness": np.array(close), "core": np.array([core[v] for v in nodes], dtype=float), "degree_share": degree / degree.max(), "degree_centrality": degree / (n - 1),
    }


def test_combined_scores_equal_brute_force(web, monkeypatch):
    df, edges, nodes, a = web
    for name in ("pagerank", "betweenness", "closeness", "eigenvector", "core_numbers"):  # each is made once
        done = graph.cut(getattr(graph, name)(df))
        monkeypatch.setattr(graph, name, lambda e, done=done: done)
    m = by_hand(edges, nodes, a)
    asked = {
        "influence_scores": (communities.influence_scores(df, 15), {"rank": 0.4, "betweenness": 0.3, "closeness": 0.2, "degree_share": 0.1}),
        "key_spreaders": (communities.key_spreaders(df, 15), {"core": 0.5, "betweenness": 0.5}),
        "key_nodes": (communities.key_nodes(df, 15), dict.fromkeys(("rank", "betweenness", "closeness", "centrality", "degree_share"), 0.2)),
        "influencers": (communities.influencers(df, 15), {"rank": 0.35, "betweenness": 0.25, "shell": 0.25, "degree_share": 0.15}),
    }
    m["shell"] = m["core"] / m["core"].max()
    for name, (got, weights) in asked.items():
        score = sum(w * m[c] for c, w in weights.items())
        best = sorted(range(len(nodes)), key=lambda i: (-round(score[i], 9), nodes[i]))[:15]
        rows = got.collect()
        assert [r["score"] for r in rows] == pytest.approx([score[i] for i in best], rel=1e-6), name
        assert {r["node"]: r["score"] for r in rows} == pytest.approx({nodes[nodes.index(r["node"])]: score[nodes.index(r["node"])] for r in rows}, rel=1e-6)
    rows = {r["node"]: r for r in communities.centrality_features(df).collect()}
    for c in ("degree_centrality", "betweenness", "centrality", "rank"):
        assert [rows[v][c] for v in nodes] == pytest.approx(list(m[c]), rel=1e-6, abs=1e-12), c


def modularity_of(a, label):
    w = a + a.T
    k, total = w.sum(axis=1), w.sum()
    same = np.array(label)[:, None] == np.array(label)[None, :]
    return float(((w - np.outer(k, k) / total) * same).sum() / total)


def one_by_one(a):
    """Single nodes move to the neighbouring community of the greatest gain, in order, until none does."""
    w = a + a.T
    k, total, label = w.sum(axis=1), w.sum(), list(range(len(a)))
    for _ in range(50):
        moved = False
        for v in range(len(a)):
            options = {label[u] for u in np.flatnonzero(w[v])} | {label[v]}
            gain = {c: sum(w[v, u] for u in range(len(a)) if label[u] == c and u != v) - k[v] * sum(k[u] for u in range(len(a)) if label[u] == c and u != v) / total for c in options}
            to = max(sorted(gain), key=gain.get)
            if gain[to] > gain[label[v]] + 1e-12:
                label[v], moved = to, True
        if not moved:
            break
    return label


def test_communities_are_about_as_good_as_one_by_one(web):
    df, _, nodes, a = web
    bar = modularity_of(a, one_by_one(a))
    for fn, share in ((communities.louvain, 0.9), (communities.greedy_modularity, 0.85)):
        found = {r["node"]: r["community"] for r in fn(df).collect()}
        assert found.keys() == set(nodes) and all(found[c] == c and c <= v for v, c in found.items())
        score = modularity_of(a, [found[v] for v in nodes])
        assert score >= share * bar, (fn, score, bar)
        labels = df.sparkSession.createDataFrame(list(found.items()), "node long, community long")
        assert communities.quality(communities.undirected(df), labels).first()[0] == pytest.approx(score)


def test_overlapping_communities_equal_matrices(spark):
    """Two layers over a random graph with a loop, opposite and parallel edges, against dense matrices."""
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 30, (70, 2))] + [(1, 1), (2, 3), (3, 2), (2, 3)]
    df = spark.createDataFrame(edges, "src long, dst long")
    layers = [(rng.normal(0, 0.5, (6, 1)), rng.normal(0, 1, 6)), (rng.normal(0, 1, (4, 6)), None)]
    a = np.zeros((30, 30))
    for i, j in edges:
        a[i, j] = a[j, i] = i != j
    degree = a.sum(1)
    root = 1 / np.sqrt(degree + 1)
    spread = root[:, None] * (a + np.eye(30)) * root[None, :]
    h = np.maximum(spread @ degree[:, None] @ layers[0][0].T + layers[0][1], 0)
    h = np.exp(spread @ h @ layers[1][0].T)
    h /= h.sum(1, keepdims=True)
    want = {(i, c): h[i, c] for i in range(30) for c in range(4) if degree[i] and h[i, c] > 0.25}
    members = communities.overlapping(df, layers, 0.25)
    got = {(r.node, r.community): r.membership for r in members.collect()}
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-9 for x in want)
    times = {i: sum(n == i for n, _ in want) for i, _ in want}
    assert max(times.values()) > 1
    for r in communities.overlapping_described(members, df).collect():
        inside = {n for n, c in want if c == r.community}
        m = sum(i in inside and j in inside for i, j in set(edges))
        assert r["size"] == len(inside) and abs(r.avg_membership - np.mean([times[n] for n in inside])) < 1e-9
        assert abs(r.density - (m / (len(inside) * (len(inside) - 1)) if len(inside) > 1 else 0)) < 1e-9
    assert communities.overlapping(df.limit(0), layers).count() == 0
