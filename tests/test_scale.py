"""Operators that were built to scale, against brute force: nearest neighbours, autoencoder, path counts, sketched distances."""

import random

import numpy as np
import pytest
from brindle.operators import autoencoder, communities, graph, nearest, paths


def nearest_by_hand(rows, k):
    out = {}
    for key, v in rows:
        d = sorted((float(np.sqrt(((np.array(v) - np.array(w)) ** 2).sum())), other) for other, w in rows if other != key)
        out[key] = d[:k]
    return out


@pytest.mark.parametrize("case", ["clusters", "copies", "grid", "few"])
def test_nearest_equals_all_pairs_with_fewer_distances(spark, monkeypatch, case):
    r = np.random.default_rng(4)
    if case == "clusters":
        rows = [(i, (r.normal(0, 0.2, 3) + 10 * r.integers(0, 12) * np.array([1, 0.5, -1])).tolist()) for i in range(700)]
    elif case == "copies":  # one vector of a third of the rows
        rows = [(i, [0.0, 0.0] if i % 3 == 0 else r.normal(0, 5, 2).tolist()) for i in range(600)]
    elif case == "grid":  # ties
        rows = [(i, [float(i % 20), float(i // 20)]) for i in range(400)]
    else:
        rows = [(i, [float(i)]) for i in range(4)]
    monkeypatch.setattr(nearest, "BLOCK", 100)
    df = spark.createDataFrame([*rows, (9999, None), (9998, [float("nan")] * len(rows[0][1]))], "i long, v array<double>")
    got, compared = nearest.nearest(df, "i", "v", 5, 24 if case != "few" else None)
    found = {}
    for x in got.collect():
        found.setdefault(x["i"], []).append((x["d"], x["n"]))
    want = nearest_by_hand(rows, 5)
    assert found.keys() == want.keys()
    for i in want:
        assert [n for _, n in sorted(found[i])] == [n for _, n in want[i]] and np.allclose(sorted(d for d, _ in found[i]), [d for d, _ in want[i]])
    if case in ("clusters", "copies"):
        assert compared < len(rows) ** 2 * 0.4, compared
    if case == "few":
        assert nearest.nearest(df.limit(0), "i", "v", 5)[0].count() == 0


def test_nearest_holds_the_copies_of_one_lot(spark, monkeypatch):
    """Where all cells meet, no written table has more rows than a lot, and all neighbours are found."""
    r = np.random.default_rng(8)
    rows = [(i, r.normal(size=8).tolist()) for i in range(500)]
    monkeypatch.setattr(nearest, "BLOCK", 20)
    monkeypatch.setattr(nearest, "LOT_ROWS", 1000)
    sizes, write = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: (out := write(df), sizes.append(out.count() if "slice" in df.columns else 0))[0])
    got = nearest.nearest(spark.createDataFrame(rows, "i long, v array<double>"), "i", "v", 5, 6)[0].collect()
    assert 1000 < max(sizes) <= 2000 < sum(sizes)
    want = nearest_by_hand(rows, 5)
    assert {(x["i"], x["n"]) for x in got} == {(i, n) for i, best in want.items() for _, n in best}
    assert nearest.lots([5.0, 0.0, 2.0], [3, 4, 1], 10.0) == [[(0, 0, 2)], [(0, 2, 3), (2, 0, 1)]]


@pytest.mark.parametrize("case", ["far from zero", "ties", "huge"])
def test_products_leave_all_near_pairs(case):
    r = np.random.default_rng(2)
    x, y = r.normal(size=(40, 6)), r.normal(size=(300, 6))
    if case == "far from zero":
        x, y = x * 1e-6 + 1e4, y * 1e-6 + 1e4
    elif case == "ties":
        x, y = np.round(x), np.round(y)
    else:
        x, y = x * 1e200, y * 1e200
    with np.errstate(over="ignore"):
        d = nearest._between(x, y)
        got = nearest.closest(x, y, 5)
    want = {(i, j): d[i, j] for i in range(40) for j in range(300) if d[i, j] <= np.sort(d[i])[4]}
    assert {(int(i), int(j)): v for i, j, v in zip(*got, strict=True)} == want


def test_cells_that_all_meet_ask_together(spark, monkeypatch):
    """Each of 8 cells had all rows sent once; blocks of 200 rows of several cells have them sent less often."""
    r = np.random.default_rng(8)
    rows = [(i, r.normal(size=8).tolist()) for i in range(500)]
    monkeypatch.setattr(nearest, "BLOCK", 200)
    monkeypatch.setattr(nearest, "LOT_ROWS", 10)
    sizes, write = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: (out := write(df), sizes.append(out.count() if "slice" in df.columns else 0))[0])
    got = nearest.nearest(spark.createDataFrame(rows, "i long, v array<double>"), "i", "v", 5, 8)[0].collect()
    assert sum(sizes) < 6 * 500
    assert {(x["i"], x["n"]) for x in got} == {(i, n) for i, best in nearest_by_hand(rows, 5).items() for _, n in best}
    between = np.abs(np.arange(6)[:, None] - np.arange(6))
    assert nearest.asking(between, np.array([2, 3, 1, 9, 1, 1]), 5).tolist() == [0, 0, 1, 2, 3, 3]


def test_gradients_equal_differences():
    r = np.random.default_rng(0)
    sizes, linear, x = [3, 4, 2, 4, 3], {1, 3}, r.normal(size=(7, 3))
    v = autoencoder.flat(autoencoder.start(sizes, 1)) + r.normal(0, 0.1, 3 * 4 + 4 + 4 * 2 + 2 + 2 * 4 + 4 + 4 * 3 + 3)
    _, g = autoencoder.gradient(autoencoder.shaped(v, sizes), x, linear)
    at = lambda w: autoencoder.gradient(autoencoder.shaped(w, sizes), x, linear)[0]
    for i in range(len(v)):
        e = np.eye(len(v))[i] * 1e-6
        assert g[i] == pytest.approx((at(v + e) - at(v - e)) / 2e-6, rel=1e-4, abs=1e-5)


def test_autoencoder_beats_axes_on_a_curve(spark):
    r = np.random.default_rng(7)
    t = r.uniform(-1.2, 1.2, 500)
    rows = [(i, float(np.sin(a)), float(np.cos(a)), float(a * 2)) for i, a in enumerate(t)] + [(999, 0.0, 0.0, 2.4)]
    df = spark.createDataFrame([*rows, (1000, None, 0.9, 0.0)], "i long, a double, b double, c double").coalesce(2)
    model = autoencoder.Autoencoder(["a", "b", "c"], hidden=(8,), latent=1, steps=80, rate=0.04, batch_rows=10_000).fit(df)
    assert model.losses[-1] < 0.2 * model.losses[0]
    scored = model.score(df, 0.95).collect()
    x = np.array([row[1:] for row in rows])
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    axis = np.linalg.svd(z, full_matrices=False)[2][:1]
    straight = ((z - z @ axis.T @ axis) ** 2).mean()
    assert len(scored) == 502 and np.mean([s["score"] for s in scored if s["i"] < 999]) < 0.5 * straight
    assert next(s for s in scored if s["i"] == 999)["is_anomaly"] and 10 <= sum(s["is_anomaly"] for s in scored) <= 40
    codes = model.encode(df).select("latent").collect()
    assert {len(c["latent"]) for c in codes} == {1}
    assert autoencoder.Autoencoder(["a", "b"], steps=2).fit(df.limit(0)).score(df.limit(0)).count() == 0
    parts = autoencoder.Autoencoder(["a", "b", "c"], hidden=(4,), latent=1, steps=4, batch_rows=130).fit(df)
    assert len(parts.losses) == 4


def tangle(seed=3, n=40, m=110):
    r = random.Random(seed)
    return sorted({(a, b) for a, b in ((r.randrange(n), r.randrange(n)) for _ in range(m)) if a != b} | {(n + 1, n + 2)})


def bfs(edges, s):
    steps, depth, line = {}, {s: 0}, [s]
    for a, b in edges:
        steps.setdefault(a, []).append(b)
    for v in line:
        for w in steps.get(v, []):
            if w not in depth:
                depth[w] = depth[v] + 1
                line.append(w)
    return depth


def between_by_hand(edges, sources):
    """For each pair the share of shortest paths through each node, by counting paths both ways."""
    nodes = sorted({x for e in edges for x in e})
    dist = {s: bfs(edges, s) for s in nodes}
    count = {}
    for s in nodes:
        count[s] = {s: 1}
        for v in sorted(dist[s], key=dist[s].get):
            for a, b in edges:
                if a == v and dist[s].get(b) == dist[s][v] + 1:
                    count[s][b] = count[s].get(b, 0) + count[s][v]
    out = {s: dict.fromkeys(nodes, 0.0) for s in sources}
    for s in sources:
        for t in dist[s]:
            for v in dist[s]:
                if v not in (s, t) and t in dist[v] and dist[s][v] + dist[v][t] == dist[s][t] and s != t:
                    out[s][v] += count[s][v] * count[v][t] / count[s][t]
    return out


def test_path_counts_equal_brute_force(spark):
    edges = tangle()
    df = spark.createDataFrame([*edges, edges[0], (5, 5)], "src long, dst long")
    nodes = sorted({x for e in edges for x in e})
    want = between_by_hand(edges, nodes)
    got = {x["node"]: x["betweenness"] for x in paths.betweenness(df, normalized=False, batch=25).collect()}
    assert got.keys() == set(nodes) and all(got[v] == pytest.approx(sum(want[s][v] for s in nodes)) for v in nodes)
    some = nodes[::4]
    got = {x["node"]: x for x in paths.betweenness(df, sources=spark.createDataFrame([(s,) for s in some], "node long"), normalized=False).collect()}
    n, k = len(nodes), len(some)
    for v in nodes:
        parts = np.array([want[s][v] for s in some])
        assert got[v]["betweenness"] == pytest.approx(parts.sum() * n / k)
        assert got[v]["error"] == pytest.approx(n * parts.std(ddof=1) / np.sqrt(k) * np.sqrt(1 - k / n), abs=1e-9)
    old = {x["node"]: x["betweenness"] for x in graph.betweenness(df).collect()}
    assert old == pytest.approx({x["node"]: x["betweenness"] for x in paths.betweenness(df).collect()})
    assert paths.betweenness(df.limit(0)).count() == 0


def test_sketched_distances_are_near_the_exact_ones(spark):
    edges = tangle(5, 200, 500)
    df = spark.createDataFrame([*edges, (7, 7)], "src long, dst long")
    exact = {x["node"]: x["closeness"] for x in graph.closeness(df).collect()}
    got = {x["node"]: x["closeness"] for x in paths.closeness(df).collect()}
    assert got.keys() == exact.keys()
    assert all(got[v] == pytest.approx(exact[v], rel=0.06, abs=1e-9) for v in exact)
    nodes = sorted({x for e in edges for x in e})
    dist = [d for s in nodes for v, d in bfs(edges, s).items() if v != s]
    steps = {x["distance"]: x["pairs"] for x in paths.neighbourhood(df).collect()}
    assert max(steps) == max(dist)
    assert all(steps[t] == pytest.approx(len(nodes) + sum(d <= t for d in dist), rel=0.06) for t in steps)


def test_sketches_of_separate_and_split_parts_stay_on_their_tasks(spark, monkeypatch):
    """No written table carries sketches along edges; components that are dealt by registers, over files and in lots, give the same distances as whole ones."""
    wide = [(f"a{i}", f"b{i * j % 60}") for i in range(90) for j in range(1, 12)]
    edges = wide + [(b, a) for a, b in wide] + [(f"p{i}", f"p{i + 1}") for i in range(30)] + [("alone", "alone"), (None, "open")]
    df = spark.createDataFrame(edges, "src string, dst string")
    kinds, write = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: (kinds.extend(k for _, k in df.dtypes), write(df))[1])
    whole = {x["node"]: x["closeness"] for x in paths.closeness(df).collect()}
    steps = [(x["distance"], x["pairs"]) for x in paths.neighbourhood(df).collect()]
    assert "binary" not in kinds
    plain = [e for e in edges if e[0] is not None and e[0] != e[1]]
    nodes = sorted({x for e in edges for x in e if x is not None})
    far = {s: bfs(plain, s) for s in nodes}
    assert steps == [(t, float(sum(d <= t for x in far.values() for d in x.values()))) for t in range(31)]  # so few nodes are told one by one
    assert whole.keys() == set(nodes) and whole["alone"] == whole["open"] == 0
    monkeypatch.setattr(paths, "FEW", 20)
    rough = {x["node"]: x["closeness"] for x in paths.closeness(df).collect()}
    assert all(rough[v] == pytest.approx(whole[v], rel=0.06) for v in nodes)
    for name, value in (("EDGES", 500), ("LOT", 300), ("STATE", 1 << 16), ("OWN", 50)):
        monkeypatch.setattr(paths, name, value)
    split = {x["node"]: x["closeness"] for x in paths.closeness(df).collect()}
    assert all(split[v] == pytest.approx(whole[v], rel=0.06) for v in nodes)
    none = df.limit(0)
    assert paths.closeness(none).count() == 0 and [x["pairs"] for x in paths.neighbourhood(none).collect()] == [0.0]


def test_loops_keep_one_round_on_disk(spark, monkeypatch):
    df = spark.createDataFrame([(i, i + 1) for i in range(4)] + [(9, 0)], "src long, dst long")
    left = lambda f: (len(graph._written), f(), len(graph._written))
    before, one, after = left(lambda: {x["distance"]: x["pairs"] for x in paths.neighbourhood(df).collect()})
    assert after - before <= 2
    monkeypatch.setattr(paths, "EDGES", 1)
    monkeypatch.setattr(paths, "LOT", 3)  # two lots
    assert {x["distance"]: x["pairs"] for x in paths.neighbourhood(df).collect()} == one
    before, _, after = left(lambda: graph.core_numbers(df).count())
    assert after - before <= 2
    before, _, after = left(lambda: graph.label_propagation(df, 4).count())
    assert after - before <= 1
