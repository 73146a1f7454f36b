"""Graph, matching, vector and layer operators against brute force on small tables, and sources and sinks by round trips."""

import math
import random
from collections import Counter
from difflib import SequenceMatcher

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.functions import text as T
from brindle.functions.bloom import BloomFilter, ScalableBloomFilter
from brindle.operators import communities, crossevent, features, graph, monitoring, neural, vectors
from brindle.plans import catalog
from brindle.sources import crawl


def random_edges(n, m, seed):
    rng = random.Random(seed)
    return sorted({(rng.randrange(n), rng.randrange(n)) for _ in range(m)})


def around(pairs):
    near = {}
    for a, b in pairs:
        near.setdefault(a, set())
        near.setdefault(b, set())
        if a != b:
            near[a].add(b)
            near[b].add(a)
    return near


def cores(near):
    left, out, k = {v: set(x) for v, x in near.items()}, {}, 0
    while left:
        low = [v for v, x in left.items() if len(x) <= k]
        if not low:
            k += 1
            continue
        for v in low:
            out[v] = k
            for w in left.pop(v):
                if w in left:
                    left[w].discard(v)
    return out


def part_of(near, start, without=None):
    seen, todo = {start}, [start]
    while todo:
        v = todo.pop()
        for w in near[v] - seen:
            if without != {v, w}:
                seen.add(w)
                todo.append(w)
    return seen


@pytest.fixture(scope="module")
def tangle(spark):
    pairs = random_edges(40, 48, 3)
    return spark.createDataFrame(pairs, "src long, dst long"), around(pairs)


def test_cores_equal_peeling(spark, tangle):
    assert {r.node: r.core for r in graph.core_numbers(tangle[0]).collect()} == cores(tangle[1])


def test_components_and_bridges_equal_search(spark, tangle):
    edges, near = tangle
    assert {r.node: r.component for r in graph.components(edges).collect()} == {v: min(part_of(near, v)) for v in near}
    want = {(a, b) for a in near for b in near[a] if a < b and b not in part_of(near, a, {a, b})}
    assert {(r.src, r.dst) for r in graph.bridges(edges).collect()} == want


def test_communities_of_two_cliques(spark):
    clique = [(a, b) for a in range(5) for b in range(a)]
    edges = spark.createDataFrame(clique + [(a + 10, b + 10) for a, b in clique] + [(0, 10)], "src long, dst long").withColumn("weight", F.lit(1))
    for fn in (communities.louvain, communities.greedy_modularity):
        assert {r.node: r.community for r in fn(edges).collect()} == {**dict.fromkeys(range(5), 0), **dict.fromkeys(range(10, 15), 10)}
    labels = communities.greedy_modularity(edges)
    got = {r.community: (r.size, sorted(r.top)[0]) for r in communities.described(labels, edges).collect()}
    assert got[0] == (5, 0) and got[10] == (5, 10)


def test_tf_idf_likeness_equals_all_pairs(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice("xy"), " ".join(rng.choice(["apple", "pear", "fig", "plum", "kiwi"]) for _ in range(rng.randint(1, 8)))) for i in range(30)]
    docs = spark.createDataFrame(rows, "k long, g string, t string")
    got = {r.g: r for r in features.tf_idf_similarity(docs, "k", "t", "g", block=4).collect()}
    for g in "xy":
        texts = [Counter(t.split()) for _, h, t in rows if h == g]
        n = len(texts)
        df = Counter(w for t in texts for w in t)
        vec = [{w: c * (math.log((1 + n) / (1 + df[w])) + 1) for w, c in t.items()} for t in texts]
        norm = [math.sqrt(sum(x * x for x in v.values())) for v in vec]
        cos = [sum(v[w] * u.get(w, 0) for w in v) / norm[i] / norm[j] for i, v in enumerate(vec) for j, u in enumerate(vec) if i < j]
        assert got[g].similarity_mean == pytest.approx(np.mean(cos)) and got[g].similarity_std == pytest.approx(np.std(cos), abs=1e-6) and got[g].similarity_max == pytest.approx(max(cos))


def test_tf_idf_likeness_makes_no_copies_of_texts(spark, monkeypatch):
    """Large groups: one with equal texts needs no pairs, one without meets in lots of bounded size; both equal one block a group."""
    rng = random.Random(6)
    words = [f"w{i}" for i in range(40)]
    rows = [(i, "x", " ".join(rng.sample(words, 12)) + (f" v{i}" * (i % 9))) for i in range(120)] + [(500 + i, "y", " ".join(rng.sample(words, 9))) for i in range(60)] + [(700, "y", "w1 w2"), (701, "y", "w2 w1")]
    docs = spark.createDataFrame(rows, "k long, g string, t string")
    one = {r.g: r for r in features.tf_idf_similarity(docs, "k", "t", "g").collect()}
    monkeypatch.setattr(features, "LOT_ROWS", 300)
    lots, write = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: (lots.append(df.columns), write(df))[1])
    many = {r.g: r for r in features.tf_idf_similarity(docs, "k", "t", "g", block=10).collect()}
    assert sum(c == ["g", "m"] for c in lots) == 3  # 120 texts in 12 blocks, 480 copies a lot
    for g in "xy":
        assert one[g][1:] == pytest.approx(many[g][1:], abs=1e-9)
    assert many["y"].similarity_max == 1.0 > many["x"].similarity_max + 1e-6


def test_templates_and_pairwise_likeness(spark):
    rows = [("u", 1, "buy now cheap 1"), ("u", 2, "buy now cheap 2"), ("u", 3, "something else entirely"), ("v", 1, "alone")]
    posts = spark.createDataFrame(rows, "user_id string, posted_at long, content string").withColumn("post_id", F.col("posted_at"))
    got = {r.user_id: (r.template_ratio, r.templates) for r in vectors.template_features(posts).collect()}
    assert got == {"u": (2 / 3, 1), "v": (0.0, 0)}
    texts = [t for u, _, t in rows if u == "u"]
    want = [SequenceMatcher(None, a, b).ratio() for i, a in enumerate(texts) for b in texts[i + 1 :]]
    r = vectors.pairwise_ratio(posts).where("user_id = 'u'").first()
    assert r.similarity_mean == pytest.approx(np.mean(want)) and r.similarity_std == pytest.approx(np.std(want)) and r.similarity_max == max(want)


def test_whole_network_of_layers(spark):
    rng = np.random.default_rng(1)
    pairs = [(0, 1), (1, 2), (2, 0), (3, 1)]
    h = rng.normal(size=(4, 3))
    x = spark.createDataFrame([(i, h[i].tolist()) for i in range(4)], "node long, h array<double>")
    edges = spark.createDataFrame([(a, b, "st"[a % 2]) for a, b in pairs], "src long, dst long, type string")
    layer = {"bases": rng.normal(size=(2, 3, 3)), "coefficients": {"s": rng.normal(size=2), "t": rng.normal(size=2)}, "root": rng.normal(size=(3, 3)), "scale": np.ones(3), "shift": np.zeros(3)}
    weights = {"input": np.eye(3), "convolutions": [layer], "attention": {"weight": rng.normal(size=(2, 3, 3)), "source": rng.normal(size=(2, 3)), "target": rng.normal(size=(2, 3))}, "dense": np.eye(3), "output": rng.normal(size=(3, 3))}
    z = h @ layer["root"].T
    for k in "st":
        w = np.tensordot(layer["coefficients"][k], layer["bases"], axes=1)
        for v in range(4):
            into = [h[a] for a, b in pairs if b == v and "st"[a % 2] == k]
            z[v] += w @ np.mean(into, axis=0) if into else 0
    z = np.maximum(z, 0)
    out = np.zeros((4, 3))
    for k in range(2):
        p = z @ weights["attention"]["weight"][k].T
        for v in range(4):
            e = {a: p[a] @ weights["attention"]["source"][k] + p[v] @ weights["attention"]["target"][k] for a, b in pairs if b == v}
            m = {a: math.exp(s if s > 0 else 0.2 * s) for a, s in e.items()}
            out[v] += sum((m[a] / sum(m.values()) * p[a] for a in m), np.zeros(3)) / 2
    y = np.maximum(out, 0) @ weights["output"].T
    y = np.exp(y) / np.exp(y).sum(axis=1, keepdims=True)
    got = {r.node: r.h for r in neural.hetero_gnn(x, edges, weights).collect()}
    assert all(np.allclose(got[v], y[v]) for v in range(4))


def test_trained_network_tells_two_groups(spark):
    rows = [(i, [float(i % 2), 1.0]) for i in range(40)]
    x = spark.createDataFrame(rows, "node long, h array<double>")
    edges = spark.createDataFrame([(i, (i + 2) % 40) for i in range(40)], "src long, dst long")
    wide = neural.neighbourhood_features(x, edges, 2, 1)
    model = neural.train(wide, spark.createDataFrame([(i, i % 2) for i in range(30)], "node long, label int"), 4, 2)
    assert all(r.prediction == r.node % 2 and r.confidence > 0.5 for r in neural.predict(wide, model).collect())


def test_analysis_over_two_events(spark):
    def event(shift):
        users = spark.createDataFrame([(f"e{shift}_{i}", f"some_long_name_{i}", "likes tea", f"http://a/{i}") for i in range(3)], "user_id string, username string, bio string, avatar_url string")
        posts = spark.createDataFrame([(f"e{shift}_{i}", f"2024-01-0{j + 1} 1{i}:00:00", "hello #tag", ["tag"]) for i in range(3) for j in range(3)], "user_id string, posted_at string, content string, hashtags array<string>").withColumn("posted_at", F.to_timestamp("posted_at"))
        return {"users": users, "posts": posts, "edges": spark.createDataFrame([(f"e{shift}_0", f"e{shift}_1"), (f"e{shift}_1", f"e{shift}_2")], "src string, dst string")}

    got = crossevent.analyze([event(1), event(2)])
    best = {(r.u1, r.u2): r.kind for r in got["matches"].collect()}
    assert {best[(f"e1_{i}", f"e2_{i}")] for i in range(3)} == {"same_username"}
    assert got["similarities"].first().similarity == 0 and got["roles"].count() == 6 and got["evolution"].first().users == 6
    assert got["assets"].select("node").distinct().count() == 6


def test_user_vector_has_all_families(spark):
    posts = spark.createDataFrame([(1, f"2024-01-0{i % 5 + 1} 0{i % 7}:00:00", "great day! #sun") for i in range(20)], "user_id long, posted_at string, content string").withColumn("posted_at", F.to_timestamp("posted_at"))
    users = spark.createDataFrame([(1, "bob1234", "Bob", None, None)], "user_id long, username string, display_name string, bio string, avatar_url string")
    v = vectors.user_vector(posts, users, spark.createDataFrame([(1, 0.5)], "user_id long, pagerank double"), lags=4)
    row = v.select(vectors.all_features(v).alias("m")).first().m
    assert row["network.pagerank"] == 0.5 and row["metadata.profile_completeness"] == 0.5 and row["metadata.pattern_ratio"] == 1.0
    assert {f"temporal.autocorrelation_{i}" for i in range(1, 5)} <= set(row) and row["temporal.daily_mean"] == 4.0


def test_growing_and_saved_filters(spark, tmp_path):
    f = ScalableBloomFilter(10, 1e-6)
    assert all(f.add(str(i)) for i in range(10)) and not f.add("3")
    for i in range(10, 60):
        f.add(str(i))
    assert all(str(i) in f for i in range(60)) and [x.capacity for x in f.filters][:2] == [10, 20] and f.filters[1].error == pytest.approx(0.9e-6)
    f.filters[0].save(spark, str(tmp_path / "f"))
    back = BloomFilter.load(spark, str(tmp_path / "f"))
    assert "3" in back and back.added == 10 and back.size == f.filters[0].size


def test_registry_and_limits(spark):
    r = monitoring.Registry()
    r.register("b", lambda: spark.range(1).select(F.lit(2).alias("value")), "two")
    r.register("a", lambda: spark.range(1).select(F.lit(1.5).alias("value")), "one", "s")
    assert r.export_prometheus() == "# HELP a one\na 1.5\n# HELP b two\nb 2.0\n"
    assert '"name":"a","value":1.5' in r.export_json()


def test_crawl_reads_a_folder(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"id": 1, "chat_id": 2, "text": "Hello #World"}\nnot json\n{"id": 2, "chat_id": 2, "text": "bye"}\n')
    raw = crawl.landed(spark, str(tmp_path))
    assert [r.post_id for r in crawl.crawl(raw, "telegram", query="hello").collect()] == ["2:1"]
    assert [r.post_id for r in crawl.hashtag(raw, "telegram", "world").collect()] == ["2:1"]
    assert crawl.crawl(raw, "telegram", post_ids=["2:2"], limit=5).count() == 1


def test_lists_are_trimmed(spark):
    row = spark.range(1).select(T.text_list(F.array(F.lit(" a0"), F.lit("a0 "), F.lit(" "), F.lit("b1"))).alias("x"), T.paired_hashtags(F.lit("# t0 # u # #")).alias("y")).first()
    assert row.x == ["a0", "b1"] and row.y == ["t0"]


def test_balances_between_two_scores_round_as_in_sql(spark, tmp_path):
    rows = [(i, f"Customer#{i}", 3, i / 100 * (-1) ** i, "BUILDING") for i in range(50, 1_000_000, 100)]
    spark.createDataFrame(rows, "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").write.parquet(str(tmp_path / "customer.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet/*.parquet'")
    want = {r[0]: r[1:] for r in con.execute(catalog.ORACLE_SQL["reuse_score"]).fetchall()}
    assert {r["u1"]: (r["score"], r["kind"]) for r in catalog.QUERIES["reuse_score"](spark, str(tmp_path)).collect()} == want


def test_attributes_meet_as_all_pairs_do(spark):
    rng = random.Random(4)
    name = lambda: "".join(rng.choice("abC1") for _ in range(rng.randrange(0, 9)))
    user = lambda i: (i, name() or None, rng.choice([None, "", "red blue", "Blue", "green"]), rng.choice([None, None, "x.png", "y.png"]))
    kind = "user_id long, username string, bio string, avatar_url string"
    one, two = [user(i) for i in range(60)] + [(900, "ab1cd2ef", None, None)], [user(100 + i) for i in range(60)] + [(901, "ab3cd4ef", None, None)]
    every = spark.createDataFrame(one, kind).crossJoin(spark.createDataFrame(two, "v long, name2 string, bio2 string, avatar2 string"))
    like = {(r["user_id"], r["v"]): r["s"] for r in every.select("user_id", "v", T.ratio("username", "name2").alias("s")).collect()}
    for least in (0.28, 0.2, 0.1):
        got = {(r["u1"], r["u2"]): r["attribute"] for r in crossevent.by_attributes(spark.createDataFrame(one, kind), spark.createDataFrame(two, kind), least).collect()}
        # pairs without two avatars: all of them are found
        for a in one:
            for b in two:
                if not (a[3] and b[3]):
                    x, y = (set((z[2] or "").lower().split()) for z in (a, b))
                    score = 0.3 * like[a[0], b[0]] + 0.3 * (len(x & y) / len(x | y) if x and y else 0.0)
                    assert ((a[0], b[0]) in got) == (score > least), (a, b)
        assert least > 0.2 or (900, 901) in got


def test_names_of_one_form_meet_only_where_they_can_pass(spark):
    u = spark.range(2000).selectExpr("id AS user_id", "format_string('Supplier#%09d', id) AS username", "CAST(NULL AS string) AS bio", "CAST(NULL AS string) AS avatar_url")
    names = u.select(F.lower("username").alias("low")).withColumn("size", F.length("low"))
    assert crossevent._met_by_names(names, names, 0.28, 3).count() < 2000 * 100
