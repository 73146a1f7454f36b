"""Edge rules of the analytics operators by hand, and the sources, sinks, sketches and streams."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from brindle.functions import text as T
from brindle.functions.bloom import BloomFilter
from brindle.operators import anomaly, crossevent, evidence, features, graph, monitoring, relational
from brindle.sources import parsers, sinks
from brindle.streaming import operators as streams

T0 = datetime(2024, 1, 1)


def series(spark, values):
    return spark.createDataFrame([("a", T0 + timedelta(hours=i), float(v)) for i, v in enumerate(values)], "k string, ts timestamp, v double")


def test_volume_spike_and_short_series(spark):
    import random

    rng = random.Random(1)
    values = [100 + rng.random() for _ in range(30)]
    values[20] = 500
    hits = [r.ts for r in anomaly.volume_anomaly(series(spark, values), ["k"], "ts", "v").collect() if r.is_anomaly]
    assert T0 + timedelta(hours=20) in hits
    assert not any(r.is_anomaly for r in anomaly.volume_anomaly(series(spark, [1, 2, 900]), ["k"], "ts", "v").collect())


def test_level_shift(spark):
    found = anomaly.level_shift(series(spark, [0.1] * 15 + [0.8] * 15), ["k"], "ts", "v", 5, 0.3)
    assert found.count() >= 1
    assert anomaly.level_shift(series(spark, [0.1] * 9), ["k"], "ts", "v", 5, 0.3).count() == 0


def test_sessions_merge_at_an_equal_gap(spark):
    rows = [("u", T0 + timedelta(seconds=s)) for s in (0, 3600, 7200, 10801)]
    got = anomaly.gap_sessions(spark.createDataFrame(rows, "u string, ts timestamp"), ["u"], "ts").collect()
    assert [(r["size"], r.time_span) for r in got] == [(3, 7200.0)]


def test_bot(spark):
    posts = spark.createDataFrame([("b", T0 + timedelta(hours=i), "same") for i in range(20)], "user_id string, posted_at timestamp, content string")
    users = spark.createDataFrame([("b", 10, 5000)], "user_id string, followers_count long, following_count long")
    r = anomaly.bot_score(posts, users).first()
    assert abs(r.score - 0.8) < 1e-9 and r.is_bot


def test_planted_outliers(spark):
    import random

    rng = random.Random(42)
    rows = [(i, *(rng.gauss(0, 1) for _ in range(3))) for i in range(200)] + [(1000 + i, *(rng.gauss(10, 1) for _ in range(3))) for i in range(10)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double")
    cols = ["a", "b", "c"]
    forest = anomaly.IsolationForest(trees=30, contamination=0.05).fit(df, cols).transform(df)
    for flagged in (anomaly.z_scores(df, cols), anomaly.mahalanobis(df, cols), forest):
        got = {r.id for r in flagged.collect() if r.is_anomaly}
        assert any(i >= 1000 for i in got)


def mini(spark):
    edges = [("a", "b", 1), ("b", "a", 1), ("b", "c", 2), ("c", "d", 1), ("d", "d", 1), ("e", "f", 1)]
    return spark.createDataFrame(edges, "src string, dst string, weight long")


def test_graph_by_hand(spark):
    g = mini(spark)
    assert abs(sum(r["rank"] for r in graph.pagerank(g, rounds=15).collect()) - 1) < 1e-9
    assert graph.shortest_path(g, "a", "d") == ["a", "b", "c", "d"] and graph.shortest_path(g, "d", "a") == []
    assert {(r.src, r.dst) for r in graph.bridges(g).collect()} == {("a", "b"), ("b", "c"), ("c", "d"), ("e", "f")}
    assert {r.node: r.component for r in graph.components(g).collect()} == {"a": "a", "b": "a", "c": "a", "d": "a", "e": "e", "f": "e"}
    assert {r.node: r.core for r in graph.core_numbers(g).collect()} == dict.fromkeys("abcdef", 1)
    assert {r.node: r.level for r in graph.levels(g, "a").collect()} == {"a": 0, "b": 1, "c": 2, "d": 3}
    between = {r.node: r.betweenness for r in graph.betweenness(g, normalized=False).collect()}
    assert between["b"] == 2 and between["c"] == 2 and between["a"] == 0
    tri = spark.createDataFrame([(1, 2, 1), (2, 3, 1), (3, 1, 1), (3, 4, 1)], "src long, dst long, weight long")
    assert {r.node: (r.triangles, round(r.clustering, 6)) for r in graph.clustering(tri).collect()} == {1: (1, 1.0), 2: (1, 1.0), 3: (1, 0.333333), 4: (0, 0.0)}
    assert {r.node: r.core for r in graph.core_numbers(tri).collect()} == {1: 2, 2: 2, 3: 2, 4: 1}


def test_text(spark):
    rows = [("Hi #Tag1 #été @me https://Ex.com/A/#x <b>bold</b> \U0001f600",), ("",), (None,)]
    df = spark.createDataFrame(rows, "t string")
    r = df.select(T.hashtags(F.col("t")).alias("h"), T.mentions(F.col("t")).alias("m"), T.urls(F.col("t")).alias("u"), T.clean(F.col("t")).alias("c")).collect()
    assert r[0].h[:2] == ["Tag1", "été"] and r[0].m == ["me"] and r[0].u == ["https://ex.com/A"] and r[0].c == "Hi bold"
    assert r[1].h == [] and r[2].h is None
    sims = spark.createDataFrame([("hello world", "hello world"), ("abc", ""), ("kitten", "sitting")], "a string, b string").select(T.ratio("a", "b").alias("r"), T.lcs("a", "b").alias("l")).collect()
    assert sims[0].r == 1 and sims[1].r == 0 and abs(sims[2].l - 4 / 7) < 1e-9
    counts = spark.createDataFrame([("1.2万",), ("3,456",), ("2亿",), ("none",)], "t string").select(T.count_text(F.col("t")).alias("n")).collect()
    assert [c.n for c in counts] == [12000, 3456, 200000000, 0]


def test_autocorrelation_and_frequency_edges(spark):
    one = spark.createDataFrame([("u", T0)], "user_id string, posted_at timestamp")
    assert features.post_frequency(one).first()[1:] == (1.0, 0.0, 0.0)
    assert features.autocorrelation(one).count() == 0


def test_upsert_takes_the_latest(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "id long, name string, n long")
    new = spark.createDataFrame([(2, "x", 5, 1), (2, "y", None, 2), (3, "z", 9, 1)], "id long, name string, n long, at long")
    got = {r.id: (r.name, r.n) for r in relational.upsert(old, new, ["id"], arrival="at").collect()}
    assert got == {1: ("a", 1), 2: ("y", None), 3: ("z", 9)}
    assert relational.insert_new(old, new, ["id"], "at").count() == 3


def test_alert_fires_once_after_the_duration(spark):
    df = series(spark, [0, 9, 9, 9, 0, 9])
    got = monitoring.alerts(df, ["k"], "ts", "v", ">", 5, 3600).collect()
    assert [(r.start, r.fired_at) for r in got] == [(T0 + timedelta(hours=1), T0 + timedelta(hours=2))]


def test_token_bucket(spark):
    rows = [("k", T0 + timedelta(seconds=s), i) for i, s in enumerate((0, 0, 0, 1))]
    got = monitoring.token_bucket(spark.createDataFrame(rows, "k string, ts timestamp, i long"), "k", "ts", "i", 1.0, 2.0)
    assert [r.allowed for r in got.orderBy("i").collect()] == [True, True, False, True]


def test_evidence_kinds(spark):
    df = spark.createDataFrame([("sentiment_mean",), ("avatar_similarity_count",), ("pagerank",), ("other",)], "f string")
    assert [r[0] for r in df.select(evidence.kind_of(F.col("f"))).collect()] == ["temporal", "content", "network", "behavioral"]


def test_snapshots(spark):
    n = lambda x: spark.createDataFrame([(i,) for i in x], "node long")
    e = lambda x: spark.createDataFrame(x, "src long, dst long")
    r = crossevent.snapshot_similarity(n([1, 2, 3, 4]), e([(1, 2), (2, 3)]), n([2, 3, 4, 5]), e([(2, 3)])).first()
    assert abs(r.similarity - (0.6 * 3 / 5 + 0.4 * 0.5)) < 1e-9


def test_parsers_skip_bad_lines(spark):
    tweet = {"id": "1", "author_id": "7", "text": "x", "created_at": "2024-01-01T00:00:00Z", "entities": {"hashtags": [{"tag": "a"}]}, "includes": {"users": [{"id": "7", "username": "bob"}]}, "referenced_tweets": [{"type": "retweeted", "id": "9"}]}
    weibo = {"mid": "5", "user": {"id": "2", "screen_name": "n"}, "text": "<b>#t# hi</b>", "created_at": "Mon Jan 01 10:00:00 +0800 2024"}
    raw = spark.createDataFrame([(json.dumps(tweet),), ("{bad",), (json.dumps(weibo),)], "value string")
    got = parsers.tweets(raw).collect()
    assert [(r.post_id, r.author, r.is_retweet, r.hashtags) for r in got] == [("1", "bob", True, ["a"])]
    w = next(r for r in parsers.weibo_posts(raw).collect() if r.post_id == "5")
    assert w.hashtags == ["t"] and w.posted_at is not None


def test_sinks(spark, tmp_path):
    df = spark.range(5)
    for kind in ("csv", "json", "parquet"):
        sinks.export(df, f"{tmp_path}/x.{kind}")
    assert spark.read.parquet(f"{tmp_path}/x.parquet").count() == 5
    with pytest.raises(ValueError):
        sinks.export(df, f"{tmp_path}/x.zzz")
    sinks.write_graph(spark.range(2), mini(spark), f"{tmp_path}/g")
    assert sinks.read_graph(spark, f"{tmp_path}/g")[1].count() == 6


def test_bloom(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias("x"))
    b = BloomFilter.of(df, "x", 1000, 0.01)
    assert all(str(i) in b for i in range(1000))
    assert sum(str(i) in b for i in range(5000, 6000)) < 60
    assert df.where(b.contains("x")).count() == 1000


def test_stream_dedup_windows_and_dead_letters(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    rows = [{"id": str(i % 3), "payload": "p", "timestamp": f"2024-01-01T00:0{i}:00Z", "retry_count": 0} for i in range(6)]
    (src / "a.json").write_text("\n".join([json.dumps(r) for r in rows] + ["{bad"]))
    lines = streams.subscribe(spark, str(src))
    once = streams.first_seen(streams.messages(lines), "id", "timestamp")
    once.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c1").trigger(availableNow=True).start(str(out)).awaitTermination()
    assert spark.read.parquet(str(out)).count() == 3
    assert streams.rejected(spark.read.text(str(src))).count() == 1

    def fail(batch, _):
        raise RuntimeError("no")

    streams.consume(lines, fail, f"{tmp_path}/c2", f"{tmp_path}/dead", retries=1).awaitTermination()
    assert spark.read.json(f"{tmp_path}/dead").count() == 7
    keyed = streams.envelope(spark.range(3), "t", "kind", "id")
    streams_in = tmp_path / "q"
    keyed.select("value").write.text(str(streams_in))
    assert streams.messages(spark.read.text(str(streams_in))).count() == 3
