"""Cases that earlier versions of the corpus operators got wrong."""

import unicodedata

import numpy as np
from pyspark.sql import functions as F

from brindle.llm import common, fingerprints, line_dedup, neighbours, sentencepieces, suffix_dedup


def test_neighbours_of_scaled_copies_go_by_id(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(-40, 40, 24).astype(float)
    rows = [(50, base.tolist())] + [(51 + i, (base * (i + 2)).tolist()) for i in range(48)] + [(200 + i, rng.normal(size=24).tolist()) for i in range(600)]
    df = spark.createDataFrame(rows[::-1], "vec_id long, embedding array<double>")
    got = [(r["rank"], r["vec_id"], r["score"]) for r in neighbours.nearest(df, F.col("vec_id") == 50, cell_rows=64).orderBy("rank").collect()]
    alone = lambda v: float((v * base).sum() / (np.sqrt((v * v).sum()) * np.sqrt((base * base).sum())))
    best = sorted((-alone(np.array(v)), i) for i, v in rows if i != 50)[:5]
    assert [(i, s) for _, i, s in got] == [(i, -s) for s, i in best]
    assert all(s <= 1 + 1e-15 for _, _, s in got)


def test_fingerprints_fold_case_fully(spark):
    pairs = [("Straße ẞ", "STRASSE ss"), ("ΟΔΟΣ ΟΔΟΣ.", "οδοσ οδος."), ("ﬁne ŉ", "FINE ʼN"), ("ǰ", "J̌"), ("Ꭰ ꭰ", "ꭰ Ꭰ")]
    rows = spark.createDataFrame([(a, b) for a, b in pairs], "a string, b string").select(fingerprints.canonical(F.col("a")).alias("a"), fingerprints.canonical(F.col("b")).alias("b")).collect()
    assert all(r["a"] == r["b"] for r in rows), rows
    full = lambda t: unicodedata.normalize("NFKD", unicodedata.normalize("NFKD", t.casefold()).casefold())
    assert all(full(a) == full(b) for a, b in pairs)


def test_ranges_of_repeated_rows_are_kept_once(spark):
    r = np.random.default_rng(1)
    text = "".join(chr(97 + c) for c in r.integers(0, 26, 2400))
    df = spark.createDataFrame([(7, text)] * 50 + [(8, "x" + text)], "doc_id long, text string")
    one = suffix_dedup.repeated_ranges(df.dropDuplicates())
    many = suffix_dedup.repeated_ranges(df)
    most = lambda d: d.agg(F.max(F.size("ranges"))).first()[0]
    assert most(many) <= most(one) + 2
    assert {x["doc_id"]: x["text"] for x in suffix_dedup.cut_texts(df).collect()} == {8: "x"}


def test_the_labelled_sample_has_a_row_an_id(spark):
    docs = spark.createDataFrame([(1, f"t{i}") for i in range(500)] + [(2, None), (3, "c")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None)], "doc_id long, quality int")
    rows = common.labelled_sample(docs, labels, "quality", F.lit(True), 5).collect()
    assert len(rows) == 2 and sorted((x["y"], x["text"]) for x in rows) == [(0, None), (1, "t0")]


def test_substrings_are_joined_without_broadcasts(spark, monkeypatch):
    r = np.random.default_rng(2)
    text = lambda n: "".join(chr(97 + c) for c in r.integers(0, 26, n))
    same = text(600)
    df = spark.createDataFrame([(1, same + text(300)), (2, text(100) + same), (3, same), (4, text(900))], "doc_id long, text string")
    plans, stored = [], common.stored
    plan = lambda d: plans.append(d._jdf.queryExecution().executedPlan().toString())
    monkeypatch.setattr(common, "stored", lambda d, what="step": (plan(d), stored(d, what))[1])
    for done in (suffix_dedup.cut_texts(df), suffix_dedup.deduplicate(df)):
        plan(done)
        assert done.count()
    assert not any("BroadcastHashJoin" in p for p in plans)
    assert sum("SortMergeJoin" in p for p in plans) >= 6


def test_lines_just_under_the_threshold_make_few_pairs(spark, monkeypatch):
    """A family of lines at Jaccard similarities of about 0.7: what meets in mixed buckets is told apart where it meets."""
    r = np.random.default_rng(21)
    word = lambda: "".join(chr(97 + c) for c in r.integers(0, 26, 6))
    base = [word() for _ in range(60)]
    lines = [" ".join(word() if i in edits else w for i, w in enumerate(base)) for edits in (set(r.choice(60, 5, replace=False).tolist()) for _ in range(150))]
    made, stored = [], common.stored
    monkeypatch.setattr(common, "stored", lambda df, what="step", **o: (out := stored(df, what, **o), made.append((what, out.count())) if what == "pairs" else None)[0])
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    kept = sum(x["n_removed"] == 0 for x in line_dedup.deduplicate(docs).collect())
    sets = [{x[i : i + 5] for i in range(len(x) - 4)} for x in lines]
    close = sum(100 * len(a & b) >= 80 * len(a | b) for i, a in enumerate(sets) for b in sets[:i])
    assert kept > 100 and made[-1][1] <= 5 * close + 200, (kept, close, made)


def test_odd_sketches_lose_no_links(spark):
    """Of lines of all lengths with more and more edits every pair that is linked could be, and few are that are far from it."""
    r = np.random.default_rng(22)
    text = lambda n: "".join(chr(97 + c) for c in r.integers(0, 26, n))
    pairs = []
    for n in (20, 60, 300, 1200, 6000):
        for share in (0.0, 0.01, 0.02, 0.022, 0.025, 0.03, 0.05, 0.1):
            one = text(n)
            at = set(r.choice(n, int(share * n), replace=False).tolist())
            pairs.append((one, "".join("#" if i in at else c for i, c in enumerate(one))))
    pairs += [("ab" * 400, "ab" * 390 + "cd" * 10), ("z" * 50, "z" * 5000), ("abc", "abc"), (text(100) * 30, text(100))]
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i long, x string, y string")
    side = lambda c: line_dedup.odd_sketches(rows.select(F.col("i").alias("lid"), F.col(c).alias("norm")), 5).select(F.col("lid").alias("i"), F.col("n").alias("n" + c), F.col("odd").alias("o" + c))
    got = {x["i"]: x["could"] for x in side("x").join(side("y"), "i").select("i", line_dedup.could_link(80).alias("could")).collect()}
    sets = lambda t: {t[i : i + 5] for i in range(max(1, len(t) - 4))}
    likeness = [len(sets(x) & sets(y)) / len(sets(x) | sets(y)) for x, y in pairs]
    assert sum(j >= 0.8 for j in likeness) > 15
    assert all(got[i] for i, j in enumerate(likeness) if j >= 0.8)
    assert not any(got[i] for i, j in enumerate(likeness) if j < 0.6 and len(pairs[i][0]) < 2000)


def test_equal_lines_are_signed_once_and_texts_travel_for_near_pairs_only(spark, monkeypatch):
    """Of 40 different lines, each ten times, 40 signatures; of lines at a Jaccard of about 0.6, which share buckets, no pair is compared by its texts."""
    r = np.random.default_rng(23)
    text = lambda n: "".join(chr(97 + c) for c in r.integers(0, 26, n))
    base = text(400)
    far = ["".join("#" if i in at else c for i, c in enumerate(base)) for at in (set(r.choice(400, 12, replace=False).tolist()) for _ in range(20))]
    lines = [text(int(n)) for n in r.integers(20, 900, 20)] + far
    rows, stored = {}, common.stored
    monkeypatch.setattr(common, "stored", lambda df, what="step", **o: (out := stored(df, what, **o), rows.setdefault(what, []).append(out.count()))[0])
    docs = spark.createDataFrame(list(enumerate(lines * 10)), "doc_id long, text string")
    assert sum(x["n_removed"] == 0 for x in line_dedup.deduplicate(docs).collect()) == 40
    assert rows["signatures"] == [40]
    assert rows["edges"][0] > 0 and sum(rows["near"]) == 0, rows


def test_odd_sketches_are_as_long_as_lines_need(spark):
    """Twice as many bits as shingles at least, up to 2,048; sketches of two lengths are compared as if the longer one had been made shorter."""
    r = np.random.default_rng(24)
    text = lambda n: "".join(chr(97 + c) for c in r.integers(0, 26, n))
    pairs = [(one := text(n), one + text(n // 6)) for n in (20, 60, 64, 120, 130, 230, 250, 450, 500, 516, 600)]
    pairs += [(text(n), text(n)) for n in (60, 300, 900)] + [(text(500), text(530))]
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i long, x string, y string")
    side = lambda c: line_dedup.odd_sketches(rows.select(F.col("i").alias("lid"), F.col(c).alias("norm")), 5).select(F.col("lid").alias("i"), F.col("n").alias("n" + c), F.col("odd").alias("o" + c))
    got = {g.i: g for g in side("x").join(side("y"), "i").select("*", line_dedup.could_link(80).alias("could")).collect()}
    for i, g in got.items():
        assert len(g.ox) == min(32, max(2, 2 ** int(np.ceil(np.log2(g.nx / 32))))) and len({x[j : j + 5] for x in [pairs[i][0]] for j in range(len(x) - 4)}) == g.nx
        assert g.could == (i < 11), i
    assert sum(len(g.ox) != len(g.oy) for g in got.values()) >= 4


def test_a_query_takes_few_steps_and_meets_every_point():
    rng = np.random.default_rng(5)
    tree, q = neighbours.KdTree(rng.normal(size=(20_000, 8))), rng.normal(size=8)
    far, steps, last = ((tree.points - q) ** 2).sum(axis=1), list(tree.nearing(q)), 0.0
    assert len(steps) <= 8
    assert sorted(np.concatenate([ids for ids, _ in steps]).tolist()) == list(range(20_000))
    for ids, bound in steps:
        assert (far[ids] >= last).all() and (far[ids] <= bound).all()
        last = bound


def test_merging_looks_up_each_place_few_times():
    import public_tokenizers

    class Counted(dict):
        n = 0

        def get(self, *a):
            Counted.n += 1
            return super().get(*a)

    def plain(unit):
        parts = list(unit)
        while scores := {-i: m.rank[x + y][0] for i, (x, y) in enumerate(zip(parts, parts[1:], strict=False)) if x + y in m.rank}:
            at = -max(scores, key=lambda i: (scores[i], i))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [i for p in parts for i in ([m.rank[p][1]] if p in m.rank else [m.bytes[b] for b in p.encode()])]

    m = sentencepieces.Model(public_tokenizers.path("piece_bpe_32k.model"))
    r = np.random.default_rng(8)
    units = ["▁", "▁▁▁", "▁x", "▁thethethe", "▁aaaaaaaaa\nb"] + ["▁" + "".join(r.choice(list("etaoinshr,\né5"), r.integers(1, 30))) for _ in range(300)]
    for unit in units:
        assert np.frombuffer(m.merged(unit), dtype=np.uint32).tolist() == plain(unit), unit
    m.rank, m.score = Counted(m.rank), Counted({p: s for p, (s, _) in m.rank.items()}).get
    m.merged("▁" + "theinandon" * 20)
    assert 0 < Counted.n < 5 * 201
