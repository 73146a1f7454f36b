"""The corpus operators against brute force, exact round trips and held-out accuracy, and on odd tables."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.llm import common, fingerprints, line_dedup, near_dup, neighbours, packing, quality, sentencepieces, suffix_dedup, toxicity, warc
from brindle.llm.components import components

P = pytest.importorskip("public_tokenizers")
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t) if t else 0) for i, t in rows], DOC)


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and blank texts, repeated rows, a shared passage, near copies, a long run, and a long text."""
    rng = random.Random(3)
    base, passage = prose(rng, 120), prose(rng, 80)
    words = base.split()
    near = " ".join(["x"] + words[1:])
    rows = [(None, base), (1, None), (2, ""), (3, "  \n "), (4, base), (4, base), (5, near), (6, prose(rng, 30) + passage + prose(rng, 30)), (7, passage + "é" + prose(rng, 9)), (8, "a" * 700), (9, prose(rng, 4000)), (10, "one"), (11, "One\n"), (12, prose(rng, 50) + "\n" + base)]
    return frame(spark, rows), rows


def test_suffix_dedup_equals_brute_force(spark, odd):
    docs, rows = odd
    got = suffix_dedup.deduplicate(docs).select("doc_id", "n_bytes", F.expr("aggregate(spans, 0L, (n, s) -> n + s.`end` - s.first)").alias("removed"), F.size("spans").alias("k"), F.sha2("kept", 256).alias("h")).collect()
    want = [(i, len((t or "").encode()), *b) for (i, t), b in zip(rows, suffix_dedup.brute_force([(t or "").encode() for _, t in rows], 200), strict=True)]
    assert Counter(map(tuple, got)) == Counter(want)


def test_suffix_cut_keeps_columns_and_valid_text(spark, odd):
    out = suffix_dedup.cut_texts(odd[0])
    assert out.columns == odd[0].columns
    for r in out.collect():
        assert r.text is None or r.n_chars == len(r.text)


def shingled(text, k):
    w = (text or "").encode().translate(near_dup.LOWER).split()
    return {tuple(w[i : i + k]) for i in range(max(len(w) - k + 1, 1))} if w else set()


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates_equal_brute_force(spark, odd, k):
    docs, rows = odd
    sets = [(i, shingled(t, k)) for i, t in rows if i is not None]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in sets:
        for j, b in sets:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    for r in near_dup.near_duplicates(docs, words=k).collect():
        if r.doc_id is None:
            assert r.kept and r.component_id is None
        else:
            assert r.component_id == find(r.doc_id) and r.kept == (r.doc_id == r.component_id)
            assert r.n_shingles == len(dict(sets)[r.doc_id])


def test_near_duplicates_compare_large_mixed_buckets(spark):
    """Variants of one text, most of them just under the threshold to each other: few pairs are links, and every bucket is large."""
    rng = random.Random(4)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(700):
        words = list(base)
        for j in rng.sample(range(120), rng.randint(8, 10)):
            words[j] = f"v{i}x{j}"
        rows.append((i, " ".join(words)))
    x = np.array([[w.startswith("w") for w in t.split()] for _, t in rows], dtype=np.int64)
    both = x @ x.T
    near = 100 * both >= 80 * (240 - both)
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in np.flatnonzero(near[i, :i]):
            a, b = root[i], root[j]
            if a != b:
                root = [min(a, b) if r in (a, b) else r for r in root]
    assert 100 < len(set(root)) < 650
    assert {r.doc_id: r.component_id for r in near_dup.near_duplicates(frame(spark, rows), words=1).collect()} == dict(enumerate(root))


def test_packing_places_every_piece_once(spark, odd):
    path = P.path("word_bpe_49k.json")
    got = packing.pack(odd[0], path, capacity=64).toPandas()
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    want = Counter()
    for i, t in odd[1]:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), 64)):
            import zlib

            part = np.array(ids[at : at + 64], dtype="<u4")
            want[(-1 if i is None else i, k, at, len(part), zlib.crc32(part.tobytes()))] += 1
    assert Counter(zip(got.doc_id.fillna(-1).astype(int), got.piece, got.start, got.length, got.ids_crc32, strict=True)) == want
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s.length.sum() <= 64 and (s.offset == s.length.cumsum() - s.length).all()
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 64) + 1


def test_word_bpe_equals_the_library():
    import pyarrow as pa
    from tokenizers import Tokenizer

    from brindle.llm.tokens import WordBpe

    path = P.path("word_bpe_49k.json")
    texts = ["", " ", "it's <|endoftext|> x", "ÀÉ ß İstanbul ΣΑΣ 中文", "don't I'LL we're'''s 123 a\x85b ﬁ ½", "é tab\there\nnew", "Hello, WORLD!! $$$ 3.14"] * 2
    tok, own = Tokenizer.from_file(path), WordBpe(path)
    for i, ids in own.batches(pa.array(texts)):
        assert ids.tolist() == tok.encode(texts[i], add_special_tokens=False).ids


def test_completion_reaches_the_bound():
    plan = packing.Completion({1200: 5, 848: 5, 2048: 2, 1000: 4, 24: 4, 1024: 4}, 2048).solve()
    assert sum(n for _, n in plan) == 11
    assert all(sum(k * v for k, v in f.items()) <= 2048 for f, _ in plan)


def test_sentencepieces_equal_the_library(spark, odd):
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = [*odd[1], (20, "Hello  world\n foo é 中文 \U0001f600 "), (21, " lead"), (22, "the the the of of")]
    docs = frame(spark, rows)
    got = sentencepieces.encode(docs, path).collect()
    assert Counter((r.doc_id, tuple(r.ids), r.decoded) for r in got) == Counter((i, tuple(sp.encode(t or "")), t or "") for i, t in rows)


def test_warc_round_trip_with_magic_in_payloads(spark):
    inner = "WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    long = "x" * 150
    rows = [(1, "u1", "a" + inner * 3), (2, "u2", long), (3, "u3", long), (4, "u4", None), (5, "u5", ""), (6, "u6", inner), (7, None, "é" * 60), (8, "u8", "é" * 60), (9, "u9", inner + "tail")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = common.new_path(spark, "test")
    warc.write_archive(pages, path, records_a_file=4)
    got = {warc_id(r.record_id): r for r in warc.read_archive(spark, path).collect()}
    assert sorted(got) == list(range(1, 10))
    for i, _, html in rows:
        body = (html or "").encode()
        twin = {3: 2, 8: 7}.get(i)
        assert got[i].record_type == ("revisit" if twin else "response")
        assert got[i].digest == hashlib.sha256(body).hexdigest()
        assert bytes(got[i].payload) == (b"" if twin else body)
        assert warc_id(got[i].refers_to) == twin


def test_warc_reads_on_after_a_long_header(spark):
    rows = [(1, "u1", "a"), (2, "data:," + "x" * 70000, "b"), (3, "u3", "c"), (4, "u4", "d")]
    path = common.new_path(spark, "test")
    warc.write_archive(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), path)
    got = {warc_id(r.record_id): (r.target_uri, bytes(r.payload).decode()) for r in warc.read_archive(spark, path).collect()}
    assert got == {i: (u, h) for i, u, h in rows}


def warc_id(urn):
    return int(urn.rsplit(":", 1)[1].rstrip(">")) if urn else None


def test_neighbours_find_what_brute_force_finds(spark):
    rng = np.random.default_rng(5)
    vecs = rng.normal(size=(400, 16)).round(3)
    rows = [(i, v.tolist()) for i, v in enumerate(vecs)] + [(1000 + i, vecs[0].tolist()) for i in range(9)]
    bad = [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16), (2003, [float("inf")] + [1.0] * 15), (2004, [None] + [1.0] * 15), (2005, [1.0, 2.0]), (None, [1.0] * 16)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>")
    got = neighbours.nearest(df, F.col("vec_id") % 50 == 0, cell_rows=64).collect()
    x = {i: np.float32(v).astype(float) for i, v in rows}
    hit = total = 0
    for q in (i for i in x if i % 50 == 0):
        best = sorted((-(x[q] @ v) / np.sqrt(x[q] @ x[q]) / np.sqrt(v @ v), i) for i, v in x.items() if i != q)
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [r for r, _, _ in mine] == [1, 2, 3, 4, 5]
        hit += len({i for _, i, _ in mine} & {i for _, i in best[:5]})
        total += 5
        assert all(abs(s + next(b for b, j in best if j == i)) < 1e-12 for _, i, s in mine)
    assert hit / total >= 0.9
    assert [r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == 0] == [1000, 1001, 1002, 1003, 1004]
    assert neighbours.nearest(df.limit(0), F.lit(True)).count() == 0


def test_fingerprints(spark):
    texts = ["É  café\n x", "é CAFÉ x ", "é café x", "other", None, "", "ﬁn ＡＢ", "fin ab"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    f = {r.doc_id: r.fingerprint for r in fingerprints.fingerprints(docs).collect()}
    assert f[0] == f[1] == f[2] and f[4] == f[5] and f[6] == f[7] and len(set(f.values())) == 4
    nxt = {(r.doc_id, r.text): r.next for r in fingerprints.with_next(docs, rows_a_range=2).collect()}
    full = [t or "" for t in texts]
    assert nxt == {(i, full[i]): full[i - 1] for i in range(len(full))}


def test_line_dedup(spark):
    rng = random.Random(9)
    a, b = prose(rng, 30), prose(rng, 30)
    almost = a.split()
    almost[4] = "changed"
    rows = [(1, f"{a}\nshort\n{b}"), (2, f"short\n{' '.join(almost)}"), (3, f"  {b.upper()}  "), (4, None), (5, ""), (6, prose(rng, 30))]
    got = {r.doc_id: r for r in line_dedup.deduplicate(frame(spark, rows)).collect()}
    assert got[1].text == rows[0][1] and got[1].n_removed == 0
    assert got[2].text == "short" and got[2].n_removed == 1 and got[2].n_chars == 5
    assert got[3].text == "" and got[4].text is None and got[5].text == "" and got[6].text == rows[5][1]


def line_roots(lines):
    """The first line of each line's component, by brute force."""
    sets = [{s[i : i + 5] for i in range(max(len(s) - 4, 1))} for s in lines]
    root = list(range(len(lines)))
    for i in range(len(lines)):
        for j in range(i):
            if root[i] != root[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return root


def kept_lines(spark, lines, **options):
    docs = frame(spark, list(enumerate(lines)))
    return {r.doc_id for r in line_dedup.deduplicate(docs, **options).collect() if not r.n_removed}


def edited(rng, line, n):
    """line with n characters changed to ones that occur nowhere else."""
    out = list(line)
    for i in rng.sample(range(len(out)), n):
        out[i] = chr(rng.randint(0x4E00, 0x9F00))
    return "".join(out)


def test_line_dedup_finds_scattered_edits(spark):
    """Pairs at a Jaccard of about 0.8 to 0.85, long and short, with and without spaces."""
    rng = random.Random(11)
    lines = []
    for i in range(120):
        base = prose(rng, rng.choice((25, 60, 150)))
        base = base.replace(" ", "-") if i % 2 else base
        lines += [base, edited(rng, base, max(1, len(base) // 50))]
    root = line_roots(lines)
    assert len(set(root)) < 190
    assert kept_lines(spark, lines) == set(root)


def test_line_dedup_finds_edits_at_the_starts_of_words(spark):
    """Pairs of 60 words of 12 letters, of which 16 differ in their first letter: a Jaccard of 0.81 of all shingles, of far less at word starts."""
    rng = random.Random(13)
    lines = []
    for _ in range(100):
        words = ["".join(rng.choice("abcdefghijklmnopqrstuvw") for _ in range(12)) for _ in range(60)]
        lines.append(" ".join(words))
        for i in rng.sample(range(60), 16):
            words[i] = rng.choice("xyz") + words[i][1:]
        lines.append(" ".join(words))
    root = line_roots(lines)
    assert len(set(root)) == 100
    assert len(kept_lines(spark, lines)) <= 105


def test_line_sketches_lose_no_links(spark):
    """Sets at a Jaccard of exactly 0.8, up to the longest lines: the share of their least hashes stays over the limit."""
    rng = np.random.default_rng(14)
    size = line_dedup.SKETCH
    for n in (20, 100, 1000):
        failed = 0
        for _ in range(4000):
            h = rng.permutation(n)
            one, two = np.sort(h[: n * 9 // 10])[:size], np.sort(h[n // 10 :])[:size]
            failed += len(np.intersect1d(one, two)) < line_dedup.SHARE * max(len(one), len(two))
        assert failed <= 2


def test_least_hashes(spark):
    """The bound changes nothing: repeated shingles, short, long and empty lines."""
    rng = random.Random(15)
    lines = ["", "abc", "abcdefgh", "ab" * 4000, prose(rng, 900), "z" * 5000 + prose(rng, 10), prose(rng, 20)]
    frame_ = spark.createDataFrame([(x,) for x in lines], "norm string")
    every = F.slice(F.sort_array(F.array_distinct(line_dedup.place_hashes(F.col("norm"), 5))), 1, 64)
    assert all(r.a == r.b and r.a for r in frame_.select(line_dedup.least_hashes(F.col("norm"), 5, 64).alias("a"), every.alias("b")).collect())


def test_line_dedup_compares_mixed_buckets(spark):
    """Variants of one line, most of them just under the threshold to each other."""
    rng = random.Random(12)
    base = prose(rng, 60)
    lines = [edited(rng, base, rng.randint(4, 6)) for _ in range(200)]
    root = line_roots(lines)
    assert 5 < len(set(root)) < 190
    assert kept_lines(spark, lines) == set(root)


def test_line_dedup_of_runs_and_short_lines(spark):
    """Equal sets of shingles at any length, and short lines by equality."""
    lines = ["-" * 30, "-" * 90, "ha " * 10, "ha " * 100, "}", " } ", "\t", "\t", "", "return", "Return"]
    assert kept_lines(spark, lines, short=True) == {0, 2, 4, 6, 7, 8, 9}


def test_classifiers_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"  # several hundred held-out rows; the smallest table has 19
    for got, label, least in ((quality.op2_quality(spark, sf), "quality", 0.95), (toxicity.op9_toxicity(spark, sf), "toxic", 0.95)):
        pdf = got.toPandas().merge(common.table(spark, sf, "labels").toPandas(), on="doc_id")
        held = pdf[pdf.held_out]
        assert len(held) and pdf.score.between(0, 1).all() and (pdf.predicted == (pdf.score >= 0.3)).all()
        assert (held.predicted == held[label]).mean() >= least


def test_classifiers_without_labels_or_rows(spark, odd):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for fn in (quality.classify, toxicity.classify):
        assert {round(r.score, 9) for r in fn(odd[0], none).collect()} == {0.5}
        assert fn(odd[0].limit(0), none).count() == 0


def test_empty_tables(spark):
    docs = spark.createDataFrame([], DOC)
    assert suffix_dedup.cut_texts(docs).count() == 0
    assert near_dup.keep_one(docs).count() == 0
    assert line_dedup.deduplicate(docs).count() == 0
    assert packing.pack(docs, P.path("word_bpe_49k.json")).count() == 0
    assert fingerprints.with_next(docs).count() == 0


def test_machine_learns_an_interaction():
    rng = np.random.default_rng(0)
    rows = [np.flatnonzero(rng.random(6) < 0.5) for _ in range(3000)]
    y = np.array([float(0 in r and 1 in r) for r in rows])
    fm = toxicity.FactorizationMachine(epochs=30).fit(rows, y, np.arange(6))
    s = fm.scores(rows)
    assert s[y == 1].min() > s[y == 0].max()


def test_additive_model_learns_a_pair():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    m = quality.AdditiveModel(rounds=30, pair_rounds=60).fit(x, y)
    assert ((m.scores(x) > 0.5) == (y == 1)).mean() > 0.9


def test_components_take_few_steps(spark, monkeypatch):
    """Stars settle in two rounds, and links that come later only join the components that are known."""
    steps, write = [], common.stored
    monkeypatch.setattr(common, "stored", lambda df, what="step": (steps.append(what), write(df, what))[1])
    nodes = spark.range(400).select(F.col("id").alias("doc_id"))
    star = spark.range(1, 400).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b")).where("b % 2 = 0")
    known = write(components(star, nodes))
    assert steps == ["stars"]
    chain = [(2 * i, 2 * i + 1) for i in range(100)] + [(301, 303), (303, 303), (5, 301)]
    got = {r.doc_id: r.component for r in components(spark.createDataFrame(chain, "a long, b long"), nodes, known).collect()}
    assert len(steps) <= 5
    assert got == {i: 0 if i % 2 == 0 or i < 200 or i in (301, 303) else i for i in range(400)}
    path = spark.range(399).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert components(path, nodes).agg(F.max("component")).first()[0] == 0
