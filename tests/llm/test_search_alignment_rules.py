"""Lexical search, tokenizer alignment and quality rules: SQL or brute force over whole tables, and odd rows."""

import hashlib
import math
import random
import re
from collections import Counter
from itertools import accumulate

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from brindle.llm import alignment, lexical, quality_rules
from brindle.llm.tokens import byte_names

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


# ---- search


def ranked(docs, items, k):
    """All scores, then the best: (item, rank, doc, score)."""
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    tfs = [(i, Counter(find(t))) for i, t in docs]
    tfs = [(i, c) for i, c in tfs if c]
    n, length, df = len(tfs), sum(sum(c.values()) for _, c in tfs), Counter(t for _, c in tfs for t in c)
    out = []
    for item, text in items:
        own = Counter(find(text))
        scored = []
        for i, c in tfs:
            m = 75 + 25 * sum(c.values()) * n // length
            s = sum(r * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, r in own.items() if t in c)
            if s > 0:
                scored.append((-s, i is None, i if i is not None else 0, i))
        out += [(item, rank, x[3], -x[0]) for rank, x in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


DOCS = "doc_id long, text string, score long, rank string"
ITEMS = "item_id long, text string, q int"


def test_search_equals_all_scores(spark, monkeypatch):
    r = random.Random(3)
    words = ["the", "a", "Élan", "été", "x1", "straße", "日本", "B", "b", "zz", "Q9"] + [f"w{i}" for i in range(40)]
    docs = [(i, r.choice([" ", ", ", "\n"]).join(r.choice(words[: r.choice([3, 11, 51])]) for _ in range(r.choice([1, 5, 80]))), 1, "x") for i in range(300)]
    docs += [(300 + i, docs[7][1], 1, "x") for i in range(60)]  # copies: ties by id
    docs += [(None, docs[7][1], 1, "x"), (7, docs[7][1], 1, "x"), (400, None, 1, "x"), (401, "", 1, "x"), (402, " !? ", 1, "x"), (403, "w1 " * 30_000, 1, "x")]
    items = [(i, " ".join(r.choice(words) for _ in range(12)), 0) for i in range(25)] + [(25, None, 0), (26, "", 0), (27, "nowhere", 0), (28, docs[7][1], 0), (28, docs[7][1], 0)]
    for cells, block in ((300, 7), (8_000_000, 2000)):  # many small shards and blocks, or one
        monkeypatch.setattr(lexical, "BLOCK", block)
        got = lexical.search(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(items, ITEMS), 20)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        assert sorted(map(tuple, got.collect()), key=repr) == ranked([d[:2] for d in docs], [i[:2] for i in items], 20)
    assert lexical.search(spark.createDataFrame([], DOCS), spark.createDataFrame(items, ITEMS)).count() == 0
    assert lexical.search(spark.createDataFrame(docs, DOCS), spark.createDataFrame([], ITEMS)).count() == 0


def test_threshold_stops_early_and_only_strictly_below():
    rng = np.random.default_rng(1)
    doc, term = np.nonzero(rng.random((5000, 6)) < 0.5)
    impact = rng.integers(1, 1000, len(doc)) ** 2
    shard, table = lexical.Shard(np.arange(5000), np.zeros(5000, dtype=bool), doc, term, impact, 6), np.zeros((5000, 6), dtype=np.int64)
    table[doc, term] = impact
    best, weights = lexical.Best(20), np.array([3, 1, 2], dtype=np.int64)
    scored = shard.search(np.array([0, 2, 5]), weights, best)
    want = np.lexsort((np.arange(5000), -(table[:, [0, 2, 5]] @ weights)))[:20]
    assert best.ids.tolist() == want.tolist() and scored < 2500
    tied = lexical.Shard(np.arange(500)[::-1].copy(), np.zeros(500, dtype=bool), np.arange(500), np.zeros(500, dtype=np.int64), np.full(500, 9), 1)
    best = lexical.Best(20)
    assert tied.search(np.array([0]), np.array([1]), best) == 500  # equal scores lie not strictly below
    assert best.ids.tolist() == list(range(20))


def test_terms_end_where_texts_do():
    hashes, n = lexical.terms(pa.array(["ab", "cd", "", "ab,cd é", "..", "AB" + "x" * 3_000_000 + " cd"]).slice(1))
    assert n.tolist() == [1, 0, 3, 0, 2] and hashes[0] == hashes[2] == hashes[5] and len(set(hashes.tolist())) == 4


# ---- alignment


def by_hand(texts):
    a_of, b_of, names = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B), byte_names()
    a_of.encode_special_tokens = True
    a_bytes = lambda i: bytes(names[c] for c in a_of.id_to_token(i))
    b_bytes = lambda i: bytes([int(b_of.id_to_piece(i)[3:5], 16)]) if b_of.is_byte(i) else b_of.id_to_piece(i).replace("▁", " ").encode()
    docs = []
    for text in texts:
        raw = (" " + (text or "")).encode()
        a, b = (a_of.encode(" " + text, add_special_tokens=False).ids, b_of.encode(text)) if text else ([], [])
        if not text or b"".join(map(a_bytes, a)) != raw or b"".join(map(b_bytes, b)) != raw:
            docs.append(None)
            continue
        a_end, b_end = list(accumulate(len(a_bytes(i)) for i in a)), list(accumulate(len(b_bytes(i)) for i in b))
        links, i, j = [], 0, 0
        while i < len(a):
            links.append((a[i], b[j]))
            i, j = i + (a_end[i] <= b_end[j]), j + (b_end[j] <= a_end[i])
        both = [0, *sorted({*a_end} & {*b_end})]
        within = lambda ids, ends, lo, hi: ",".join(str(t) for t, e in zip(ids, ends, strict=True) if lo < e <= hi)
        docs.append((a, b, [f"{within(a, a_end, lo, hi)}|{within(b, b_end, lo, hi)}" for lo, hi in zip(both, both[1:], strict=False)], links))
    n = Counter(x for d in docs if d for x in d[3])
    best = {}
    for (_, y), c in n.items():
        best[y] = max(best.get(y, 0), c)
    rows = [(len(d[0]), len(d[1]), len(d[2]), len(d[3]), sum(n[x] == best[x[1]] for x in d[3]), sum(n[x] for x in d[3]), hashlib.sha256(";".join(d[2]).encode()).hexdigest()) if d else (0,) * 6 + ("",) for d in docs]
    return rows, n


def odd_texts():
    r = random.Random(1)
    texts = ["", None, " ", "  ", "a", "a  b\n\n\tc ", "a\r\nb;\r", "x▁y", "<|endoftext|> hi <s></s> <0x0A>", "日本語 テキスト　空白", "\x00a\x1cb", "emoji 😀😀 ok", "don't we'll 123 4567 ,,, ...", "   lead", "trail   ", "\n", "\t\tq", "word " * 3000]
    texts += ["".join(r.choice("ab é\n\t\r 1,.'s日▁　😀<>|ﬁ﻿") for _ in range(r.randint(1, 60))) for _ in range(300)]
    return texts + ["".join(r.choice("ab é\n\t 1,.'s日😀<>|ﬁ﻿\x00\x7f") for _ in range(r.randint(1, 60))) for _ in range(600)]


def test_alignment_equals_the_libraries(spark, monkeypatch):
    texts = odd_texts()
    docs = spark.createDataFrame([(i if i != 9 else None, t, 1, "b") for i, t in enumerate(texts)] + [(4, "a", 1, "b")], "doc_id long, text string, n_a int, b string").repartition(3)
    want, pairs = by_hand([*texts, "a"])
    for memo, units in ((6_000_000, 400_000), (100, 50)):
        monkeypatch.setattr(alignment, "MEMO", memo)
        monkeypatch.setattr(alignment, "UNITS", units)
        got = alignment.align(docs, A, B).collect()
        assert sorted((tuple(x) for x in got), key=repr) == sorted(((i if i != 9 else None, *w) for i, w in zip([*range(len(texts)), 4], want, strict=True)), key=repr)
    shards = alignment.count_shards(docs, A, B)
    assert {(x["a"], x["b"]): x["n"] for x in alignment.pair_counts(spark, shards).collect()} == dict(pairs)
    assert alignment.align(docs.limit(0), A, B).count() == 0


def test_long_texts_are_joined_in_parts(spark, monkeypatch):
    pair = alignment.Pair.open(A, B)
    got = alignment.Aligned(pair, [" one", " two,", " three\nfour"] * 60)
    assert got.ok and len(got.names) == 180 and got.names[0] == got.names[177] and got.sizes[:3].tolist() == got.sizes[150:153].tolist()


# ---- quality rules

ROWS = "doc_id long, text string, source string, kept string, row int, did string"


def test_rules_remove_what_many_documents_of_a_host_share(spark):
    letters = lambda i: "".join(chr(97 + int(c)) for c in str(i))  # noqa: E731, as digits count as one
    own = lambda i: " ".join(f"w{letters(i)}x{letters(j)}" for j in range(30))
    rows = [(i, f"Read more: page {i}\n{own(i)}", "h", "", 0, "") for i in range(10)]
    rows += [(20 + i, f"read  MORE: page {i}\n{own(20 + i)}", "g", "", 0, "") for i in range(3)]  # too few on this host
    rows += [(30 + i, own(99) + "\nthe same copy", "h", "", 0, "") for i in range(9)]  # equal copies count once
    rows += [(40, "read more: page 0\n" * 40, "h", "", 0, "")]
    out = {r["doc_id"]: r for r in quality_rules.apply_rules(spark.createDataFrame(rows, ROWS).repartition(3)).collect()}
    assert all(out[i]["n_removed_words"] == 4 and out[i]["clean_text"] == own(i) and out[i]["kept"] for i in range(10))
    assert all(out[i]["n_removed_lines"] == 0 and out[i]["kept"] for i in [20, 21, 22, *range(30, 39)])
    assert out[40]["clean_text"] == "" and out[40]["n_dup_lines"] == 39 and out[40]["base_failed"] and not out[40]["kept"]
    rows = [(i, "\n".join([f"t{letters(i)} a b", *(f"line {c} of the menu of this host" for c in "abcd")]), "h", "", 0, "") for i in range(10)]
    out = quality_rules.apply_rules(spark.createDataFrame(rows, ROWS)).collect()
    assert all(not r["base_failed"] and not r["kept"] and r["n_removed_words"] == 32 for r in out)  # depleted


def test_rules_of_odd_rows(spark):
    rows = [(1, None, None, "", 0, ""), (1, None, None, "", 0, ""), (None, "", "s", "", 0, ""), (2, " \t\x0b\f\r\n ", "s", "", 0, ""), (3, "a b c #$%\n\na b c #$%\r\na b c #$%", "s", "", 0, "")]
    rows += [(4, "one two three four five six seven eight nine " * 5, "s", "", 0, ""), (5, "x " * 50_000, "s", "", 0, ""), (6, "\n".join(f"w{i}" for i in range(50_000)), "s", "", 0, "")]
    df = quality_rules.apply_rules(spark.createDataFrame(rows, ROWS))
    out = {r["doc_id"]: r for r in df.collect()}
    assert df.count() == 8 and df.columns[:4] == ["doc_id", "text", "source", "row"] and df.columns[4] == "did"
    assert all(out[i]["n_words"] == 0 and out[i]["base_failed"] and not out[i]["kept"] for i in (1, None, 2))
    assert out[1]["clean_text"] is None and out[None]["clean_text"] == ""
    assert (out[3]["n_words"], out[3]["word_chars"], out[3]["n_symbols"], out[3]["n_dup_lines"]) == (9, 21, 9, 1)
    assert (out[4]["n_words"], out[4]["n_repeat_words"], out[4]["base_failed"]) == (45, 45, True)
    assert (out[5]["n_words"], out[5]["n_repeat_words"]) == (50_000, 50_000)
    assert (out[6]["n_words"], out[6]["n_repeat_words"], out[6]["kept"]) == (50_000, 0, True)
    assert quality_rules.apply_rules(spark.createDataFrame([], ROWS)).count() == 0


def repeated(words):
    wins = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    n = Counter(wins)
    return len({j for i, w in enumerate(wins) if n[w] > 1 for j in range(i, i + 8)})


def test_repeated_words_equal_brute_force(spark):
    r = random.Random(2)
    rows = [(i, " ".join(r.choice("abc"[: r.choice([1, 2, 3])]) for _ in range(r.randint(0, 60))), "s", "", 0, "") for i in range(200)]
    out = quality_rules.apply_rules(spark.createDataFrame(rows, ROWS)).select("doc_id", "n_repeat_words").collect()
    assert dict(map(tuple, out)) == {i: repeated(t.split()) for i, t, *_ in rows}


@pytest.mark.parametrize("name", ["op11_search", "op13_quality_rules"])
def test_queries_equal_their_sql(spark, name):
    import duckdb

    from brindle.llm import queries

    con, sf = duckdb.connect(), "/root/testdata/sf0.001"
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    cur = con.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in cur.description]
    df = queries.QUERIES[name](spark, sf)
    assert sorted(df.columns) == sorted(names)
    assert sorted(map(tuple, df.select(*names).collect())) == sorted(cur.fetchall())
