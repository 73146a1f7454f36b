"""Cases that reviews found: rows with null or repeated ids, long headers and texts, clashing columns, and all of Unicode."""

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from brindle.llm import common, fingerprints, line_dedup, near_dup, suffix_dedup, warc

DOC = "doc_id long, text string"


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7))) for _ in range(n))


def removed(spark, rows):
    docs = spark.createDataFrame(rows, DOC)
    got = suffix_dedup.deduplicate(docs).select("doc_id", "n_bytes", F.sha2("kept", 256).alias("h")).collect()
    want = suffix_dedup.brute_force([(t or "").encode() for _, t in rows], 200)
    return sorted((r.n_bytes, r.h) for r in got), sorted((len((t or "").encode()), h) for (_, t), (_, _, h) in zip(rows, want, strict=True))


def test_suffix_dedup_of_many_rows_without_id(spark):
    rng = random.Random(1)
    passage = prose(rng, 70)
    rows = [(None, prose(rng, 60)) for _ in range(300)] + [(None, prose(rng, 20) + passage), (None, passage), (7, passage + prose(rng, 9))]
    got, want = removed(spark, rows)
    assert got == want


def test_suffix_dedup_tells_texts_of_one_id_apart(spark, monkeypatch):
    rng = random.Random(2)
    passage = prose(rng, 70)
    rows = [(5, prose(rng, 60)) for _ in range(40)] + [(5, prose(rng, 20) + passage), (6, passage)]
    monkeypatch.setattr(suffix_dedup, "ambiguous", lambda docs: True)
    got, want = removed(spark, rows)
    assert got == want


def test_suffix_dedup_across_the_parts_of_a_long_text(spark):
    rng = random.Random(3)
    long = prose(rng, 62_000)
    assert len(long) > suffix_dedup.PART
    at = suffix_dedup.PART
    got, want = removed(spark, [(1, long), (2, "x" + long[at - 300 : at + 300]), (3, prose(rng, 50))])
    assert got == want


def test_near_duplicates_of_a_long_text(spark):
    rng = random.Random(4)
    long = prose(rng, 30_000)
    docs = spark.createDataFrame([(1, long), (2, long + " tail"), (3, prose(rng, 300))], DOC)
    assert {r.doc_id: r.component_id for r in near_dup.near_duplicates(docs, words=2).collect()} == {1: 1, 2: 1, 3: 3}


def test_warc_of_repeated_page_ids(spark):
    long, longer = "x" * 120, "y" * 200
    rows = [(1, "u", long), (1, "u", longer), (2, "u", long), (3, "u", longer)]
    path = common.new_path(spark, "test")
    warc.write_archive(spark.createDataFrame(rows, "page_id long, url string, html string"), path)
    got = {(warc_id(r.record_id), r.record_type, warc_id(r.refers_to), len(r.payload)) for r in warc.read_archive(spark, path).collect()}
    assert got == {(1, "response", None, 120), (1, "response", None, 200), (2, "revisit", 1, 0), (3, "revisit", 1, 0)}


def warc_id(urn):
    return int(urn.rsplit(":", 1)[1].rstrip(">")) if urn else None


def test_revisits_have_the_size_of_their_own_payload(spark, tmp_path):
    rows = [(1, "u", "x" * 120), (1, "u", "y" * 200), (2, "u", "x" * 120), (None, "u", None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {(r.page_id, r.payload_bytes, r.record_type) for r in warc.op4_warc(spark, str(tmp_path)).collect()}
    assert got == {(1, 120, "response"), (1, 200, "response"), (2, 120, "revisit"), (None, 0, "response")}


def test_canonical_forms_of_all_of_unicode(spark):
    rng = random.Random(5)
    every = [chr(i) for i in range(0x21, 0x110000) if not 0xD800 <= i < 0xE000 and unicodedata.category(chr(i)) != "Cn"]
    some = [c for c in every if not 0xAC00 <= ord(c) < 0xD7A4 or ord(c) % 9 == 0]
    some = [c for c in some if not 0x3400 <= ord(c) < 0xA000 or ord(c) % 50 == 0]
    marks = [c for c in every if unicodedata.combining(c)]
    texts = ["a" + c + "b" for c in some]
    pairs = []
    for _ in range(500):
        t = "".join(rng.choice(some if rng.random() < 0.3 else "aeoucnAEÉéöñ  ") + "".join(rng.choice(marks) for _ in range(rng.choice((0, 0, 1, 2, 3)))) for _ in range(8))
        pairs.append((t, unicodedata.normalize(rng.choice(("NFC", "NFD")), t)))
    flat = texts + [x for p in pairs for x in p]
    docs = spark.createDataFrame(list(enumerate(flat)), "i long, t string")
    got = {r.i: r.c for r in docs.select("i", fingerprints.canonical(F.col("t")).alias("c")).collect()}
    fold = lambda t: " ".join(unicodedata.normalize("NFKD", "".join(fingerprints.form_of(c) for c in t.lower())).split(" ")).strip(" ")
    for i, t in enumerate(texts):
        assert unicodedata.normalize("NFKD", got[i]).strip() == fold(t).strip(), t.encode("unicode_escape")
    for k in range(len(pairs)):
        assert got[len(texts) + 2 * k] == got[len(texts) + 2 * k + 1]


def test_next_of_rows_with_hot_and_missing_ids(spark):
    rows = [(i, f"t{i}") for i in range(10)] + [(4, f"same{i}") for i in range(25)] + [(None, f"none{i}") for i in range(25)] + [(None, None)]
    docs = spark.createDataFrame(rows, DOC)
    got = [(r.doc_id, r.text, r.next) for r in fingerprints.with_next(docs, rows_a_range=4).collect()]
    assert sorted(x[1] for x in got) == sorted(x[2] for x in got) == sorted(t or "" for _, t in rows)
    follow = {t: n for _, t, n in got}
    at, seen = "t9", []
    while at not in seen:
        seen.append(at)
        at = follow[at]
    assert len(seen) == len(rows)
    ids = {t or "": i for i, t in rows}
    assert [ids[t] for t in seen] == [9, 8, 7, 6, 5] + [4] * 26 + [3, 2, 1, 0] + [None] * 26


def test_lines_of_rows_without_id_and_clashing_columns(spark):
    line = "one line that is long enough to be compared with the others"
    docs = spark.createDataFrame([(None, line, "a"), (None, line + "\nother", "b"), (3, line, "c")], "doc_id long, text string, lid string")
    got = {r.lid: (r.text, r.n_removed) for r in line_dedup.deduplicate(docs, short=True).collect()}
    assert sorted(v[1] for v in got.values()) == [0, 1, 1] and set(got) == {"a", "b", "c"}
    with pytest.raises(ValueError):
        line_dedup.deduplicate(docs.withColumn("n_lines", F.lit(1)))
    assert line_dedup.deduplicate(spark.createDataFrame([(None, None, "x")], "doc_id long, text string, lid string")).first().n_lines == 1
