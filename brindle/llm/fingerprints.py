"""Exact document fingerprints: canonical text, wide xxhash buckets, and byte comparison within equal buckets."""

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Texts of these characters alone are canonical but for white space, once in lower case: ASCII and Latin-1's letters, composed, without the sharp s.
PLAIN = "^[\\x00-\\x7fÀ-ÖØ-Þà-öø-ÿ]*$"
PAGE = 256
HANGUL, LEADS, VOWELS, TAILS = 0xAC00, 0x1100, 0x1161, 0x11A7
CUT = "\x01"


def form_of(c: str) -> str:
    """A character fully decomposed, compatibility forms too, with its case folded; white space is a space. The iota that is written below stays a mark, whose order counts, where full folding makes it a letter."""
    if c.isspace():
        return " "
    was, now = "", c
    while was != now:
        was, now = now, unicodedata.normalize("NFKD", "".join(x if x == "\u0345" else x.casefold() for x in unicodedata.normalize("NFKD", now)))
    return "".join(" " if x.isspace() else x for x in now)


@lru_cache
def tables() -> tuple[list[str], list[str], str, list[str], dict[str, str]]:
    """Made from Python's Unicode data: for each page of 256 code points its place in the two tables that follow, or ""; the forms of the
    characters that have another one; a character class of all combining marks; the marks' classes; and Latin-1's letters by base and mark."""
    forms, classes = {}, {}
    for i in range(0x80, sys.maxunicode + 1):
        if 0xD800 <= i < 0xE000 or HANGUL <= i < HANGUL + 11172:
            continue
        c = chr(i)
        if (form := form_of(c)) != c:
            forms[i] = form
        if unicodedata.combining(c):
            classes[i] = unicodedata.combining(c)
    pages = sorted({i // PAGE for i in (*forms, *classes)})
    place = {p: str(n * PAGE) for n, p in enumerate(pages)}
    flat = [forms.get(p * PAGE + k, "") for p in pages for k in range(PAGE)]
    order = [str(classes.get(p * PAGE + k, 0)) for p in pages for k in range(PAGE)]
    starts = [i for i in classes if i - 1 not in classes]
    ends = [i for i in classes if i + 1 not in classes]
    marks = "[" + "".join(f"\\x{{{a:x}}}-\\x{{{z:x}}}" for a, z in zip(starts, ends, strict=True)) + "]"
    latin = {unicodedata.normalize("NFD", chr(i)): chr(i) for i in range(0xE0, 0x100) if len(unicodedata.normalize("NFD", chr(i))) == 2}
    return [place.get(p, "") for p in range(sys.maxunicode // PAGE + 1)], flat, marks, order, latin


def _listed(items: list[str]) -> Column:
    """A constant array, made once when the plan is: looked up by place, not searched."""
    return F.split(F.lit(CUT.join(items)), CUT)


def canonical(text: Column) -> Column:
    """Case folded in full, Unicode compatibility decomposition with marks in canonical order, and each run of white space as one space, none at the ends.

    Two texts have equal forms exactly if they are canonically or compatibly equivalent but for case and white space. Latin-1's
    letters are composed again, so that texts of them and ASCII skip the way through the tables. Hangul is taken apart by
    arithmetic. Null stays null.
    """
    pages, forms, marks, order, latin = tables()
    lowered = F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))  # common, so that it needn't go through the tables
    at = lambda c: F.get(_listed(pages), F.shiftright(F.ascii(c), 8))
    entry = lambda c, table: F.get(_listed(table), at(c).cast("int") + F.ascii(c).bitwiseAND(PAGE - 1))
    pick = lambda first, n, i: F.substring(F.lit("".join(chr(first + k) for k in range(n))), (i + 1).cast("int"), F.lit(1))

    def decomposed(c: Column) -> Column:
        s = F.ascii(c) - HANGUL
        hangul = F.concat(pick(LEADS, 19, F.floor(s / 588)), pick(VOWELS, 21, F.floor(F.pmod(s, F.lit(588)) / 28)), F.when(F.pmod(s, F.lit(28)) > 0, pick(TAILS, 28, F.pmod(s, F.lit(28)))).otherwise(""))
        other = F.when(at(c) != "", F.nullif(entry(c, forms), F.lit("")))
        return F.when(F.ascii(c) < 0x80, c).when((s >= 0) & (s < 11172), hangul).otherwise(F.coalesce(other, c))

    wide = F.array_join(F.transform(F.regexp_extract_all(lowered, F.lit("[\\x00-\\x7f]+|[^\\x00-\\x7f]"), F.lit(0)), decomposed), "")
    ordered = lambda run: F.array_join(F.transform(F.array_sort(F.transform(F.split(run, ""), lambda c, i: F.struct(entry(c, order).cast("int").alias("class"), i.alias("i"), c.alias("c")))), lambda x: x["c"]), "")
    runs = F.transform(F.regexp_extract_all(wide, F.lit(f"{marks}{{2,}}|{marks}|[^{marks[1:-1]}]+"), F.lit(0)), lambda t: F.when(t.rlike(f"^{marks}{{2}}"), ordered(t)).otherwise(t))
    sorted_ = F.when(wide.rlike(f"{marks}{{2}}"), F.array_join(runs, "")).otherwise(wide)
    for pair, letter in latin.items():
        sorted_ = F.replace(sorted_, F.lit(pair), F.lit(letter))
    folded = F.when(lowered.rlike(PLAIN), lowered).otherwise(sorted_)
    return F.trim(F.regexp_replace(folded, "\\s+", " "))


def wide_hash(text: Column) -> Column:
    """128 bits as 32 hexadecimal digits: two xxhash64 of the text with different company."""
    one, two = F.xxhash64(text), F.xxhash64(F.lit("brindle"), text, F.length(text))
    return F.concat(F.lpad(F.hex(one), 16, "0"), F.lpad(F.hex(two), 16, "0"))


def collisions(docs: DataFrame, text: str = "text") -> DataFrame | None:
    """The wide hashes that different canonical texts share, found by comparing bytes: a hash with two distinct texts. None if there are none, as a rule."""
    forms = docs.select(canonical(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("canon"))
    texts = forms.select("canon", wide_hash(F.col("canon")).alias("hash")).distinct()
    found = common.stored(texts.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash"), "collisions")
    return None if found.isEmpty() else found


def named(rows: DataFrame, canon: str, out: str, hit: DataFrame | None) -> DataFrame:
    """rows with the fingerprint of the canonical text in column `canon`: its wide hash, and in a collision its SHA-256 too."""
    hashed = rows.withColumn(out, wide_hash(F.col(canon)))
    if hit is None:
        return hashed
    marked = hashed.join(hit.select(F.col("hash").alias(out), F.lit(True).alias("_hit")), out, "left")
    return marked.withColumn(out, F.when(F.col("_hit"), F.concat(F.col(out), F.lit("-"), F.sha2(F.col(canon).cast("binary"), 256))).otherwise(F.col(out))).drop("_hit")


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """docs with the fingerprint of each text in column `out`: equal exactly if the canonical texts are equal byte for byte.

    Texts are grouped by the wide hash and compared within equal buckets. A null text counts as empty.
    """
    if out in docs.columns or "_canon" in docs.columns:
        raise ValueError(f"column {out} is there already")
    rows = docs.withColumn("_canon", canonical(F.coalesce(F.col(text).cast("string"), F.lit(""))))
    return named(rows, "_canon", out, collisions(docs, text)).select(*docs.columns, out)


def with_next(docs: DataFrame, most_ranges: int = 4096, rows_a_range: int = 2000) -> DataFrame:
    """doc_id, text and next (the text of the next document in descending doc_id; after the last comes the first).

    Equal ids go on by a hash of the text, null ids come last, a null text is empty. doc_id is cut into ranges at approximate
    quantiles, at most about `most_ranges` numbers whatever the table's size; an id, or the missing id, that many rows have is
    a range of its own and is cut further by the hash. The window works within a range, and what follows a range's last row is
    the first row of the next range that has any, one row a range. Only rows that are the same throughout stay together.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = rows.agg(F.count("*").alias("n")).first()["n"]
    if not size:
        return rows.withColumn("next", F.col("text"))
    each = max(rows_a_range, -(-size // most_ranges))
    n = max(1, size // each)
    bounds = rows.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], 10 * n)).first()[0] or []
    # at most size / each ids come to the driver
    hot = {r["doc_id"]: r["n"] for r in rows.groupBy("doc_id").agg(F.count("*").alias("n")).where(F.col("n") > each).collect()}
    named = [i for i in hot if i is not None]
    cuts = sorted({*(bounds if n > 1 else []), *named, *(i - 1 for i in named if i > -(2**63))})
    # the first range in descending order is number 0; null ids are beyond the last
    part = F.when(F.col("doc_id").isNull(), F.lit(len(cuts) + 1)).otherwise((F.lit(len(cuts)) - _below(cuts)) if cuts else F.lit(0))
    h = F.xxhash64("text")
    deep = F.lit(1)
    for i, count in hot.items():
        deep = F.when(F.col("doc_id").eqNullSafe(F.lit(i)), F.lit(-(-count // each))).otherwise(deep)
    share = (F.shiftright(h, 11).cast("double") + 2.0**52) / 2.0**53  # grows with the hash, from 0 to 1
    placed = rows.withColumn("h", h).withColumn("part", part.cast("int")).withColumn("sub", F.least(F.floor(share * deep), deep - 1).cast("int"))
    led = placed.withColumn("next", F.lead("text").over(Window.partitionBy("part", "sub").orderBy(F.col("doc_id").desc_nulls_last(), "h", "text")))
    firsts = placed.groupBy("part", "sub").agg(F.min_by("text", F.struct((-F.col("doc_id")).alias("d"), "h", "text")).alias("first"))
    around = Window.partitionBy(F.lit(0)).orderBy("part", "sub")  # one row a range
    follow = common.stored(firsts.select("part", "sub", F.coalesce(F.lead("first").over(around), F.first("first").over(around)).alias("first")), "firsts")
    return led.join(follow, ["part", "sub"]).select("doc_id", "text", F.coalesce("next", "first").alias("next"))


def _below(cuts: list[int]) -> Column:
    """How many cuts are smaller than doc_id, by halving."""
    def build(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col("doc_id") > cuts[mid], build(mid + 1, hi)).otherwise(build(lo, mid))

    return build(0, len(cuts))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprints of every document and of its text with the next one's beginning in its last half, and whether they are equal (1 or 0).

    A null text is empty; null ids come last and repeated ids in the order of a hash of their texts; each row gives one; an empty table
    gives none. Other columns are not read.
    """
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next", F.lit(1), half))
    docs = common.table(spark, sf_dir, "documents")
    hit = collisions(docs)
    rows = with_next(docs).withColumn("edited", edited)
    forms = rows.select("doc_id", "edited", n.cast("long").alias("n_chars"), canonical(F.col("text")).alias("c"), canonical(F.col("edited")).alias("c_edited"), canonical(F.col("next")).alias("c_next"))
    return named(named(forms, "c", "fingerprint", hit), "c_edited", "edited_fingerprint", hit).select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        (F.col("c_edited") == F.col("c")).cast("double").alias("near_edited"),
        (F.col("c_next") == F.col("c")).cast("double").alias("near_next"),
    )
