"""Quality rules for whole documents, in DataFrame functions only: repeats within a text, and lines that many documents of a host share."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SPACES = " \t\n\x0b\f\r"
GAP = "[\\x20\\x09-\\x0D]+"
WORDY = "[^\\x20\\x09-\\x0D]"
SYMBOLS = "[#*$%&|<>]"
#: A table of frequent lines of at most so many rows (two longs each) is broadcast; a larger one is joined by shuffles.
MOST_BROADCAST = 1_000_000


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value made once however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, GAP))


def covered(starts: Column, width: int) -> Column:
    """How many positions the windows of `width` from these sorted starts cover."""
    zero = F.struct(F.lit(-width).alias("last"), F.lit(0).cast("long").alias("n"))
    step = lambda s, i: F.struct(i.alias("last"), (s["n"] + F.least(F.lit(width), i - s["last"])).alias("n"))
    return F.aggregate(starts, zero, step, lambda s: s["n"])


def repeated_words(words: Column, width: int = 8) -> Column:
    """How many words lie in windows of `width` words that are there twice or more, the first included.

    Windows are compared by 64-bit hashes of their words' hashes, and sorted only where a hash is there twice.
    """
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    none = F.array().cast("array<bigint>")
    windows = lambda h: F.when(F.size(h) >= width, F.transform(F.sequence(F.lit(1), F.size(h) - (width - 1)), lambda i: F.xxhash64(F.slice(h, i, F.lit(width))))).otherwise(none)
    placed = lambda w: F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("at"))))
    same = lambda s, j, p: F.coalesce(F.get(s, j)["h"] == p["h"], F.lit(False))
    starts = lambda s: F.sort_array(F.transform(F.filter(s, lambda p, j: same(s, j - 1, p) | same(s, j + 1, p)), lambda p: p["at"]))
    return let(let(hashes, windows), lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("long")).otherwise(let(placed(w), lambda s: covered(starts(s), width))))


def measures(text: Column) -> Column:
    """A struct of n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a text that isn't null."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORDY))
    long = lambda c, name: c.cast("long").alias(name)
    by_words = let(words_of(text), lambda w: F.struct(long(F.size(w), "n_words"), long(F.length(F.array_join(w, "")), "word_chars"), long(repeated_words(w), "n_repeat_words")))
    return F.struct(by_words.alias("w"), long(F.regexp_count(text, F.lit(SYMBOLS)), "n_symbols"), long(let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))), "n_dup_lines"))


def normal_lines(text: Column) -> Column:
    """The lines of a text in lower case, digits as 0, white space folded to one space and trimmed; what has no word is empty."""
    flat = F.regexp_replace(F.regexp_replace(F.lower(text), "[0-9]", "0"), "[\\x20\\x09\\x0B-\\x0D]+", " ")
    return F.transform(F.split(flat, "\n"), lambda x: F.trim(x))


def _keyed(docs: DataFrame, host: str) -> DataFrame:
    """row (all columns, so that no name clashes), did, text, dk (which tells texts apart) and hk (hosts); a null id is the least, a null text empty, null hosts are one."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.select(F.struct("*").alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("did"), text.alias("text"), F.xxhash64(F.col(host).cast("string")).alias("hk"))
    return keyed.withColumn("dk", F.xxhash64("text", F.length("text")))


def _lines(keyed: DataFrame) -> DataFrame:
    """hk, did, dk, pos, lk (a line's hash) and words of every line with a word."""
    lines = keyed.select("hk", "did", "dk", F.posexplode(normal_lines(F.col("text"))).alias("pos", "line")).where("line <> ''")
    words = F.length("line") - F.length(F.replace("line", F.lit(" "), F.lit(""))) + 1
    return lines.select("hk", "did", "dk", "pos", F.xxhash64("line").alias("lk"), words.cast("long").alias("words"))


def frequent_lines(docs: DataFrame, host: str = "source", least_docs: int = 5, share: float = 0.02) -> DataFrame:
    """hk, lk and n_docs of lines that more than `least_docs` documents of a host have, and more than `share` of them all.

    Documents are told apart by their texts, so that any number of equal copies counts as one. Each document's lines are made distinct
    before they are counted, and counted in part where they are, so that a line of a third of all documents meets in no one task.
    """
    keyed = _keyed(docs, host)
    n_docs = _lines(keyed).select("hk", "lk", "dk").distinct().groupBy("hk", "lk").agg(F.count("*").alias("n_docs"))
    hosts = keyed.select("hk", "dk").distinct().groupBy("hk").agg(F.count("*").alias("of"))
    return n_docs.where(F.col("n_docs") > least_docs).join(hosts, "hk").where(F.col("n_docs") > share * F.col("of")).select("hk", "lk", "n_docs")


def apply_rules(docs: DataFrame, host: str = "source", least_docs: int = 5, share: float = 0.02, least_words: int = 20, most_repeated: int = 30, most_removed: int = 50) -> DataFrame:
    """docs with clean_text, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_removed_lines, n_removed_words, base_failed and kept.

    clean_text lacks the host's frequent lines. A document fails the base rules with fewer than `least_words` words, or if more than
    `most_repeated` in 100 of them are in repeated windows of eight words; it is depleted if fewer than `least_words` words are left
    or more than `most_removed` in 100 went; kept is neither. A null text has no words and stays null; repeated rows and
    equal texts fare alike; documents of a null host are one host; an empty table gives no rows. Other columns pass
    through; one that has the name of a new column is replaced.
    """
    keyed = _keyed(docs, host)
    frequent = common.stored(frequent_lines(docs, host, least_docs, share).select("hk", "lk"), "frequent")
    few = frequent.count() <= MOST_BROADCAST
    met = _lines(keyed).join(F.broadcast(frequent) if few else frequent, ["hk", "lk"])
    gone = met.groupBy("hk", "did", "dk").agg(F.collect_set(F.struct("pos", "words")).alias("gone"))
    out = keyed.withColumn("m", measures(F.col("text"))).drop("text").join(gone, ["hk", "did", "dk"], "left").withColumn("text", F.col("row")["text"])
    left = lambda x: F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.transform("gone", lambda g: g["pos"]))
    cleaned = let(F.split("text", "\n"), lambda x: F.array_join(F.transform(left(x), lambda i: F.get(x, i)), "\n"))
    count = lambda n: F.coalesce(n, F.lit(0)).cast("long")
    found = {"clean_text": F.when(F.col("gone").isNull(), F.col("text")).otherwise(cleaned)}
    found |= {c: F.col(f"m.w.{c}") for c in ("n_words", "word_chars", "n_repeat_words")} | {c: F.col(f"m.{c}") for c in ("n_symbols", "n_dup_lines")}
    found |= {"n_removed_lines": count(F.when(F.col("gone").isNotNull(), F.size("gone"))), "n_removed_words": count(F.aggregate("gone", F.lit(0).cast("long"), lambda s, g: s + g["words"]))}
    failed = (found["n_words"] < least_words) | (100 * found["n_repeat_words"] > most_repeated * found["n_words"])
    depleted = (found["n_words"] - found["n_removed_words"] < least_words) | (100 * found["n_removed_words"] > most_removed * found["n_words"])
    found |= {"base_failed": failed, "kept": ~failed & ~depleted}
    return out.select(*(F.col("row")[c].alias(c) for c in docs.columns if c not in found), *(x.alias(c) for c, x in found.items()))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The measures and the verdict on every document; a source counts as a host. Nulls, repeats and empty tables: see apply_rules."""
    done = apply_rules(common.table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return done.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_removed_words", "base_failed", "kept")


def oracle(least_docs: int = 5, share: float = 0.02) -> str:
    """The same in SQL: windows and lines by their texts, not by hashes."""
    return f"""WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
 w AS (SELECT doc_id, source, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words FROM d),
 wins AS (SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS win FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8)),
 hot AS (SELECT doc_id, unnest(range(i, i + 8)) AS place FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM wins) WHERE n > 1),
 reps AS (SELECT doc_id, count(DISTINCT place) AS n FROM hot GROUP BY 1),
 raw AS (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line FROM d),
 dups AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM raw WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY 1),
 norm AS (SELECT doc_id, source, text, trim(regexp_replace(regexp_replace(lower(line), '[0-9]', '0', 'g'), '[\\x20\\x09\\x0B-\\x0D]+', ' ', 'g')) AS line FROM raw),
 hosts AS (SELECT source, count(DISTINCT text) AS n_texts FROM d GROUP BY 1),
 freq AS (SELECT norm.source, line FROM norm JOIN hosts ON norm.source IS NOT DISTINCT FROM hosts.source WHERE line <> '' GROUP BY 1, 2, n_texts
  HAVING count(DISTINCT text) > {least_docs} AND count(DISTINCT text) > {share} * n_texts),
 gone AS (SELECT doc_id, sum(len(string_split(norm.line, ' '))) AS n FROM norm JOIN freq ON norm.source IS NOT DISTINCT FROM freq.source AND norm.line = freq.line GROUP BY 1),
 m AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(dups.n, 0) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(reps.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(gone.n, 0) AS BIGINT) AS n_removed_words
  FROM w LEFT JOIN dups USING (doc_id) LEFT JOIN reps USING (doc_id) LEFT JOIN gone USING (doc_id))
 SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
 NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND n_words - n_removed_words >= 20 AND 100 * n_removed_words <= 50 * n_words AS kept FROM m"""
