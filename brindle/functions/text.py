"""Text, URL, hash and set functions as column expressions. All stay in the JVM but `clean_full`, `ratio` and `lcs`."""

import html
import unicodedata
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

WORD = r"[\p{L}\p{N}_]"
URL = r"(?:https?://|www\.)[^\s<>\"']+"
#: The emoji ranges that cleaning removes.
EMOJI = "[\\x{1F600}-\\x{1F64F}\\x{1F300}-\\x{1F5FF}\\x{1F680}-\\x{1F6FF}\\x{1F1E0}-\\x{1F1FF}\\x{2702}-\\x{27B0}\\x{24C2}-\\x{1F251}]+"
CJK = "[\\x{4e00}-\\x{9fff}]"
#: The words of the rule-based polarity, and the words that keyword extraction leaves out.
POSITIVE = [
    "good", "great", "excellent", "amazing", "wonderful", "fantastic", "awesome", "love", "happy", "joy", "beautiful", "perfect",
    "best", "nice", "brilliant", "superb", "outstanding", "好", "棒", "优秀", "喜欢", "爱", "开心", "快乐", "美好", "完美", "精彩", "出色", "赞", "厉害",
]
NEGATIVE = [
    "bad", "terrible", "awful", "horrible", "worst", "hate", "sad", "angry", "disappointed", "poor", "negative", "wrong", "fail",
    "failure", "problem", "issue", "disaster", "坏", "差", "糟糕", "讨厌", "恨", "难过", "伤心", "愤怒", "失望", "问题", "错误", "失败", "垃圾",
]
STOP = [
    "the", "a", "an", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will",
    "would", "could", "should", "may", "might", "must", "shall", "can", "need", "dare", "ought", "used", "to", "of", "in",
    "for", "on", "with", "at", "by", "from", "as", "into", "through", "during", "before", "after", "above", "below",
    "between", "under", "again", "further", "then", "once", "here", "there", "when", "where", "why", "how", "all", "each",
    "few", "more", "most", "other", "some", "such", "no", "nor", "not", "only", "own", "same", "so", "than", "too", "very",
    "的", "是", "在", "了", "和", "与", "或", "这", "那", "有", "我", "你", "他", "她", "它", "们", "就", "也", "都", "而", "及", "着", "但",
    "如果", "因为", "所以", "虽然", "但是",
]


def hashtags(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"#({WORD}+)"), F.lit(1))


def mentions(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"@({WORD}+)"), F.lit(1))


def paired_hashtags(text: Column) -> Column:
    """The form #tag#: trimmed, empty ones left out, repeats kept."""
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit("#([^#]+)#"), F.lit(1)), lambda x: F.trim(x)), lambda x: x != "")


def normalize_url(url: Column) -> Column:
    """Trimmed; https if it doesn't begin with http:// or https://; scheme and host in lower case; no fragment; no slash at the path's end but where it is all of the path."""
    url = F.trim(url)
    full = F.when(url.rlike("^https?://"), url).otherwise(F.concat(F.lit("https://"), url))
    part = lambda i: F.regexp_extract(full, r"^([A-Za-z]+)://([^/?#]*)([^?#]*)(\?[^#]*)?", i)
    return F.concat(F.lower(part(1)), F.lit("://"), F.lower(part(2)), F.coalesce(F.nullif(F.regexp_replace(part(3), "/+$", ""), F.lit("")), F.lit("/")), F.when(part(4) == "?", "").otherwise(part(4)))


def urls(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(URL), F.lit(0)), normalize_url)


def script_language(text: Column) -> Column:
    """zh if more than 0.3 of the characters that aren't spaces are Chinese, en if more than half are ASCII letters, else other; null for a text of spaces alone."""
    n = F.nullif(F.length(F.regexp_replace(text, " ", "")), F.lit(0))
    return F.when(F.regexp_count(text, F.lit(CJK)) / n > 0.3, "zh").when(F.regexp_count(text, F.lit("[A-Za-z]")) / n > 0.5, "en").when(n.isNotNull(), "other")


def clean(text: Column, urls: bool = True, mentions: bool = True, hashtags: bool = True, emoji: bool = True, lower: bool = False, most: int | None = None) -> Column:
    """Control characters, tags, emoji, URLs, mentions and hashtags to spaces; white space folded. clean_full adds entities and NFKC."""
    steps = [("[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]", True), ("<[^>]+>", True), (EMOJI, emoji), (URL, urls), (f"@{WORD}+", mentions), (f"#{WORD}+", hashtags)]
    for pattern, on in steps:
        text = F.regexp_replace(text, pattern, " ") if on else text
    text = F.trim(F.regexp_replace(text, "\\s+", " "))
    text = F.lower(text) if lower else text
    return text if most is None else F.substring(text, 1, most)


@F.pandas_udf(StringType())
def unescaped(texts: pd.Series) -> pd.Series:
    """HTML entities and Unicode compatibility forms, which Spark has no function for."""
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", html.unescape(t)))


def clean_full(text: Column, **options) -> Column:
    return clean(unescaped(F.regexp_replace(text, "<[^>]+>", " ")), **options)


def normalized_content(text: Column, **options) -> Column:
    """struct of the clean text, lengths before and after, its script, and what the raw text has: URLs, hashtags, mentions, tags, control characters."""
    cleaned = clean_full(text, **options)
    return F.struct(
        cleaned.alias("text"), F.length(text).alias("original_length"), F.length(cleaned).alias("cleaned_length"), script_language(cleaned).alias("language"), urls(text).alias("urls"), hashtags(text).alias("hashtags"), mentions(text).alias("mentions"),
        F.regexp_count(text, F.lit("<[^>]+>")).alias("html_tags"), F.regexp_count(text, F.lit("[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]")).alias("control_chars"), F.greatest(F.length(text) - F.length(cleaned), F.lit(0)).alias("removed_chars"),
    )


def cleaning_stats(rows: DataFrame, column: str = "content") -> DataFrame:
    """One row over normalized_content structs: how many, mean lengths and reduction, and how many URLs, hashtags and mentions."""
    c = lambda f: F.col(f"{column}.{f}")
    return rows.agg(F.count("*").alias("total"), F.avg(c("original_length")).alias("avg_original_length"), F.avg(c("cleaned_length")).alias("avg_cleaned_length"), F.avg(c("original_length") - c("cleaned_length")).alias("avg_reduction"), *(F.coalesce(F.sum(F.size(c(f))), F.lit(0)).alias(f"total_{f}") for f in ("urls", "hashtags", "mentions")))


def tokens(text: Column) -> Column:
    """Words after URLs, mentions and tags are gone and punctuation is space."""
    bare = F.regexp_replace(F.regexp_replace(text, URL, " "), f"[@#]{WORD}+", " ")
    return F.filter(F.split(F.trim(F.regexp_replace(bare, "[^\\p{L}\\p{N}_\\s]+", " ")), "\\s+"), lambda w: w != "")


def lexicon(words: Column, positive: list[str] = POSITIVE, negative: list[str] = NEGATIVE) -> Column:
    """struct(score, label, confidence): (pos - neg) / (pos + neg), labelled beyond 0.1 either way; confidence is the share of words found."""
    count = lambda listed: F.size(F.filter(words, lambda w: F.lower(w).isin(listed)))
    pos, neg = count(positive), count(negative)
    score = (pos - neg) / F.greatest(pos + neg, F.lit(1))
    return F.struct(score.alias("score"), F.when(score > 0.1, "positive").when(score < -0.1, "negative").otherwise("neutral").alias("label"), (pos + neg) / F.greatest(F.size(words), F.lit(1)).alias("confidence"))


def features(text: Column) -> dict[str, Column]:
    n = F.length(text)
    return {
        "word_count": F.size(F.filter(F.split(text, "\\s+"), lambda w: w != "")).cast("long"),
        "char_count": n.cast("long"),
        "hashtag_count": F.regexp_count(text, F.lit(f"#{WORD}+")).cast("long"),
        "mention_count": F.regexp_count(text, F.lit(f"@{WORD}+")).cast("long"),
        "url_count": F.regexp_count(text, F.lit(URL)).cast("long"),
        "exclamation_count": F.regexp_count(text, F.lit("!")).cast("long"),
        "question_count": F.regexp_count(text, F.lit("[?]")).cast("long"),
        "uppercase_ratio": F.regexp_count(text, F.lit("\\p{Lu}")) / F.greatest(n, F.lit(1)),
    }


def keywords(docs: DataFrame, key: str, text: str, k: int = 5, stop: tuple[str, ...] = tuple(STOP)) -> DataFrame:
    """Per document its k commonest words of over one character; ties to the word that comes first."""
    from pyspark.sql import Window

    words = docs.select(key, F.posexplode(tokens(F.col(text))).alias("pos", "word")).where((F.length("word") > 1) & ~F.col("word").isin(list(stop)))
    counted = words.groupBy(key, "word").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    return counted.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), "first"))).where(F.col("rank") <= k).select(key, "rank", "word", "n")


def hamming(a: Column, b: Column) -> Column:
    """Characters that differ by place; of texts of different length the longer one's length."""
    pairs = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.when(x != y, 1).otherwise(0))
    return F.when(F.length(a) != F.length(b), F.greatest(F.length(a), F.length(b))).otherwise(F.aggregate(pairs, F.lit(0), lambda s, x: s + x))


def jaccard(a: Column, b: Column, both_empty: float = 1.0) -> Column:
    """Of two sets as arrays without repeats; both empty: `both_empty`, one empty: 0."""
    either = F.size(F.array_union(a, b))
    return F.when(either == 0, F.lit(both_empty)).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(either, F.lit(1)))


def word_set(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(F.trim(text)), "\\s+"), lambda w: w != ""))


def text_list(items: Column) -> Column:
    """Trimmed, without empty ones and repeats, in order; null is an empty list."""
    return F.coalesce(F.array_distinct(F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x != "")), F.array().cast("array<string>"))


def url_list(items: Column) -> Column:
    return F.filter(text_list(items), lambda x: x.rlike("^https?://"))


def blank_to_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def valid_url(url: Column) -> Column:
    return F.when(F.trim(url).rlike("^https?://"), F.trim(url))


def language_code(code: Column) -> Column:
    short = F.lower(F.trim(code))
    return F.when((F.length(short) <= 16) & (short != ""), short)


def url_node(url: Column) -> Column:
    return F.concat(F.lit("url:"), F.substring(F.md5(url), 1, 12))


def tag_node(tag: Column) -> Column:
    return F.regexp_replace(F.lower(tag), "^#+|#+$", "")


def count_text(text: Column) -> Column:
    """A shown count: plain digits with commas, or with a suffix 万 or w (10^4), 亿 or b (10^8), k, m; what can't be read is 0."""
    number = F.regexp_extract(F.regexp_replace(text, ",", ""), r"([0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")
    unit = F.lower(F.regexp_extract(text, r"[0-9.,]+\s*([^\s0-9.,])", 1))
    times = F.when(unit.isin("万", "w"), 1e4).when(unit.isin("亿", "b"), 1e8).when(unit == "k", 1e3).when(unit == "m", 1e6).otherwise(1.0)
    return F.coalesce(F.round(number * times).cast("long"), F.lit(0).cast("long"))


@F.pandas_udf(DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching-blocks likeness of two texts in lower case; equal texts 1, an empty one 0."""
    return pd.Series([0.0 if not x or not y else 1.0 if x.lower() == y.lower() else SequenceMatcher(None, x.lower(), y.lower()).ratio() for x, y in zip(a, b, strict=True)])


def lcs_share(x: str | None, y: str | None) -> float:
    """Length of the longest common subsequence over the longer length, by bit-parallel rows; 0 if either is empty."""
    if not x or not y:
        return 0.0
    masks: dict[str, int] = {}
    for i, c in enumerate(x):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(x)) - 1
    row = full
    for c in y:
        hit = row & masks.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return (len(x) - row.bit_count()) / max(len(x), len(y))


@F.pandas_udf(DoubleType())
def lcs(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([lcs_share(x, y) for x, y in zip(a, b, strict=True)])
