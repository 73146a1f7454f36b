"""Full-text search over a postings table: token overlap, BM25, suggestions, user search."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions import text as T
from brindle.sources import adapters as A


def postings(docs: DataFrame, key: str = "post_id", text: str = "content") -> DataFrame:
    """term, key and tf: the inverted index, to be written partitioned by term for repeated use."""
    words = docs.select(key, F.explode(T.tokens(F.lower(text))).alias("term"))
    return words.groupBy("term", key).agg(F.count("*").alias("tf"))


def query_terms(query: str) -> list[str]:
    return "".join(c.lower() if c.isalnum() or c == "_" else " " for c in query).split()


def overlap(index: DataFrame, query: str, key: str = "post_id") -> DataFrame:
    """key, score: the share of the query's tokens (repeats count) that a document holds, for documents with any."""
    terms = query_terms(query)
    counts = {t: terms.count(t) for t in terms}
    hit = index.where(F.col("term").isin(list(counts)))  # reaches the index's scan
    weight = F.lit(0)
    for t, n in counts.items():
        weight = F.when(F.col("term") == t, n).otherwise(weight)
    return hit.groupBy(key).agg((F.sum(weight) / len(terms)).alias("score"))


def bm25(docs: DataFrame, query: str, key: str = "post_id", text: str = "content", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """key, score by BM25 with idf = ln(1 + (N - df + 0.5) / (df + 0.5)); lengths in tokens."""
    terms = sorted(set(query_terms(query)))
    words = docs.select(key, T.tokens(F.lower(text)).alias("w"))
    sized = words.select(key, F.size("w").alias("len"), F.filter("w", lambda t: t.isin(terms)).alias("hits"))
    base = sized.agg(F.count("*").alias("total"), F.avg("len").alias("mean"))
    tf = sized.select(key, "len", F.explode("hits").alias("term")).groupBy(key, "len", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))  # at most the query's terms
    both = tf.join(F.broadcast(df), "term").join(F.broadcast(base))
    idf = F.log(1 + (F.col("total") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("mean")))
    return both.groupBy(key).agg(F.sum(part).alias("score"))


def users_like(users: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """3 for the query in the user name, 2 in the display name, 1 in the bio."""
    q = query.lower()
    has = lambda c, n: F.when(F.coalesce(F.lower(c).contains(q), F.lit(False)), n).otherwise(0)
    score = has("username", 3) + has("display_name", 2) + has("bio", 1)
    return users.withColumn("score", score).where("score > 0").orderBy(F.desc("score"), "user_id").limit(limit)


def suggest(index: DataFrame, prefix: str, limit: int = 10) -> DataFrame:
    return index.where(F.col("term").startswith(prefix.lower())).select("term").distinct().orderBy("term").limit(limit)


def phrase_heads(docs: DataFrame, phrase: str, text: str = "content", most: int = 100) -> DataFrame:
    """Distinct beginnings of the texts that hold the phrase."""
    return docs.where(F.col(text).ilike(f"%{phrase}%")).select(F.substring(text, 1, most).alias("head")).distinct()


def without(index: DataFrame, gone: DataFrame, key: str = "post_id") -> DataFrame:
    return index.join(gone.select(key), key, "left_anti")


def index_statistics(index: DataFrame, key: str = "post_id") -> DataFrame:
    return index.agg(F.countDistinct(key).alias("documents"), F.countDistinct("term").alias("terms"), F.sum("tf").alias("tokens"))


def best(scored: DataFrame, k: int, key: str = "post_id") -> DataFrame:
    top = scored.orderBy(F.desc("score"), key).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), key)))  # k rows


TOKENS = r"""tok AS (SELECT post_id, unnest(list_filter(regexp_split_to_array(regexp_replace(regexp_replace(regexp_replace(lower(content), '(?:https?://|www\.)[^\s<>"'']+', ' ', 'g'), '[@#][\p{L}\p{N}_]+', ' ', 'g'), '[^\p{L}\p{N}_\s]+', ' ', 'g'), '\s+'), lambda x: x <> '')) AS term FROM texts)"""


def register(add, r6) -> None:
    idx = lambda s, d: postings(A.texts(s, d))
    add("search_overlap", lambda s, d: r6(overlap(idx(s, d), "than the shwh")), "SELECT post_id, round(count(DISTINCT term) / 3, 6) AS score FROM tok WHERE term IN ('than', 'the', 'shwh') GROUP BY 1", A.TEXTS, TOKENS)
    add("search_bm25", lambda s, d: r6(bm25(A.texts(s, d), "shwh thores than")), "SELECT post_id, round(sum(ln(1 + (total - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 6) AS score FROM tf JOIN (SELECT term, count(*) AS df FROM tf GROUP BY 1) USING (term) JOIN sz USING (post_id), (SELECT count(*) AS total FROM texts), (SELECT sum(len) / (SELECT count(*) FROM texts) AS mean FROM sz) GROUP BY 1", A.TEXTS, TOKENS, "sz AS (SELECT post_id, count(*) AS len FROM tok GROUP BY 1), tf AS (SELECT post_id, term, count(*) AS tf FROM tok WHERE term IN ('shwh', 'thores', 'than') GROUP BY 1, 2)")
    add("search_users", lambda s, d: users_like(A.users(s, d), "er#0000001", 20).select("user_id", F.col("score").cast("long").alias("score")), "SELECT user_id, CAST(2 AS BIGINT) AS score FROM users WHERE contains(lower(display_name), 'er#0000001') ORDER BY user_id LIMIT 20", A.USERS)
    add("suggest_terms", lambda s, d: suggest(idx(s, d), "Tho", 20), "SELECT DISTINCT term FROM tok WHERE starts_with(term, 'tho') ORDER BY term LIMIT 20", A.TEXTS, TOKENS)
    add("index_statistics", lambda s, d: index_statistics(idx(s, d)), "SELECT count(DISTINCT post_id) AS documents, count(DISTINCT term) AS terms, count(*) AS tokens FROM tok", A.TEXTS, TOKENS)
    add("index_delete", lambda s, d: index_statistics(without(idx(s, d), A.texts(s, d).where("language = 'fr'"))), "SELECT count(DISTINCT post_id) AS documents, count(DISTINCT term) AS terms, count(*) AS tokens FROM tok WHERE post_id NOT IN (SELECT post_id FROM texts WHERE language = 'fr')", A.TEXTS, TOKENS)
    add("phrase_heads", lambda s, d: phrase_heads(A.texts(s, d), "of the").agg(F.count("*").alias("n")), "SELECT count(DISTINCT left(content, 100)) AS n FROM texts WHERE content ILIKE '%of the%'", A.TEXTS)
