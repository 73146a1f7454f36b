"""Crawls over landed payloads: what a platform's pages gave is read as JSON lines from a folder, parsed and filtered.

No network is used: a fetcher lands the payloads, as files of one JSON document a line, and the functions here give the rows that a
crawl of them would. Each takes the raw lines (`value`) or a folder.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.sources import parsers

#: The parsers of each platform's posts and users.
POSTS = {"twitter": parsers.tweets, "weibo": parsers.weibo_posts, "reddit": parsers.reddit_posts, "telegram": parsers.telegram_posts}
USERS = {"twitter": parsers.twitter_users, "weibo": parsers.weibo_users, "reddit": parsers.reddit_users, "telegram": parsers.telegram_users}


def landed(spark: SparkSession, path: str) -> DataFrame:
    """The lines of the files in a folder; read with readStream the same folder is a stream."""
    return spark.read.text(path)


def _newest(posts: DataFrame, limit: int | None) -> DataFrame:
    return posts if limit is None else posts.orderBy(F.desc("posted_at"), "post_id").limit(limit)


def crawl(raw: DataFrame, platform: str, query: str | None = None, user_ids: list[str] | None = None, post_ids: list[str] | None = None, since=None, until=None, limit: int | None = None) -> DataFrame:
    """Posts of a platform that hold the query (in any case), are by one of the users and are one of the posts, as far as given; the newest `limit`."""
    posts = POSTS[platform](raw)
    tests: list[Column] = []
    if query is not None:
        tests.append(F.contains(F.lower("content"), F.lit(query.lower())))
    if user_ids is not None:
        tests.append(F.col("user_id").isin(user_ids))
    if post_ids is not None:
        tests.append(F.col("post_id").isin(post_ids))
    if since is not None:
        tests.append(F.col("posted_at") >= F.lit(since))
    if until is not None:
        tests.append(F.col("posted_at") <= F.lit(until))
    for test in tests:
        posts = posts.where(test)
    return _newest(posts, limit)


def keywords(raw: DataFrame, platform: str, words: list[str], limit: int | None = None) -> DataFrame:
    """Posts that hold any of the words."""
    posts = POSTS[platform](raw)
    return _newest(posts.where(F.exists(F.array(*(F.lit(w.lower()) for w in words)), lambda w: F.contains(F.lower("content"), w))), limit)


def timeline(raw: DataFrame, platform: str, user_id: str, limit: int | None = None) -> DataFrame:
    return crawl(raw, platform, user_ids=[user_id], limit=limit)


def hashtag(raw: DataFrame, platform: str, tag: str, limit: int | None = None) -> DataFrame:
    """Posts with the hashtag, given with or without its #, in any case."""
    bare = tag.strip("#").lower()
    return _newest(POSTS[platform](raw).where(F.exists("hashtags", lambda t: F.lower(t) == bare)), limit)


def trending(raw: DataFrame, column: str = "value") -> DataFrame:
    """name and tweet_count of each trend of payloads with a data list."""
    got = parsers.parsed(raw, "data array<struct<name: string, trend_name: string, tweet_count: bigint>>", column)
    return got.select(F.explode("data").alias("t")).select(F.coalesce("t.name", "t.trend_name").alias("name"), F.coalesce("t.tweet_count", F.lit(0)).alias("tweet_count"))


def hot_search(raw: DataFrame, column: str = "value") -> DataFrame:
    """payload, rank, topic and heat of a hot list: the rank counts the entries with a description, in order, within their payload."""
    got = raw.select(F.md5(column).alias("payload"), F.from_json(column, "cards array<struct<`desc`: string, desc_extr: string>>").alias("x")).where("x IS NOT NULL")
    each = got.select("payload", F.posexplode("x.cards").alias("pos", "c")).where("coalesce(c.`desc`, '') <> ''")
    return each.select("payload", F.row_number().over(Window.partitionBy("payload").orderBy("pos")).alias("rank"), F.col("c.`desc`").alias("topic"), F.col("c.desc_extr").alias("heat"))


def comments(raw: DataFrame, post_id: str | None = None, limit: int | None = None) -> DataFrame:
    """Comments as interactions, of one post if given, the oldest `limit`."""
    found = parsers.weibo_comments(raw)
    found = found if post_id is None else found.where(F.col("post_id") == post_id)
    return found if limit is None else found.orderBy("posted_at", "interaction_id").limit(limit)


def dialogs(raw: DataFrame, column: str = "value") -> DataFrame:
    """id, title and kind of a dialog list: channel for broadcasts, chat for others with a title; the rest is left out."""
    got = parsers.parsed(raw, "id bigint, title string, broadcast boolean, participants_count bigint", column)
    kind = F.when(F.coalesce("broadcast", F.lit(False)), "channel").when(F.col("title").isNotNull(), "chat")
    return got.select("id", "title", kind.alias("kind"), F.coalesce("participants_count", F.lit(0)).alias("members")).where("kind IS NOT NULL")
