"""JSON payloads of social platforms to rows: landed lines in, flat posts and users out."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions import text as T
from brindle.sources import adapters as A

TWEET = """id string, author_id string, text string, created_at string, lang string,
 entities struct<hashtags: array<struct<tag: string>>, mentions: array<struct<username: string>>, urls: array<struct<expanded_url: string, url: string>>>,
 public_metrics struct<like_count: bigint, retweet_count: bigint, reply_count: bigint, quote_count: bigint>,
 attachments struct<media_keys: array<string>>, referenced_tweets array<struct<type: string, id: string>>,
 includes struct<users: array<struct<id: string, username: string>>, media: array<struct<media_key: string, url: string>>>"""
WEIBO = """id string, mid string, user struct<id: string, screen_name: string>, text string, created_at string,
 pics array<struct<url: string, large: struct<url: string>>>, attitudes_count bigint, reposts_count bigint, comments_count bigint"""
REDDIT = "kind string, data struct<id: string, author: string, title: string, selftext: string, url: string, is_self: boolean, created_utc: double, ups: bigint, num_comments: bigint, link_flair_text: string, parent_id: string, body: string>"
TELEGRAM = "id bigint, chat_id bigint, sender struct<id: bigint, username: string, first_name: string, last_name: string>, text string, date string, views bigint, forwards bigint"


def parsed(raw: DataFrame, schema: str, column: str = "value") -> DataFrame:
    """Rows of the JSON texts that fit; a line that is no JSON is left out."""
    return raw.select(F.from_json(column, schema, {"mode": "PERMISSIVE"}).alias("x")).where("x IS NOT NULL").select("x.*")


def _list(items: Column, field: str) -> Column:
    return F.coalesce(F.filter(F.transform(items, lambda x: x[field]), lambda x: x.isNotNull()), F.array().cast("array<string>"))


def tweets(raw: DataFrame, column: str = "value") -> DataFrame:
    """Flat tweets; authors and media are looked up in the payload's includes, an unknown author keeps the id; of several references of a kind the last counts."""
    t = parsed(raw, TWEET, column).where("id IS NOT NULL")
    refs = F.coalesce("referenced_tweets", F.array().cast("array<struct<type: string, id: string>>"))
    last = lambda kind: F.try_element_at(F.filter(refs, lambda r: r["type"] == kind), F.lit(-1))["id"]
    author = F.try_element_at(F.filter("includes.users", lambda u: u["id"] == F.col("author_id")), F.lit(1))["username"]
    media = F.filter("includes.media", lambda m: F.array_contains("attachments.media_keys", m["media_key"]))
    metric = lambda name: F.coalesce(F.col(f"public_metrics.{name}"), F.lit(0))
    return t.select(
        F.col("id").alias("post_id"), F.col("author_id").alias("user_id"), F.coalesce(author, "author_id").alias("author"), F.lit("twitter").alias("platform"), F.col("text").alias("content"), F.col("lang").alias("language"),
        F.try_to_timestamp("created_at").alias("posted_at"), _list(F.col("entities.hashtags"), "tag").alias("hashtags"), _list(F.col("entities.mentions"), "username").alias("mentions"),
        F.coalesce(F.transform("entities.urls", lambda u: F.coalesce(u["expanded_url"], u["url"])), F.array().cast("array<string>")).alias("urls"), _list(media, "url").alias("media"),
        metric("like_count").alias("likes_count"), metric("retweet_count").alias("shares_count"), metric("reply_count").alias("comments_count"),
        F.exists(refs, lambda r: r["type"] == "retweeted").alias("is_retweet"), F.exists(refs, lambda r: r["type"] == "replied_to").alias("is_reply"), last("replied_to").alias("parent_post_id"), last("quoted").alias("quoted_post_id"),
    )


TWITTER_USER = "id string, username string, name string, description string, profile_image_url string, created_at string, verified boolean, public_metrics struct<followers_count: bigint, following_count: bigint, tweet_count: bigint>"
WEIBO_USER = """id string, screen_name string, name string, description string, bio string, avatar_hd string, avatar_large string, profile_image_url string, created_at string,
 followers_count bigint, followers bigint, follow_count bigint, friends bigint, statuses_count bigint, statuses bigint, verified boolean"""
WEIBO_COMMENTS = "data array<struct<id: string, user: struct<id: string>, status: struct<id: string>, created_at: string, text: string>>, comments array<struct<id: string, user: struct<id: string>, status: struct<id: string>, created_at: string, text: string>>"
REDDIT_USER = "data struct<name: string, subreddit: struct<title: string, public_description: string>, icon_img: string, snoovatar_img: string, created_utc: double, link_karma: bigint, comment_karma: bigint, verified: boolean>"
TELEGRAM_USER = "id bigint, username string, first_name string, last_name string, about string, verified boolean"


def _user(platform: str, rows: DataFrame, **columns: Column) -> DataFrame:
    """Flat users; what a platform doesn't tell is null, a missing count 0, and unverified."""
    text = lambda c: columns.get(c, F.lit(None).cast("string")).alias(c)
    count = lambda c: F.coalesce(columns.get(c, F.lit(0)), F.lit(0)).cast("long").alias(c)
    when = columns.get("created_at", F.lit(None).cast("timestamp")).alias("created_at")
    return rows.select(columns["user_id"].alias("user_id"), F.lit(platform).alias("platform"), text("username"), text("display_name"), text("bio"), text("avatar_url"), when, count("followers_count"), count("friends_count"), count("posts_count"), F.coalesce("verified", F.lit(False)).alias("verified"))


def twitter_users(raw: DataFrame, column: str = "value") -> DataFrame:
    m = lambda f: F.col(f"public_metrics.{f}")
    return _user("twitter", parsed(raw, TWITTER_USER, column).where("id IS NOT NULL"), user_id=F.col("id"), username=F.col("username"), display_name=F.col("name"), bio=F.col("description"), avatar_url=F.col("profile_image_url"), created_at=F.try_to_timestamp("created_at"), followers_count=m("followers_count"), friends_count=m("following_count"), posts_count=m("tweet_count"))


def weibo_users(raw: DataFrame, column: str = "value") -> DataFrame:
    """Users by their first known key of each kind; one without id is left out."""
    u = parsed(raw, WEIBO_USER, column).where("coalesce(id, '') <> ''")
    name, blank = F.coalesce("screen_name", "name", F.lit("")), F.lit("")
    return _user("weibo", u, user_id=F.col("id"), username=name, display_name=name, bio=F.coalesce("description", "bio", blank), avatar_url=F.coalesce("avatar_hd", "avatar_large", "profile_image_url", blank), created_at=weibo_time(F.col("created_at")), followers_count=F.coalesce("followers_count", "followers"), friends_count=F.coalesce("follow_count", "friends"), posts_count=F.coalesce("statuses_count", "statuses"))


def weibo_comments(raw: DataFrame, column: str = "value") -> DataFrame:
    """Comments of a payload's data or comments list as interactions; one without id is left out."""
    c = parsed(raw, WEIBO_COMMENTS, column).select(F.explode(F.coalesce("data", "comments")).alias("c")).select("c.*").where("coalesce(id, '') <> ''")
    return c.select(F.concat(F.lit("weibo_comment_"), "id").alias("interaction_id"), F.lit("comment").alias("type"), F.coalesce("user.id", F.lit("")).alias("user_id"), F.coalesce("status.id", F.lit("")).alias("post_id"), weibo_time(F.col("created_at")).alias("posted_at"), F.trim(F.regexp_replace("text", "<[^>]+>", "")).alias("content"))


def reddit_users(raw: DataFrame, column: str = "value") -> DataFrame:
    """Users named by their handle; posts_count is their karma for links and comments."""
    u = parsed(raw, REDDIT_USER, column).select("data.*").where("name IS NOT NULL")
    karma = F.coalesce("link_karma", F.lit(0)) + F.coalesce("comment_karma", F.lit(0))
    return _user("reddit", u, user_id=F.col("name"), username=F.col("name"), display_name=F.col("subreddit.title"), bio=F.col("subreddit.public_description"), avatar_url=F.coalesce(F.nullif("icon_img", F.lit("")), "snoovatar_img"), created_at=F.timestamp_seconds("created_utc"), posts_count=karma)


def telegram_users(raw: DataFrame, column: str = "value") -> DataFrame:
    """Users; the shown name is first and last name."""
    u = parsed(raw, TELEGRAM_USER, column).where("id IS NOT NULL")
    shown = F.nullif(F.trim(F.concat_ws(" ", "first_name", F.nullif("last_name", F.lit("")))), F.lit(""))
    return _user("telegram", u, user_id=F.col("id").cast("string"), username=F.col("username"), display_name=shown, bio=F.col("about"))


def weibo_time(text: Column) -> Column:
    """Of the usual forms; the weekday in front is dropped, as Spark can't parse it; else null."""
    bare = F.regexp_replace(text, "^[A-Za-z]{3} ", "")
    return F.coalesce(*(F.try_to_timestamp(bare, F.lit(p)) for p in ("MMM dd HH:mm:ss Z yyyy", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd")))


def weibo_posts(raw: DataFrame, column: str = "value") -> DataFrame:
    w = parsed(raw, WEIBO, column).where("coalesce(id, mid) IS NOT NULL")
    zero = lambda c: F.coalesce(c, F.lit(0))
    bare = F.trim(F.regexp_replace("text", "<[^>]+>", ""))
    return w.select(F.coalesce("id", "mid").alias("post_id"), F.col("user.id").alias("user_id"), F.col("user.screen_name").alias("author"), F.lit("weibo").alias("platform"), bare.alias("content"), F.lit("zh").alias("language"), weibo_time(F.col("created_at")).alias("posted_at"), T.paired_hashtags(bare).alias("hashtags"), F.coalesce(F.transform("pics", lambda p: F.coalesce(p["large"]["url"], p["url"])), F.array().cast("array<string>")).alias("media"), zero("attitudes_count").alias("likes_count"), zero("reposts_count").alias("shares_count"), zero("comments_count").alias("comments_count"))


def reddit_posts(raw: DataFrame, column: str = "value") -> DataFrame:
    r = parsed(raw, REDDIT, column).where("kind = 't3'").select("data.*")
    body = F.concat_ws("\n\n", T.blank_to_null(F.col("title")), T.blank_to_null(F.col("selftext")))
    flair = F.when(T.blank_to_null(F.col("link_flair_text")).isNotNull(), F.array("link_flair_text")).otherwise(F.array().cast("array<string>"))
    return r.select(F.col("id").alias("post_id"), F.col("author").alias("user_id"), F.lit("reddit").alias("platform"), body.alias("content"), F.timestamp_seconds("created_utc").alias("posted_at"), flair.alias("hashtags"), F.coalesce("ups", F.lit(0)).alias("likes_count"), F.lit(0).cast("long").alias("shares_count"), F.coalesce("num_comments", F.lit(0)).alias("comments_count"))


def reddit_comments(raw: DataFrame, column: str = "value") -> DataFrame:
    """Comments as rows that name their parent; a tree of any depth is a walk over them."""
    r = parsed(raw, REDDIT, column).where("kind = 't1'").select("data.*")
    return r.select(F.col("id").alias("comment_id"), F.regexp_replace("parent_id", "^t[13]_", "").alias("parent_id"), F.col("author").alias("user_id"), F.col("body").alias("content"))


def telegram_posts(raw: DataFrame, column: str = "value") -> DataFrame:
    m = parsed(raw, TELEGRAM, column).where("id IS NOT NULL")
    body = F.coalesce("text", F.lit(""))
    return m.select(F.concat_ws(":", F.col("chat_id").cast("string"), F.col("id").cast("string")).alias("post_id"), F.col("sender.id").cast("string").alias("user_id"), F.concat_ws(" ", "sender.first_name", "sender.last_name").alias("author"), F.lit("telegram").alias("platform"), body.alias("content"), F.try_to_timestamp("date").alias("posted_at"), T.hashtags(body).alias("hashtags"), T.mentions(body).alias("mentions"), F.coalesce("views", F.lit(0)).alias("likes_count"), F.coalesce("forwards", F.lit(0)).alias("shares_count"))


def thread_depths(comments: DataFrame, key: str, parent: str, most: int | None = None) -> DataFrame:
    """key and depth (roots 0) of every comment whose chain of parents ends at a root, by pointer jumping: each round doubles the distance looked up, so that depth d takes log2(d) rounds. most: a depth to stop at."""
    from brindle.operators.graph import cut

    at = comments.select(key, F.col(parent).alias("up"), F.when(F.col(parent).isNull(), 0).otherwise(1).alias("depth"))
    while True:
        far = at.select(F.col(key).alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"))
        at = cut(at.join(far, "up", "left").select(key, F.col("next").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")))
        if at.where("up IS NOT NULL").isEmpty():
            break
    out = at.select(key, "depth")
    return out if most is None else out.where(F.col("depth") <= most)


def register(add, r6) -> None:
    def landed(s, d):
        o = A.table(s, d, "orders")
        body = F.struct(F.col("o_orderkey").cast("string").alias("id"), F.col("o_custkey").cast("string").alias("author_id"), F.concat(F.lit("post #"), F.col("o_orderstatus")).alias("text"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("created_at"), F.struct(F.array(F.struct(F.col("o_orderstatus").alias("tag"))).alias("hashtags")).alias("entities"), F.struct((F.col("o_orderkey") % 5).alias("like_count")).alias("public_metrics"), F.array(F.struct(F.when(F.col("o_orderkey") % 2 == 0, "retweeted").otherwise("replied_to").alias("type"), F.col("o_custkey").cast("string").alias("id"))).alias("referenced_tweets"))
        return o.select(F.to_json(body).alias("value"))

    add("parse_tweets", lambda s, d: tweets(landed(s, d)).select("post_id", "user_id", "author", "content", F.array_join("hashtags", ",").alias("tags"), "likes_count", "is_retweet", "parent_post_id"), "SELECT CAST(o_orderkey AS VARCHAR) AS post_id, CAST(o_custkey AS VARCHAR) AS user_id, CAST(o_custkey AS VARCHAR) AS author, 'post #' || o_orderstatus AS content, o_orderstatus AS tags, o_orderkey % 5 AS likes_count, o_orderkey % 2 = 0 AS is_retweet, CASE WHEN o_orderkey % 2 = 1 THEN CAST(o_custkey AS VARCHAR) END AS parent_post_id FROM orders")
    def turns(s, d):
        key = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
        up = F.when(F.col("turn") > 0, F.concat_ws("-", F.col("conv_id").cast("string"), (F.col("turn") - 1).cast("string")))
        return A.table(s, d, "conversations").select(key.alias("id"), up.alias("parent")).distinct()

    add("thread_depths", lambda s, d: thread_depths(turns(s, d), "id", "parent").withColumn("depth", F.col("depth").cast("long")), "SELECT DISTINCT conv_id || '-' || turn AS id, turn AS depth FROM conversations")
    add("count_text", lambda s, d: A.table(s, d, "orders").select("o_orderkey", T.count_text(F.concat(F.col("o_custkey").cast("string"), F.when(F.col("o_orderkey") % 2 == 0, "万").otherwise(""))).alias("n")), "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey * 10000 ELSE o_custkey END AS n FROM orders")
