"""Dashboard and view aggregates over users, posts, interactions and tasks."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def recent(df: DataFrame, column: str, as_of: Column, days: int) -> DataFrame:
    """Rows of the `days` before as_of. as_of is explicit, so that a query gives the same rows whenever it runs."""
    return df.where(F.col(column) >= as_of - F.expr(f"INTERVAL {days} DAYS"))


def overview(posts: DataFrame, users: DataFrame) -> DataFrame:
    """One row: posts, distinct authors, suspicious users."""
    authors = posts.agg(F.count("*").alias("total_posts"), F.countDistinct("user_id").alias("total_users"))
    return authors.crossJoin(users.agg(F.count_if("is_suspicious").alias("suspicious_users")))  # two rows of one


def distribution(df: DataFrame, column: str, name: str = "n") -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias(name))


def top_tags(posts: DataFrame, k: int = 10, tags: str = "hashtags") -> DataFrame:
    counted = posts.select(F.explode(tags).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))
    return counted.orderBy(F.desc("n"), "tag").limit(k)


def per_day(posts: DataFrame, *measures: Column, time: str = "posted_at") -> DataFrame:
    """Measures of each day that has posts."""
    return posts.groupBy(F.to_date(time).alias("date")).agg(*measures)


def time_series(posts: DataFrame) -> DataFrame:
    return per_day(posts, F.count("*").alias("post_count"), F.countDistinct("user_id").alias("active_users"))


def sentiment_trend(posts: DataFrame) -> DataFrame:
    return per_day(posts.where("sentiment_score IS NOT NULL"), F.avg("sentiment_score").alias("avg_sentiment"), F.count("*").alias("n"))


def engagement_trend(posts: DataFrame) -> DataFrame:
    return per_day(posts, F.sum("likes_count").alias("likes"), F.sum("shares_count").alias("shares"), F.sum("comments_count").alias("comments"))


def topic_trend(posts: DataFrame, topic: str) -> DataFrame:
    tagged = posts.select("posted_at", F.explode("hashtags").alias("tag")).where(F.col("tag") == topic)
    return per_day(tagged, F.count("*").alias("n"))


def busy_days(posts: DataFrame, more_than: int = 100, newest: int = 20) -> DataFrame:
    """Days and platforms with more than so many posts: what counts as an event."""
    return posts.groupBy(F.to_date("posted_at").alias("date"), "platform").agg(F.count("*").alias("post_count")).where(F.col("post_count") > more_than).orderBy(F.desc("date"), "platform").limit(newest)


def present_on_both(posts: DataFrame, users: DataFrame, day1: str, day2: str) -> DataFrame:
    """Users with posts on both days, and their number of posts on them."""
    mine = posts.withColumn("date", F.to_date("posted_at")).where(F.col("date").isin(F.to_date(F.lit(day1)), F.to_date(F.lit(day2))))
    both = mine.groupBy("user_id").agg(F.countDistinct("date").alias("days"), F.count("*").alias("post_count")).where("days = 2")
    return both.join(users.select("user_id", "username"), "user_id").select("user_id", "username", "post_count")


def network(users: DataFrame, edges: DataFrame, k: int = 200) -> tuple[DataFrame, DataFrame]:
    """The k users with most followers, and the edges among them by (source, target, type); loops are left out."""
    nodes = users.orderBy(F.desc("followers_count"), "user_id").limit(k)
    ids = F.broadcast(nodes.select("user_id"))  # at most k rows
    among = edges.where("source <> target").join(ids.withColumnRenamed("user_id", "source"), "source", "left_semi").join(ids.withColumnRenamed("user_id", "target"), "target", "left_semi")
    return nodes, among.groupBy("source", "target", "type").agg(F.count("*").alias("weight"))


def anomaly_accounts(users: DataFrame, features: DataFrame, threshold: float = 0.5, limit: int = 100) -> DataFrame:
    scored = features.where(F.col("anomaly_score") >= threshold).select("user_id", "anomaly_score")
    return users.drop("anomaly_score").join(scored, "user_id").orderBy(F.desc("anomaly_score"), "user_id").limit(limit)


def user_stats(users: DataFrame, posts: DataFrame, interactions: DataFrame) -> DataFrame:
    """Per user: posts, interactions and the last post. Either side is summed before it is joined, so that nothing fans out."""
    p = posts.groupBy("user_id").agg(F.countDistinct("post_id").alias("total_posts"), F.max("posted_at").alias("last_post_at"))
    i = interactions.groupBy("user_id").agg(F.countDistinct("interaction_id").alias("total_interactions"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return users.join(p, "user_id", "left").join(i, "user_id", "left").select("user_id", "username", zero("total_posts"), zero("total_interactions"), "last_post_at")


def post_stats(posts: DataFrame, users: DataFrame) -> DataFrame:
    """Per post its author and engagement = likes + 2 shares + 3 comments."""
    score = F.col("likes_count") + 2 * F.col("shares_count") + 3 * F.col("comments_count")
    return posts.join(users.select("user_id", "username"), "user_id", "left").select("post_id", "username", score.alias("engagement"))


def task_stats(tasks: DataFrame) -> DataFrame:
    return tasks.groupBy("platform", "task_type", "status").agg(
        F.count("*").alias("task_count"), F.sum("result_count").alias("total_results"), F.avg("retry_count").alias("avg_retries"), F.sum(F.when(F.col("retry_count") >= F.col("max_retries"), 1).otherwise(0)).alias("exhausted")
    )


def terms(df: DataFrame, column: str, size: int = 10) -> DataFrame:
    """The commonest values as text; null, empty, zero and false don't count; arrays count by element."""
    kind = dict(df.dtypes)[column]
    value = F.explode(column) if kind.startswith("array") else F.col(column)
    shown = df.select(value.alias("value")).where(F.col("value").isNotNull())
    text = F.col("value").cast("string")
    return shown.where(~text.isin("", "0", "0.0", "false")).groupBy(text.alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(size)


def histogram(df: DataFrame, column: str, width: float) -> DataFrame:
    return df.groupBy((F.floor(F.col(column) / width) * width).cast("double").alias("bucket")).agg(F.count("*").alias("n"))


def bucket_of(time: str, interval: str) -> Column:
    """hour, day, week (of the year, from Monday, days before the first Monday in week 00) or month; any other counts as day."""
    week = ((F.dayofyear(time) + 6 - F.weekday(time)) / 7).cast("int")
    by = {
        "hour": F.date_format(time, "yyyy-MM-dd HH:00"),
        "week": F.concat(F.date_format(time, "yyyy"), F.lit("-W"), F.lpad(week.cast("string"), 2, "0")),
        "month": F.date_format(time, "yyyy-MM"),
    }
    return by.get(interval, F.date_format(time, "yyyy-MM-dd"))


def posts_by_time(posts: DataFrame, interval: str = "day") -> DataFrame:
    return posts.where("posted_at IS NOT NULL").groupBy(bucket_of("posted_at", interval).alias("bucket")).agg(F.count("*").alias("n"))


def described(df: DataFrame, column: str) -> DataFrame:
    """mean, population std, min, max, median and quartiles (exact, linear between neighbours)."""
    q = lambda p: F.percentile(column, F.lit(p))
    return df.agg(F.avg(column).alias("mean"), F.stddev_pop(column).alias("std"), F.min(column).alias("min"), F.max(column).alias("max"), q(0.5).alias("median"), q(0.25).alias("q1"), q(0.75).alias("q3"))


def all_posts(posts: DataFrame, users: DataFrame, platform: str | None = None, limit: int = 1000) -> DataFrame:
    mine = posts if platform is None else posts.where(F.col("platform") == platform)
    return mine.join(users.select("user_id", "username"), "user_id").orderBy(F.desc("posted_at"), "post_id").limit(limit)
