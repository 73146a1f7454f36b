"""The registered queries of the analytics side and their SQL oracles.

Each entry names an operator, applies it to whole fixture tables through the adapters, and states the same result in SQL. Floats are
rounded to six digits on both sides; ties in orders are broken by keys.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions import text as T
from brindle.operators import anomaly, crossevent, evidence, features, graph, monitoring, relational, reports, search
from brindle.sources import adapters as A
from brindle.plans import more
from brindle.sources import parsers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

STOP = ["the", "and", "that", "this"]


def add(name: str, query: Query, sql: str | None = None, *views: str) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLE_SQL[name] = (f"WITH {', '.join(views)} " if views else "") + sql


def r6(df: DataFrame) -> DataFrame:
    """Doubles rounded to six digits; -0 becomes 0."""
    return df.select(*(F.round(F.col(c) + F.lit(0.0), 6).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes))



def as_of():
    return F.lit("1998-01-01").cast("timestamp_ntz")


# ---- lookups, lists and counts
add("user_by_id", lambda s, d: relational.matching(A.users(s, d), user_id=42), "SELECT * FROM users WHERE user_id = 42", A.USERS)
add("user_by_platform_name", lambda s, d: relational.matching(A.users(s, d), platform="BUILDING", username="customer000000007"), "SELECT * FROM users WHERE platform = 'BUILDING' AND username = 'customer000000007'", A.USERS)
add("list_users", lambda s, d: relational.list_users(A.users(s, d), platform="BUILDING", is_suspicious=False, limit=50, offset=10, newest="followers_count"), "SELECT * FROM users WHERE platform = 'BUILDING' AND NOT is_suspicious ORDER BY followers_count DESC, user_id LIMIT 50 OFFSET 10", A.USERS)
add("list_posts", lambda s, d: relational.list_posts(A.posts(s, d).drop("hashtags", "sentiment_score"), platform="1-URGENT", start="1996-01-01", end="1997-12-31", limit=100, offset=20), "SELECT * EXCLUDE (hashtags, sentiment_score) FROM posts WHERE platform = '1-URGENT' AND posted_at BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1997-12-31' ORDER BY posted_at DESC, post_id LIMIT 100 OFFSET 20", A.POSTS)
add("posts_by_hashtag", lambda s, d: relational.posts_by_hashtag(A.posts(s, d), "tag1", limit=100).select("post_id"), "SELECT post_id FROM posts WHERE len(list_filter(hashtags, lambda x: contains(x, 'tag1'))) > 0 ORDER BY posted_at DESC, post_id LIMIT 100", A.POSTS)
add("posts_by_whole_hashtag", lambda s, d: relational.posts_by_hashtag(A.posts(s, d), "tag1", limit=100, whole=True).select("post_id"), "SELECT post_id FROM posts WHERE list_contains(hashtags, 'tag1') ORDER BY posted_at DESC, post_id LIMIT 100", A.POSTS)
add("list_interactions", lambda s, d: relational.page(relational.matching(A.activity(s, d), user_id=7, platform="click"), F.desc("posted_at"), "event_id", limit=100), "SELECT * FROM activity WHERE user_id = 7 AND platform = 'click' ORDER BY posted_at DESC, event_id LIMIT 100", A.ACTIVITY)
add("search_content", lambda s, d: relational.search_content(A.texts(s, d), "THAN_the", limit=50, newest="post_id").select("post_id"), "SELECT post_id FROM texts WHERE content ILIKE '%THAN_the%' ORDER BY post_id DESC LIMIT 50", A.TEXTS)
add("pending_tasks", lambda s, d: relational.pending_tasks(A.tasks(s, d)).select("task_id", "priority", "created_at"), "SELECT task_id, priority, created_at FROM tasks WHERE status = 'pending' AND retry_count < max_retries ORDER BY priority DESC, created_at, task_id LIMIT 10", A.TASKS)
add("update_task_status", lambda s, d: relational.with_status(A.tasks(s, d), 33, "completed", None, result_count=5).select("task_id", "status", "result_count"), "SELECT task_id, CASE WHEN task_id = 33 THEN 'completed' ELSE status END AS status, CASE WHEN task_id = 33 THEN 5 ELSE result_count END AS result_count FROM tasks", A.TASKS)
add("increment_retry", lambda s, d: relational.with_retry(A.tasks(s, d), 33).select("task_id", "retry_count"), "SELECT task_id, CAST(retry_count + CASE WHEN task_id = 33 THEN 1 ELSE 0 END AS INTEGER) AS retry_count FROM tasks", A.TASKS)
add("delete_old_tasks", lambda s, d: relational.without_old(A.tasks(s, d), "created_at", as_of(), 30, F.col("status") == "completed").select("task_id"), "SELECT task_id FROM tasks WHERE NOT (created_at < TIMESTAMP '1998-01-01' - INTERVAL 30 DAY AND status = 'completed')", A.TASKS)
add("delete_old_logs", lambda s, d: relational.without_old(A.activity(s, d), "posted_at", F.lit("2024-01-31").cast("timestamp_ntz"), 10).select("event_id"), "SELECT event_id FROM activity WHERE NOT (posted_at < TIMESTAMP '2024-01-31' - INTERVAL 10 DAY)", A.ACTIVITY)
add("mark_suspicious", lambda s, d: relational.marked(A.users(s, d).withColumn("suspicious_score", F.lit(0.0)), 17, 0.9).select("user_id", "is_suspicious", "suspicious_score"), "SELECT user_id, is_suspicious OR user_id = 17 AS is_suspicious, CASE WHEN user_id = 17 THEN CAST(0.9 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS suspicious_score FROM users", A.USERS)
add("suspicious_users", lambda s, d: relational.top_scored(A.users(s, d), "anomaly_score", 0.7, "user_id").select("user_id", "anomaly_score"), "SELECT user_id, anomaly_score FROM users WHERE anomaly_score >= 0.7 ORDER BY anomaly_score DESC, user_id LIMIT 100", A.USERS)
add("count_users", lambda s, d: relational.count_rows(A.users(s, d), "user_id", is_suspicious=True), "SELECT count(user_id) AS n FROM users WHERE is_suspicious", A.USERS)
add("count_posts", lambda s, d: relational.within(A.posts(s, d), "posted_at", "1996-01-01", "1996-12-31").agg(F.count("post_id").alias("n")), "SELECT count(post_id) AS n FROM posts WHERE posted_at BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-12-31'", A.POSTS)
add("count_interactions", lambda s, d: relational.count_rows(A.activity(s, d), "event_id", platform="purchase"), "SELECT count(event_id) AS n FROM activity WHERE platform = 'purchase'", A.ACTIVITY)
add("raw_sql", lambda s, d: s.sql("SELECT n_regionkey, count(*) AS n FROM {nation} WHERE n_nationkey >= :least GROUP BY n_regionkey", args={"least": 3}, nation=A.table(s, d, "nation")), "SELECT n_regionkey, count(*) AS n FROM nation WHERE n_nationkey >= 3 GROUP BY n_regionkey")

# ---- writes by key
OLD = "old AS (SELECT user_id, username, followers_count FROM users WHERE user_id <= 1000)"
NEW = "new AS (SELECT user_id, username || 'x' AS username, followers_count + 1 AS followers_count FROM users WHERE user_id > 900)"


def _versions(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    u = A.users(s, d).select("user_id", "username", "followers_count")
    new = u.where("user_id > 900").select("user_id", F.concat("username", F.lit("x")).alias("username"), (F.col("followers_count") + 1).alias("followers_count"))
    return u.where("user_id <= 1000"), new


add("upsert_users", lambda s, d: relational.upsert(*_versions(s, d), ["user_id"]), "SELECT user_id, coalesce(new.username, old.username) AS username, coalesce(new.followers_count, old.followers_count) AS followers_count FROM old FULL JOIN new USING (user_id)", A.USERS, OLD, NEW)
add("upsert_some_columns", lambda s, d: relational.upsert(*_versions(s, d), ["user_id"], ["followers_count"]), "SELECT user_id, coalesce(old.username, new.username) AS username, coalesce(new.followers_count, old.followers_count) AS followers_count FROM old FULL JOIN new USING (user_id)", A.USERS, OLD, NEW)
add("insert_ignore", lambda s, d: relational.insert_new(*_versions(s, d), ["user_id"]), "SELECT * FROM old UNION ALL SELECT * FROM new WHERE user_id NOT IN (SELECT user_id FROM old)", A.USERS, OLD, NEW)
add("update_sentiment", lambda s, d: relational.with_values(A.users(s, d).select("user_id", "username", "followers_count"), _versions(s, d)[1].select("user_id", "followers_count"), ["user_id"]), "SELECT u.user_id, u.username, coalesce(new.followers_count, u.followers_count) AS followers_count FROM users u LEFT JOIN new USING (user_id)", A.USERS, NEW)
add("first_wins_dedup", lambda s, d: relational.first_of_each(A.texts(s, d), ["content"], "post_id").select("post_id"), "SELECT min(post_id) AS post_id FROM texts GROUP BY content", A.TEXTS)
add("search_filters", lambda s, d: relational.filtered(A.posts(s, d), platforms=["1-URGENT", "2-HIGH"], start="1996-01-01", end="1998-01-01", hashtags=["#TAG3"], least_likes=20).select("post_id"), "SELECT post_id FROM posts WHERE platform IN ('1-URGENT', '2-HIGH') AND posted_at BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1998-01-01' AND list_contains(hashtags, 'tag3') AND likes_count >= 20", A.POSTS)
add("sort_by_likes", lambda s, d: relational.sorted_posts(A.posts(s, d), "likes").limit(50).select("post_id"), "SELECT post_id FROM posts ORDER BY likes_count DESC, posted_at DESC, post_id LIMIT 50", A.POSTS)
add("sort_by_comments", lambda s, d: relational.sorted_posts(A.posts(s, d), "comments").limit(50).select("post_id"), "SELECT post_id FROM posts ORDER BY comments_count DESC, posted_at DESC, post_id LIMIT 50", A.POSTS)

# ---- dashboard aggregates
add("daily_activity", lambda s, d: reports.time_series(A.activity(s, d)), "SELECT CAST(posted_at AS DATE) AS date, count(*) AS post_count, count(DISTINCT user_id) AS active_users FROM activity GROUP BY 1", A.ACTIVITY)
add("type_distribution", lambda s, d: reports.distribution(A.activity(s, d), "platform"), "SELECT platform, count(*) AS n FROM activity GROUP BY 1", A.ACTIVITY)
add("overview_stats", lambda s, d: reports.overview(A.posts(s, d), A.users(s, d)), "SELECT count(*) AS total_posts, count(DISTINCT user_id) AS total_users, (SELECT count(*) FROM users WHERE is_suspicious) AS suspicious_users FROM posts", A.POSTS, A.USERS)
add("top_hashtags", lambda s, d: reports.top_tags(A.posts(s, d)), "SELECT tag, count(*) AS n FROM (SELECT unnest(hashtags) AS tag FROM posts) GROUP BY 1 ORDER BY n DESC, tag LIMIT 10", A.POSTS)
add("recent_activity", lambda s, d: reports.time_series(reports.recent(A.posts(s, d), "posted_at", as_of(), 90)), "SELECT CAST(posted_at AS DATE) AS date, count(*) AS post_count, count(DISTINCT user_id) AS active_users FROM posts WHERE posted_at >= TIMESTAMP '1998-01-01' - INTERVAL 90 DAY GROUP BY 1", A.POSTS)
add("sentiment_trend", lambda s, d: r6(reports.sentiment_trend(A.posts(s, d))), "SELECT CAST(posted_at AS DATE) AS date, round(avg(sentiment_score), 6) AS avg_sentiment, count(*) AS n FROM posts WHERE sentiment_score IS NOT NULL GROUP BY 1", A.POSTS)
add("engagement_trend", lambda s, d: reports.engagement_trend(A.posts(s, d)), "SELECT CAST(posted_at AS DATE) AS date, CAST(sum(likes_count) AS BIGINT) AS likes, CAST(sum(shares_count) AS BIGINT) AS shares, CAST(sum(comments_count) AS BIGINT) AS comments FROM posts GROUP BY 1", A.POSTS)
add("topic_trend", lambda s, d: reports.topic_trend(A.posts(s, d), "tag3"), "SELECT CAST(posted_at AS DATE) AS date, count(*) AS n FROM (SELECT posted_at, unnest(hashtags) AS tag FROM posts) WHERE tag = 'tag3' GROUP BY 1", A.POSTS)
add("busy_days", lambda s, d: reports.busy_days(A.activity(s, d), 60), "SELECT CAST(posted_at AS DATE) AS date, platform, count(*) AS post_count FROM activity GROUP BY 1, 2 HAVING count(*) > 60 ORDER BY date DESC, platform LIMIT 20", A.ACTIVITY)
add("cross_day_users", lambda s, d: reports.present_on_both(A.activity(s, d), A.users(s, d), "2024-01-05", "2024-01-06"), "SELECT user_id, username, count(*) AS post_count FROM activity JOIN users USING (user_id) WHERE CAST(posted_at AS DATE) IN (DATE '2024-01-05', DATE '2024-01-06') GROUP BY 1, 2 HAVING count(DISTINCT CAST(posted_at AS DATE)) = 2", A.ACTIVITY, A.USERS)


def _network(s: SparkSession, d: str) -> DataFrame:
    e = A.activity(s, d).select(F.col("user_id").alias("source"), (F.col("event_id") % 150).alias("target"), F.col("platform").alias("type"))
    return reports.network(A.users(s, d), e, 60)[1]


add("network_edges", _network, "SELECT user_id AS source, event_id % 150 AS target, platform AS type, count(*) AS weight FROM activity WHERE user_id <> event_id % 150 AND user_id IN (SELECT user_id FROM top) AND event_id % 150 IN (SELECT user_id FROM top) GROUP BY 1, 2, 3", A.USERS, A.ACTIVITY, "top AS (SELECT user_id FROM users ORDER BY followers_count DESC, user_id LIMIT 60)")
add("anomaly_accounts", lambda s, d: reports.anomaly_accounts(A.users(s, d), A.users(s, d).select("user_id", "anomaly_score")).select("user_id", "username", "anomaly_score"), "SELECT user_id, username, anomaly_score FROM users WHERE anomaly_score >= 0.5 ORDER BY anomaly_score DESC, user_id LIMIT 100", A.USERS)
add("all_posts", lambda s, d: reports.all_posts(A.posts(s, d), A.users(s, d), "2-HIGH", 500).select("post_id", "username"), "SELECT post_id, username FROM posts JOIN users USING (user_id) WHERE posts.platform = '2-HIGH' ORDER BY posted_at DESC, post_id LIMIT 500", A.POSTS, A.USERS)
add("user_stats_view", lambda s, d: reports.user_stats(A.users(s, d), A.posts(s, d), A.activity(s, d).withColumnRenamed("event_id", "interaction_id")), "SELECT u.user_id, u.username, coalesce(p.n, 0) AS total_posts, coalesce(i.n, 0) AS total_interactions, p.t AS last_post_at FROM users u LEFT JOIN (SELECT user_id, count(DISTINCT post_id) AS n, max(posted_at) AS t FROM posts GROUP BY 1) p USING (user_id) LEFT JOIN (SELECT user_id, count(DISTINCT event_id) AS n FROM activity GROUP BY 1) i USING (user_id)", A.USERS, A.POSTS, A.ACTIVITY)
add("post_stats_view", lambda s, d: reports.post_stats(A.posts(s, d), A.users(s, d)), "SELECT post_id, username, likes_count + 2 * shares_count + 3 * comments_count AS engagement FROM posts LEFT JOIN users USING (user_id)", A.POSTS, A.USERS)
add("task_stats_view", lambda s, d: r6(reports.task_stats(A.tasks(s, d))), "SELECT platform, task_type, status, count(*) AS task_count, CAST(sum(result_count) AS BIGINT) AS total_results, round(avg(retry_count), 6) AS avg_retries, CAST(sum(CASE WHEN retry_count >= max_retries THEN 1 ELSE 0 END) AS BIGINT) AS exhausted FROM tasks GROUP BY 1, 2, 3", A.TASKS)
add("terms_aggregation", lambda s, d: reports.terms(A.posts(s, d), "likes_count"), "SELECT CAST(likes_count AS VARCHAR) AS value, count(*) AS n FROM posts WHERE likes_count <> 0 GROUP BY 1 ORDER BY n DESC, value LIMIT 10", A.POSTS)
add("numeric_histogram", lambda s, d: reports.histogram(A.activity(s, d), "value", 10), "SELECT CAST(floor(value / 10) * 10 AS DOUBLE) AS bucket, count(*) AS n FROM activity GROUP BY 1", A.ACTIVITY)
add("posts_by_week", lambda s, d: reports.posts_by_time(A.posts(s, d), "week"), "SELECT strftime(posted_at, '%Y-W%W') AS bucket, count(*) AS n FROM posts GROUP BY 1", A.POSTS)
add("posts_by_hour", lambda s, d: reports.posts_by_time(A.activity(s, d), "hour"), "SELECT strftime(posted_at, '%Y-%m-%d %H:00') AS bucket, count(*) AS n FROM activity GROUP BY 1", A.ACTIVITY)
add("posts_by_month", lambda s, d: reports.posts_by_time(A.posts(s, d), "month"), "SELECT strftime(posted_at, '%Y-%m') AS bucket, count(*) AS n FROM posts GROUP BY 1", A.POSTS)
add("feature_statistics", lambda s, d: r6(reports.described(A.table(s, d, "lineitem"), "l_extendedprice")), "SELECT round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, round(min(x), 6) AS min, round(max(x), 6) AS max, round(quantile_cont(x, 0.5), 6) AS median, round(quantile_cont(x, 0.25), 6) AS q1, round(quantile_cont(x, 0.75), 6) AS q3 FROM (SELECT l_extendedprice AS x FROM lineitem)")

# ---- features
add("post_frequency", lambda s, d: r6(features.post_frequency(A.activity(s, d))), "SELECT user_id, round(CASE WHEN sum(n) < 2 THEN sum(n) ELSE avg(n) END, 6) AS daily_mean, round(CASE WHEN sum(n) < 2 THEN 0 ELSE stddev_pop(n) END, 6) AS daily_std, round(CASE WHEN sum(n) < 2 THEN 0 ELSE (max(n) - avg(n)) / greatest(stddev_pop(n), 1.0) END, 6) AS burst FROM (SELECT user_id, CAST(posted_at AS DATE) AS day, count(*) AS n FROM activity GROUP BY 1, 2) GROUP BY 1", A.ACTIVITY)
add("time_distribution", lambda s, d: r6(features.time_distribution(A.activity(s, d))), "SELECT user_id, round(e, 6) AS hour_entropy, round(w, 6) AS work_ratio, round(n, 6) AS night_ratio, round(k, 6) AS weekend_ratio FROM (SELECT user_id, -sum(p * log2(p + 1e-10)) AS e FROM (SELECT user_id, count(*) / sum(count(*)) OVER (PARTITION BY user_id) AS p FROM activity GROUP BY user_id, hour(posted_at)) GROUP BY 1) JOIN (SELECT user_id, avg(CASE WHEN hour(posted_at) BETWEEN 9 AND 17 THEN 1.0 ELSE 0 END) AS w, avg(CASE WHEN hour(posted_at) >= 22 OR hour(posted_at) <= 5 THEN 1.0 ELSE 0 END) AS n, avg(CASE WHEN isodow(posted_at) >= 6 THEN 1.0 ELSE 0 END) AS k FROM activity GROUP BY 1) USING (user_id)", A.ACTIVITY)
add("hour_autocorrelation", lambda s, d: r6(features.autocorrelation(A.activity(s, d), 24).withColumn("lag", F.col("lag").cast("long"))), "SELECT user_id, k AS lag, round(CASE WHEN v <= 1e-12 THEN 0 ELSE avg((x - m) * (y - m)) / v END, 6) AS value FROM (SELECT a.user_id, k, a.x, b.x AS y, m, v FROM series a JOIN stats USING (user_id), range(1, 25) t(k), series b WHERE b.user_id = a.user_id AND b.i = a.i + k) GROUP BY user_id, k, v", A.ACTIVITY, "counts AS (SELECT user_id, date_trunc('hour', posted_at) AS h, count(*) AS n FROM activity GROUP BY 1, 2), hours AS (SELECT user_id, unnest(range(min(h), max(h) + INTERVAL 1 HOUR, INTERVAL 1 HOUR)) AS h FROM counts GROUP BY 1), series AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY h) AS i, coalesce(n, 0) AS x FROM hours LEFT JOIN counts USING (user_id, h)), stats AS (SELECT user_id, avg(x) AS m, var_pop(x) AS v FROM series GROUP BY 1)")


def _delays(s: SparkSession, d: str) -> DataFrame:
    e = A.activity(s, d)
    return features.response_delay(e.select("user_id", F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("response_time"), F.col("posted_at").alias("response_at"), F.lit("2024-01-10").cast("timestamp_ntz").alias("original_at")))


add("response_delay", lambda s, d: r6(_delays(s, d)), "SELECT user_id, round(avg(x), 6) AS delay_mean, round(stddev_pop(x), 6) AS delay_std FROM (SELECT user_id, CASE WHEN event_id % 3 = 0 THEN value WHEN posted_at >= TIMESTAMP '2024-01-10' THEN epoch_us(posted_at) / 1e6 - epoch_us(TIMESTAMP '2024-01-10') / 1e6 END AS x FROM activity) WHERE x IS NOT NULL GROUP BY 1", A.ACTIVITY)
add("sentiment_stats", lambda s, d: r6(features.sentiment_stats(A.posts(s, d).where("sentiment_score IS NOT NULL").withColumn("label", F.when(F.col("sentiment_score") > 0.1, "positive").when(F.col("sentiment_score") < -0.1, "negative").otherwise("neutral")), score="sentiment_score")), "SELECT user_id, round(sum(s) / sum(n), 6) AS sentiment_mean, round(sqrt(greatest(sum(ss) / sum(n) - (sum(s) / sum(n)) ** 2, 0)), 6) AS sentiment_std, round(max(n) / sum(n), 6) AS consistency FROM (SELECT user_id, CASE WHEN sentiment_score > 0.1 THEN 1 WHEN sentiment_score < -0.1 THEN -1 ELSE 0 END AS label, count(*) AS n, sum(sentiment_score) AS s, sum(sentiment_score ** 2) AS ss FROM posts WHERE sentiment_score IS NOT NULL GROUP BY 1, 2) GROUP BY 1", A.POSTS)
WORDS = "words AS (SELECT user_id, unnest(regexp_split_to_array(lower(content), '[ \\t\\n\\r\\f\\v]+')) AS w FROM texts)"
add("word_topics", lambda s, d: r6(features.word_topics(A.texts(s, d), STOP)), "SELECT user_id, round(-sum(p * log2(p + 1e-10)), 6) AS topic_entropy, round(max(p), 6) AS top_share FROM (SELECT user_id, count(*) / sum(count(*)) OVER (PARTITION BY user_id) AS p FROM words WHERE length(w) > 2 AND w NOT IN ('the', 'and', 'that', 'this') GROUP BY user_id, w) GROUP BY 1", A.TEXTS, WORDS)
add("text_style", lambda s, d: r6(features.text_style(A.texts(s, d))), "SELECT user_id, round(avg(length(content)), 6) AS avg_length, round(sum(len(regexp_extract_all(content, '!'))) / greatest(sum(length(content)), 1), 6) AS exclamation, round(sum(len(regexp_extract_all(content, '[?]'))) / greatest(sum(length(content)), 1), 6) AS question, round(sum(len(regexp_extract_all(content, '\\p{Lu}'))) / greatest(sum(length(content)), 1), 6) AS uppercase, round(sum(len(regexp_extract_all(content, '[\\x{1F600}-\\x{1F64F}\\x{1F300}-\\x{1F5FF}\\x{1F680}-\\x{1F6FF}\\x{1F1E0}-\\x{1F1FF}\\x{2702}-\\x{27B0}\\x{24C2}-\\x{1F251}]+'))) / greatest(sum(length(content)), 1), 6) AS emoji FROM texts GROUP BY 1", A.TEXTS)


def _hours(s: SparkSession, d: str) -> DataFrame:
    e = A.activity(s, d)
    near = e.select(F.col("user_id").alias("a")).distinct().withColumn("b", F.col("a") + 1)
    return features.hour_distances(e, near.join(e.select(F.col("user_id").alias("b")).distinct(), "b").select("a", "b"))


HOURS = "p AS (SELECT user_id, hour(posted_at) AS h, count(*) / sum(count(*)) OVER (PARTITION BY user_id) AS p FROM activity GROUP BY 1, 2), ids AS (SELECT DISTINCT user_id FROM p), grid AS (SELECT x.user_id AS a, y.user_id AS b, h FROM ids x JOIN ids y ON y.user_id = x.user_id + 1, range(24) t(h)), q AS (SELECT a, b, h, coalesce(l.p, 0) AS l, coalesce(r.p, 0) AS r FROM grid LEFT JOIN p l USING (h) LEFT JOIN p r USING (h) WHERE FALSE)"
add("hour_js_similarity", lambda s, d: r6(_hours(s, d)), "SELECT a, b, round(1 - sqrt(greatest(sum(CASE WHEN l > 0 THEN l * ln(2 * l / (l + r)) ELSE 0 END + CASE WHEN r > 0 THEN r * ln(2 * r / (l + r)) ELSE 0 END) / 2, 0)), 6) AS similarity FROM (SELECT a, b, g.h, coalesce((SELECT p FROM p WHERE user_id = a AND p.h = g.h), 0) AS l, coalesce((SELECT p FROM p WHERE user_id = b AND p.h = g.h), 0) AS r FROM grid g) GROUP BY 1, 2", A.ACTIVITY, HOURS.split(", q AS")[0])
add("username_features", lambda s, d: r6(features.username_features(A.users(s, d), ["platform"])), "SELECT platform, round(avg(CASE WHEN regexp_matches(username, '(?i)^[a-z]+[0-9]+$|^[a-z]+_[0-9]+$|^user[0-9]+$|^[a-z]{8,12}[0-9]{3,6}$|^[a-z]+[0-9]{4,}$') THEN 1.0 ELSE 0 END), 6) AS pattern_ratio, round(avg(length(regexp_replace(username, '[^0-9]', '', 'g')) / length(username)), 6) AS digit_ratio FROM users GROUP BY 1", A.USERS)
add("profile_completeness", lambda s, d: r6(A.users(s, d).select("user_id", features.completeness("username", "display_name", "bio", "platform", "followers_count").alias("completeness"))), "SELECT user_id, round((4 + CASE WHEN trim(coalesce(bio, '')) <> '' THEN 1 ELSE 0 END) / 5, 6) AS completeness FROM users", A.USERS)
add("registration_regularity", lambda s, d: r6(features.registration_regularity(A.posts(s, d), ["platform"], "posted_at")))
add("avatar_pairs", lambda s, d: features.avatar_pairs(A.table(s, d, "pages").select("page_id", F.regexp_replace("url", "[0-9]+", "").alias("u")), "page_id", "u").select("a", "b", F.col("distance").cast("long").alias("distance")), "SELECT a, b, n AS distance FROM (SELECT x.page_id AS a, y.page_id AS b, (SELECT count(*) FROM range(1, 33) t(i) WHERE substr(x.h, i, 1) <> substr(y.h, i, 1)) AS n FROM u x JOIN u y ON x.page_id < y.page_id) WHERE n <= 5", "u AS (SELECT page_id, md5(regexp_replace(url, '[0-9]+', '', 'g')) AS h FROM pages)")
add("tf_idf_similarity", lambda s, d: r6(features.tf_idf_similarity(A.texts(s, d), "post_id", "content", "user_id")))

# ---- anomalies
DAILY = "daily AS (SELECT platform, CAST(posted_at AS DATE) AS day, CAST(count(*) AS DOUBLE) AS n FROM activity GROUP BY 1, 2)"


def _daily(s: SparkSession, d: str) -> DataFrame:
    return A.activity(s, d).groupBy("platform", F.to_date("posted_at").alias("day")).agg(F.count("*").cast("double").alias("n"))


add("volume_anomaly", lambda s, d: anomaly.volume_anomaly(_daily(s, d), ["platform"], "day", "n", 7, 2.0), "SELECT platform, day, n, coalesce(k >= 2 AND s > 0 AND abs(n - m) / nullif(s, 0) > 2, FALSE) AS is_anomaly FROM (SELECT *, avg(n) OVER w AS m, stddev_pop(n) OVER w AS s, count(n) OVER w AS k FROM daily WINDOW w AS (PARTITION BY platform ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING))", A.ACTIVITY, DAILY)
add("level_shift", lambda s, d: r6(anomaly.level_shift(_daily(s, d), ["platform"], "day", "n", 7, 2.0)), "SELECT platform, day, n, round(b - a, 6) AS change FROM (SELECT *, row_number() OVER (PARTITION BY platform ORDER BY day) - 1 AS i, count(*) OVER (PARTITION BY platform) AS len, avg(n) OVER (PARTITION BY platform ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS a, avg(n) OVER (PARTITION BY platform ORDER BY day ROWS BETWEEN CURRENT ROW AND 6 FOLLOWING) AS b FROM daily) WHERE len >= 14 AND i >= 7 AND i <= len - 8 AND abs(b - a) > 2", A.ACTIVITY, DAILY)
add("gap_sessions", lambda s, d: r6(anomaly.gap_sessions(A.activity(s, d), ["user_id"], "posted_at")), "SELECT user_id, min(posted_at) AS start, max(posted_at) AS \"end\", count(*) AS size, round((epoch_us(max(posted_at)) - epoch_us(min(posted_at))) / 1e6, 6) AS time_span FROM (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY posted_at ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, CASE WHEN posted_at - lag(posted_at) OVER (PARTITION BY user_id ORDER BY posted_at) <= INTERVAL 3600 SECOND THEN 0 ELSE 1 END AS f FROM activity)) GROUP BY user_id, g HAVING count(*) >= 3", A.ACTIVITY)
add("bot_score", lambda s, d: r6(anomaly.bot_score(A.activity(s, d).withColumnRenamed("platform", "content"))), "SELECT user_id, round(CASE WHEN k >= 1 AND s < 60 THEN 0.3 ELSE 0 END + CASE WHEN r < 0.3 THEN 0.3 ELSE 0 END, 6)::DOUBLE AS score, CASE WHEN k >= 1 AND s < 60 THEN 0.3 ELSE 0 END + CASE WHEN r < 0.3 THEN 0.3 ELSE 0 END > 0.5 AS is_bot FROM (SELECT user_id, stddev_pop(g) AS s, count(g) AS k, count(DISTINCT platform) / count(platform) AS r FROM (SELECT *, epoch_us(posted_at) / 1e6 - lag(epoch_us(posted_at) / 1e6) OVER (PARTITION BY user_id ORDER BY posted_at) AS g FROM activity) GROUP BY 1)", A.ACTIVITY)
LINES = ["l_quantity", "l_extendedprice", "l_discount"]
STATS = "st AS (SELECT avg(l_quantity) AS m1, stddev_pop(l_quantity) AS s1, avg(l_extendedprice) AS m2, stddev_pop(l_extendedprice) AS s2, avg(l_discount) AS m3, stddev_pop(l_discount) AS s3 FROM lineitem)"
add("zscore_detector", lambda s, d: r6(anomaly.z_scores(A.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", *LINES), LINES, 1.6).drop(*LINES)), "SELECT l_orderkey, l_linenumber, round(z, 6) AS score, z > 1.6 AS is_anomaly FROM (SELECT l_orderkey, l_linenumber, greatest(abs(l_quantity - m1) / s1, abs(l_extendedprice - m2) / s2, abs(l_discount - m3) / s3) AS z FROM lineitem, st)", STATS)
add("mahalanobis_detector", lambda s, d: r6(anomaly.mahalanobis(A.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", *LINES[:2]), LINES[:2], 2.0).drop(*LINES)), "SELECT l_orderkey, l_linenumber, round(z, 6) AS score, z > 2.0 AS is_anomaly FROM (SELECT l_orderkey, l_linenumber, sqrt(greatest((b * x * x - 2 * c * x * y + a * y * y) / (a * b - c * c), 0)) AS z FROM (SELECT l_orderkey, l_linenumber, l_quantity - mx AS x, l_extendedprice - my AS y, a, b, c FROM lineitem, (SELECT avg(l_quantity) AS mx, avg(l_extendedprice) AS my, var_samp(l_quantity) AS a, var_samp(l_extendedprice) AS b, covar_samp(l_quantity, l_extendedprice) AS c FROM lineitem)))")
add("local_outlier_factor", lambda s, d: r6(anomaly.local_outlier_factor(A.table(s, d, "embeddings"), "vec_id", "embedding", 10)), "SELECT a.k AS vec_id, round(avg(b.lrd) / max(c.lrd), 6) AS lof, round(1 / (avg(b.lrd) / max(c.lrd) + 1e-10), 6) AS density FROM best a JOIN dens b ON a.n = b.k JOIN dens c ON a.k = c.k GROUP BY a.k", "v AS (SELECT vec_id AS k, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), d AS (SELECT a.k, b.k AS n, list_distance(a.v, b.v) AS d FROM v a JOIN v b ON a.k <> b.k), best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY d, n) AS r FROM d) WHERE r <= 10), reach AS (SELECT k, max(d) AS kd FROM best GROUP BY 1), dens AS (SELECT b.k, 1 / (avg(greatest(b.d, r.kd)) + 1e-10) AS lrd FROM best b JOIN reach r ON b.n = r.k GROUP BY 1)")


def _forest(s: SparkSession, d: str) -> DataFrame:
    parts = A.table(s, d, "lineitem").groupBy("l_partkey").agg(*(F.avg(c).alias(c) for c in LINES))
    return r6(anomaly.IsolationForest().fit(parts, LINES).transform(parts))


add("isolation_forest", _forest)
add("reconstruction_error", lambda s, d: r6(anomaly.reconstruction_error(A.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", *LINES), LINES)))


def _ensemble(s: SparkSession, d: str) -> DataFrame:
    score, flag = anomaly.ensemble([F.col("anomaly_score"), F.col("followers_count") / 10000.0], [0.75, 0.25])
    return r6(A.users(s, d).select("user_id", score.alias("score"), flag.alias("is_anomaly")))


add("ensemble_detector", _ensemble, "SELECT user_id, round(anomaly_score * 0.75 + followers_count / 10000.0 * 0.25, 6) AS score, anomaly_score * 0.75 + followers_count / 10000.0 * 0.25 > 0.5 AS is_anomaly FROM users", A.USERS)
add("anomaly_class", lambda s, d: A.table(s, d, "embeddings").select("vec_id", anomaly.anomaly_class(F.transform(F.slice("embedding", 1, 5), lambda x: x * 20)).alias("kind")), "SELECT vec_id, CASE WHEN embedding[1] * 20 > 3 THEN 'viral_content' WHEN embedding[2] * 20 > 3 THEN 'rapid_spread' WHEN embedding[3] * 20 > 3 THEN 'unusual_engagement' ELSE 'behavioral_anomaly' END AS kind FROM embeddings")

# ---- text
add("text_features", lambda s, d: r6(A.texts(s, d).select("post_id", *(c.alias(n) for n, c in T.features(F.col("content")).items()))), "SELECT post_id, CAST(len(list_filter(regexp_split_to_array(content, '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> '')) AS BIGINT) AS word_count, length(content) AS char_count, CAST(len(regexp_extract_all(content, '#[\\p{L}\\p{N}_]+')) AS BIGINT) AS hashtag_count, CAST(len(regexp_extract_all(content, '@[\\p{L}\\p{N}_]+')) AS BIGINT) AS mention_count, CAST(len(regexp_extract_all(content, '(?:https?://|www\\.)[^\\s<>\"'']+')) AS BIGINT) AS url_count, CAST(len(regexp_extract_all(content, '!')) AS BIGINT) AS exclamation_count, CAST(len(regexp_extract_all(content, '[?]')) AS BIGINT) AS question_count, round(len(regexp_extract_all(content, '\\p{Lu}')) / greatest(length(content), 1), 6) AS uppercase_ratio FROM texts", A.TEXTS)
add("script_language", lambda s, d: A.texts(s, d).select("post_id", T.script_language(F.col("content")).alias("script")), "SELECT post_id, CASE WHEN len(regexp_extract_all(content, '[\\x{4e00}-\\x{9fff}]')) / n > 0.3 THEN 'zh' WHEN len(regexp_extract_all(content, '[A-Za-z]')) / n > 0.5 THEN 'en' WHEN n > 0 THEN 'other' END AS script FROM (SELECT *, nullif(length(replace(content, ' ', '')), 0) AS n FROM texts)", A.TEXTS)
add("mentions", lambda s, d: A.texts(s, d).select("post_id", F.array_join(T.mentions(F.col("content")), ",").alias("mentions")), "SELECT post_id, coalesce(array_to_string(regexp_extract_all(content, '@([\\p{L}\\p{N}_]+)', 1), ','), '') AS mentions FROM texts", A.TEXTS)
add("normalize_url", lambda s, d: A.table(s, d, "pages").select("page_id", T.normalize_url(F.col("url")).alias("url")), "SELECT page_id, lower(regexp_extract(u, '^([A-Za-z]+)://([^/?#]*)', 1)) || '://' || lower(regexp_extract(u, '^[A-Za-z]+://([^/?#]*)', 1)) || coalesce(nullif(regexp_replace(regexp_extract(u, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/+$', ''), ''), '/') || regexp_extract(u, '^[A-Za-z]+://[^/?#]*[^?#]*(\\?[^#]*)?', 1) AS url FROM (SELECT page_id, CASE WHEN regexp_matches(trim(url), '^https?://') THEN trim(url) ELSE 'https://' || trim(url) END AS u FROM pages)")
add("lexicon_sentiment", lambda s, d: r6(A.texts(s, d).select("post_id", T.lexicon(T.tokens(F.col("content")), ["the", "les", "der"], ["that", "des", "die"]).alias("x")).select("post_id", "x.score", "x.label")), "SELECT post_id, round(s, 6) AS score, CASE WHEN s > 0.1 THEN 'positive' WHEN s < -0.1 THEN 'negative' ELSE 'neutral' END AS label FROM (SELECT post_id, (p - n) / greatest(p + n, 1) AS s FROM (SELECT post_id, len(list_filter(w, lambda x: lower(x) IN ('the', 'les', 'der'))) AS p, len(list_filter(w, lambda x: lower(x) IN ('that', 'des', 'die'))) AS n FROM (SELECT post_id, regexp_split_to_array(regexp_replace(regexp_replace(regexp_replace(content, '(?:https?://|www\\.)[^\\s<>\"'']+', ' ', 'g'), '[@#][\\p{L}\\p{N}_]+', ' ', 'g'), '[^\\p{L}\\p{N}_\\s]+', ' ', 'g'), '\\s+') AS w FROM texts)))", A.TEXTS)
add("word_jaccard", lambda s, d: r6(A.table(s, d, "part").select("p_partkey", T.jaccard(T.word_set(F.col("p_name")), T.word_set(F.col("p_type"))).alias("similarity"))), "SELECT p_partkey, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) AS similarity FROM (SELECT p_partkey, list_distinct(string_split(lower(trim(p_name)), ' ')) AS a, list_distinct(string_split(lower(trim(p_type)), ' ')) AS b FROM part)")
add("url_hamming", lambda s, d: A.table(s, d, "pages").select("page_id", T.hamming(F.md5("url"), F.md5("html")).cast("long").alias("distance")), "SELECT page_id, (SELECT count(*) FROM range(1, 33) t(i) WHERE substr(md5(url), i, 1) <> substr(md5(html), i, 1)) AS distance FROM pages")
add("url_node", lambda s, d: A.table(s, d, "pages").select("page_id", T.url_node(F.col("url")).alias("node")), "SELECT page_id, 'url:' || substr(md5(url), 1, 12) AS node FROM pages")
add("tag_node", lambda s, d: A.table(s, d, "customer").select("c_custkey", T.tag_node(F.concat(F.lit("##"), F.col("c_mktsegment"), F.lit("#"))).alias("node")), "SELECT c_custkey, lower(c_mktsegment) AS node FROM customer")
add("clean_html", lambda s, d: A.table(s, d, "pages").select("page_id", F.length(T.clean_full(F.col("html"))).alias("n")))
add("validated_fields", lambda s, d: A.users(s, d).select("user_id", T.blank_to_null(F.col("bio")).alias("bio"), T.language_code(F.concat(F.lit(" "), F.col("platform"))).alias("code")), "SELECT user_id, nullif(trim(bio), '') AS bio, lower(platform) AS code FROM users", A.USERS)
add("keywords", lambda s, d: T.keywords(A.texts(s, d), "post_id", "content", 3).select("post_id", F.col("rank").cast("long").alias("rank"), "n"))

# ---- graphs
add("graph_statistics", lambda s, d: r6(graph.statistics(A.nation_graph(s, d))), "SELECT (SELECT count(*) FROM (SELECT src FROM edges UNION SELECT dst FROM edges)) AS nodes, (SELECT count(*) FROM edges) AS edges, round((SELECT count(*) FROM edges) / ((SELECT count(*) FROM (SELECT src FROM edges UNION SELECT dst FROM edges)) * ((SELECT count(*) FROM (SELECT src FROM edges UNION SELECT dst FROM edges)) - 1)), 6) AS density, round((SELECT count(*) FROM edges a JOIN edges b ON a.src = b.dst AND a.dst = b.src) / (SELECT count(*) FROM edges), 6) AS reciprocity", A.NATION_GRAPH)
add("degrees", lambda s, d: graph.degrees(A.purchases(s, d)), "SELECT node, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i + o) AS BIGINT) AS degree FROM (SELECT src AS node, 0 AS i, 1 AS o FROM edges UNION ALL SELECT dst, 1, 0 FROM edges) GROUP BY 1", A.purchases_sql())
add("pagerank", lambda s, d: r6(graph.pagerank(A.nation_graph(s, d), rounds=10)), "SELECT node, round(rank, 6) AS rank FROM r WHERE i = 10", "RECURSIVE " + A.NATION_GRAPH + ", nodes AS (SELECT src AS node FROM edges UNION SELECT dst FROM edges), sh AS (SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) AS share FROM edges), r AS (SELECT node, 0 AS i, CAST(1.0 AS DOUBLE) / (SELECT count(*) FROM nodes) AS rank FROM nodes UNION ALL SELECT node, i + 1, 0.15 / (SELECT count(*) FROM nodes) + 0.85 * (got + (1 - sum(got) OVER ()) / (SELECT count(*) FROM nodes)) FROM (SELECT n.node, max(r0.i) AS i, coalesce(sum(CASE WHEN s.dst = n.node THEN r0.rank * s.share END), 0) AS got FROM nodes n, (SELECT * FROM r WHERE i < 10) r0 LEFT JOIN sh s ON s.src = r0.node GROUP BY n.node))")
add("trace_propagation", lambda s, d: graph.levels(A.nation_graph(s, d), 3, 4).select("node", F.col("level").cast("long").alias("level")), "SELECT node, CAST(min(level) AS BIGINT) AS level FROM r GROUP BY 1", "RECURSIVE " + A.NATION_GRAPH + ", r AS (SELECT CAST(3 AS BIGINT) AS node, 0 AS level UNION SELECT dst, level + 1 FROM r JOIN edges ON src = node WHERE level < 4)")
add("propagation_tree", lambda s, d: graph.levels(A.nation_graph(s, d), 3).select("node", F.col("level").cast("long").alias("level"), "parent"), "SELECT l.node, CAST(l.level AS BIGINT) AS level, (SELECT min(e.src) FROM edges e JOIN l p ON p.node = e.src WHERE e.dst = l.node AND p.level = l.level - 1) AS parent FROM l", "RECURSIVE " + A.NATION_GRAPH + ", r AS (SELECT CAST(3 AS BIGINT) AS node, 0 AS level UNION SELECT dst, level + 1 FROM r JOIN edges ON src = node WHERE level < 25), l AS (SELECT node, min(level) AS level FROM r GROUP BY 1)")
add("ego_network", lambda s, d: graph.neighbourhood(A.nation_graph(s, d), 3, 2).select("src", "dst", "weight"), "SELECT src, dst, weight FROM edges WHERE src IN (SELECT node FROM r) AND dst IN (SELECT node FROM r)", "RECURSIVE " + A.NATION_GRAPH + ", r AS (SELECT CAST(3 AS BIGINT) AS node, 0 AS level UNION SELECT dst, level + 1 FROM r JOIN edges ON src = node WHERE level < 2)")
add("clustering", lambda s, d: r6(graph.clustering(A.nation_graph(s, d))), "SELECT n.node, coalesce(t, 0) AS triangles, round(CASE WHEN k < 2 THEN 0 ELSE 2 * coalesce(t, 0) / (k * (k - 1)) END, 6) AS clustering FROM (SELECT a AS node, count(*) AS k FROM u GROUP BY 1) n LEFT JOIN (SELECT x.a AS node, count(*) AS t FROM u x JOIN u y ON x.a = y.a AND x.b < y.b JOIN u z ON z.a = x.b AND z.b = y.b GROUP BY 1) q USING (node)", A.NATION_GRAPH, "u AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges)")
add("closeness", lambda s, d: r6(graph.closeness(A.nation_graph(s, d))), "SELECT b AS node, round(CASE WHEN sum(k) > 0 THEN (count(*) - 1) * (count(*) - 1) / (sum(k) * ((SELECT count(DISTINCT node) FROM nodes) - 1)) ELSE 0 END, 6) AS closeness FROM (SELECT a, b, min(k) AS k FROM r GROUP BY 1, 2) GROUP BY 1", "RECURSIVE " + A.NATION_GRAPH + ", nodes AS (SELECT src AS node FROM edges UNION SELECT dst FROM edges), r AS (SELECT node AS a, node AS b, 0 AS k FROM nodes UNION SELECT a, dst, k + 1 FROM r JOIN edges ON src = b WHERE k < 25)")
add("assortativity", lambda s, d: r6(graph.assortativity(A.purchases(s, d))), "SELECT round(corr(o, i), 6) AS assortativity FROM edges JOIN (SELECT src, count(*) AS o FROM edges GROUP BY 1) USING (src) JOIN (SELECT dst, count(*) AS i FROM edges GROUP BY 1) USING (dst)", A.purchases_sql())


def _regions(s: SparkSession, d: str) -> DataFrame:
    return A.table(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("node"), F.col("n_regionkey").cast("long").alias("value"))


REGIONS = "att AS (SELECT CAST(n_nationkey AS BIGINT) AS node, CAST(n_regionkey AS BIGINT) AS value FROM nation)"
add("attribute_clustering", lambda s, d: r6(graph.attribute_groups(A.nation_graph(s, d), _regions(s, d))), "SELECT value, size, internal, external, round(internal / (size * (size - 1)), 6) AS density, round(internal / (internal + external), 6) AS homophily FROM (SELECT value, count(*) AS size FROM att GROUP BY 1) JOIN (SELECT a.value, count(*) FILTER (a.value = b.value) AS internal, count(*) FILTER (a.value <> b.value) AS external FROM edges JOIN att a ON src = a.node JOIN att b ON dst = b.node GROUP BY 1) USING (value)", A.NATION_GRAPH, REGIONS)
add("attribute_mixing", lambda s, d: r6(graph.mixing(A.nation_graph(s, d), _regions(s, d))), "SELECT round((same / t - ab / (t * t)) / (1 - ab / (t * t)), 6) AS assortativity FROM (SELECT sum(n) AS t, sum(n) FILTER (a = b) AS same FROM m), (SELECT sum(x.n * y.n) AS ab FROM (SELECT a, sum(n) AS n FROM m GROUP BY 1) x JOIN (SELECT b, sum(n) AS n FROM m GROUP BY 1) y ON a = b)", A.NATION_GRAPH, REGIONS, "m AS (SELECT p.value AS a, q.value AS b, count(*) AS n FROM edges JOIN att p ON src = p.node JOIN att q ON dst = q.node GROUP BY 1, 2)")
add("relations", lambda s, d: graph.relations(A.purchases(s, d), "c7", direction="both"), "SELECT * FROM edges WHERE src = 'c7' OR dst = 'c7'", A.purchases_sql())


def labelled_sql(rounds: int, body: str) -> str:
    """Views l0 to l<rounds>, each made from the one before by `body` ({p} is the one before); u has both directions of the edges."""
    views = ["u AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges)", "l0 AS (SELECT DISTINCT a AS node, a AS label FROM u)"]
    return ", ".join(views + [f"l{i + 1} AS MATERIALIZED ({body.format(p=f'l{i}')})" for i in range(rounds)])


LEAST = "SELECT x.node, least(min(x.label), min(y.label)) AS label FROM {p} x JOIN u ON u.a = x.node JOIN {p} y ON y.node = u.b GROUP BY 1"
COMMON = "SELECT node, label FROM (SELECT u.a AS node, y.label, row_number() OVER (PARTITION BY u.a ORDER BY count(*) DESC, y.label) AS r FROM u JOIN {p} y ON y.node = u.b GROUP BY 1, 2) WHERE r = 1"
add("components", lambda s, d: graph.components(A.purchases(s, d)), "SELECT node, label AS component FROM l16", A.purchases_sql(), labelled_sql(16, LEAST))
add("label_propagation", lambda s, d: graph.label_propagation(A.purchases(s, d), 3), "SELECT node, label FROM l3", A.purchases_sql(), labelled_sql(3, COMMON))
add("core_numbers", lambda s, d: graph.core_numbers(A.purchases(s, d)))
add("betweenness", lambda s, d: r6(graph.betweenness(A.nation_graph(s, d))))
add("eigenvector", lambda s, d: r6(graph.eigenvector(A.nation_graph(s, d), 60)))
add("bridges", lambda s, d: graph.bridges(A.purchases(s, d)))
add("propagation_speed", lambda s, d: r6(graph.propagation_speed(A.activity(s, d), "posted_at")), "SELECT round(avg(s), 6) AS mean, round(max(s), 6) AS max, round(min(s), 6) AS min, round(quantile_cont(s, 0.5), 6) AS median, round(stddev_pop(s), 6) AS std FROM (SELECT 1e6 / (epoch_us(t) - lag(epoch_us(t)) OVER (ORDER BY t)) AS s FROM (SELECT DISTINCT posted_at AS t FROM activity)) WHERE s IS NOT NULL", A.ACTIVITY)

for module in (parsers, crossevent, evidence, monitoring, search, more):
    module.register(add, r6)
