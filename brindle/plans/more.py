"""More registered queries: sources, parsers, text, communities, matching, vectors, layers and monitoring."""

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.functions import text as T
from brindle.operators import anomaly, autoencoder, communities, crossevent, evidence, features, graph, monitoring, neural, paths, relational, reports, vectors
from brindle.sources import adapters as A
from brindle.sources import crawl, parsers
from brindle.streaming import stateful


def _json(rows: DataFrame, **columns) -> DataFrame:
    return rows.select(F.to_json(F.struct(*(c.alias(n) for n, c in columns.items()))).alias("value"))


def register(add, r6) -> None:
    text = lambda c: F.col(c).cast("string")
    long = lambda c: F.col(c).cast("long").alias(c)

    # ---- users and comments of the platforms
    cust = lambda s, d: A.table(s, d, "customer")
    shown = ["user_id", "platform", "username", "display_name", "bio", "followers_count", "friends_count", "posts_count", "verified"]
    add("parse_twitter_users", lambda s, d: parsers.twitter_users(_json(cust(s, d), id=text("c_custkey"), username=F.col("c_name"), name=F.col("c_mktsegment"), description=F.when(F.col("c_nationkey") > 5, F.lit("x")), verified=F.col("c_acctbal") > 0, public_metrics=F.struct(F.col("c_nationkey").cast("long").alias("followers_count"), (F.col("c_custkey") % 7).cast("long").alias("tweet_count")))).select(*shown), "SELECT CAST(c_custkey AS VARCHAR) AS user_id, 'twitter' AS platform, c_name AS username, c_mktsegment AS display_name, CASE WHEN c_nationkey > 5 THEN 'x' END AS bio, CAST(c_nationkey AS BIGINT) AS followers_count, CAST(0 AS BIGINT) AS friends_count, CAST(c_custkey % 7 AS BIGINT) AS posts_count, c_acctbal > 0 AS verified FROM customer")
    add("parse_weibo_users", lambda s, d: parsers.weibo_users(_json(cust(s, d), id=text("c_custkey"), screen_name=F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")), name=F.col("c_mktsegment"), bio=F.lit("b"), followers=F.col("c_nationkey").cast("long"), friends=F.lit(3), statuses_count=F.lit(4), statuses=F.lit(5))).select(*shown), "SELECT CAST(c_custkey AS VARCHAR) AS user_id, 'weibo' AS platform, n AS username, n AS display_name, 'b' AS bio, CAST(c_nationkey AS BIGINT) AS followers_count, CAST(3 AS BIGINT) AS friends_count, CAST(4 AS BIGINT) AS posts_count, FALSE AS verified FROM (SELECT *, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE c_mktsegment END AS n FROM customer)")
    add("parse_reddit_users", lambda s, d: parsers.reddit_users(_json(cust(s, d), data=F.struct(F.col("c_name").alias("name"), F.struct(F.col("c_mktsegment").alias("title")).alias("subreddit"), F.col("c_nationkey").cast("long").alias("link_karma"), F.lit(2).alias("comment_karma"), F.lit(True).alias("verified")))).select(*shown), "SELECT c_name AS user_id, 'reddit' AS platform, c_name AS username, c_mktsegment AS display_name, CAST(NULL AS VARCHAR) AS bio, CAST(0 AS BIGINT) AS followers_count, CAST(0 AS BIGINT) AS friends_count, CAST(c_nationkey + 2 AS BIGINT) AS posts_count, TRUE AS verified FROM customer")
    add("parse_telegram_users", lambda s, d: parsers.telegram_users(_json(cust(s, d), id=F.col("c_custkey"), username=F.col("c_name"), first_name=F.col("c_mktsegment"), last_name=F.when(F.col("c_custkey") % 2 == 0, F.lit("Y")).otherwise(""), about=F.lit("z"))).select(*shown), "SELECT CAST(c_custkey AS VARCHAR) AS user_id, 'telegram' AS platform, c_name AS username, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment || ' Y' ELSE c_mktsegment END AS display_name, 'z' AS bio, CAST(0 AS BIGINT) AS followers_count, CAST(0 AS BIGINT) AS friends_count, CAST(0 AS BIGINT) AS posts_count, FALSE AS verified FROM customer")
    orders = lambda s, d: A.table(s, d, "orders")
    entry = lambda k: F.struct(F.when(F.col("o_orderkey") % k > 0, text("o_orderkey")).alias("id"), F.struct(text("o_custkey").alias("id")).alias("user"), F.struct(F.lit("p").alias("id")).alias("status"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("created_at"), F.concat(F.lit("<b>"), F.col("o_orderstatus"), F.lit("</b> ")).alias("text"))
    add("parse_weibo_comments", lambda s, d: parsers.weibo_comments(_json(orders(s, d), data=F.array(entry(5)))).withColumn("posted_at", F.date_format("posted_at", "yyyy-MM-dd")), "SELECT 'weibo_comment_' || o_orderkey AS interaction_id, 'comment' AS type, CAST(o_custkey AS VARCHAR) AS user_id, 'p' AS post_id, strftime(o_orderdate, '%Y-%m-%d') AS posted_at, o_orderstatus AS content FROM orders WHERE o_orderkey % 5 > 0")
    weibo = lambda s, d: _json(orders(s, d), mid=text("o_orderkey"), user=F.struct(text("o_custkey").alias("id"), F.lit("n").alias("screen_name")), text=F.concat(F.lit("<i>#"), F.col("o_orderstatus"), F.lit("#</i> #b# x")), created_at=F.date_format("o_orderdate", "yyyy-MM-dd HH:mm"), attitudes_count=F.col("o_orderkey") % 9, comments_count=F.lit(2))
    add("parse_weibo_posts", lambda s, d: parsers.weibo_posts(weibo(s, d)).select("post_id", "user_id", "content", F.array_join("hashtags", ",").alias("tags"), F.date_format("posted_at", "yyyy-MM-dd").alias("day"), "likes_count", "comments_count"), "SELECT CAST(o_orderkey AS VARCHAR) AS post_id, CAST(o_custkey AS VARCHAR) AS user_id, '#' || o_orderstatus || '# #b# x' AS content, o_orderstatus || ',b' AS tags, strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderkey % 9 AS likes_count, CAST(2 AS BIGINT) AS comments_count FROM orders")
    reddit = lambda s, d, kind: _json(orders(s, d), kind=F.lit(kind), data=F.struct(text("o_orderkey").alias("id"), text("o_custkey").alias("author"), F.col("o_orderstatus").alias("title"), F.when(F.col("o_orderkey") % 2 == 0, F.lit("body")).otherwise("").alias("selftext"), F.lit(86400.0).alias("created_utc"), (F.col("o_orderkey") % 9).alias("ups"), F.lit(3).alias("num_comments"), F.lit("flair").alias("link_flair_text"), F.concat(F.lit("t3_"), text("o_custkey")).alias("parent_id"), F.lit("said").alias("body")))
    add("parse_reddit_posts", lambda s, d: parsers.reddit_posts(reddit(s, d, "t3")).select("post_id", "user_id", "content", F.array_join("hashtags", ",").alias("tags"), F.unix_seconds("posted_at").alias("at"), "likes_count", "shares_count", "comments_count"), "SELECT CAST(o_orderkey AS VARCHAR) AS post_id, CAST(o_custkey AS VARCHAR) AS user_id, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus || chr(10) || chr(10) || 'body' ELSE o_orderstatus END AS content, 'flair' AS tags, CAST(86400 AS BIGINT) AS at, o_orderkey % 9 AS likes_count, CAST(0 AS BIGINT) AS shares_count, CAST(3 AS BIGINT) AS comments_count FROM orders")
    add("parse_reddit_comments", lambda s, d: parsers.reddit_comments(reddit(s, d, "t1")), "SELECT CAST(o_orderkey AS VARCHAR) AS comment_id, CAST(o_custkey AS VARCHAR) AS parent_id, CAST(o_custkey AS VARCHAR) AS user_id, 'said' AS content FROM orders")
    gram = lambda s, d: _json(orders(s, d), id=F.col("o_orderkey"), chat_id=F.lit(7), sender=F.struct(F.col("o_custkey").alias("id"), F.lit("Ann").alias("first_name"), F.lit("B").alias("last_name")), text=F.concat(F.lit("#"), F.col("o_orderstatus"), F.lit(" @me hi")), views=F.lit(5))
    add("parse_telegram_posts", lambda s, d: parsers.telegram_posts(gram(s, d)).select("post_id", "user_id", "author", "content", F.array_join("hashtags", ",").alias("tags"), F.array_join("mentions", ",").alias("named")), "SELECT '7:' || o_orderkey AS post_id, CAST(o_custkey AS VARCHAR) AS user_id, 'Ann B' AS author, '#' || o_orderstatus || ' @me hi' AS content, o_orderstatus AS tags, 'me' AS named FROM orders")

    # ---- crawls over landed payloads
    add("crawl_keywords", lambda s, d: crawl.keywords(weibo(s, d), "weibo", ["#o#", "zzz"]).select("post_id"), "SELECT CAST(o_orderkey AS VARCHAR) AS post_id FROM orders WHERE o_orderstatus = 'O'")
    add("crawl_timeline", lambda s, d: crawl.timeline(gram(s, d), "telegram", "7").select("post_id"), "SELECT '7:' || o_orderkey AS post_id FROM orders WHERE o_custkey = 7")
    add("crawl_hashtag", lambda s, d: crawl.hashtag(gram(s, d), "telegram", "#f").select("post_id"), "SELECT '7:' || o_orderkey AS post_id FROM orders WHERE o_orderstatus = 'F'")
    add("crawl_query", lambda s, d: crawl.crawl(weibo(s, d), "weibo", query="#P#", since="1995-01-01", limit=100).select("post_id"), "SELECT CAST(o_orderkey AS VARCHAR) AS post_id FROM orders WHERE o_orderstatus = 'P' AND o_orderdate >= TIMESTAMP '1995-01-01' ORDER BY o_orderdate DESC, post_id LIMIT 100")
    add("crawl_trending", lambda s, d: crawl.trending(_json(A.table(s, d, "nation"), data=F.array(F.struct(F.col("n_name").alias("name"), F.col("n_nationkey").cast("long").alias("tweet_count")), F.struct(F.concat(F.lit("t"), F.col("n_name")).alias("name"), F.lit(None).cast("long").alias("tweet_count"))))), "SELECT n_name AS name, CAST(n_nationkey AS BIGINT) AS tweet_count FROM nation UNION ALL SELECT 't' || n_name, 0 FROM nation")
    add("crawl_hot_search", lambda s, d: crawl.hot_search(_json(A.table(s, d, "nation"), cards=F.array(F.struct(F.lit("").alias("desc"), F.lit("1").alias("desc_extr")), F.struct(F.col("n_name").alias("desc"), F.lit("2").alias("desc_extr")), F.struct(F.lit("x").alias("desc"), F.lit("3").alias("desc_extr"))))).select(long("rank"), "topic", "heat"), "SELECT CAST(1 AS BIGINT) AS rank, n_name AS topic, '2' AS heat FROM nation UNION ALL SELECT 2, 'x', '3' FROM nation")
    add("crawl_comments", lambda s, d: crawl.comments(_json(orders(s, d), comments=F.array(entry(3))), "p").select("interaction_id"), "SELECT 'weibo_comment_' || o_orderkey AS interaction_id FROM orders WHERE o_orderkey % 3 > 0")
    add("crawl_dialogs", lambda s, d: crawl.dialogs(_json(cust(s, d), id=F.col("c_custkey"), title=F.when(F.col("c_custkey") % 3 > 0, F.col("c_name")), broadcast=F.col("c_custkey") % 2 == 0)).select("id", "title", "kind"), "SELECT c_custkey AS id, CASE WHEN c_custkey % 3 > 0 THEN c_name END AS title, CASE WHEN c_custkey % 2 = 0 THEN 'channel' ELSE 'chat' END AS kind FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 > 0")

    # ---- lists, statistics, reports
    add("list_tasks", lambda s, d: relational.page(relational.matching(A.tasks(s, d), platform="1-URGENT", status="pending"), F.desc("created_at"), "task_id", limit=100).select("task_id"), "SELECT task_id FROM tasks WHERE platform = '1-URGENT' AND status = 'pending' ORDER BY created_at DESC, task_id LIMIT 100", A.TASKS)
    add("list_logs", lambda s, d: relational.page(relational.matching(A.activity(s, d), platform="error"), F.desc("posted_at"), "event_id", limit=100).select("event_id"), "SELECT event_id FROM activity WHERE platform = 'error' ORDER BY posted_at DESC, event_id LIMIT 100", A.ACTIVITY)
    add("store_statistics", lambda s, d: reports.distribution(A.posts(s, d), "platform").crossJoin(A.posts(s, d).agg(F.count("*").alias("posts"))).crossJoin(A.users(s, d).agg(F.count("*").alias("users"))), "SELECT platform, count(*) AS n, (SELECT count(*) FROM posts) AS posts, (SELECT count(*) FROM users) AS users FROM posts GROUP BY 1", A.USERS, A.POSTS)
    pages = lambda s, d: A.table(s, d, "pages").select("page_id", T.normalized_content(F.col("html")).alias("content"))
    add("cleaning_stats", lambda s, d: r6(T.cleaning_stats(pages(s, d))))
    add("normalized_content", lambda s, d: pages(s, d).select("page_id", "content.original_length", "content.html_tags", "content.control_chars"), "SELECT page_id, CAST(length(html) AS INTEGER) AS original_length, CAST(len(regexp_extract_all(html, '<[^>]+>')) AS INTEGER) AS html_tags, CAST(len(regexp_extract_all(html, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]')) AS INTEGER) AS control_chars FROM pages")

    # ---- text
    docs = lambda s, d: A.texts(s, d)
    add("hashtags", lambda s, d: docs(s, d).select("post_id", F.array_join(T.hashtags(F.col("content")), ",").alias("tags")), "SELECT post_id, coalesce(array_to_string(regexp_extract_all(content, '#([\\p{L}\\p{N}_]+)', 1), ','), '') AS tags FROM texts", A.TEXTS)
    add("paired_hashtags", lambda s, d: docs(s, d).select("post_id", F.size(T.paired_hashtags(F.col("content"))).cast("long").alias("n")), "SELECT post_id, CAST(len(list_filter(regexp_extract_all(content, '#([^#]+)#', 1), lambda x: trim(x, ' ') <> '')) AS BIGINT) AS n FROM texts", A.TEXTS)
    add("emoji_count", lambda s, d: docs(s, d).select("post_id", F.regexp_count("content", F.lit(T.EMOJI)).cast("long").alias("n")), "SELECT post_id, len(regexp_extract_all(content, '[\\x{1F600}-\\x{1F64F}\\x{1F300}-\\x{1F5FF}\\x{1F680}-\\x{1F6FF}\\x{1F1E0}-\\x{1F1FF}\\x{2702}-\\x{27B0}\\x{24C2}-\\x{1F251}]+')) AS n FROM texts", A.TEXTS)
    parts = lambda s, d: A.table(s, d, "part")
    add("text_lists", lambda s, d: parts(s, d).select("p_partkey", F.array_join(T.text_list(F.array(F.concat(F.lit(" "), F.col("p_brand")), F.lit(" "), F.col("p_brand"), F.col("p_type"))), "|").alias("items")), "SELECT p_partkey, CASE WHEN p_brand = p_type THEN p_brand ELSE p_brand || '|' || p_type END AS items FROM part")
    add("url_lists", lambda s, d: A.table(s, d, "pages").select("page_id", F.array_join(T.url_list(F.array("url", F.lit("ftp://x"), F.concat(F.lit(" "), F.col("url")))), "|").alias("urls"), T.valid_url(F.col("url")).alias("valid")), "SELECT page_id, CASE WHEN regexp_matches(trim(url), '^https?://') THEN trim(url) ELSE '' END AS urls, CASE WHEN regexp_matches(trim(url), '^https?://') THEN trim(url) END AS valid FROM pages")
    add("lexicon_default", lambda s, d: r6(parts(s, d).select("p_partkey", T.lexicon(T.tokens(F.concat_ws(" ", F.when(F.col("p_partkey") % 2 == 0, F.lit("Good superb 好")), F.when(F.col("p_partkey") % 3 == 0, F.lit("worst failure")), F.lit("x")))).alias("x")).select("p_partkey", "x.score", "x.label")), "SELECT p_partkey, round((p - n) / greatest(p + n, 1), 6) AS score, CASE WHEN p > n THEN 'positive' WHEN p < n THEN 'negative' ELSE 'neutral' END AS label FROM (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 3 ELSE 0 END AS p, CASE WHEN p_partkey % 3 = 0 THEN 2 ELSE 0 END AS n FROM part)")

    # ---- graphs and communities
    posts = lambda s, d: orders(s, d).select(F.col("o_orderkey").alias("post_id"), (F.col("o_orderkey") - 1).alias("parent_id"), F.concat(F.lit("u"), text("o_custkey")).alias("author"), F.array(F.concat(F.lit("u"), (F.col("o_custkey") % 10).cast("string"))).alias("mentions"))
    add("interaction_graph", lambda s, d: graph.interaction_graph(posts(s, d)), "SELECT src, dst, count(*) AS weight FROM (SELECT 'u' || a.o_custkey AS src, 'u' || b.o_custkey AS dst FROM orders a JOIN orders b ON a.o_orderkey - 1 = b.o_orderkey UNION ALL SELECT 'u' || o_custkey, 'u' || (o_custkey % 10) FROM orders) WHERE src <> dst GROUP BY 1, 2")
    add("central_nodes", lambda s, d: communities.central_nodes(graph.degrees(A.purchases(s, d)), "degree", 20).select(long("rank"), "node", "score"), "SELECT row_number() OVER (ORDER BY score DESC, node) AS rank, node, score FROM (SELECT node, count(*) AS score FROM (SELECT src AS node FROM edges UNION ALL SELECT dst FROM edges) GROUP BY 1) ORDER BY score DESC, node LIMIT 20", A.purchases_sql())
    add("neighbours", lambda s, d: graph.neighbours(A.purchases(s, d), "s3", direction="in"), "SELECT DISTINCT src AS node FROM edges WHERE dst = 's3'", A.purchases_sql())
    typed = lambda s, d: A.activity(s, d).select(F.col("user_id").alias("src"), (F.col("event_id") % 50).alias("dst"), F.col("platform").alias("type"), "event_id")
    add("latest_relation", lambda s, d: graph.latest_relation(typed(s, d), "event_id"), "SELECT user_id AS src, event_id % 50 AS dst, arg_max(platform, event_id) AS type, max(event_id) AS event_id FROM activity GROUP BY 1, 2", A.ACTIVITY)
    add("merged_relations", lambda s, d: graph.merged_relations(typed(s, d).select("src", "type", "dst"), A.table(s, d, "customer").select(F.col("c_custkey").alias("node"))), "SELECT DISTINCT user_id AS src, platform AS type, event_id % 50 AS dst FROM activity WHERE user_id IN (SELECT c_custkey FROM customer) AND event_id % 50 IN (SELECT c_custkey FROM customer)", A.ACTIVITY)
    add("edge_index", lambda s, d: communities.edge_index(A.purchases(s, d), graph.nodes_of(A.purchases(s, d))).select(long("src_id"), long("dst_id")), "SELECT a.id AS src_id, b.id AS dst_id FROM edges JOIN ids a ON src = a.node JOIN ids b ON dst = b.node", A.purchases_sql(), "ids AS (SELECT node, row_number() OVER (ORDER BY node) - 1 AS id FROM (SELECT src AS node FROM edges UNION SELECT dst FROM edges))")
    add("path_steps", lambda s, d: r6(communities.path_steps(A.activity(s, d).select("platform", F.col("event_id").alias("node"), F.col("posted_at").alias("ts")), ["platform"])), "SELECT platform, event_id AS source, lead(event_id) OVER w AS target, round((epoch_us(lead(posted_at) OVER w) - epoch_us(posted_at)) / 1e6, 6) AS time_diff FROM activity WINDOW w AS (PARTITION BY platform ORDER BY posted_at, event_id) QUALIFY target IS NOT NULL", A.ACTIVITY)
    nation = lambda s, d: A.nation_graph(s, d)
    add("community_quality", lambda s, d: r6(communities.quality(communities.undirected(A.purchases(s, d)), graph.nodes_of(A.purchases(s, d)).select("node", (F.length("node") % 3).alias("community")))), "SELECT round(sum(i) / sum(k) - sum(k * k) / (sum(k) * sum(k)), 6) AS modularity FROM (SELECT length(a) % 3 AS c, CAST(sum(w) AS DOUBLE) AS k, CAST(sum(CASE WHEN length(a) % 3 = length(b) % 3 THEN w ELSE 0 END) AS DOUBLE) AS i FROM u GROUP BY 1)", A.purchases_sql(), "u AS (SELECT src AS a, dst AS b, weight AS w FROM edges UNION ALL SELECT dst, src, weight FROM edges)")
    add("louvain", lambda s, d: communities.louvain(nation(s, d)))
    add("greedy_modularity", lambda s, d: communities.greedy_modularity(nation(s, d)))
    add("community_table", lambda s, d: r6(communities.described(graph.nodes_of(A.purchases(s, d)).select("node", F.length("node").alias("community")), A.purchases(s, d)).select(long("community"), "size", "density")), "SELECT community, size, round(coalesce(e, 0) / (size * (size - 1)), 6) AS density FROM (SELECT CAST(length(node) AS BIGINT) AS community, count(*) AS size FROM (SELECT src AS node FROM edges UNION SELECT dst FROM edges) GROUP BY 1) LEFT JOIN (SELECT CAST(length(src) AS BIGINT) AS community, count(*) AS e FROM edges WHERE length(src) = length(dst) GROUP BY 1) USING (community) WHERE size >= 3", A.purchases_sql())
    add("influence_scores", lambda s, d: r6(communities.influence_scores(nation(s, d))))
    add("key_spreaders", lambda s, d: r6(communities.key_spreaders(nation(s, d))))
    add("key_nodes", lambda s, d: r6(communities.key_nodes(nation(s, d))))
    add("influencers_by_degree", lambda s, d: r6(communities.influencers(A.purchases(s, d), 20, "degree").select("node", "score")), "SELECT node, round(n / (SELECT max(n) FROM g), 6) AS score FROM g ORDER BY n DESC, node LIMIT 20", A.purchases_sql(), "g AS (SELECT node, count(*) AS n FROM (SELECT src AS node FROM edges UNION ALL SELECT dst FROM edges) GROUP BY 1)")
    add("influencers", lambda s, d: r6(communities.influencers(nation(s, d))))
    add("centrality_features", lambda s, d: r6(communities.centrality_features(nation(s, d))))
    add("network_metrics", lambda s, d: r6(communities.network_metrics(nation(s, d))))
    every_way = lambda s, d: (lambda e: e.select("src", "dst").unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))))(A.purchases(s, d))
    add("sketched_closeness", lambda s, d: r6(paths.closeness(every_way(s, d))))
    add("neighbourhood", lambda s, d: paths.neighbourhood(every_way(s, d)))
    add("sampled_betweenness", lambda s, d: r6((lambda e: paths.betweenness(e, graph.nodes_of(e).orderBy(F.xxhash64("node"), "node").limit(16)))(every_way(s, d))))
    region = lambda s, d: A.table(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("node"), F.col("n_regionkey").cast("long").alias("community"))
    add("community_features", lambda s, d: r6(communities.community_features(nation(s, d), region(s, d)).select("node", long("community_index"), "degree_share")), "SELECT node, i AS community_index, round(n / (2 * (SELECT count(*) FROM edges)), 6) AS degree_share FROM (SELECT node, count(*) AS n FROM (SELECT src AS node FROM edges UNION ALL SELECT dst FROM edges) GROUP BY 1) LEFT JOIN (SELECT CAST(n_nationkey AS BIGINT) AS node, i FROM nation JOIN (SELECT n_regionkey, row_number() OVER (ORDER BY count(*) DESC, n_regionkey) - 1 AS i FROM nation GROUP BY 1) USING (n_regionkey)) USING (node)", A.NATION_GRAPH)
    add("structural_similarity", lambda s, d: r6(communities.structural_similarity(nation(s, d), A.nation_graph(s, d, 7))))
    add("community_overlap", lambda s, d: parts(s, d).select("p_partkey", F.array_join(communities.overlap(F.split("p_name", " "), F.split(F.lower("p_type"), " ")), ",").alias("shared")), "SELECT p_partkey, coalesce(array_to_string(list_sort(list_intersect(string_split(p_name, ' '), string_split(lower(p_type), ' '))), ','), '') AS shared FROM part")

    # ---- matching over events
    half = lambda s, d, k: typed(s, d).where(F.col("event_id") % 2 == k).select(F.col("src"), F.col("dst")).distinct()
    label = lambda s, d: A.table(s, d, "customer").select(F.col("c_custkey").alias("node"), F.col("c_nationkey").alias("label"))
    add("relation_alignment", lambda s, d: r6(crossevent.by_relations(half(s, d, 0), half(s, d, 1), label(s, d), label(s, d))), "SELECT u1, u2, round(0.7 * c / (n1 + n2 - c) + CASE WHEN a.c_nationkey IS NOT DISTINCT FROM b.c_nationkey THEN 0.3 ELSE 0 END, 6) AS relation FROM (SELECT x.src AS u1, y.src AS u2, count(*) AS c FROM e0 x JOIN e1 y USING (dst) GROUP BY 1, 2) JOIN (SELECT src AS u1, count(*) AS n1 FROM e0 GROUP BY 1) USING (u1) JOIN (SELECT src AS u2, count(*) AS n2 FROM e1 GROUP BY 1) USING (u2) LEFT JOIN customer a ON a.c_custkey = u1 LEFT JOIN customer b ON b.c_custkey = u2 WHERE 0.7 * c / (n1 + n2 - c) + CASE WHEN a.c_nationkey IS NOT DISTINCT FROM b.c_nationkey THEN 0.3 ELSE 0 END > 0.2", A.ACTIVITY, "e0 AS (SELECT DISTINCT user_id AS src, event_id % 50 AS dst FROM activity WHERE event_id % 2 = 0), e1 AS (SELECT DISTINCT user_id AS src, event_id % 50 AS dst FROM activity WHERE event_id % 2 = 1)")
    scores = lambda s, d, k, name: A.users(s, d).where(F.col("user_id") % k > 0).select(F.col("user_id").alias("u1"), (F.col("user_id") + 1).alias("u2"), F.col("anomaly_score").alias(name))
    add("reuse_matches", lambda s, d: r6(crossevent.reuse_matches(scores(s, d, 2, "attribute").withColumn("name_similarity", F.lit(0.5)).withColumn("avatar_similarity", F.lit(0.97)), scores(s, d, 3, "behavior"), least=0.3).select("u1", "u2", "kind")), "SELECT user_id AS u1, user_id + 1 AS u2, CASE WHEN a THEN 'same_avatar' WHEN s > 0.8 THEN 'behavioral_match' ELSE 'probable_match' END AS kind FROM (SELECT user_id, anomaly_score AS s, user_id % 2 > 0 AS a, CASE WHEN user_id % 2 > 0 THEN 0.45 * anomaly_score ELSE 0 END + CASE WHEN user_id % 3 > 0 THEN 0.35 * anomaly_score ELSE 0 END AS base FROM users WHERE user_id % 2 > 0 OR user_id % 3 > 0) WHERE CASE WHEN a THEN least(base * 1.05, 1) ELSE base END >= 0.3", A.USERS)
    add("strategy_features", lambda s, d: r6(crossevent.strategy_features(docs(s, d), ["user_id"])), "SELECT user_id, CAST(1 AS DOUBLE) AS posting_frequency, round(sum(length(content)) / count(*) / 1000, 6) AS content_length_avg, round(sum(len(regexp_extract_all(content, '#[\\p{L}\\p{N}_]+'))) / count(*), 6) AS hashtag_usage, round(sum(len(regexp_extract_all(content, '@[\\p{L}\\p{N}_]+'))) / count(*), 6) AS mention_usage, round(sum(len(regexp_extract_all(content, 'https?://[^ \\t\\n\\r\\f\\v]+'))) / count(*), 6) AS url_usage FROM texts GROUP BY 1", A.TEXTS)
    add("activity_levels", lambda s, d: r6(A.activity(s, d).groupBy("user_id").agg(F.count("*").alias("n"), F.sum("value").alias("v")).select("user_id", crossevent.activity_level(F.col("n"), F.col("v")).alias("activity"))), "SELECT user_id, round(least(count(*) / 10 * 0.5 + sum(value) / 100 * 0.5, 1), 6) AS activity FROM activity GROUP BY 1", A.ACTIVITY)
    marked = lambda s, d, k: A.users(s, d).where(F.col("user_id") % k == 0).select("user_id")
    add("evolution_summary", lambda s, d: r6(crossevent.evolution_summary(A.users(s, d), marked(s, d, 3), marked(s, d, 7))), "SELECT count(*) AS users, count(*) FILTER (user_id % 3 = 0) AS changed, count(*) FILTER (user_id % 7 = 0) AS moved, round(count(*) FILTER (user_id % 3 = 0) / count(*), 6) AS change_rate, round(count(*) FILTER (user_id % 7 = 0) / count(*), 6) AS move_rate FROM users", A.USERS)
    add("report_summary", lambda s, d: r6(crossevent.summary(3, A.users(s, d).withColumnRenamed("anomaly_score", "score"), A.users(s, d).select(F.col("platform").alias("component"), "user_id"), A.users(s, d).select(F.col("anomaly_score").alias("similarity")))), "SELECT CAST(3 AS INTEGER) AS events, count(*) AS reused, count(*) FILTER (anomaly_score >= 0.8) AS high_risk, count(DISTINCT platform) AS assets, count(*) AS accounts, round(avg(anomaly_score), 6) AS graph_similarity FROM users", A.USERS)

    def days(s, d, lo, hi):
        e = A.activity(s, d).where(F.col("posted_at").between(F.lit(lo), F.lit(hi)))
        return e.select("user_id", "posted_at", F.concat(F.col("platform"), F.lit("!")).alias("content"), F.array("platform").alias("hashtags"))

    same = lambda s, d: A.activity(s, d).select(F.col("user_id").alias("u1"), F.col("user_id").alias("u2"))
    add("behavior_alignment", lambda s, d: r6(crossevent.by_behavior(days(s, d, "2024-01-01", "2024-01-12"), days(s, d, "2024-01-12", "2024-02-01"), same(s, d)).select("u1", "u2", "topic_similarity")), "SELECT u1, u1 AS u2, round(c / (n1 + n2 - c), 6) AS topic_similarity FROM (SELECT x.user_id AS u1, n1, n2, (SELECT count(*) FROM (SELECT DISTINCT platform FROM p1 WHERE user_id = x.user_id INTERSECT SELECT DISTINCT platform FROM p2 WHERE user_id = x.user_id)) AS c FROM (SELECT user_id, count(DISTINCT platform) AS n1 FROM p1 GROUP BY 1) x JOIN (SELECT user_id, count(DISTINCT platform) AS n2 FROM p2 GROUP BY 1) y USING (user_id))", A.ACTIVITY, "p1 AS (SELECT * FROM activity WHERE posted_at BETWEEN TIMESTAMP '2024-01-01' AND TIMESTAMP '2024-01-12'), p2 AS (SELECT * FROM activity WHERE posted_at BETWEEN TIMESTAMP '2024-01-12' AND TIMESTAMP '2024-02-01')")

    # ---- streams, replayed over what has landed
    def live(s, d):
        path = f"{d}/event[s].parquet"  # a pattern, as a stream reads folders or patterns, and the table may be a file
        ticks = s.readStream.schema(s.read.parquet(path).schema).parquet(path)
        return stateful.replayed_alerts(ticks, ["user_id"], "ts", F.col("value") > 40.0, 3600.0, "1 hour").select("user_id", *(F.col(c).cast("timestamp_ntz").alias(c) for c in ("start", "fired_at", "end")))

    add("live_alerts", live, monitoring.ALERT_SQL, A.ACTIVITY)

    # ---- vectors, anomalies, evidence
    wide = lambda s, d: A.table(s, d, "lineitem").groupBy("l_suppkey").agg(F.struct(F.avg("l_quantity").alias("q"), F.avg("l_discount").alias("t")).alias("temporal"), F.struct(F.max("l_tax").alias("x")).alias("content"))
    base = "f AS (SELECT l_suppkey, avg(l_quantity) AS q, avg(l_discount) AS t, CAST(max(l_tax) AS DOUBLE) AS x FROM lineitem GROUP BY 1)"
    add("feature_map", lambda s, d: r6((lambda w: w.select("l_suppkey", F.explode(vectors.all_features(w, "l_suppkey")).alias("name", "value")))(wide(s, d))), "SELECT l_suppkey, 'temporal.q' AS name, round(q, 6) AS value FROM f UNION ALL SELECT l_suppkey, 'temporal.t', round(t, 6) FROM f UNION ALL SELECT l_suppkey, 'content.x', round(x, 6) FROM f", base)
    add("feature_vector", lambda s, d: r6((lambda w: w.select("l_suppkey", F.posexplode(vectors.to_vector(vectors.all_features(w, "l_suppkey"), ["content.x", "none", "temporal.q"])).alias("pos", "value")).withColumn("pos", long("pos")))(wide(s, d))), "SELECT l_suppkey, CAST(0 AS BIGINT) AS pos, round(x, 6) AS value FROM f UNION ALL SELECT l_suppkey, 1, 0 FROM f UNION ALL SELECT l_suppkey, 2, round(q, 6) FROM f", base)
    add("normalized_features", lambda s, d: r6((lambda w: w.select("l_suppkey", F.explode(vectors.normalized(vectors.all_features(w, "l_suppkey"))).alias("name", "value")))(wide(s, d))), "SELECT l_suppkey, name, round((value - avg(value) OVER w) / stddev_pop(value) OVER w, 6) AS value FROM (SELECT l_suppkey, 'temporal.q' AS name, q AS value FROM f UNION ALL SELECT l_suppkey, 'temporal.t', t FROM f UNION ALL SELECT l_suppkey, 'content.x', x FROM f) WINDOW w AS (PARTITION BY l_suppkey)", base)
    member = lambda s, d: A.users(s, d).withColumn("avatar_url", F.lit(None).cast("string"))
    add("user_vector", lambda s, d: r6((lambda v: v.select("user_id", "temporal.daily_mean", "metadata.profile_completeness"))(vectors.user_vector(A.activity(s, d).select("user_id", "posted_at", F.col("platform").alias("content")), member(s, d)))), "SELECT user_id, round(CASE WHEN sum(n) < 2 THEN sum(n) ELSE avg(n) END, 6)::DOUBLE AS daily_mean, round(coalesce(max(c), 0), 6) AS profile_completeness FROM (SELECT user_id, CAST(posted_at AS DATE) AS day, count(*) AS n FROM activity GROUP BY 1, 2) LEFT JOIN (SELECT user_id, (2 + CASE WHEN trim(coalesce(bio, '')) <> '' THEN 1 ELSE 0 END) / 4 AS c FROM users) USING (user_id) GROUP BY 1", A.ACTIVITY, A.USERS)
    add("topic_features", lambda s, d: r6(vectors.topic_features(docs(s, d))))
    add("top_contributions", lambda s, d: r6(A.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.explode(anomaly.top_contributions(F.create_map(F.lit("a"), F.col("l_discount") - 0.05, F.lit("b"), F.col("l_tax") - 0.04, F.lit("c"), F.lit(0.03)), 1)).alias("x")).select("l_orderkey", "l_linenumber", "x.key", F.col("x.value").cast("double").alias("value"))), "SELECT l_orderkey, l_linenumber, x.k AS key, round(x.v, 6) AS value FROM (SELECT l_orderkey, l_linenumber, list_sort([{'m': -abs(l_discount - 0.05), 'k': 'a', 'v': l_discount - 0.05}, {'m': -abs(l_tax - 0.04), 'k': 'b', 'v': l_tax - 0.04}, {'m': -0.03::DOUBLE, 'k': 'c', 'v': 0.03::DOUBLE}])[1] AS x FROM lineitem)")
    two = ["l_quantity", "l_extendedprice"]
    scaled = "z AS (SELECT l_orderkey, l_linenumber, (l_quantity - q0) / (q1 - q0) AS x, (l_extendedprice - p0) / (p1 - p0) AS y FROM lineitem, (SELECT min(l_quantity) AS q0, max(l_quantity) AS q1, min(l_extendedprice) AS p0, max(l_extendedprice) AS p1 FROM lineitem))"
    moments = "m AS (SELECT avg(x) AS mx, avg(y) AS my, var_pop(x) AS a, covar_pop(x, y) AS b, var_pop(y) AS c FROM z)"
    axis = "v AS (SELECT mx, my, b / sqrt(b * b + (l - a) * (l - a)) AS vx, (l - a) / sqrt(b * b + (l - a) * (l - a)) AS vy FROM (SELECT *, (a + c) / 2 + sqrt((a - c) * (a - c) / 4 + b * b) AS l FROM m))"
    place = "((x - mx) * vx + (y - my) * vy) * CASE WHEN CASE WHEN abs(vx) >= abs(vy) THEN vx ELSE vy END < 0 THEN -1 ELSE 1 END"
    add("latent", lambda s, d: r6(anomaly.latent(A.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", *two), two, 1).select("l_orderkey", "l_linenumber", F.col("latent")[0].alias("place"))), f"SELECT l_orderkey, l_linenumber, round({place}, 6) AS place FROM z, v", scaled, moments, axis)

    def coded(s, d):
        rows = A.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", *two, "l_discount", "l_tax")
        return r6(autoencoder.Autoencoder([*two, "l_discount", "l_tax"], hidden=(8,), latent=2, steps=30).fit(rows).score(rows).select("l_orderkey", "l_linenumber", "score", "is_anomaly"))

    add("autoencoder_scores", coded)

    def stack(s, d):
        rows = anomaly.z_scores(A.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"), ["l_quantity", "l_extendedprice"], 1.6).withColumnRenamed("score", "z").withColumnRenamed("is_anomaly", "f")
        return anomaly.stacked(rows, ["f"], ["z"]).groupBy("f").agg(F.count("*").alias("n"))

    add("stacked_detector", stack, "SELECT greatest(abs(l_quantity - m1) / s1, abs(l_extendedprice - m2) / s2) > 1.6 AS f, count(*) AS n FROM lineitem, (SELECT avg(l_quantity) AS m1, stddev_pop(l_quantity) AS s1, avg(l_extendedprice) AS m2, stddev_pop(l_extendedprice) AS s2 FROM lineitem) GROUP BY 1")
    add("detection_rate", lambda s, d: r6(monitoring.detection_rate(A.activity(s, d), F.col("platform") == "error")), "SELECT round(avg(CASE WHEN platform = 'error' THEN 1.0 ELSE 0 END) * 100, 6) AS anomaly_detection_rate FROM activity", A.ACTIVITY)
    proxies = lambda s, d: A.table(s, d, "supplier").select((F.col("s_acctbal") > 0).alias("is_healthy"), (F.col("s_suppkey") % 10 / 10.0).alias("quality_score"), (F.col("s_suppkey") % 4 / 4.0).alias("success_rate"), F.col("s_nationkey").cast("string").alias("country"), "s_suppkey")
    add("proxy_stats", lambda s, d: r6(monitoring.proxy_stats(proxies(s, d)).withColumn("countries", F.size("countries").cast("long"))), "SELECT count(*) AS total, count(*) FILTER (s_acctbal > 0) AS healthy, count(*) FILTER (NOT s_acctbal > 0) AS unhealthy, round(avg(s_suppkey % 10 / 10), 6) AS avg_quality, round(avg(s_suppkey % 4 / 4), 6) AS avg_success_rate, count(DISTINCT s_nationkey) AS countries FROM supplier")
    add("proxy_weights", lambda s, d: r6(proxies(s, d).select("s_suppkey", monitoring.proxy_weight(F.col("quality_score"), F.col("success_rate"), F.lit(3.0)).alias("weight"))), "SELECT s_suppkey, round(0.4 * (s_suppkey % 10 / 10) + 0.4 * (s_suppkey % 4 / 4) + 0.05, 6) AS weight FROM supplier")
    add("multi_bucket", lambda s, d: monitoring.multi_bucket(A.activity(s, d), "user_id", "posted_at", "event_id", [(0.0, 3.0), (0.0, 2.0)]).groupBy("allowed").agg(F.count("*").alias("n")), "SELECT r <= 2 AS allowed, count(*) AS n FROM (SELECT row_number() OVER (PARTITION BY user_id ORDER BY posted_at, event_id) AS r FROM activity) GROUP BY 1", A.ACTIVITY)

    # ---- layers: weights that make them plain means
    def field(s, d):
        return A.table(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("node"), F.array(F.col("n_nationkey").cast("double"), F.col("n_regionkey").cast("double")).alias("h"))

    flat = lambda df: r6(df.select("node", F.col("h")[0].alias("a"), F.col("h")[1].alias("b")))
    mean = "SELECT n.n_nationkey::BIGINT AS node, round(coalesce(avg(m.n_nationkey), 0){more_a}, 6) AS a, round(coalesce(avg(m.n_regionkey), 0){more_b}, 6) AS b FROM nation n LEFT JOIN edges ON dst = n.n_nationkey LEFT JOIN nation m ON m.n_nationkey = src GROUP BY n.n_nationkey, n.n_regionkey"
    add("rgcn_layer", lambda s, d: flat(neural.rgcn(field(s, d), nation(s, d).withColumn("type", F.lit("t")), np.eye(2)[None], {"t": np.array([1.0])}, np.eye(2))), mean.format(more_a=" + n.n_nationkey", more_b=" + n.n_regionkey"), A.NATION_GRAPH)
    add("gat_layer", lambda s, d: flat(neural.gat(field(s, d), nation(s, d), np.eye(2)[None], np.zeros((1, 2)), np.zeros((1, 2)))), mean.format(more_a="", more_b=""), A.NATION_GRAPH)
    layer = [(np.array([[0.02], [-0.02], [0.0]]), np.array([-2.4, 2.4, 0.0]))]
    members = lambda s, d: communities.overlapping(A.purchases(s, d), layer, 0.3)
    shares = """both_ways AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges), deg AS (SELECT src AS node, count(*) AS n FROM both_ways GROUP BY 1),
 z AS (SELECT d.node, d.n / (d.n + 1) + sum(o.n / sqrt((d.n + 1) * (o.n + 1))) AS z FROM deg d JOIN both_ways b ON b.src = d.node JOIN deg o ON o.node = b.dst GROUP BY d.node, d.n),
 e AS (SELECT node, unnest([0, 1, 2]) AS community, unnest([exp(0.02 * z - 2.4), exp(2.4 - 0.02 * z), 1.0]) AS x FROM z),
 members AS (SELECT * FROM (SELECT node, community, x / sum(x) OVER (PARTITION BY node) AS membership FROM e) WHERE membership > 0.3)"""
    add("overlapping_communities", lambda s, d: r6(members(s, d)), "SELECT node, CAST(community AS INT) AS community, round(membership, 6) AS membership FROM members", A.purchases_sql(), shares)
    add("overlapping_described", lambda s, d: r6(communities.overlapping_described(members(s, d), A.purchases(s, d))), """SELECT CAST(community AS INT) AS community, size, round(coalesce(m / (size * (size - 1)), 0), 6) AS density, round(avg_membership, 6) AS avg_membership
 FROM (SELECT community, count(*) AS size, avg(n) AS avg_membership FROM members JOIN (SELECT node, count(*) AS n FROM members GROUP BY 1) USING (node) GROUP BY 1)
 LEFT JOIN (SELECT a.community, count(*) AS m FROM edges JOIN members a ON a.node = src JOIN members b ON b.node = dst AND b.community = a.community GROUP BY 1) USING (community)""", A.purchases_sql(), shares)
    add("gat_attention", lambda s, d: r6(neural.gat(field(s, d), nation(s, d), np.eye(2)[None], np.array([[0.1, 0.0]]), np.zeros((1, 2)), attention=True).select("src", "dst", "alpha")), "SELECT src, dst, round(exp(src * 0.1) / sum(exp(src * 0.1)) OVER (PARTITION BY dst), 6) AS alpha FROM edges", A.NATION_GRAPH)
    add("evidence_top", lambda s, d: evidence.items(A.table(s, d, "lineitem").groupBy("l_suppkey").agg(F.avg("l_quantity").alias("daily_amount"), F.avg("l_discount").alias("profile_discount")), "l_suppkey", ["daily_amount", "profile_discount"]).where("rank = 1").select("l_suppkey", "feature"), "SELECT l_suppkey, arg_max(f, i) AS feature FROM (SELECT l_suppkey, f, abs(z) * 0.5 * CASE WHEN abs(z) >= 4 THEN 5 WHEN abs(z) >= 3 THEN 3 WHEN abs(z) >= 2 THEN 2 ELSE 1 END AS i FROM (SELECT l_suppkey, 'daily_amount' AS f, (q - avg(q) OVER ()) / stddev_pop(q) OVER () AS z FROM f UNION ALL SELECT l_suppkey, 'profile_discount', (t - avg(t) OVER ()) / stddev_pop(t) OVER () FROM f) WHERE abs(z) >= 1) GROUP BY 1", base)
    to_mean = lambda st: features.cosine([F.col(c) for c in features.STYLE], [F.col(f"m_{c}") for c in features.STYLE])
    parts_sql = {"avg_length": "avg(length(content))", **{n: f"sum(len(regexp_extract_all(content, '{p}'))) / greatest(sum(length(content)), 1)" for n, p in (("exclamation", "!"), ("question", "[?]"), ("uppercase", "\\p{Lu}"))}, "emoji": "0.0"}
    style_sql = f"st AS (SELECT user_id, {', '.join(f'100 * ({x}) AS {n}' if n != 'avg_length' else f'({x}) / 1000 AS {n}' for n, x in parts_sql.items())} FROM texts GROUP BY 1)"
    dot = lambda a, b: " + ".join(f"{a}.{n} * {b}.{n}" for n in parts_sql)
    weighed = lambda st: st.select("user_id", (F.col("avg_length") / 1000).alias("avg_length"), *((100 * F.col(c)).alias(c) for c in features.STYLE[1:]))  # noqa: E731, so that no part hides the others
    add("style_similarity", lambda s, d: r6((lambda st: st.crossJoin(F.broadcast(st.agg(*(F.avg(c).alias(f"m_{c}") for c in features.STYLE)))).select("user_id", to_mean(st).alias("similarity")))(weighed(features.text_style(docs(s, d))))), f"SELECT user_id, round(({dot('st', 'g')}) / (sqrt({dot('st', 'st')}) * sqrt({dot('g', 'g')})), 6) AS similarity FROM st, (SELECT {', '.join(f'avg({n}) AS {n}' for n in parts_sql)} FROM st) AS g", A.TEXTS, style_sql)
