"""Views of the fixture tables in the roles of the social model, as DataFrames and as SQL for the oracles.

Operators are generic over column names; only these adapters know the fixtures.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("user_id"),
        F.col("c_mktsegment").alias("platform"),
        F.lower(F.regexp_replace("c_name", "#", "")).alias("username"),
        F.col("c_name").alias("display_name"),
        F.when(F.col("c_nationkey") % 3 == 0, F.concat(F.lit(" from "), F.col("c_nationkey").cast("string"))).alias("bio"),
        F.floor("c_acctbal").cast("long").alias("followers_count"),
        (F.col("c_acctbal") < 0).alias("is_suspicious"),
        (F.round(F.abs(F.col("c_acctbal")) / 10000 * 10000) / 10000).alias("anomaly_score"),  # halves as binary numbers have them, as in SQL
    )


USERS = """users AS (SELECT c_custkey AS user_id, c_mktsegment AS platform, lower(replace(c_name, '#', '')) AS username, c_name AS display_name,
 CASE WHEN c_nationkey % 3 = 0 THEN ' from ' || c_nationkey END AS bio, CAST(floor(c_acctbal) AS BIGINT) AS followers_count,
 c_acctbal < 0 AS is_suspicious, round(abs(c_acctbal) / 10000, 4) AS anomaly_score FROM customer)"""


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("post_id"),
        F.col("o_custkey").alias("user_id"),
        F.col("o_orderpriority").alias("platform"),
        F.col("o_orderdate").alias("posted_at"),
        (F.col("o_orderkey") % 97).alias("likes_count"),
        (F.col("o_orderkey") % 13).alias("shares_count"),
        (F.col("o_orderkey") % 7).alias("comments_count"),
        F.array(F.concat(F.lit("tag"), (F.col("o_orderkey") % 11).cast("string")), F.concat(F.lit("tag"), (F.col("o_custkey") % 5).cast("string"))).alias("hashtags"),
        F.when(F.col("o_orderkey") % 10 != 0, F.col("o_totalprice") / 500000 - 0.5).alias("sentiment_score"),
        F.col("o_orderstatus").alias("status"),
    )


POSTS = """posts AS (SELECT o_orderkey AS post_id, o_custkey AS user_id, o_orderpriority AS platform, o_orderdate AS posted_at,
 o_orderkey % 97 AS likes_count, o_orderkey % 13 AS shares_count, o_orderkey % 7 AS comments_count,
 ['tag' || (o_orderkey % 11), 'tag' || (o_custkey % 5)] AS hashtags,
 CASE WHEN o_orderkey % 10 <> 0 THEN o_totalprice / 500000 - 0.5 END AS sentiment_score, o_orderstatus AS status FROM orders)"""


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("task_id"),
        F.col("o_orderpriority").alias("platform"),
        F.concat(F.lit("type"), (F.col("o_custkey") % 3).cast("string")).alias("task_type"),
        F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "P", "running").otherwise("completed").alias("status"),
        (F.col("o_orderkey") % 9).cast("int").alias("priority"),
        (F.col("o_orderkey") % 4).cast("int").alias("retry_count"),
        F.lit(3).alias("max_retries"),
        (F.col("o_orderkey") % 50).alias("result_count"),
        F.col("o_orderdate").alias("created_at"),
    )


TASKS = """tasks AS (SELECT o_orderkey AS task_id, o_orderpriority AS platform, 'type' || (o_custkey % 3) AS task_type,
 CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'P' THEN 'running' ELSE 'completed' END AS status, CAST(o_orderkey % 9 AS INTEGER) AS priority,
 CAST(o_orderkey % 4 AS INTEGER) AS retry_count, 3 AS max_retries, o_orderkey % 50 AS result_count, o_orderdate AS created_at FROM orders)"""


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").alias("posted_at"), F.col("event_type").alias("platform"), "value")


ACTIVITY = "activity AS (SELECT event_id, user_id, ts AS posted_at, event_type AS platform, value FROM events)"


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("post_id"), F.col("source").alias("user_id"), F.col("lang").alias("language"), F.col("text").alias("content"))


TEXTS = "texts AS (SELECT doc_id AS post_id, source AS user_id, lang AS language, text AS content FROM documents)"


def purchases(spark: SparkSession, sf_dir: str, least_weight: int = 1) -> DataFrame:
    """A directed weighted graph: customers to the suppliers that they bought from."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    pairs = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_custkey").alias("c"), F.col("l_suppkey").alias("s")).agg(F.count("*").alias("weight"))
    return pairs.where(F.col("weight") >= least_weight).select(F.concat(F.lit("c"), F.col("c").cast("string")).alias("src"), F.concat(F.lit("s"), F.col("s").cast("string")).alias("dst"), "weight")


def purchases_sql(least_weight: int = 1) -> str:
    return f"""edges AS (SELECT 'c' || o_custkey AS src, 's' || l_suppkey AS dst, count(*) AS weight FROM lineitem JOIN orders ON l_orderkey = o_orderkey
 GROUP BY o_custkey, l_suppkey HAVING count(*) >= {least_weight})"""


def nation_graph(spark: SparkSession, sf_dir: str, modulus: int = 5) -> DataFrame:
    """A small directed graph: nations to the nations two and three steps of a fixed rule on, weighted by their customers."""
    customers = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").cast("long").alias("src")).agg(F.count("*").alias("weight"))
    steps = F.explode(F.array((F.col("src") * 2 + 1) % 25, (F.col("src") * 3 + 2) % 25, (F.col("src") + modulus) % 25))
    return customers.select("src", steps.alias("dst"), "weight").where("src <> dst").dropDuplicates(["src", "dst"])


NATION_GRAPH = """edges AS (SELECT DISTINCT src, dst, weight FROM (SELECT src, weight, unnest([(src * 2 + 1) % 25, (src * 3 + 2) % 25, (src + 5) % 25]) AS dst
 FROM (SELECT CAST(c_nationkey AS BIGINT) AS src, count(*) AS weight FROM customer GROUP BY 1)) WHERE src <> dst)"""
