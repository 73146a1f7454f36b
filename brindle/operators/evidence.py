"""Evidence: how a user's features deviate from all users', ranked and summed up per user."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.sources import adapters as A

#: Words in a feature's name that tell its kind, tried in this order.
KINDS = {
    "temporal": ["daily", "hour", "time", "frequency", "burst", "delay", "autocorr"],
    "content": ["text", "similarity", "topic", "sentiment", "template", "content"],
    "network": ["centrality", "pagerank", "cluster", "community", "network"],
    "metadata": ["username", "avatar", "profile", "registration"],
    "engagement": ["engagement", "like", "share", "comment", "retweet"],
}


def kind_of(name: Column) -> Column:
    chain = F
    for kind, words in KINDS.items():
        chain = chain.when(reduce(lambda a, b: a | b, [F.lower(name).contains(w) for w in words]), kind)
    return chain.otherwise("behavioral")


def severity(deviation: Column) -> Column:
    d = F.abs(deviation)
    return F.when(d >= 4, "critical").when(d >= 3, "high").when(d >= 2, "medium").otherwise("low")


def items(features: DataFrame, key: str, columns: list[str], contributions: dict[str, str] | None = None) -> DataFrame:
    """One row for each feature of a user whose z over all users is at least 1: feature, value, deviation, usual range, weight, severity, kind, impact and rank.

    contributions names the column with what each feature adds to the detector's score (0 where there is none); the weight is its
    absolute value plus 0.5, at most 2. The one row of statistics is broadcast.
    """
    contributions = contributions or {}
    share = lambda c: F.coalesce(F.col(contributions[c]).cast("double"), F.lit(0.0)) if c in contributions else F.lit(0.0)
    stats = features.agg(*(F.avg(c).alias(f"{c}_m") for c in columns), *(F.stddev_pop(c).alias(f"{c}_s") for c in columns))
    parts = F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value"), share(c).alias("contribution"), F.col(f"{c}_m").alias("m"), F.col(f"{c}_s").alias("s")) for c in columns))
    rows = features.join(F.broadcast(stats)).select(key, F.explode(parts).alias("x")).select(key, "x.*").where("s > 0")
    rows = rows.withColumn("deviation", (F.col("value") - F.col("m")) / F.col("s")).where(F.abs("deviation") >= 1)
    weight = F.least(F.abs("contribution") + 0.5, F.lit(2.0))
    found = rows.select(key, "feature", "value", "deviation", (F.col("m") - 2 * F.col("s")).alias("low"), (F.col("m") + 2 * F.col("s")).alias("high"), weight.alias("weight"), severity(F.col("deviation")).alias("severity"), kind_of(F.col("feature")).alias("kind"))
    factor = F.when(F.col("severity") == "critical", 5).when(F.col("severity") == "high", 3).when(F.col("severity") == "medium", 2).otherwise(1)
    found = found.withColumn("impact", F.col("weight") * F.abs("deviation") * factor)
    return found.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("impact"), "feature")))


def chains(evidence: DataFrame, key: str) -> DataFrame:
    """Per user: items by severity, confidence = sum(w min(|d| / 3, 1)) / sum(w), and the risk level."""
    conf = F.sum(F.col("weight") * F.least(F.abs("deviation") / 3, F.lit(1.0))) / F.sum("weight")
    out = evidence.groupBy(key).agg(F.count("*").alias("items"), *(F.count_if(F.col("severity") == s).alias(s) for s in ("critical", "high", "medium", "low")), conf.alias("confidence"))
    critical, high, confidence = F.col("critical"), F.col("high"), F.col("confidence")
    risk = F.when((critical >= 2) | ((critical >= 1) & (high >= 3)), "critical").when((critical >= 1) | (high >= 3) | (confidence > 0.8), "high").when((high >= 1) | (confidence > 0.5), "medium").otherwise("low")
    return out.withColumn("risk", risk)


def shared_features(evidence: DataFrame, key: str) -> DataFrame:
    """Features that at least max(2, half) of the users deviate in."""
    users = evidence.agg(F.countDistinct(key).alias("n"))
    counts = evidence.groupBy("feature").agg(F.countDistinct(key).alias("users"))
    return counts.join(F.broadcast(users)).where(F.col("users") >= F.greatest(F.lit(2), F.floor(F.col("n") / 2))).select("feature", "users")


def timeline(events: DataFrame, key: str, time: str, kind: str) -> DataFrame:
    """Per user and type: how many, and the span in seconds."""
    us = F.unix_micros(F.col(time).cast("timestamp"))
    return events.groupBy(key, kind).agg(F.count("*").alias("n"), ((F.max(us) - F.min(us)) / 1e6).alias("span_seconds"))


def importance(contributions: DataFrame, feature: str, value: str, how: str = "mean") -> DataFrame:
    f = {"mean": F.avg, "max": F.max, "sum": F.sum}[how]
    return contributions.groupBy(feature).agg(f(F.abs(value)).alias("importance"))


def scores(predicted: DataFrame, label: str, prediction: str) -> DataFrame:
    """One row: accuracy, macro precision and recall over the classes of either column, and F1 of the two."""
    pairs = predicted.groupBy(F.col(label).alias("y"), F.col(prediction).alias("p")).agg(F.count("*").alias("n"))
    hit = F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0)
    as_class = pairs.select(F.col("y").alias("c"), F.col("n").alias("actual"), F.lit(0).alias("claimed"), hit.alias("hit")).unionByName(pairs.select(F.col("p").alias("c"), F.lit(0).alias("actual"), F.col("n").alias("claimed"), F.lit(0).alias("hit")))
    per = as_class.groupBy("c").agg(F.sum("actual").alias("a"), F.sum("claimed").alias("k"), F.sum("hit").alias("h"))
    out = per.agg((F.sum("h") / F.sum("a")).alias("accuracy"), F.avg(F.coalesce(F.try_divide("h", "k"), F.lit(0.0))).alias("precision"), F.avg(F.coalesce(F.try_divide("h", "a"), F.lit(0.0))).alias("recall"))
    return out.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


def register(add, r6) -> None:
    def parts(s, d):
        return A.table(s, d, "lineitem").groupBy("l_suppkey").agg(F.avg("l_quantity").alias("daily_amount"), F.avg("l_extendedprice").alias("topic_price"), F.avg("l_discount").alias("profile_discount")).withColumn("part", F.col("daily_amount") / 40 - 0.5)

    names = ["daily_amount", "topic_price", "profile_discount"]
    parted = lambda s, d: items(parts(s, d), "l_suppkey", names, {"daily_amount": "part"})
    base = "f AS (SELECT l_suppkey, avg(l_quantity) AS q, avg(l_extendedprice) AS p, avg(l_discount) AS t FROM lineitem GROUP BY 1), u AS (SELECT l_suppkey, 'daily_amount' AS feature, 'temporal' AS kind, abs(q / 40 - 0.5) AS part, q AS value, (q - avg(q) OVER ()) / stddev_pop(q) OVER () AS deviation FROM f UNION ALL SELECT l_suppkey, 'topic_price', 'content', 0, p, (p - avg(p) OVER ()) / stddev_pop(p) OVER () FROM f UNION ALL SELECT l_suppkey, 'profile_discount', 'metadata', 0, t, (t - avg(t) OVER ()) / stddev_pop(t) OVER () FROM f), e AS (SELECT *, least(part + 0.5, 2.0) AS w, CASE WHEN abs(deviation) >= 4 THEN 'critical' WHEN abs(deviation) >= 3 THEN 'high' WHEN abs(deviation) >= 2 THEN 'medium' ELSE 'low' END AS severity FROM u WHERE abs(deviation) >= 1)"
    add("evidence_items", lambda s, d: r6(parted(s, d).select("l_suppkey", "feature", "value", "deviation", "weight", "severity", "kind")), "SELECT l_suppkey, feature, round(value, 6) AS value, round(deviation, 6) AS deviation, round(w, 6) AS weight, severity, kind FROM e", base)
    add("evidence_chains", lambda s, d: r6(chains(parted(s, d), "l_suppkey")), "SELECT *, CASE WHEN critical >= 2 OR critical >= 1 AND high >= 3 THEN 'critical' WHEN critical >= 1 OR high >= 3 OR confidence > 0.8 THEN 'high' WHEN high >= 1 OR confidence > 0.5 THEN 'medium' ELSE 'low' END AS risk FROM (SELECT l_suppkey, count(*) AS items, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low, round(sum(w * least(abs(deviation) / 3, 1)) / sum(w), 6) AS confidence FROM e GROUP BY 1)", base)
    add("shared_features", lambda s, d: shared_features(parted(s, d), "l_suppkey"), "SELECT feature, count(DISTINCT l_suppkey) AS users FROM e GROUP BY 1 HAVING count(DISTINCT l_suppkey) >= greatest(2, (SELECT count(DISTINCT l_suppkey) FROM e) // 2)", base)
    add("timeline", lambda s, d: r6(timeline(A.activity(s, d), "user_id", "posted_at", "platform")), "SELECT user_id, platform, count(*) AS n, round((epoch_us(max(posted_at)) - epoch_us(min(posted_at))) / 1e6, 6) AS span_seconds FROM activity GROUP BY 1, 2", A.ACTIVITY)
    add("feature_importance", lambda s, d: r6(importance(A.table(s, d, "embeddings").select(F.posexplode("embedding").alias("pos", "value")).withColumn("pos", F.col("pos").cast("long")).withColumn("value", F.col("value").cast("double")), "pos", "value")), "SELECT CAST(i - 1 AS BIGINT) AS pos, round(avg(abs(CAST(embedding[i] AS DOUBLE))), 6) AS importance FROM embeddings, range(1, 65) t(i) GROUP BY 1")
    add("classifier_scores", lambda s, d: r6(scores(A.table(s, d, "labels"), "quality", "toxic")), "SELECT round(sum(CASE WHEN quality = toxic THEN 1 ELSE 0 END) / count(*), 6) AS accuracy, round((p0 + p1) / 2, 6) AS precision, round((r0 + r1) / 2, 6) AS recall, round(2 * ((p0 + p1) / 2) * ((r0 + r1) / 2) / ((p0 + p1) / 2 + (r0 + r1) / 2), 6) AS f1 FROM labels, (SELECT count(*) FILTER (quality = 0 AND toxic = 0) / count(*) FILTER (toxic = 0) AS p0, count(*) FILTER (quality = 1 AND toxic = 1) / count(*) FILTER (toxic = 1) AS p1, count(*) FILTER (quality = 0 AND toxic = 0) / count(*) FILTER (quality = 0) AS r0, count(*) FILTER (quality = 1 AND toxic = 1) / count(*) FILTER (quality = 1) AS r1 FROM labels) GROUP BY p0, p1, r0, r1")
    add("severity_counts", lambda s, d: parted(s, d).groupBy("kind", "severity").agg(F.count("*").alias("n")), "SELECT kind, severity, count(*) AS n FROM e GROUP BY 1, 2", base)
