"""Matching accounts across events: alignments, reuse scores, assets, evolution of behaviour, snapshot likeness."""

from functools import reduce
from itertools import combinations
from math import comb

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from brindle.functions import text as T
from brindle.operators import features, graph
from brindle.sources import adapters as A


def snapshot(nodes: DataFrame, edges: DataFrame, start, end, time: str = "ts") -> tuple[DataFrame, DataFrame]:
    """The nodes seen from start to end, both included, and the edges among them; nodes without a time are left out."""
    kept = nodes.where(F.col(time).between(F.lit(start), F.lit(end)))
    ids = kept.select("node").distinct()
    inner = edges.join(ids.withColumnRenamed("node", "src"), "src", "left_semi").join(ids.withColumnRenamed("node", "dst"), "dst", "left_semi")
    return kept, inner


def _shares(one: DataFrame, two: DataFrame, keys: list[str], name: str) -> DataFrame:
    both = one.select(*keys).distinct().withColumn("_a", F.lit(1)).join(two.select(*keys).distinct().withColumn("_b", F.lit(1)), keys, "full")
    inter, union = F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()), F.count("*")
    return both.agg(inter.alias(f"common_{name}"), union.alias(f"all_{name}"), F.coalesce(F.try_divide(inter, union), F.lit(0.0)).alias(f"jaccard_{name}"))


def snapshot_similarity(nodes1: DataFrame, edges1: DataFrame, nodes2: DataFrame, edges2: DataFrame) -> DataFrame:
    """One row: 0.6 times the nodes' Jaccard share plus 0.4 times the edges'; an empty union counts 0."""
    n, e = _shares(nodes1, nodes2, ["node"], "nodes"), _shares(edges1, edges2, ["src", "dst"], "edges")
    return n.crossJoin(e).withColumn("similarity", 0.6 * F.col("jaccard_nodes") + 0.4 * F.col("jaccard_edges"))  # single rows


#: Two lengths of names with more shortened forms than this meet by runs of characters.
FORMS = 2000


@F.pandas_udf(StringType())
def _lower(names: pd.Series) -> pd.Series:
    return names.map(lambda x: (x or "").lower())  # as T.ratio has it


@F.pandas_udf(ArrayType(StringType()))
def _forms(names: pd.Series, sizes: pd.Series) -> pd.Series:
    """What is left of each name with `size` of its characters, in all ways."""
    return pd.Series([sorted({"".join(x) for x in combinations(name, size)}) for name, size in zip(names, sizes, strict=True)])


def _met_by_names(one: DataFrame, two: DataFrame, least: float, block: int) -> DataFrame:
    """low1 and low2: the pairs of names (low, size) that alone can bring two users over `least`. They have a subsequence of the needed length, which depends on both lengths, in common.

    That is, they share a shortened form; where there are too many of these, a run of `block` characters in its stead.
    """
    sizes = [sorted(r[0] for r in u.select("size").where("size > 0").distinct().collect()) for u in (one, two)]  # only lengths
    needed = {(a, b): next((m for m in range(min(a, b) + 1) if 0.3 * (2.0 * m / (a + b)) > least), None) for a in sizes[0] for b in sizes[1]}
    spark, few = one.sparkSession, lambda a, b, m: comb(a, m) + comb(b, m) <= FORMS
    parts = []
    for short in (True, False):
        pairs = [(a, b, m) for (a, b), m in needed.items() if m is not None and few(a, b, m) == short]
        if not pairs:
            continue
        lengths = F.broadcast(spark.createDataFrame(pairs, "size1 int, size2 int, m int"))  # few rows: lengths, not names

        def side(u: DataFrame, n: int) -> DataFrame:
            name = F.col(f"low{n}")
            grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(name) - block + 1, F.lit(1))), lambda i: F.substring(name, i, F.lit(block))))
            both = u.select(F.col("low").alias(f"low{n}"), F.col("size").alias(f"size{n}")).distinct().join(lengths, f"size{n}")
            return both.withColumn("form", F.explode(_forms(name, "m") if short else grams)).select("size1", "size2", F.xxhash64("form").alias("form"), f"low{n}")

        parts.append(side(one, 1).join(side(two, 2), ["size1", "size2", "form"]).select("low1", "low2").distinct())
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], "low1 string, low2 string")


def by_attributes(users1: DataFrame, users2: DataFrame, least: float = 0.3, block: int = 3) -> DataFrame:
    """u1, u2 and 0.3 user name + 0.3 bio + 0.4 avatar likeness over `least`.

    Users meet, and not all with all, if their bios share a word, their avatars are equal, both have avatars and their names share a run
    of `block` characters, or their names alone can bring them over `least`. Lost are pairs of different avatars that need their
    digests' likeness and whose names share no such run, and pairs of very many shortened names without one.
    """
    columns = ["u", "low", "bio", "avatar"]
    given = lambda u, n: u.select(F.col("user_id").alias(f"u{n}"), _lower("username").alias(f"low{n}"), F.coalesce("bio", F.lit("")).alias(f"bio{n}"), F.coalesce("avatar_url", F.lit("")).alias(f"avatar{n}")).distinct()
    one, two = given(users1, 1), given(users2, 2)

    def keyed(u: DataFrame, n: int) -> DataFrame:
        name, avatar = F.col(f"low{n}"), F.col(f"avatar{n}")
        grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(name) - block + 1, F.lit(1))), lambda i: F.concat(F.lit("n:"), F.substring(name, i, F.lit(block))))
        keys = F.array_distinct(F.concat(F.when(avatar != "", grams).otherwise(F.array().cast("array<string>")), F.transform(T.word_set(F.col(f"bio{n}")), lambda w: F.concat(F.lit("b:"), w)), F.array(F.concat(F.lit("a:"), avatar))))
        return u.select(*(c + str(n) for c in columns), F.explode(F.filter(keys, lambda k: F.length(k) > 2)).alias("key"))

    # equal names are compared once; a pair that its names don't bring over `least` is found by another key
    names = _met_by_names(*(u.select(F.col(f"low{n}").alias("low"), F.length(f"low{n}").alias("size")) for n, u in ((1, one), (2, two))), least, block)
    alike = names.withColumn("name_similarity", T.ratio("low1", "low2")).where(0.3 * F.col("name_similarity") > least)
    met = keyed(one, 1).join(keyed(two, 2), "key").drop("key").distinct().withColumn("name_similarity", T.ratio("low1", "low2"))
    met = met.unionByName(alike.join(one, "low1").join(two, "low2")).distinct()
    avatar = F.when((F.col("avatar1") == "") | (F.col("avatar2") == ""), 0.0).otherwise(1 - T.hamming(F.md5("avatar1"), F.md5("avatar2")) / 32)
    bios = F.when((F.col("bio1") == "") | (F.col("bio2") == ""), 0.0).otherwise(T.jaccard(T.word_set(F.col("bio1")), T.word_set(F.col("bio2")), 0.0))
    scored = met.withColumn("avatar_similarity", avatar)
    return scored.withColumn("attribute", 0.3 * F.col("name_similarity") + 0.3 * bios + 0.4 * F.col("avatar_similarity")).where(F.col("attribute") > least).select("u1", "u2", "name_similarity", "avatar_similarity", "attribute")


def by_relations(edges1: DataFrame, edges2: DataFrame, groups1: DataFrame, groups2: DataFrame, least: float = 0.2) -> DataFrame:
    """u1, u2 and 0.7 times the Jaccard share of their successors plus 0.3 if they are of one community, over `least`. Pairs meet at a successor that they share; others can't pass but by community alone."""
    s1, s2 = (e.groupBy("src").agg(F.collect_set("dst").alias("to")) for e in (edges1, edges2))
    met = edges1.select(F.col("src").alias("u1"), "dst").join(edges2.select(F.col("src").alias("u2"), "dst"), "dst").select("u1", "u2").distinct()
    full = met.join(s1.select(F.col("src").alias("u1"), F.col("to").alias("a")), "u1").join(s2.select(F.col("src").alias("u2"), F.col("to").alias("b")), "u2")
    full = full.join(groups1.select(F.col("node").alias("u1"), F.col("label").alias("ga")), "u1", "left").join(groups2.select(F.col("node").alias("u2"), F.col("label").alias("gb")), "u2", "left")
    score = 0.7 * T.jaccard(F.col("a"), F.col("b"), 0.0) + F.when(F.col("ga").eqNullSafe(F.col("gb")), 0.3).otherwise(0.0)
    return full.select("u1", "u2", score.alias("relation")).where(F.col("relation") > least)


def overall(attribute: DataFrame, behavior: DataFrame, relation: DataFrame, weights: tuple[float, float, float] = (0.4, 0.35, 0.25)) -> DataFrame:
    """Full outer join of three score tables on (u1, u2); a missing score is 0."""
    joined = attribute.join(behavior, ["u1", "u2"], "full").join(relation, ["u1", "u2"], "full").na.fill(0.0, ["attribute", "behavior", "relation"])
    return joined.withColumn("score", weights[0] * F.col("attribute") + weights[1] * F.col("behavior") + weights[2] * F.col("relation"))


def reuse_score(attribute: Column, behavior: Column, relation: Column, name: Column, avatar: Column) -> Column:
    base = 0.45 * attribute + 0.35 * behavior + 0.2 * relation
    named = F.when(name > 0.9, F.least(base * 1.1, F.lit(1.0))).otherwise(base)
    return F.when(avatar > 0.95, F.least(named * 1.05, F.lit(1.0))).otherwise(named)


def match_type(name: Column, avatar: Column, behavior: Column, attribute: Column) -> Column:
    """What a match rests on: the first that is high enough, of the likenesses of names and avatars and the two scores."""
    return F.when(name > 0.95, "same_username").when(avatar > 0.95, "same_avatar").when(behavior > 0.8, "behavioral_match").when(attribute > 0.7, "attribute_match").otherwise("probable_match")


def by_behavior(posts1: DataFrame, posts2: DataFrame, pairs: DataFrame | None = None, least: float = 0.3) -> DataFrame:
    """u1, u2 and 0.4 hours + 0.3 style + 0.3 hashtag likeness over `least`, with the three parts.

    posts have user_id, posted_at, content and hashtags. pairs (u1, u2) are those to compare; without them all of two events'
    users are, as the parts leave none out beforehand: what is made then grows with the product of both numbers of users.
    """
    who = lambda p, n: p.select(F.col("user_id").alias(f"u{n}")).distinct()
    pairs = who(posts1, 1).crossJoin(who(posts2, 2)) if pairs is None else pairs.select("u1", "u2").distinct()

    def profile(p: DataFrame, n: int) -> DataFrame:
        hours = p.where("posted_at IS NOT NULL").groupBy("user_id", F.hour("posted_at").alias("h")).agg(F.count("*").alias("c")).groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("h", "c"))).alias("m"), F.sum("c").alias("total"))
        share = F.transform(F.sequence(F.lit(0), F.lit(23)), lambda h: F.coalesce(F.try_element_at("m", h), F.lit(0)) / F.col("total"))  # 24 numbers a user
        tags = p.select("user_id", F.explode("hashtags").alias("t")).groupBy("user_id").agg(F.collect_set(F.lower("t")).alias("tags"))
        style = features.text_style(p)
        out = who(p, n).withColumnRenamed(f"u{n}", "user_id").join(hours.select("user_id", share.alias("hours")), "user_id", "left").join(style.select("user_id", F.array(*(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features.STYLE)).alias("style")), "user_id", "left").join(tags, "user_id", "left")
        return out.select(F.col("user_id").alias(f"u{n}"), F.col("hours").alias(f"hours{n}"), F.col("style").alias(f"style{n}"), F.coalesce("tags", F.array().cast("array<string>")).alias(f"tags{n}"))

    both = pairs.join(profile(posts1, 1), "u1").join(profile(posts2, 2), "u2")
    half = lambda x, y: F.when(x > 0, x * F.log(F.when(x > 0, x).otherwise(1.0) / ((x + y) / 2))).otherwise(0.0)
    js = F.aggregate(F.zip_with("hours1", "hours2", lambda x, y: half(x, y) + half(y, x)), F.lit(0.0), lambda a, x: a + x) / 2
    times = F.coalesce(1 - F.sqrt(F.greatest(js, F.lit(0.0))), F.lit(0.0))
    style = F.coalesce(features.cosine(*([F.get(c, F.lit(i)) for i in range(len(features.STYLE))] for c in ("style1", "style2"))), F.lit(0.0))
    scored = both.select("u1", "u2", times.alias("time_similarity"), style.alias("style_similarity"), T.jaccard(F.col("tags1"), F.col("tags2"), 0.0).alias("topic_similarity"))
    return scored.withColumn("behavior", 0.4 * F.col("time_similarity") + 0.3 * F.col("style_similarity") + 0.3 * F.col("topic_similarity")).where(F.col("behavior") > least)


def reuse_matches(attribute: DataFrame, behavior: DataFrame, relation: DataFrame | None = None, least: float = 0.7) -> DataFrame:
    """u1, u2, score and kind of the pairs whose reuse score is at least `least`, from the alignment tables; a missing score is 0."""
    none = attribute.select("u1", "u2", F.lit(0.0).alias("relation")).limit(0)
    parts = [attribute.select("u1", "u2", "attribute", "name_similarity", "avatar_similarity"), behavior.select("u1", "u2", "behavior"), none if relation is None else relation.select("u1", "u2", "relation")]
    joined = parts[0].join(parts[1], ["u1", "u2"], "full").join(parts[2], ["u1", "u2"], "full").na.fill(0.0)
    a, b, r, n, v = (F.col(c) for c in ("attribute", "behavior", "relation", "name_similarity", "avatar_similarity"))
    return joined.select("u1", "u2", reuse_score(a, b, r, n, v).alias("score"), match_type(n, v, b, a).alias("kind")).where(F.col("score") >= least)


def detect_reuse(users1: DataFrame, users2: DataFrame, posts1: DataFrame, posts2: DataFrame, least: float = 0.7) -> DataFrame:
    """Accounts of one event that come back in another, by attributes and behaviour; relations have no part. Behaviour is compared for the pairs that attributes align: without them no score reaches 0.7."""
    attribute = by_attributes(users1, users2)
    return reuse_matches(attribute, by_behavior(posts1, posts2, attribute), least=least)


def strategy_features(posts: DataFrame, by: list[str]) -> DataFrame:
    """Means per post: posting_frequency (1 where there are any), content length in thousands, hashtags, mentions, URLs."""
    text = F.coalesce("content", F.lit(""))
    per = lambda pattern: F.sum(F.regexp_count(text, F.lit(pattern))) / F.count("*")
    return posts.groupBy(*by).agg(F.lit(1.0).alias("posting_frequency"), (F.sum(F.length(text)) / F.count("*") / 1000).alias("content_length_avg"), per(f"#{T.WORD}+").alias("hashtag_usage"), per(f"@{T.WORD}+").alias("mention_usage"), per("https?://\\S+").alias("url_usage"))


def evolution_summary(users: DataFrame, changes: DataFrame, moves: DataFrame, user: str = "user_id") -> DataFrame:
    """One row: users, those with changes of strategy and of role, and their shares."""
    distinct = lambda df, name: df.agg(F.countDistinct(user).alias(name))
    one = distinct(users, "users").crossJoin(distinct(changes, "changed")).crossJoin(distinct(moves, "moved"))  # single rows
    share = lambda c: F.coalesce(F.try_divide(c, "users"), F.lit(0.0))
    return one.select("users", "changed", "moved", share("changed").alias("change_rate"), share("moved").alias("move_rate"))


def summary(events: int, matches: DataFrame, owned: DataFrame, similarities: DataFrame, high: float = 0.8) -> DataFrame:
    """One row over a whole analysis: events, reused accounts, those of a score of at least `high`, assets, accounts in them, mean likeness of the events' graphs."""
    m = matches.agg(F.count("*").alias("reused"), F.count_if(F.col("score") >= high).alias("high_risk"))
    a = owned.agg(F.countDistinct("component").alias("assets"), F.count("*").alias("accounts"))
    g = similarities.agg(F.coalesce(F.avg("similarity"), F.lit(0.0)).alias("graph_similarity"))
    return m.crossJoin(a).crossJoin(g).select(F.lit(events).alias("events"), "*")  # single rows


def analyze(events: list[dict[str, DataFrame]], reuse: bool = True, evolve: bool = True, own: bool = True) -> dict[str, DataFrame]:
    """Matches, assets, roles, changes, moves and graph likeness over a list of events in order.

    An event has users, posts and edges (src, dst); accounts are told apart by their ids. Every pair of events is compared.
    Tables whose part is left out are not in the result.
    """
    numbered = list(enumerate(events))
    pairs = [(i, a, j, b) for i, a in numbered for j, b in numbered if i < j]
    out: dict[str, DataFrame] = {}
    if pairs:
        nodes = [graph.nodes_of(e["edges"]) for e in events]
        out["similarities"] = reduce(DataFrame.unionByName, [snapshot_similarity(nodes[i], a["edges"], nodes[j], b["edges"]).select(F.lit(i).alias("one"), F.lit(j).alias("two"), "similarity") for i, a, j, b in pairs])
    if pairs and (reuse or own):
        found = [detect_reuse(a["users"], b["users"], a["posts"], b["posts"]).select(F.lit(i).alias("one"), F.lit(j).alias("two"), "*") for i, a, j, b in pairs]
        out["matches"] = reduce(DataFrame.unionByName, found)
        if own:
            out["assets"] = assets(out["matches"])
    if evolve and events:
        posts = reduce(DataFrame.unionByName, [e["posts"].select("user_id", "content", F.lit(i).alias("event")) for i, e in numbered])
        weight = reduce(DataFrame.unionByName, [influence(e["edges"]).select(F.col("node").alias("user_id"), "influence", F.lit(i).alias("event")) for i, e in numbered])
        level = posts.groupBy("user_id", "event").agg(activity_level(F.count("*"), F.lit(0)).alias("activity")).join(weight, ["user_id", "event"], "left").na.fill(0.0)
        out["roles"] = level.select("user_id", "event", "activity", "influence", role(F.col("activity"), F.col("influence")).alias("role"))
        out["moves"] = transitions(out["roles"], "user_id", "event")
        names = ["posting_frequency", "content_length_avg", "hashtag_usage", "mention_usage", "url_usage"]
        out["changes"] = strategy_changes(strategy_features(posts, ["user_id", "event"]), "user_id", "event", names)
        out["evolution"] = evolution_summary(out["roles"], out["changes"], out["moves"])
    return out


def best_matches(*tables: DataFrame, score: str = "score") -> DataFrame:
    """The best row of each (u1, u2) over several match tables; ties to the earlier table."""
    every = tables[0].withColumn("_t", F.lit(0))
    for i, t in enumerate(tables[1:], 1):
        every = every.unionByName(t.withColumn("_t", F.lit(i)))
    return every.withColumn("_n", F.row_number().over(Window.partitionBy("u1", "u2").orderBy(F.desc(score), "_t"))).where("_n = 1").drop("_n", "_t")


def assets(matches: DataFrame) -> DataFrame:
    """node and component: accounts that matches link over any number of events are one asset, named by its smallest account."""
    return graph.components(matches.select(F.col("u1").alias("src"), F.col("u2").alias("dst")))


def activity_level(posts: Column, interactions: Column) -> Column:
    return F.least(posts / 10 * 0.5 + interactions / 100 * 0.5, F.lit(1.0))


def role(activity: Column, influence: Column) -> Column:
    return F.when((activity > 0.7) & (influence > 0.6), "leader").when((activity > 0.5) & (influence > 0.4), "amplifier").when(activity > 0.3, "participant").when(activity > 0.1, "observer").otherwise("inactive")


#: Roles from the least to the greatest.
ROLES = ["inactive", "observer", "participant", "amplifier", "leader"]


def transitions(roles: DataFrame, user: str, order: str) -> DataFrame:
    """Rows where a user's role differs from that in the event before, and which way it went."""
    before = roles.withColumn("before", F.lag("role").over(Window.partitionBy(user).orderBy(order))).where("before <> role")
    rank = lambda c: F.array_position(F.array(*map(F.lit, ROLES)), F.col(c))
    return before.select(user, order, "before", "role", F.when(rank("role") > rank("before"), "promotion").otherwise("demotion").alias("kind"))


def strategy_changes(strategies: DataFrame, user: str, order: str, columns: list[str], threshold: float = 0.3) -> DataFrame:
    """Per user, event and feature the change from the event before, where over `threshold` either way."""
    long = strategies.select(user, order, F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns))).alias("x")).select(user, order, "x.*")
    diff = long.withColumn("change", F.col("value") - F.lag("value").over(Window.partitionBy(user, "feature").orderBy(order)))
    return diff.where(F.abs("change") > threshold).drop("value")


def influence(edges: DataFrame) -> DataFrame:
    d = graph.degrees(edges)
    return d.join(F.broadcast(d.agg(F.max("degree").alias("top")))).select("node", (F.col("degree") / F.col("top")).alias("influence"))


def evolution(levels: DataFrame, user: str, order: str, value: str) -> DataFrame:
    """Per user the values in the order of events, as an array (one element for each event)."""
    return levels.groupBy(user).agg(F.transform(F.sort_array(F.collect_list(F.struct(order, value))), lambda x: x[value]).alias("values"))


def register(add, r6) -> None:
    def days(s, d, lo, hi):
        e = A.activity(s, d)
        nodes = e.select(F.col("user_id").alias("node"), F.col("posted_at").alias("ts"))
        return snapshot(nodes, e.select(F.col("user_id").alias("src"), (F.col("event_id") % 40).alias("dst")).distinct(), lo, hi)

    def alike(s, d):
        (n1, e1), (n2, e2) = days(s, d, "2024-01-01", "2024-01-02"), days(s, d, "2024-01-02", "2024-01-03")
        return r6(snapshot_similarity(n1, e1, n2, e2))

    ctes = "ed AS (SELECT DISTINCT user_id AS src, event_id % 40 AS dst FROM activity), n1 AS (SELECT DISTINCT user_id AS n FROM activity WHERE posted_at BETWEEN TIMESTAMP '2024-01-01' AND TIMESTAMP '2024-01-02'), n2 AS (SELECT DISTINCT user_id AS n FROM activity WHERE posted_at BETWEEN TIMESTAMP '2024-01-02' AND TIMESTAMP '2024-01-03'), e1 AS (SELECT * FROM ed WHERE src IN (FROM n1) AND dst IN (FROM n1)), e2 AS (SELECT * FROM ed WHERE src IN (FROM n2) AND dst IN (FROM n2)), c AS (SELECT (SELECT count(*) FROM (FROM n1 INTERSECT FROM n2)) AS cn, (SELECT count(*) FROM (FROM n1 UNION FROM n2)) AS an, (SELECT count(*) FROM (FROM e1 INTERSECT FROM e2)) AS ce, (SELECT count(*) FROM (FROM e1 UNION FROM e2)) AS ae)"
    add("snapshot_similarity", alike, "SELECT cn AS common_nodes, an AS all_nodes, round(coalesce(cn / nullif(an, 0), 0), 6) AS jaccard_nodes, ce AS common_edges, ae AS all_edges, round(coalesce(ce / nullif(ae, 0), 0), 6) AS jaccard_edges, round(0.6 * coalesce(cn / nullif(an, 0), 0) + 0.4 * coalesce(ce / nullif(ae, 0), 0), 6) AS similarity FROM c", A.ACTIVITY, ctes)
    add("event_snapshot", lambda s, d: days(s, d, "2024-01-03", "2024-01-05")[1], "SELECT * FROM ed WHERE src IN (FROM n) AND dst IN (FROM n)", A.ACTIVITY, "ed AS (SELECT DISTINCT user_id AS src, event_id % 40 AS dst FROM activity), n AS (SELECT user_id FROM activity WHERE posted_at BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-05')")

    def pairs(s, d):
        u = A.users(s, d)
        return u.select(F.col("user_id").alias("u1"), (F.col("user_id") + 1).alias("u2"), F.col("anomaly_score").alias("attribute"))

    add("overall_alignment", lambda s, d: r6(overall(pairs(s, d).where("u1 % 2 = 0"), pairs(s, d).where("u1 % 3 = 0").withColumnRenamed("attribute", "behavior"), pairs(s, d).where("u1 % 5 = 0").withColumnRenamed("attribute", "relation"))), "SELECT u1, u2, round(a, 6) AS attribute, round(b, 6) AS behavior, round(r, 6) AS relation, round(0.4 * a + 0.35 * b + 0.25 * r, 6) AS score FROM (SELECT user_id AS u1, user_id + 1 AS u2, CASE WHEN user_id % 2 = 0 THEN anomaly_score ELSE 0 END AS a, CASE WHEN user_id % 3 = 0 THEN anomaly_score ELSE 0 END AS b, CASE WHEN user_id % 5 = 0 THEN anomaly_score ELSE 0 END AS r FROM users WHERE user_id % 2 = 0 OR user_id % 3 = 0 OR user_id % 5 = 0)", A.USERS)
    add("reuse_score", lambda s, d: r6(pairs(s, d).select("u1", F.floor(F.col("attribute") * 1000).alias("k")).select("u1", (F.col("k") / 1000).alias("a"), ((F.col("k") * 7) % 1000 / 1000).alias("b"), ((F.col("k") * 3) % 1000 / 1000).alias("r"), ((F.col("k") * 11) % 1000 / 1000).alias("n"), ((F.col("k") * 13) % 1000 / 1000).alias("v")).select("u1", (F.round(reuse_score(*map(F.col, "abrnv")) * 1000) / 1000).alias("score"), match_type(*map(F.col, "nvba")).alias("kind"))), "SELECT u1, round(CASE WHEN v > 0.95 THEN least(x * CAST(1.05 AS DOUBLE), 1) ELSE x END * 1000) / 1000 AS score, CASE WHEN n > 0.95 THEN 'same_username' WHEN v > 0.95 THEN 'same_avatar' WHEN b > 0.8 THEN 'behavioral_match' WHEN a > 0.7 THEN 'attribute_match' ELSE 'probable_match' END AS kind FROM (SELECT *, CASE WHEN n > 0.9 THEN least(y * CAST(1.1 AS DOUBLE), 1) ELSE y END AS x FROM (SELECT *, CAST(0.45 AS DOUBLE) * a + CAST(0.35 AS DOUBLE) * b + CAST(0.2 AS DOUBLE) * r AS y FROM (SELECT u1, k / 1000 AS a, k * 7 % 1000 / 1000 AS b, k * 3 % 1000 / 1000 AS r, k * 11 % 1000 / 1000 AS n, k * 13 % 1000 / 1000 AS v FROM (SELECT user_id AS u1, CAST(floor(anomaly_score * 1000) AS BIGINT) AS k FROM users))))", A.USERS)
    add("best_matches", lambda s, d: r6(best_matches(pairs(s, d).withColumnRenamed("attribute", "score"), pairs(s, d).select("u1", "u2", (1 - F.col("attribute")).alias("score")))), "SELECT user_id AS u1, user_id + 1 AS u2, round(greatest(anomaly_score, 1 - anomaly_score), 6) AS score FROM users", A.USERS)
    add("account_assets", lambda s, d: assets(pairs(s, d).where("attribute > 0.7")), None)
    add("influence", lambda s, d: r6(influence(A.purchases(s, d))), "SELECT node, round(n / max(n) OVER (), 6) AS influence FROM (SELECT node, count(*) AS n FROM (SELECT src AS node FROM edges UNION ALL SELECT dst FROM edges) GROUP BY 1)", A.purchases_sql())

    def roles(s, d):
        e = A.activity(s, d).groupBy("user_id", F.weekofyear("posted_at").alias("event")).agg(F.count("*").alias("n"), F.avg("value").alias("v"))
        return e.select("user_id", "event", role(F.col("n") / 20, F.col("v") / 50).alias("role"), (F.col("n") / 20).alias("a"), (F.col("v") / 50).alias("i"))

    base = "e AS (SELECT user_id, week(posted_at) AS event, count(*) / 20 AS a, avg(value) / 50 AS i FROM activity GROUP BY 1, 2), r AS (SELECT *, CASE WHEN a > 0.7 AND i > 0.6 THEN 4 WHEN a > 0.5 AND i > 0.4 THEN 3 WHEN a > 0.3 THEN 2 WHEN a > 0.1 THEN 1 ELSE 0 END AS k FROM e)"
    add("role_transitions", lambda s, d: transitions(roles(s, d), "user_id", "event").select("user_id", F.col("event").cast("long").alias("event"), "kind"), "SELECT user_id, event, CASE WHEN k > b THEN 'promotion' ELSE 'demotion' END AS kind FROM (SELECT *, lag(k) OVER (PARTITION BY user_id ORDER BY event) AS b FROM r) WHERE b <> k", A.ACTIVITY, base)
    add("strategy_changes", lambda s, d: r6(strategy_changes(roles(s, d), "user_id", "event", ["a", "i"]).withColumn("event", F.col("event").cast("long"))), "SELECT user_id, event, feature, round(c, 6) AS change FROM (SELECT user_id, event, 'a' AS feature, a - lag(a) OVER w AS c FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event) UNION ALL SELECT user_id, event, 'i', i - lag(i) OVER w FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event)) WHERE abs(c) > 0.3", A.ACTIVITY, base)
    add("attribute_alignment", lambda s, d: r6(by_attributes(A.table(s, d, "supplier").select(F.col("s_suppkey").alias("user_id"), F.col("s_name").alias("username"), F.lit(None).cast("string").alias("bio"), F.lit(None).cast("string").alias("avatar_url")), A.table(s, d, "supplier").select((F.col("s_suppkey") + 1000).alias("user_id"), F.lower("s_name").alias("username"), F.lit(None).cast("string").alias("bio"), F.lit(None).cast("string").alias("avatar_url")), 0.28)), None)
