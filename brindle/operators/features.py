"""Behaviour features of every user at once: times, content, profile. Each function gives one row per user."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions import text as T
from brindle.operators import graph

EPS = 1e-10


def entropy(df: DataFrame, by: list[str], n: str = "n", name: str = "entropy") -> DataFrame:
    """-sum p log2(p + 1e-10) of counts n within each group."""
    total = F.sum(n).over(Window.partitionBy(*by))
    return df.withColumn("_p", F.col(n) / total).groupBy(*by).agg((-F.sum(F.col("_p") * F.log2(F.col("_p") + EPS))).alias(name))


def post_frequency(posts: DataFrame, user: str = "user_id", time: str = "posted_at") -> DataFrame:
    """Mean and population std of the daily counts over the days with posts; burst = (max - mean) / max(std, 1). One post: 1, 0, 0."""
    days = posts.where(F.col(time).isNotNull()).groupBy(user, F.to_date(time).alias("day")).agg(F.count("*").alias("n"))
    stats = days.groupBy(user).agg(F.avg("n").alias("daily_mean"), F.stddev_pop("n").alias("daily_std"), F.max("n").alias("top"), F.sum("n").alias("posts"))
    few = F.col("posts") < 2
    return stats.select(
        user,
        F.when(few, F.col("posts").cast("double")).otherwise(F.col("daily_mean")).alias("daily_mean"),
        F.when(few, 0.0).otherwise(F.col("daily_std")).alias("daily_std"),
        F.when(few, 0.0).otherwise((F.col("top") - F.col("daily_mean")) / F.greatest("daily_std", F.lit(1.0))).alias("burst"),
    )


def time_distribution(posts: DataFrame, user: str = "user_id", time: str = "posted_at") -> DataFrame:
    """Entropy over the 24 hours and shares of posts at work (9 to 17), at night (22 to 5) and on weekends."""
    seen = posts.where(F.col(time).isNotNull()).select(user, F.hour(time).alias("h"), (F.weekday(time) >= 5).alias("weekend"))
    hours = entropy(seen.groupBy(user, "h").agg(F.count("*").alias("n")), [user], name="hour_entropy")
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    shares = seen.groupBy(user).agg(share(F.col("h").between(9, 17)).alias("work_ratio"), share((F.col("h") >= 22) | (F.col("h") <= 5)).alias("night_ratio"), share(F.col("weekend")).alias("weekend_ratio"))
    return hours.join(shares, user)


def autocorrelation(posts: DataFrame, max_lag: int = 168, user: str = "user_id", time: str = "posted_at") -> DataFrame:
    """Of each user and lag in hours, up to max_lag or the series' length less one: the mean product of deviations, over n - lag pairs, by the population variance. Hours without posts count 0; no variance gives 0."""
    hour = F.date_trunc("hour", F.col(time))
    counts = posts.where(F.col(time).isNotNull()).groupBy(user, F.unix_micros(hour.cast("timestamp")).alias("us")).agg(F.count("*").alias("n"))
    at = counts.withColumn("i", ((F.col("us") - F.min("us").over(Window.partitionBy(user))) / 3_600_000_000).cast("long"))
    sized = at.groupBy(user).agg((F.max("i") + 1).alias("len"), F.sum("n").alias("total"), F.sum(F.col("n") * F.col("n")).alias("squares"))
    # zeros need no rows: sums over all hours follow from the hours with posts
    lags = sized.select(user, "len", "total", "squares", F.explode(F.sequence(F.lit(1), F.least(F.lit(max_lag), F.col("len").cast("int") - 1))).alias("lag")).where("len > 1")
    # hours meet within a stretch of max_lag and the one before it, not all of a user's hours
    a = at.select(user, F.col("i"), F.col("n").alias("x"), F.floor(F.col("i") / max_lag).alias("s"))
    b = at.select(user, F.col("i").alias("j"), F.col("n").alias("y"), F.explode(F.array(F.floor(F.col("i") / max_lag), F.floor(F.col("i") / max_lag) + 1)).alias("s"))
    products = a.join(b, [user, "s"]).where((F.col("i") > F.col("j")) & (F.col("i") - F.col("j") <= max_lag)).groupBy(user, (F.col("i") - F.col("j")).cast("int").alias("lag")).agg(F.sum(F.col("x") * F.col("y")).alias("xy"))
    # the first len - lag hours and the last len - lag hours
    heads = lags.join(at.select(user, "i", "n"), user).groupBy(user, "lag").agg(
        F.sum(F.when(F.col("i") < F.col("len") - F.col("lag"), F.col("n")).otherwise(0)).alias("head"), F.sum(F.when(F.col("i") >= F.col("lag"), F.col("n")).otherwise(0)).alias("tail")
    )
    mean = F.col("total") / F.col("len")
    var = F.col("squares") / F.col("len") - mean * mean
    pairs = F.col("len") - F.col("lag")
    cov = (F.coalesce("xy", F.lit(0)) - mean * (F.col("head") + F.col("tail")) + pairs * mean * mean) / pairs
    return lags.join(heads, [user, "lag"]).join(products, [user, "lag"], "left").select(user, "lag", F.when(var <= 1e-12, 0.0).otherwise(cov / F.when(var <= 1e-12, 1.0).otherwise(var)).alias("value"))


def response_delay(interactions: DataFrame, user: str = "user_id") -> DataFrame:
    """Mean and population std of response_time, or of response_at - original_at in seconds where that is not negative."""
    gap = (F.unix_micros(F.col("response_at").cast("timestamp")) - F.unix_micros(F.col("original_at").cast("timestamp"))) / 1e6
    delay = F.coalesce(F.col("response_time").cast("double"), F.when(gap >= 0, gap))
    return interactions.select(user, delay.alias("d")).where("d IS NOT NULL").groupBy(user).agg(F.avg("d").alias("delay_mean"), F.stddev_pop("d").alias("delay_std"))


def sentiment_stats(scored: DataFrame, user: str = "user_id", score: str = "score", label: str = "label") -> DataFrame:
    """Mean and population std of the score, and the share of the commonest label."""
    labels = scored.groupBy(user, label).agg(F.count("*").alias("n"), F.sum(score).alias("s"), F.sum(F.col(score) * F.col(score)).alias("ss"), F.count(score).alias("k"))
    mean = F.sum("s") / F.sum("k")
    return labels.groupBy(user).agg(mean.alias("sentiment_mean"), F.sqrt(F.greatest(F.sum("ss") / F.sum("k") - mean * mean, F.lit(0.0))).alias("sentiment_std"), (F.max("n") / F.sum("n")).alias("consistency"))


def word_topics(posts: DataFrame, stop: list[str], user: str = "user_id", text: str = "content") -> DataFrame:
    """Entropy of a user's words of over two characters that aren't stop words, and the commonest word's share."""
    words = posts.select(user, F.explode(F.split(F.lower(text), "\\s+")).alias("w")).where((F.length("w") > 2) & ~F.col("w").isin(stop))
    counted = words.groupBy(user, "w").agg(F.count("*").alias("n"))
    top = counted.groupBy(user).agg((F.max("n") / F.sum("n")).alias("top_share"))
    return entropy(counted, [user], name="topic_entropy").join(top, user)


def text_style(posts: DataFrame, user: str = "user_id", text: str = "content") -> DataFrame:
    """Mean length, and exclamation marks, question marks, capitals and emoji per character."""
    n = F.greatest(F.sum(F.length(text)), F.lit(1))
    per = lambda p: F.sum(F.regexp_count(text, F.lit(p))) / n
    return posts.where(F.col(text).isNotNull()).groupBy(user).agg(F.avg(F.length(text)).alias("avg_length"), per("!").alias("exclamation"), per("[?]").alias("question"), per("\\p{Lu}").alias("uppercase"), per(T.EMOJI).alias("emoji"))


STYLE = ["avg_length", "exclamation", "question", "uppercase", "emoji"]


def cosine(a: list[Column], b: list[Column]) -> Column:
    dot = lambda x, y: sum((p * q for p, q in zip(x, y, strict=True)), F.lit(0.0))
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, 0.0).otherwise(F.greatest(dot(a, b) / F.when(norm == 0, 1.0).otherwise(norm), F.lit(0.0)))


def hour_distances(posts: DataFrame, pairs: DataFrame, user: str = "user_id", time: str = "posted_at") -> DataFrame:
    """Of each pair (a, b): 1 - the Jensen-Shannon distance (root, natural log) of their hours. The pairs are given; only their users' 24 numbers meet."""
    counts = posts.groupBy(user, F.hour(time).alias("h")).agg(F.count("*").alias("n"))
    p = counts.select(user, "h", (F.col("n") / F.sum("n").over(Window.partitionBy(user))).alias("p"))
    left = pairs.join(p.select(F.col(user).alias("a"), "h", F.col("p").alias("pa")), "a").select("a", "b", "h", "pa", F.lit(0.0).alias("pb"))
    right = pairs.join(p.select(F.col(user).alias("b"), "h", F.col("p").alias("pb")), "b").select("a", "b", "h", F.lit(0.0).alias("pa"), "pb")
    both = left.unionByName(right).groupBy("a", "b", "h").agg(F.sum("pa").alias("pa"), F.sum("pb").alias("pb"))
    half = (F.col("pa") + F.col("pb")) / 2
    part = lambda c: F.when(F.col(c) > 0, F.col(c) * F.log(F.when(F.col(c) > 0, F.col(c)).otherwise(1.0) / half)).otherwise(0.0)
    return both.groupBy("a", "b").agg((1 - F.sqrt(F.greatest(F.sum(part("pa") + part("pb")) / 2, F.lit(0.0)))).alias("similarity"))


#: What makes a user name look made by a machine.
USERNAME_PATTERNS = ["^[a-z]+[0-9]+$", "^[a-z]+_[0-9]+$", "^user[0-9]+$", "^[a-z]{8,12}[0-9]{3,6}$", "^[a-z]+[0-9]{4,}$"]


def username_features(users: DataFrame, by: list[str], name: str = "username") -> DataFrame:
    """Share of names that match any pattern, and mean share of digits; empty names don't count."""
    named = users.where(F.coalesce(F.length(name), F.lit(0)) > 0)
    hit = F.lit(False)
    for p in USERNAME_PATTERNS:
        hit = hit | F.col(name).rlike(f"(?i){p}")
    return named.groupBy(*by).agg(F.avg(F.when(hit, 1.0).otherwise(0.0)).alias("pattern_ratio"), F.avg(F.regexp_count(name, F.lit("\\p{Nd}")) / F.length(name)).alias("digit_ratio"))


def completeness(*fields: str) -> Column:
    """Share of the fields that aren't blank."""
    return sum((F.when(F.coalesce(F.trim(F.col(f).cast("string")), F.lit("")) != "", 1).otherwise(0) for f in fields), F.lit(0)) / len(fields)


def registration_regularity(users: DataFrame, by: list[str], time: str) -> DataFrame:
    """1 - p of D'Agostino and Pearson's normality test of registration times; 0 with fewer than 20 rows (the kurtosis part's approximation needs them) or no spread."""
    x = F.unix_micros(F.col(time).cast("timestamp")) / 1e6
    s = users.where(F.col(time).isNotNull()).withColumn("_x", x).groupBy(*by).agg(F.count("*").alias("n"), F.skewness("_x").alias("g1"), (F.kurtosis("_x") + 3).alias("b2"))
    n = F.col("n").cast("double")
    y = F.col("g1") * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    beta = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = F.sqrt(2 * (beta - 1)) - 1
    ratio = y / F.sqrt(2 / (w2 - 1))
    z1 = F.log(ratio + F.sqrt(ratio * ratio + 1)) / F.sqrt(0.5 * F.log(w2))
    mean, var = 3 * (n - 1) / (n + 1), 24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))
    xk = (F.col("b2") - mean) / F.sqrt(var)
    sb = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / sb * (2 / sb + F.sqrt(1 + 4 / (sb * sb)))
    z2 = (1 - 2 / (9 * a) - F.cbrt((1 - 2 / a) / (1 + xk * F.sqrt(2 / (a - 4))))) / F.sqrt(2 / (9 * a))
    p = F.exp(-(z1 * z1 + z2 * z2) / 2)
    return s.select(*by, F.when((F.col("n") < 20) | F.isnan("g1") | F.col("g1").isNull(), 0.0).otherwise(1 - p).alias("regularity"))


def avatar_pairs(users: DataFrame, key: str, url: str, most: int = 5) -> DataFrame:
    """Pairs of users whose avatar URLs' MD5 digests differ in at most `most` of 32 characters.

    A pair that differs in at most `most` characters agrees in one of most + 1 blocks; so pairs meet in a block, not all in all.
    """
    size, hashed = -(-32 // (most + 1)), users.where(F.coalesce(F.length(url), F.lit(0)) > 0).select(key, F.md5(url).alias("h"))
    blocks = hashed.select(key, "h", F.posexplode(F.array(*(F.substring("h", 1 + i * size, size) for i in range(most + 1)))).alias("block", "part"))
    one, two = blocks.select(F.col(key).alias("a"), F.col("h").alias("ha"), "block", "part"), blocks.select(F.col(key).alias("b"), F.col("h").alias("hb"), "block", "part")
    return one.join(two, ["block", "part"]).where("a < b").select("a", "b", T.hamming(F.col("ha"), F.col("hb")).alias("distance")).where(F.col("distance") <= most).distinct()


#: Pairs of blocks are compared in lots with at most so many copies for each text, or so many copies.
LOT_TIMES, LOT_ROWS = 4, 100_000


def _grams(rows: DataFrame, group: str, kind: str, most_terms: int, block: int) -> DataFrame:
    """Per group the sum of squares of the products of its vectors' matrix with itself, terms by terms; rows lie by group. A task emits one matrix for each group it meets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now] * most_terms, of), pa.array(range(most_terms), pa.int32()), pa.array([r.tobytes() for r in total], pa.binary())], names=[group, "at", "sums"])

        for b in batches:
            of, names, terms = b.schema.field(0).type, b.column(0).to_pylist(), b.column(1)
            starts = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]
            for first, last in zip(starts[:-1], starts[1:], strict=True):
                if total is None or names[first] != now:
                    if total is not None:
                        yield out()
                    now, total = names[first], np.zeros((most_terms, most_terms))
                for lo in range(first, last, block):
                    part = terms.slice(lo, min(block, last - lo))
                    flat, m = part.flatten(), np.zeros((len(part), most_terms))
                    m[np.repeat(np.arange(len(part)), part.value_lengths().to_numpy(zero_copy_only=False)), flat.field("at").to_numpy()] = flat.field("v").to_numpy()
                    total += m.T @ m
        if total is not None:
            yield out()

    def squares(part: pd.DataFrame) -> pd.DataFrame:
        row = sum(np.frombuffer(x) for x in part["sums"])
        return pd.DataFrame({group: [part[group].iloc[0]], "squares": [float(row @ row)]})

    made = rows.select(group, "terms").mapInArrow(run, f"{group} {kind}, at int, sums binary")
    return made.groupBy(group, "at").applyInPandas(squares, f"{group} {kind}, squares double").groupBy(group).agg(F.sum("squares").alias("squares"))


def tf_idf_similarity(docs: DataFrame, key: str, text: str, group: str, most_terms: int = 1000, block: int = 1024) -> DataFrame:
    """Per group: mean, population std and maximum of the pairwise cosines of its texts' TF-IDF vectors.

    idf = ln((1 + n) / (1 + df)) + 1 over the group's commonest terms. A group of up to `block` texts is one task. A
    larger one has its sums from those of terms and pairs of terms, and the maximum, 1, from equal texts; if it has none, its texts
    meet in blocks of about `block`, one pair of blocks a task, in lots, so that the disk holds one lot's copies.
    """
    kind = dict(docs.dtypes)[group]
    words = docs.select(group, key, F.explode(T.tokens(F.lower(text))).alias("w")).groupBy(group, key, "w").agg(F.count("*").alias("tf"))
    sizes = docs.groupBy(group).agg(F.countDistinct(key).alias("n"))
    df = words.groupBy(group, "w").agg(F.count("*").alias("df"), F.sum("tf").alias("total"))
    df = df.withColumn("r", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("total"), "w"))).where(F.col("r") <= most_terms)
    df = df.join(sizes, group).select(group, "w", (F.row_number().over(Window.partitionBy(group).orderBy("w")) - 1).alias("at"), (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))  # at most `most_terms` a group
    found = words.join(df, [group, "w"]).groupBy(group, key).agg(F.sort_array(F.collect_list(F.struct("at", "tf", (F.col("tf") * F.col("idf")).alias("v")))).alias("terms"))
    norm = F.sqrt(F.aggregate("terms", F.lit(0.0), lambda a, x: a + x["v"] * x["v"]))
    rows = found.withColumn("norm", norm).select(group, key, F.transform("terms", lambda x: F.struct(x["at"].alias("at"), (x["v"] / F.col("norm")).alias("v"), x["tf"].alias("tf"))).alias("terms"))
    blocks = sizes.select(group, F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    dealt = rows.join(blocks, group).withColumn("own", F.pmod(F.xxhash64(key), F.col("blocks")).cast("int"))
    dealt = graph.cut(dealt.repartition(group, F.floor(F.col("own") / 64)).sortWithinPartitions(group))
    graph.collect_garbage(docs.sparkSession)
    large = dealt.where("blocks > 1")
    if large.isEmpty():
        large = None

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        def dense(own: int) -> np.ndarray:
            terms = part["terms"][part["own"] == own].tolist()
            out = np.zeros((len(terms), most_terms))
            for r, t in enumerate(terms):
                for x in t:
                    out[r, x["at"]] = x["v"]
            return out

        i, j = int(part["i"].iloc[0]), int(part["j"].iloc[0])
        left = dense(i)
        c = left @ (left if i == j else dense(j)).T
        c = c[np.triu_indices(len(left), 1)] if i == j else c.ravel()
        return pd.DataFrame({group: [part[group].iloc[0]], "s": [c.sum()], "ss": [(c * c).sum()], "m": [c.max() if c.size else 0.0]})

    def met(texts: DataFrame) -> DataFrame:
        """Every text with every block of its group."""
        ij = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least(j, F.col("own")).alias("i"), F.greatest(j, F.col("own")).alias("j")))
        return texts.withColumn("ij", F.explode(ij)).select(group, "ij.i", "ij.j", "own", "terms")

    def compared(texts: DataFrame) -> DataFrame:
        return texts.groupBy(group, "i", "j").applyInPandas(compare, f"{group} {kind}, s double, ss double, m double")

    sums = compared(met(dealt.where("blocks = 1"))).select(group, "s", "ss", "m")
    if large is not None:
        q = F.aggregate("terms", F.lit(0.0), lambda a, x: a + x["v"] * x["v"])
        own = large.select(group, q.alias("q")).groupBy(group).agg(F.sum("q").alias("q"), F.sum(F.col("q") * F.col("q")).alias("qq"))
        whole = large.select(group, F.explode("terms").alias("t")).groupBy(group, "t.at").agg(F.sum("t.v").alias("v")).groupBy(group).agg(F.sum(F.col("v") * F.col("v")).alias("square"))
        counts = F.transform("terms", lambda x: F.struct(x["at"], x["tf"]))
        equal = large.groupBy(group, F.xxhash64(counts).alias("h1"), F.xxhash64(F.lit(1), counts).alias("h2")).agg(F.count("*").alias("c")).groupBy(group).agg((F.max("c") > 1).alias("equal"))
        equal = graph.cut(equal)
        rest = large.join(equal.where("NOT equal"), group, "left_semi")
        copies, texts = rest.agg(F.sum("blocks"), F.count("*")).first()
        top = equal.where("equal").select(group, F.lit(1.0).alias("m"))
        lots = -(-(copies or 0) // max(LOT_TIMES * texts, LOT_ROWS))
        for i in range(lots):
            lot = met(rest).where(F.pmod(F.xxhash64(group, "i", "j"), F.lit(lots)) == i)
            top = top.unionByName(graph.cut(compared(lot).groupBy(group).agg(F.max("m").alias("m"))))
            graph.collect_garbage(docs.sparkSession)
        parts = own.join(whole, group).join(_grams(large, group, kind, most_terms, block), group).join(top.groupBy(group).agg(F.max("m").alias("m")), group)
        sums = sums.unionByName(parts.select(group, ((F.col("square") - F.col("q")) / 2).alias("s"), ((F.col("squares") - F.col("qq")) / 2).alias("ss"), "m"))
    sums = sums.groupBy(group).agg(F.sum("s").alias("s"), F.sum("ss").alias("ss"), F.max("m").alias("m"))
    pairs = F.col("n") * (F.col("n") - 1) / 2
    mean = F.coalesce("s", F.lit(0.0)) / F.greatest(pairs, F.lit(1.0))
    return sizes.join(sums, group, "left").select(group, mean.alias("similarity_mean"), F.sqrt(F.greatest(F.coalesce("ss", F.lit(0.0)) / F.greatest(pairs, F.lit(1.0)) - mean * mean, F.lit(0.0))).alias("similarity_std"), F.coalesce("m", F.lit(0.0)).alias("similarity_max"))


def wide_vector(*families: DataFrame, user: str = "user_id") -> DataFrame:
    """Families of features side by side, one row for each user that any has; what is missing is 0."""
    out = families[0]
    for f in families[1:]:
        out = out.join(f, user, "full")
    return out.na.fill(0.0)

