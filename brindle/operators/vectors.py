"""A user's whole feature vector, and features that need a model or an order: topics, templates, pairwise likeness."""

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as K

from brindle.functions import text as T
from brindle.operators import features


def user_vector(posts: DataFrame, users: DataFrame | None = None, network: DataFrame | None = None, lags: int = 24) -> DataFrame:
    """One row for each user with posts: user_id and the families temporal, content, network and metadata, each a struct.

    posts: user_id, posted_at, content. users: user_id, username, display_name, bio and avatar_url, for metadata; network: user_id and
    any numeric columns. What a user lacks is 0. Each family is made for all users at once and joined on user_id.
    """
    families = {
        "temporal": [features.post_frequency(posts), features.time_distribution(posts), features.autocorrelation(posts, lags)],
        "content": [features.word_topics(posts, T.STOP), features.text_style(posts)],
        "network": [network] if network is not None else [],
        "metadata": [] if users is None else [users.select("user_id", features.completeness("username", "display_name", "bio", "avatar_url").alias("profile_completeness")), features.username_features(users, ["user_id"])],
    }
    out = posts.where("user_id IS NOT NULL").select("user_id").distinct()
    for name, tables in families.items():
        for i, table in enumerate(tables):
            table = _wide(table, lags)
            columns = [c for c in table.columns if c != "user_id"]
            out = out.join(table.select("user_id", F.struct(*columns).alias(f"_{name}{i}")), "user_id", "left")
    structs = []
    for name, tables in families.items():
        fields = [(f"_{name}{i}", f) for i in range(len(tables)) for f in out.schema[f"_{name}{i}"].dataType.names]
        if fields:
            structs.append(F.struct(*(F.coalesce(F.col(p)[f].cast("double"), F.lit(0.0)).alias(f) for p, f in fields)).alias(name))
    return out.select("user_id", *structs)


def _wide(table: DataFrame, lags: int) -> DataFrame:
    """A table of (user_id, lag, value) as one row a user with a column for each lag; any other as it is."""
    if "lag" not in table.columns:
        return table
    value = next(c for c in table.columns if c not in ("user_id", "lag"))
    return table.groupBy("user_id").agg(*(F.max(F.when(F.col("lag") == i, F.col(value))).alias(f"autocorrelation_{i}") for i in range(1, lags + 1)))


def all_features(vector: DataFrame, key: str = "user_id") -> Column:
    """A map of family.field to value over the structs of user_vector."""
    entries = [F.struct(F.lit(f"{f.name}.{g}").alias("name"), F.col(f.name)[g].cast("double").alias("value")) for f in vector.schema if f.name != key and isinstance(f.dataType, K.StructType) for g in f.dataType.names]
    return F.map_from_entries(F.array(*entries))


def to_vector(values: Column, names: list[str]) -> Column:
    """The map's values in the order of the names; a name that isn't there is 0."""
    return F.array(*(F.coalesce(F.try_element_at(values, F.lit(n)), F.lit(0.0)) for n in names))


def normalized(values: Column) -> Column:
    """The map's values as z-scores over this map's own values (population std); no spread gives 0."""
    v = F.map_values(values)
    n = F.size(v)
    mean = F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / n
    std = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / n)
    return F.transform_values(values, lambda _, x: F.when(std > 0, (x - mean) / std).otherwise(0.0))


def topic_features(posts: DataFrame, topics: int = 5, words: int = 1000, seed: int = 42, user: str = "user_id", text: str = "content") -> DataFrame:
    """Per user the entropy (log2) of the mean topic mix of its posts and the mean of their largest shares, by one LDA model over the TF-IDF of all posts."""
    from pyspark.ml.clustering import LDA
    from pyspark.ml.feature import IDF, CountVectorizer
    from pyspark.ml.functions import vector_to_array

    tokens = posts.where(F.col(text).isNotNull()).select(user, F.filter(T.tokens(F.lower(text)), lambda w: (F.length(w) > 1) & ~w.isin(T.STOP)).alias("words")).where(F.size("words") > 0)
    if tokens.isEmpty():
        return tokens.select(user, F.lit(0.0).alias("topic_entropy"), F.lit(0.0).alias("topic_concentration"))
    counted = CountVectorizer(inputCol="words", outputCol="tf", vocabSize=words).fit(tokens).transform(tokens)
    weighed = IDF(inputCol="tf", outputCol="features").fit(counted).transform(counted)
    mixed = LDA(k=topics, seed=seed, maxIter=10).fit(weighed).transform(weighed).select(user, vector_to_array("topicDistribution").alias("mix"))
    mean = mixed.groupBy(user).agg(F.array(*(F.avg(F.col("mix")[i]) for i in range(topics))).alias("mean"), F.avg(F.array_max("mix")).alias("topic_concentration"))
    entropy = -F.aggregate("mean", F.lit(0.0), lambda a, p: a + p * F.log2(p + features.EPS))
    return mean.select(user, entropy.alias("topic_entropy"), "topic_concentration")


def template_features(posts: DataFrame, threshold: float = 0.7, user: str = "user_id", text: str = "content", order: str = "posted_at") -> DataFrame:
    """Per user the share of posts that follow a template and the number of templates: in order, a post joins the first template at a common-subsequence likeness of at least `threshold`, or begins one. One user's posts are one task's work, as the order is part of the rule."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        leaders: list[str] = []
        sizes: list[int] = []
        for t in part.sort_values(order, kind="stable")[text].dropna():
            for i, lead in enumerate(leaders):
                if T.lcs_share(t, lead) >= threshold:
                    sizes[i] += 1
                    break
            else:
                leaders.append(t)
                sizes.append(1)
        matched = sum(n for n in sizes if n > 1)
        return pd.DataFrame({user: [part[user].iloc[0]], "template_ratio": [matched / max(sum(sizes), 1)], "templates": [sum(n > 1 for n in sizes)]})

    kind = dict(posts.dtypes)[user]
    return posts.select(user, order, text).groupBy(user).applyInPandas(run, f"{user} {kind}, template_ratio double, templates long")


def pairwise_ratio(posts: DataFrame, user: str = "user_id", text: str = "content", key: str = "post_id") -> DataFrame:
    """Per user the mean, population std and maximum of the matching-blocks likeness of all pairs of its posts. For users with few posts, as the pairs grow with the square of their number."""
    side = lambda n: posts.select(user, F.col(key).alias(f"k{n}"), F.col(text).alias(f"t{n}"))
    pairs = side(1).join(side(2), user).where("k1 < k2").withColumn("r", T.ratio("t1", "t2"))
    return pairs.groupBy(user).agg(F.avg("r").alias("similarity_mean"), F.stddev_pop("r").alias("similarity_std"), F.max("r").alias("similarity_max"))
