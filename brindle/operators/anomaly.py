"""Anomaly detection: series, sessions, accounts, and detectors over feature arrays."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.operators import graph, nearest


def volume_anomaly(series: DataFrame, by: list[str], time: str, value: str, window: int = 7, threshold: float = 3.0) -> DataFrame:
    """Flags values over `threshold` population stds from the mean of the `window` rows before. Fewer than two of them, no spread, or a series shorter than the window: not flagged."""
    w = Window.partitionBy(*by).orderBy(time)
    before = w.rowsBetween(-window, -1)
    stats = series.withColumns({"_m": F.avg(value).over(before), "_s": F.stddev_pop(value).over(before), "_n": F.count(value).over(before), "_len": F.count("*").over(Window.partitionBy(*by))})
    z = F.when((F.col("_n") >= 2) & (F.col("_s") > 0) & (F.col("_len") >= window), F.abs(F.col(value) - F.col("_m")) / F.nullif(F.col("_s"), F.lit(0.0)))
    return stats.withColumn("is_anomaly", F.coalesce(z > threshold, F.lit(False))).drop("_m", "_s", "_n", "_len")


def level_shift(series: DataFrame, by: list[str], time: str, value: str, window: int = 7, threshold: float = 0.3) -> DataFrame:
    """Rows where the mean of the next `window` rows (with this one) differs from that of the `window` before by over `threshold`."""
    w = Window.partitionBy(*by).orderBy(time)
    full = series.withColumns({"_i": F.row_number().over(w) - 1, "_len": F.count("*").over(Window.partitionBy(*by)), "_a": F.avg(value).over(w.rowsBetween(-window, -1)), "_b": F.avg(value).over(w.rowsBetween(0, window - 1))})
    inside = full.where((F.col("_len") >= 2 * window) & (F.col("_i") >= window) & (F.col("_i") <= F.col("_len") - window - 1))
    return inside.withColumn("change", F.col("_b") - F.col("_a")).where(F.abs("change") > threshold).drop("_i", "_len", "_a", "_b")


def gap_sessions(events: DataFrame, by: list[str], time: str, gap_seconds: int = 3600, least: int = 3) -> DataFrame:
    """Runs of events, each at most `gap_seconds` after the one before, of at least `least` events: start, end, size and span in seconds."""
    found = events.groupBy(*by, F.session_window(time, f"{gap_seconds} seconds")).agg(F.min(time).alias("start"), F.max(time).alias("end"), F.count("*").alias("size"))
    span = (F.unix_micros(F.col("end").cast("timestamp")) - F.unix_micros(F.col("start").cast("timestamp"))) / 1e6
    return found.where(F.col("size") >= least).select(*by, "start", "end", "size", span.alias("time_span"))


def bot_score(posts: DataFrame, users: DataFrame | None = None, user: str = "user_id", time: str = "posted_at", content: str = "content") -> DataFrame:
    """0.3 for regular gaps (population std under 60 s), 0.3 for repeated content (under 0.3 distinct), 0.2 for following over ten times its followers; over 0.5 is a bot."""
    us = F.unix_micros(F.col(time).cast("timestamp")) / 1e6
    gaps = posts.withColumn("_g", us - F.lag(us).over(Window.partitionBy(user).orderBy(time)))
    stats = gaps.groupBy(user).agg(F.stddev_pop("_g").alias("gap_std"), F.count("_g").alias("gaps"), (F.countDistinct(content) / F.count(content)).alias("distinct_ratio"), F.count("*").alias("posts"))
    score = F.when((F.col("gaps") >= 1) & (F.col("gap_std") < 60), 0.3).otherwise(0.0) + F.when(F.col("distinct_ratio") < 0.3, 0.3).otherwise(0.0)
    if users is not None:
        stats = stats.join(users.select(user, "followers_count", "following_count"), user, "left")
        score = score + F.when((F.col("followers_count") > 0) & (F.col("following_count") > 10 * F.col("followers_count")), 0.2).otherwise(0.0)
    return stats.select(user, score.alias("score"), (score > 0.5).alias("is_bot"))


def z_params(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: each column's mean and population std (0 counts as 1e-10)."""
    floor = lambda c: F.when(F.stddev_pop(c) == 0, 1e-10).otherwise(F.stddev_pop(c))
    return df.agg(*(F.avg(c).alias(f"{c}_mean") for c in columns), *(floor(c).alias(f"{c}_std") for c in columns))


def z_scores(df: DataFrame, columns: list[str], threshold: float = 3.0, method: str = "any") -> DataFrame:
    """df with the largest absolute z as score, and is_anomaly: any, all, or a majority of the columns beyond the threshold. The one row of parameters is broadcast."""
    z = [F.abs((F.col(c) - F.col(f"{c}_mean")) / F.col(f"{c}_std")) for c in columns]
    beyond = sum((F.when(x > threshold, 1).otherwise(0) for x in z), F.lit(0))
    needed = {"any": 1, "all": len(columns), "majority": len(columns) // 2 + 1}[method]
    score = F.greatest(*z) if len(z) > 1 else z[0]
    return df.join(F.broadcast(z_params(df, columns))).withColumns({"score": score, "is_anomaly": beyond >= needed}).select(*df.columns, "score", "is_anomaly")


def mahalanobis(df: DataFrame, columns: list[str], threshold: float = 3.0) -> DataFrame:
    """df with the Mahalanobis distance (sample covariance; its pseudo-inverse if singular) as score. One row of moments comes to the driver."""
    d = len(columns)
    aggs = [F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)] + [F.covar_samp(a, b).alias(f"c{i}_{j}") for i, a in enumerate(columns) for j, b in enumerate(columns) if i <= j]
    row = df.agg(*aggs).first()
    if row["m0"] is None or row["c0_0"] is None:
        return df.withColumns({"score": F.lit(0.0), "is_anomaly": F.lit(False)})
    cov = np.array([[row[f"c{min(i, j)}_{max(i, j)}"] for j in range(d)] for i in range(d)], dtype=float)
    inv = np.linalg.pinv(cov)
    off = [F.col(c) - row[f"m{i}"] for i, c in enumerate(columns)]
    square = sum((off[i] * off[j] * float(inv[i, j]) for i in range(d) for j in range(d)), F.lit(0.0))
    return df.withColumn("score", F.sqrt(F.greatest(square, F.lit(0.0)))).withColumn("is_anomaly", F.col("score") > threshold)


def local_outlier_factor(df: DataFrame, key: str, vector: str, neighbours: int = 20) -> DataFrame:
    """LOF of every row by its exact nearest neighbours, ties by key (see nearest)."""
    best = graph.cut(nearest.nearest(df, key, vector, neighbours)[0].select(F.col(key).alias("k"), "n", "d"))
    reach = best.groupBy("k").agg(F.max("d").alias("kd"))
    dens = best.join(reach.select(F.col("k").alias("n"), "kd"), "n").groupBy("k").agg((1 / (F.avg(F.greatest("d", "kd")) + 1e-10)).alias("lrd"))
    lof = best.join(dens.withColumnRenamed("k", "n"), "n").groupBy("k").agg(F.avg("lrd").alias("others")).join(dens, "k")
    return lof.select(F.col("k").alias(key), (F.col("others") / F.col("lrd")).alias("lof"), (1 / (F.col("others") / F.col("lrd") + 1e-10)).alias("density"))


class IsolationForest:
    """Trees grown on a bounded sample of scaled rows; path lengths scored in batches."""

    def __init__(self, trees: int = 100, rows_a_tree: int = 256, contamination: float = 0.1, seed: int = 42):
        self.trees, self.rows_a_tree, self.contamination, self.seed = trees, rows_a_tree, contamination, seed
        self.forest: list[tuple] = []

    def fit(self, df: DataFrame, columns: list[str]) -> "IsolationForest":
        self.columns = columns
        stats = z_params(df, columns).first()
        self.mean = np.array([stats[f"{c}_mean"] for c in columns])
        self.std = np.array([stats[f"{c}_std"] for c in columns])
        most = self.trees * self.rows_a_tree
        sample = df.select(*columns).dropna().orderBy(F.xxhash64(*columns)).limit(most).toPandas().to_numpy(dtype=float)  # at most `most` rows
        x, rng = (sample - self.mean) / self.std, np.random.default_rng(self.seed)
        n = min(self.rows_a_tree, len(x))
        self.norm = self._expected(n)
        depth = int(np.ceil(np.log2(max(n, 2))))
        self.forest = [self._grow(x[rng.choice(len(x), n, replace=False)], depth, rng) for _ in range(self.trees)] if n else []
        return self

    @staticmethod
    def _expected(n: int) -> float:
        return 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else float(n == 2)

    def _grow(self, x: np.ndarray, depth: int, rng: np.random.Generator) -> tuple:
        if depth == 0 or len(x) <= 1 or not (spread := np.flatnonzero(np.ptp(x, axis=0))).size:
            return (self._expected(len(x)),)
        j = int(rng.choice(spread))
        cut = float(rng.uniform(x[:, j].min(), x[:, j].max()))
        left = x[:, j] < cut
        return j, cut, self._grow(x[left], depth - 1, rng), self._grow(x[~left], depth - 1, rng)

    def _depths(self, tree: tuple, x: np.ndarray, at: int = 0) -> np.ndarray:
        if len(tree) == 1:
            return np.full(len(x), at + tree[0])
        left = x[:, tree[0]] < tree[1]
        out = np.empty(len(x))
        out[left], out[~left] = self._depths(tree[2], x[left], at + 1), self._depths(tree[3], x[~left], at + 1)
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        scaled = (x - self.mean) / self.std
        return 2 ** (-np.mean([self._depths(t, scaled) for t in self.forest], axis=0) / max(self.norm, 1e-10)) if self.forest else np.zeros(len(x))

    def transform(self, df: DataFrame, contributions: bool = False) -> DataFrame:
        """df with score (higher: more isolated) and is_anomaly: over the 1 - contamination quantile (to a ten-thousandth of the rows). contributions: what each column's value adds to the score against its mean."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                x = b[self.columns].to_numpy(dtype=float)
                b = b.assign(score=self.scores(x))
                for j, c in enumerate(self.columns if contributions else ()):
                    flat = x.copy()
                    flat[:, j] = self.mean[j]
                    b[f"{c}_contribution"] = b["score"] - self.scores(flat)
                yield b

        from pyspark.sql.types import DoubleType, StructType

        schema = StructType([*df.schema.fields]).add("score", DoubleType())
        for c in self.columns if contributions else ():
            schema = schema.add(f"{c}_contribution", DoubleType())
        scored = df.mapInPandas(run, schema)
        cut = scored.agg(F.percentile_approx("score", F.lit(1 - self.contamination), F.lit(10_000)).alias("cut"))
        return scored.join(F.broadcast(cut)).withColumn("is_anomaly", F.col("score") > F.col("cut")).drop("cut")


def ensemble(scores: list[Column], weights: list[float] | None = None, method: str = "weighted_average", threshold: float = 0.5) -> tuple[Column, Column]:
    """(score, is_anomaly) of several detectors' scores: weighted_average, max, or voting (the share of scores over 0.5)."""
    weights = weights or [1 / len(scores)] * len(scores)
    total = sum(weights)
    combined = {
        "weighted_average": lambda: sum((s * (w / total) for s, w in zip(scores, weights, strict=True)), F.lit(0.0)),
        "max": lambda: F.greatest(*scores) if len(scores) > 1 else scores[0],
        "voting": lambda: sum((F.when(s > 0.5, 1.0).otherwise(0.0) for s in scores), F.lit(0.0)) / len(scores),
    }[method]()
    return combined, combined > threshold


class Detectors:
    """An ensemble put together detector by detector: (name, score column, weight)."""

    def __init__(self, method: str = "weighted_average", threshold: float = 0.5):
        self.method, self.threshold, self.names, self.scores, self.weights = method, threshold, [], [], []

    def add(self, name: str, score: Column, weight: float | None = None) -> "Detectors":
        """Without a weight all detectors weigh the same from now on; with one, it is put behind those that are there."""
        self.names.append(name)
        self.scores.append(score)
        self.weights = [1 / len(self.scores)] * len(self.scores) if weight is None else [*self.weights, weight]
        return self

    def columns(self) -> tuple[Column, Column]:
        return ensemble(self.scores, self.weights, self.method, self.threshold)


def stacked(df: DataFrame, flags: list[str], scores: list[str], threshold: float = 0.5) -> DataFrame:
    """df with score and is_anomaly of a logistic regression that learns, from the detectors' scores, whether any of them flags a row. No flag or only flags: that share."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector, vector_to_array

    voted = df.withColumn("_any", sum((F.col(f).cast("int") for f in flags), F.lit(0)) > 0)
    share = voted.agg(F.avg(F.col("_any").cast("double"))).first()[0]
    if share in (None, 0.0, 1.0):
        return df.withColumn("score", F.lit(share or 0.0)).withColumn("is_anomaly", F.col("score") > threshold)
    rows = voted.withColumn("features", array_to_vector(F.array(*(F.col(c).cast("double") for c in scores)))).withColumn("label", F.col("_any").cast("double"))
    done = LogisticRegression(regParam=0.01).fit(rows).transform(rows)
    return done.withColumn("score", vector_to_array("probability")[1]).select(*df.columns, "score", (F.col("score") > threshold).alias("is_anomaly"))


def latent(df: DataFrame, columns: list[str], dims: int = 2) -> DataFrame:
    """df with latent, the coordinates of its min-max scaled columns on their first principal axes. A d x d moment matrix comes to the driver."""
    d = len(columns)
    span = df.agg(*(F.min(c).alias(f"lo{i}") for i, c in enumerate(columns)), *(F.max(c).alias(f"hi{i}") for i, c in enumerate(columns))).first()
    if span["lo0"] is None:
        return df.withColumn("latent", F.array(*[F.lit(0.0)] * dims))
    scaled = [(F.col(c) - span[f"lo{i}"]) / ((span[f"hi{i}"] - span[f"lo{i}"]) or 1.0) for i, c in enumerate(columns)]
    row = df.agg(*(F.avg(x).alias(f"m{i}") for i, x in enumerate(scaled)), *(F.covar_pop(scaled[i], scaled[j]).alias(f"c{i}_{j}") for i in range(d) for j in range(i, d))).first()
    cov = np.array([[row[f"c{min(i, j)}_{max(i, j)}"] for j in range(d)] for i in range(d)], dtype=float)
    axes = np.linalg.eigh(cov)[1][:, ::-1][:, :dims]
    axes = axes * np.where(axes[np.abs(axes).argmax(axis=0), range(axes.shape[1])] < 0, -1, 1)
    return df.withColumn("latent", F.array(*(sum(((s - row[f"m{i}"]) * float(axes[i, k]) for i, s in enumerate(scaled)), F.lit(0.0)) for k in range(axes.shape[1]))))


def report(score: Column, anomaly_type: Column) -> Column:
    return F.struct(score.alias("score"), anomaly_type.alias("type"), F.least(F.abs(score) / 2, F.lit(1.0)).alias("confidence"))


def anomaly_class(features: Column) -> Column:
    """unknown for fewer than five features; else by the first of the features 0, 1 and 2 that is over 3."""
    at = lambda i: F.get(features, F.lit(i)) > 3
    return F.when(F.size(features) < 5, "unknown").when(at(0), "viral_content").when(at(1), "rapid_spread").when(at(2), "unusual_engagement").otherwise("behavioral_anomaly")


def top_contributions(contributions: Column, k: int = 5) -> Column:
    """The k entries of a map with the largest absolute values, ties by name."""
    order = lambda a, b: F.when(F.abs(a["value"]) > F.abs(b["value"]), -1).when(F.abs(a["value"]) < F.abs(b["value"]), 1).when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)
    return F.slice(F.array_sort(F.map_entries(contributions), order), 1, k)


def reconstruction_error(df: DataFrame, columns: list[str], latent: int = 2, quantile: float = 0.95) -> DataFrame:
    """df with the squared error of a PCA reconstruction of min-max scaled columns as score, flagged over its quantile: a linear stand-in for an autoencoder. A d x d moment matrix comes to the driver."""
    d = len(columns)
    span = df.agg(*(F.min(c).alias(f"lo{i}") for i, c in enumerate(columns)), *(F.max(c).alias(f"hi{i}") for i, c in enumerate(columns))).first()
    scaled = [(F.col(c) - span[f"lo{i}"]) / ((span[f"hi{i}"] - span[f"lo{i}"]) or 1.0) for i, c in enumerate(columns)]
    row = df.agg(*(F.avg(s).alias(f"m{i}") for i, s in enumerate(scaled)), *(F.covar_pop(scaled[i], scaled[j]).alias(f"c{i}_{j}") for i in range(d) for j in range(i, d))).first()
    cov = np.array([[row[f"c{min(i, j)}_{max(i, j)}"] for j in range(d)] for i in range(d)], dtype=float)
    basis = np.linalg.eigh(cov)[1][:, ::-1][:, :latent]
    off = [s - row[f"m{i}"] for i, s in enumerate(scaled)]
    keep = np.eye(d) - basis @ basis.T
    error = sum(((sum((off[j] * float(keep[i, j]) for j in range(d)), F.lit(0.0))) ** 2 for i in range(d)), F.lit(0.0)) / d
    scored = df.withColumn("score", error)
    cut = scored.agg(F.percentile_approx("score", F.lit(quantile), F.lit(10_000)).alias("cut"))
    return scored.join(F.broadcast(cut)).withColumn("is_anomaly", F.col("score") > F.col("cut")).drop("cut")
