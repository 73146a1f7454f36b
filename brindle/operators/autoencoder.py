"""A nonlinear autoencoder, fitted by mini-batch gradients that tasks sum over their rows."""

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from brindle.operators import graph

Weights = list[tuple[np.ndarray, np.ndarray]]


def start(sizes: list[int], seed: int) -> Weights:
    r = np.random.default_rng(seed)
    return [(r.normal(0, np.sqrt(1 / a), (a, b)), np.zeros(b)) for a, b in zip(sizes, sizes[1:], strict=False)]


def layers(weights: Weights, x: np.ndarray, linear: set[int]) -> list[np.ndarray]:
    """What each layer gives, tanh but where it is linear; the input first."""
    out = [x]
    for i, (w, b) in enumerate(weights):
        z = out[-1] @ w + b
        out.append(z if i in linear else np.tanh(z))
    return out


def gradient(weights: Weights, x: np.ndarray, linear: set[int]) -> tuple[float, np.ndarray]:
    """The squared error of rows x against what comes back, summed, and its gradient as one vector."""
    out = layers(weights, x, linear)
    back, found = 2 * (out[-1] - x), []
    for i in range(len(weights) - 1, -1, -1):
        if i not in linear:
            back = back * (1 - out[i + 1] ** 2)
        found += [back.sum(axis=0), (out[i].T @ back).ravel()]
        back = back @ weights[i][0].T
    return float(((out[-1] - x) ** 2).sum()), np.concatenate(found[::-1])


def flat(weights: Weights) -> np.ndarray:
    return np.concatenate([np.concatenate((w.ravel(), b)) for w, b in weights])


def shaped(vector: np.ndarray, sizes: list[int]) -> Weights:
    out, at = [], 0
    for a, b in zip(sizes, sizes[1:], strict=False):
        out.append((vector[at : at + a * b].reshape(a, b), vector[at + a * b : at + a * b + b]))
        at += a * b + b
    return out


class Autoencoder:
    """Rows of numeric columns, standardised, through a narrow middle and back.

    A step takes one of about n / batch_rows parts of the rows, dealt by a hash; tasks sum gradients, Spark adds them up by weight, and
    the driver, which never has more than the weights, moves them (Adam). So a fit reads about steps * batch_rows rows
    however many there are. Nulls count as the column's mean; a constant column is 0. The same rows and seed give the same
    weights but for the order of sums.
    """

    def __init__(self, columns: list[str], hidden: tuple[int, ...] = (32, 16), latent: int = 8, steps: int = 150, rate: float = 0.02, batch_rows: int = 200_000, seed: int = 42):
        self.columns, self.steps, self.rate, self.batch_rows, self.seed = columns, steps, rate, batch_rows, seed
        self.sizes = [len(columns), *hidden, latent, *hidden[::-1], len(columns)]
        self.middle = len(hidden)  # the layer whose output is the code
        self.linear = {self.middle, len(self.sizes) - 2}
        self.losses: list[float] = []

    def _vector(self, df: DataFrame):
        return F.array(*(F.coalesce((F.col(c).cast("double") - m) / s, F.lit(0.0)) for c, m, s in zip(self.columns, self.mean, self.scale, strict=True)))

    def fit(self, df: DataFrame) -> "Autoencoder":
        row = df.agg(F.count("*").alias("n"), *(f(c).alias(f"{k}{i}") for i, c in enumerate(self.columns) for k, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
        self.mean = [float(row[f"m{i}"] or 0.0) for i in range(len(self.columns))]
        self.scale = [float(row[f"s{i}"] or 0.0) or 1.0 for i in range(len(self.columns))]
        weights = flat(start(self.sizes, self.seed))
        folds = max(1, round(row["n"] / self.batch_rows))
        path = f"{graph.shared_folder(df.sparkSession)}/rows-{uuid.uuid4().hex}"
        rows = df.select(self._vector(df).alias("x")).withColumn("fold", F.pmod(F.xxhash64("x"), F.lit(folds)).cast("int"))
        rows.write.partitionBy("fold").parquet(path)  # a step reads its own part only
        rows = df.sparkSession.read.schema("x array<double>, fold int").parquet(path)
        first, second = np.zeros_like(weights), np.zeros_like(weights)
        for step in range(1, self.steps + 1 if row["n"] else 1):
            loss, n, g = self._step(rows.where(F.col("fold") == step % folds), weights)
            if not n:
                continue
            self.losses.append(loss / n)
            g = g / n
            first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
            weights = weights - self.rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        self.weights = shaped(weights, self.sizes)
        return self

    def _step(self, rows: DataFrame, vector: np.ndarray) -> tuple[float, int, np.ndarray]:
        weights, linear, size = shaped(vector, self.sizes), self.linear, len(vector)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(size + 2)
            for b in batches:
                x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                loss, g = gradient(weights, x, linear)
                total += np.concatenate((g, [loss, b.num_rows]))
            if total[-1]:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(size + 2, dtype=np.int32)), pa.array(total)], names=["i", "g"])

        got = dict(rows.select("x").mapInArrow(run, "i int, g double").groupBy("i").agg(F.sum("g")).collect())
        total = np.array([got.get(i, 0.0) for i in range(size + 2)])
        return total[-2], int(total[-1]), total[:-2]

    def encode(self, df: DataFrame, out: str = "latent") -> DataFrame:
        """df with its rows' codes."""
        weights, linear, middle = self.weights, self.linear, self.middle

        @F.pandas_udf(ArrayType(DoubleType()))
        def code(x: pd.Series) -> pd.Series:
            return pd.Series(list(layers(weights, np.array(x.tolist()), linear)[middle + 1])) if len(x) else pd.Series([], dtype=object)

        return df.withColumn(out, code(self._vector(df)))

    def score(self, df: DataFrame, quantile: float = 0.95) -> DataFrame:
        """df with score, the mean squared error of a row's standardised columns, and is_anomaly: whether it is over this quantile of the scores."""
        weights, linear = self.weights, self.linear

        @F.pandas_udf(DoubleType())
        def error(x: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype=float)
            rows = np.array(x.tolist())
            return pd.Series(((layers(weights, rows, linear)[-1] - rows) ** 2).mean(axis=1))

        scored = graph.cut(df.withColumn("score", error(self._vector(df))))
        limit = scored.agg(F.percentile_approx("score", F.lit(quantile), F.lit(10_000)).alias("_limit"))
        return scored.join(F.broadcast(limit)).withColumn("is_anomaly", F.col("score") > F.col("_limit")).drop("_limit")
