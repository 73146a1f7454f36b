"""Graph neural layers as message passing: edges are joined, messages averaged by target, and weights applied in Arrow batches.

x has node and h (array of double), edges have src, dst and, for typed graphs, type. Weights are numpy arrays of the layer's size, which
go to the tasks with the function.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def linear(x: DataFrame, weight: np.ndarray, bias: np.ndarray | None = None, activation: str | None = None, column: str = "h") -> DataFrame:
    """x with column replaced by weight applied to it (out x in), plus bias; activation: relu, elu or softmax."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                y = np.array(b[column].tolist(), dtype=float) @ weight.T + (0 if bias is None else bias)
                if activation == "relu":
                    y = np.maximum(y, 0)
                elif activation == "elu":
                    y = np.where(y > 0, y, np.expm1(np.minimum(y, 0)))
                elif activation == "softmax":
                    y = np.exp(y - y.max(axis=1, keepdims=True))
                    y /= y.sum(axis=1, keepdims=True)
                b = b.assign(**{column: list(y)})
            yield b

    return x.mapInPandas(run, x.schema)


def _mean(messages: DataFrame, by: list[str], dim: int) -> DataFrame:
    """The mean of the vectors of each group, element by element, combined before the shuffle."""
    return messages.groupBy(*by).agg(F.array(*(F.avg(F.col("h")[i]) for i in range(dim))).alias("h"))


def rgcn(x: DataFrame, edges: DataFrame, bases: np.ndarray, coefficients: dict[str, np.ndarray], root: np.ndarray, bias: np.ndarray | None = None) -> DataFrame:
    """node, h of a relational graph convolution: for each edge type the mean of the sources' vectors times that type's weight, a mix of `bases` by its coefficients, added up; plus the node's own vector times `root`."""
    size, dim = root.shape
    means = _mean(edges.join(x.select(F.col("node").alias("src"), "h"), "src"), ["dst", "type"], dim).withColumnRenamed("dst", "node")
    parts = [linear(x.select("node", "h"), root, bias)]
    for kind, mix in coefficients.items():
        parts.append(linear(means.where(F.col("type") == kind).select("node", "h"), np.tensordot(mix, bases, axes=1)))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    summed = every.groupBy("node").agg(F.array(*(F.sum(F.col("h")[i]) for i in range(size))).alias("h"))
    return summed.join(x.select("node"), "node", "left_semi")


def gcn(x: DataFrame, edges: DataFrame, weight: np.ndarray, bias: np.ndarray | None = None, activation: str | None = None) -> DataFrame:
    """node, d, h of a graph convolution: the sum over a node and its neighbours of their vectors over the roots of both d, times `weight` (out x in).

    x also has d, one more than the node's degree; edges hold each link in both directions, once. Sums are combined before the
    shuffle, and taken of the shorter of the vectors before and after the weight.
    """
    size, dim = weight.shape
    early = size < dim
    told = linear(x.select("node", "d", "h"), weight) if early else x.select("node", "d", "h")
    told = told.select("node", "d", F.transform("h", lambda v: v / F.sqrt("d")).alias("h"))
    sent = edges.join(told.select(F.col("node").alias("src"), "h"), "src").select(F.col("dst").alias("node"), F.lit(None).cast(x.schema["d"].dataType).alias("d"), "h")
    summed = told.unionByName(sent).groupBy("node").agg(F.max("d").alias("d"), F.array(*(F.sum(F.col("h")[i]) for i in range(min(size, dim)))).alias("h"))
    out = summed.where("d IS NOT NULL").select("node", "d", F.transform("h", lambda v: v / F.sqrt("d")).alias("h"))
    return linear(out, np.eye(size) if early else weight, bias, activation)


def gat(x: DataFrame, edges: DataFrame, weight: np.ndarray, source: np.ndarray, target: np.ndarray, slope: float = 0.2, join: str = "concat", attention: bool = False) -> DataFrame:
    """node, h of multi-head attention: weight is heads x out x in, source and target are heads x out.

    The softmax runs over the edges into a node; its sums are aggregates, not a window, so that a hub is no task's burden.
    join: concat or mean of the heads. attention: instead src, dst, head and alpha of each edge. A node without incoming edges gets zeros.
    """
    heads, out, _ = weight.shape
    z = linear(x.select("node", "h"), weight.reshape(heads * out, -1))
    part = lambda c, k: F.slice(c, k * out + 1, out)
    dot = lambda c, k, v: sum((F.get(c, F.lit(k * out + i)) * float(v[k, i]) for i in range(out)), F.lit(0.0))
    ends = edges.select("src", "dst").distinct().join(z.select(F.col("node").alias("src"), F.col("h").alias("hs")), "src").join(z.select(F.col("node").alias("dst"), F.col("h").alias("hd")), "dst")
    raw = lambda k: dot("hs", k, source) + dot("hd", k, target)
    scored = ends.select("src", "dst", F.explode(F.array(*(F.struct(F.lit(k).alias("head"), F.when(raw(k) > 0, raw(k)).otherwise(slope * raw(k)).alias("e"), part("hs", k).alias("v")) for k in range(heads)))).alias("m")).select("src", "dst", "m.*")
    top = scored.groupBy("dst", "head").agg(F.max("e").alias("top"))
    mass = scored.join(top, ["dst", "head"]).withColumn("w", F.exp(F.col("e") - F.col("top")))
    total = mass.groupBy("dst", "head").agg(F.sum("w").alias("total"))
    alpha = mass.join(total, ["dst", "head"]).withColumn("alpha", F.col("w") / F.col("total"))
    if attention:
        return alpha.select("src", "dst", "head", "alpha")
    per = alpha.groupBy(F.col("dst").alias("node"), "head").agg(F.array(*(F.sum(F.col("alpha") * F.col("v")[i]) for i in range(out))).alias("h"))
    wide = per.groupBy("node").agg(*(F.max(F.when(F.col("head") == k, F.col("h"))).alias(f"h{k}") for k in range(heads)))
    zero = F.array_repeat(F.lit(0.0), out)
    vectors = [F.coalesce(f"h{k}", zero) for k in range(heads)]
    joined: Column = F.concat(*vectors) if join == "concat" else F.transform(F.sequence(F.lit(0), F.lit(out - 1)), lambda i: sum((F.get(v, i) for v in vectors), F.lit(0.0)) / heads)
    return x.select("node").join(wide, "node", "left").select("node", joined.alias("h"))


def hetero_gnn(x: DataFrame, edges: DataFrame, weights: dict) -> DataFrame:
    """node, h (class probabilities): input layer, two relational convolutions with scale and shift and ReLU, attention with mean heads, two dense layers. Inference with given weights."""
    h = linear(x, weights["input"], weights.get("input_bias"))
    for layer in weights["convolutions"]:
        h = rgcn(h, edges, layer["bases"], layer["coefficients"], layer["root"], layer.get("bias"))
        h = linear(h, np.diag(layer["scale"]), layer["shift"], "relu")
    a = weights["attention"]
    h = gat(h, edges, a["weight"], a["source"], a["target"], join="mean")
    h = linear(h, weights["dense"], weights.get("dense_bias"), "relu")
    return linear(h, weights["output"], weights.get("output_bias"), "softmax")


def neighbourhood_features(x: DataFrame, edges: DataFrame, dim: int, hops: int = 2) -> DataFrame:
    """node, h: a node's vector with the mean vectors of its neighbours after one hop, two hops and so on behind it."""
    out, at = x.select("node", F.col("h").alias("h0")), x.select("node", "h")
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    for k in range(1, hops + 1):
        at = _mean(both.join(at.withColumnRenamed("node", "src"), "src"), ["dst"], dim).withColumnRenamed("dst", "node")
        out = out.join(at.withColumnRenamed("h", f"h{k}"), "node", "left")
    zero = F.array_repeat(F.lit(0.0), dim)
    return out.select("node", F.concat(*(F.coalesce(f"h{k}", zero) for k in range(hops + 1))).alias("h"))


def train(x: DataFrame, labels: DataFrame, width: int, classes: int, hidden: int = 32, seed: int = 42, iterations: int = 100):
    """A multilayer perceptron over neighbourhood features, as Spark fits it on (node, label): the trained part of a graph network whose message passing is fixed."""
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    from pyspark.ml.functions import array_to_vector

    rows = x.join(labels, "node").select(array_to_vector("h").alias("features"), F.col("label").cast("double").alias("label"))
    return MultilayerPerceptronClassifier(layers=[width, hidden, classes], seed=seed, maxIter=iterations).fit(rows)


def predict(x: DataFrame, model) -> DataFrame:
    """node, prediction and confidence (the largest probability)."""
    from pyspark.ml.functions import array_to_vector, vector_to_array

    done = model.transform(x.select("node", array_to_vector("h").alias("features")))
    return done.select("node", F.col("prediction").cast("long").alias("prediction"), F.array_max(vector_to_array("probability")).alias("confidence"))
