"""Nearest neighbours by cosine: stable projections to few dimensions, kd-trees, and a chi-square stopping test."""

from functools import reduce
from math import factorial, inf

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common


def chi_square_below(x: np.ndarray | float, m: int) -> np.ndarray | float:
    """The chi-square distribution's share below x for an even number m of degrees of freedom."""
    h = np.minimum(np.asarray(x, dtype=float) / 2, 700)
    return 1 - np.exp(-h) * sum(h**i / factorial(i) for i in range(m // 2))


#: So many queries meet a chunk of rows in one task.
LOT = 4096


class KdTree:
    """Leaves of at most `leaf` points, cut at the medians of the widest axes; boxes are those of the points within."""

    def __init__(self, points: np.ndarray, leaf: int = 64):
        parts, todo = [], [np.arange(len(points))]
        while todo:
            ids = todo.pop()
            if len(ids) <= leaf:
                parts.append(ids)
                continue
            axis = int(np.argmax(np.ptp(points[ids], axis=0)))
            order = ids[np.argpartition(points[ids, axis], len(ids) // 2)]
            todo += [order[: len(ids) // 2], order[len(ids) // 2 :]]
        self.points, self.parts = points, parts
        self.low = np.stack([points[p].min(axis=0) for p in parts])
        self.high = np.stack([points[p].max(axis=0) for p in parts])

    def nearing(self, q: np.ndarray, at_once: int = 8):
        """(ids, bound): points in steps of growing projected distance from q, and the squared distance below which all have come.

        Leaves are opened `at_once`, then twice as many each time, so that a query takes few steps and opens at most about twice what it needs.
        """
        gap = np.maximum(np.maximum(self.low - q, q - self.high), 0)
        far = (gap * gap).sum(axis=1)
        order = np.argsort(far, kind="stable")
        ids, dist = np.zeros(0, dtype=np.int64), np.zeros(0)
        k = 0
        while k < len(order):
            new = np.concatenate([self.parts[i] for i in order[k : k + at_once]])
            off = self.points[new] - q
            ids, dist = np.concatenate((ids, new)), np.concatenate((dist, (off * off).sum(axis=1)))
            k, at_once = k + at_once, 2 * at_once
            bound = far[order[k]] if k < len(order) else inf
            due = dist <= bound
            out = ids[due]
            ids, dist = ids[~due], dist[~due]
            yield out, bound


def lengths(vectors: np.ndarray) -> np.ndarray:
    return np.sqrt((vectors * vectors).sum(axis=1))


#: Products of matrices are further than this from no cosine; see `search`.
SLACK = 1e-9


def search(vectors: np.ndarray, norms: np.ndarray, names: np.ndarray, tree: KdTree, query: np.ndarray, q: np.ndarray, k: int, sure: float, known: float = inf) -> tuple[np.ndarray, np.ndarray]:
    """The k best rows found and their cosines, ties to the smaller name. A cosine is summed in the same order wherever its row lies. Projected neighbours are verified until a row as near as the k-th best would, with a chance of `sure`, have come by now.

    The squared projected distance over the squared true distance of unit vectors follows a chi-square distribution.
    norms: the rows' lengths. known: a squared distance that k others are already within. Of the rows that have come only those are summed that a product of matrices puts among the best, or nearly.
    """
    m, norm = len(q), np.sqrt((query * query).sum())
    guess = (vectors @ (query / norm)) / norms
    ids, scores = np.zeros(0, dtype=np.int64), np.zeros(0)
    for new, bound in tree.nearing(q):
        if len(ids) == k:
            new = new[~(guess[new] < scores.min() - SLACK)]
        if len(new) > k:
            g = guess[new]
            new = new[~(g < np.partition(g, len(g) - k)[len(g) - k] - SLACK)]
        if len(new):
            rows = vectors[new]
            got = (rows * query).sum(axis=1) / (norms[new] * norm)
            ids, scores = np.concatenate((ids, new)), np.concatenate((scores, got))
            if len(ids) > k:
                best = np.lexsort((names[ids], -scores))[:k]
                ids, scores = ids[best], scores[best]
        reach = min(known, max(2 - 2 * scores.min(), 0.0) if len(ids) == k else inf)
        if reach < inf and bound > reach * 1e-12 and chi_square_below(bound / max(reach, 1e-12), m) >= sure:
            break
    return ids, scores


def _valid(v: Column) -> Column:
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(fine & F.exists(v, lambda x: x != 0), F.lit(False))


def _of_one_size(rows: DataFrame, dim: int, total: int, k: int, dims: int, sure: float, cell_rows: int, most_cells: int, sample: int, seed: int) -> DataFrame:
    """query (a vector's first id), ids and score of the k + 1 best that each asking vector finds. rows: ids (the smallest k + 1 of a vector's ids), vec, and asks (not empty if it asks).

    Rows have one home, their cell, in chunks of a bounded size; queries go to the cells. Only where more than LOT queries meet in
    a cell, its rows are there once for each lot of them.
    """
    matrix = np.random.default_rng(seed + dim).normal(size=(dim, dims))
    levels = int(np.ceil(np.log2(max(1, min(most_cells, total / cell_rows)))))

    def project(vecs: pd.Series) -> np.ndarray:
        v = np.array(vecs.tolist(), dtype=float).reshape(len(vecs), dim)
        scale = np.abs(v).max(axis=1, keepdims=True)
        v = v / scale
        return (v / np.sqrt((v * v).sum(axis=1))[:, None]) @ matrix

    def flat(batches):
        for b in batches:
            if len(b):
                yield pd.DataFrame({"point": list(project(b["vec"]))})

    # at most `sample` points of `dims` numbers come to the driver
    some = rows.orderBy(F.xxhash64(F.col("ids")[0])).limit(sample).select("vec").mapInPandas(flat, "point array<double>").toPandas()["point"] if levels else []
    points = np.array(list(some), dtype=float).reshape(len(some), dims)
    boxes = [(np.full(dims, -inf), np.full(dims, inf), np.arange(len(points)))]
    splits: list[tuple[int, float]] = []  # a heap: node i has children 2i + 1 and 2i + 2
    for _ in range(levels):
        halves = []
        for lo, hi, ids in boxes:
            axis = int(np.argmax(np.ptp(points[ids], axis=0))) if len(ids) > 1 else 0
            cut = float(np.median(points[ids, axis])) if len(ids) else 0.0
            splits.append((axis, cut))
            left_hi, right_lo = hi.copy(), lo.copy()
            left_hi[axis], right_lo[axis] = min(cut, hi[axis]), max(cut, lo[axis])
            halves += [(lo, left_hi, ids[points[ids, axis] < cut]), (right_lo, hi, ids[points[ids, axis] >= cut])]
        boxes = halves
    low, high = np.stack([b[0] for b in boxes]), np.stack([b[1] for b in boxes])

    def cell(p: np.ndarray) -> np.ndarray:
        node = np.zeros(len(p), dtype=np.int64)
        for _ in range(levels):
            axis, cut = np.array([splits[i][0] for i in node], dtype=int), np.array([splits[i][1] for i in node])
            node = 2 * node + 1 + (p[np.arange(len(p)), axis] >= cut)
        return node - (2**levels - 1)

    def placed(batches):
        for b in batches:
            if len(b):
                p = project(b["vec"])
                yield b.assign(point=list(p), cell=cell(p))

    indexed = common.stored(rows.mapInPandas(placed, "ids array<long>, vec array<double>, asks array<long>, point array<double>, cell long"), "index")
    asking = indexed.where(F.size("asks") > 0).select(F.col("ids")[0].alias("query"), "vec", "point", "cell")
    # of each of the at most `most_cells` cells: in how many chunks its rows lie
    chunks = common.stored(indexed.groupBy("cell").agg(F.ceil(F.count("*") / (4 * cell_rows)).cast("int").alias("chunks")), "chunks")
    chunked = indexed.join(F.broadcast(chunks), "cell").select("ids", F.col("vec").alias("v"), F.col("point").alias("p"), "cell", F.pmod(F.xxhash64(F.col("ids")[0]), F.col("chunks")).cast("int").alias("chunk"))

    def meet(rows_: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows_) and len(asked):
            v = np.array(rows_["v"].tolist(), dtype=float)
            tree = KdTree(np.array(rows_["p"].tolist(), dtype=float))
            norms, ids = lengths(v), rows_["ids"].to_list()
            names = np.array([i[0] for i in ids], dtype=np.int64)
            for query, vec, point, known in zip(asked["query"], asked["vec"], asked["point"], asked["known"], strict=True):
                at, score = search(v, norms, names, tree, np.array(vec, dtype=float), np.array(point, dtype=float), k + 1, sure, known)
                out += [(query, list(ids[i]), float(s)) for i, s in zip(at, score, strict=True)]
        return pd.DataFrame(out, columns=["query", "ids", "score"])

    def ask(q: DataFrame) -> DataFrame:
        lots = common.stored(q.groupBy("cell").agg(F.ceil(F.count("*") / LOT).cast("int").alias("lots")), "lots")
        here = chunked.join(F.broadcast(lots), "cell").select("ids", "v", "p", "cell", "chunk", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)).alias("lot"))
        sent = q.join(F.broadcast(lots), "cell").join(F.broadcast(chunks), "cell").withColumn("lot", F.pmod(F.xxhash64("query"), F.col("lots")).cast("int"))
        sent = sent.select("query", "vec", "point", "known", "cell", "lot", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
        keys = ["cell", "chunk", "lot"]
        return here.groupBy(*keys).cogroup(common.stored(sent, "asked").groupBy(*keys)).applyInPandas(meet, "query long, ids array<long>, score double")

    home = common.stored(ask(asking.withColumn("known", F.lit(float("inf")))), "home")
    # the (k + 1)-th best at home bounds what other cells have to offer
    reach = home.groupBy("query").agg(F.sort_array(F.collect_list("score"), asc=False).alias("s")).select("query", F.when(F.size("s") > k, F.greatest(2 - 2 * F.get("s", F.lit(k)), F.lit(0.0))).otherwise(F.lit(float("inf"))).alias("known"))

    def onward(batches):
        for b in batches:
            if len(b):
                p = np.array(b["point"].tolist(), dtype=float)
                for i in range(len(b)):
                    gap = np.maximum(np.maximum(low - p[i], p[i] - high), 0)
                    far, known = (gap * gap).sum(axis=1), b["known"].iloc[i]
                    go = np.ones(len(low), dtype=bool) if known == inf else chi_square_below(far / max(known, 1e-12), dims) < sure
                    go[b["cell"].iloc[i]] = False
                    if not (to := np.flatnonzero(go)).size:
                        continue
                    yield pd.DataFrame({"query": b["query"].iloc[i], "vec": [b["vec"].iloc[i]] * len(to), "point": [b["point"].iloc[i]] * len(to), "cell": to, "known": known})

    away = ask(common.stored(asking.join(reach, "query", "left").select("query", "vec", "point", "cell", F.coalesce("known", F.lit(float("inf"))).alias("known")).mapInPandas(onward, "query long, vec array<double>, point array<double>, cell long, known double"), "sent"))
    best = Window.partitionBy("query").orderBy(F.desc("score"), F.col("ids")[0])
    return home.unionByName(away).withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1).drop("n")


def nearest(vectors: DataFrame, query: Column, k: int = 5, dims: int = 8, sure: float = 0.999, cell_rows: int = 16_384, most_cells: int = 16_384, sample: int = 131_072, seed: int = 11) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest other rows by cosine, ties to the smaller vec_id.

    vectors has vec_id and embedding; query is a condition on vec_id. The cells of a kd-tree over the projections of a bounded
    sample (`sample` rows) hold every row. A query is answered in its own cell first; then in the cells that a nearer row could
    lie in, by the chi-square test; within a cell, by the cell's own kd-tree. Equal vectors are indexed once, with their
    k + 1 smallest ids (more can't be among k nearest) and all their queries.

    Vectors that are null, empty, zero, or hold null or non-finite components take no part; vectors of different lengths
    don't meet; rows without vec_id take no part; a repeated vec_id with equal vectors counts once. Fewer than k others:
    all of them. No vectors: no rows.
    """
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("vec")).where(F.col("vec_id").isNotNull() & _valid(F.col("vec"))).dropDuplicates(["vec_id", "vec"])
    order = Window.partitionBy("vec").orderBy("vec_id")
    first = rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1).groupBy("vec").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    # a vector's queries are kept in lots, so that no row grows with the number of copies
    asking = rows.where(query).groupBy("vec", F.pmod(F.xxhash64("vec_id"), F.lit(64)).alias("lot")).agg(F.collect_list("vec_id").alias("asks"))
    kept = common.stored(first.withColumn("dim", F.size("vec")), "vectors")
    sizes = {r["dim"]: r["n"] for r in kept.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    lots = common.stored(kept.join(asking.select("vec", "lot", "asks"), "vec", "left").select("dim", "ids", "vec", "asks"), "lots")
    met = []
    for dim, total in sorted(sizes.items()):
        own = lots.where(F.col("dim") == dim)
        flags = own.groupBy("ids").agg(F.first("vec").alias("vec"), F.max(F.size(F.coalesce("asks", F.array().cast("array<long>")))).alias("some"))
        one = flags.select("ids", "vec", F.when(F.col("some") > 0, F.slice("ids", 1, 1)).otherwise(F.array().cast("array<long>")).alias("asks"))
        found = _of_one_size(one, dim, total, k, dims, sure, cell_rows, most_cells, sample, seed)
        asked = own.where("asks IS NOT NULL").select(F.col("ids")[0].alias("query"), F.explode("asks").alias("query_id"))
        met.append(asked.join(found, "query").select("query_id", F.explode("ids").alias("vec_id"), "score").where("vec_id <> query_id"))
    if not met:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return reduce(DataFrame.unionByName, met).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def op1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each query's 5 nearest by cosine, the queries being the rows whose vec_id is divisible by 50.

    Rows without vec_id, and vectors that are null, empty, zero or hold null or non-finite components, take no part; equal vectors
    have equal scores and come in the order of vec_id; an empty table gives no rows. Other columns are not read.
    """
    return nearest(common.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
