"""Exact nearest neighbours by cells around pivots, with the triangle inequality deciding which cells must meet."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.operators import graph

#: At most so many pivots; rows of a block, which meets SLICE times as many in a task; a margin for rounding.
PIVOTS, BLOCK, SLICE, SLACK = 512, 8192, 4, 1e-9
#: Cells ask in lots that send, by the bounds, at most so many times all vectors, or so many vectors.
LOT_TIMES, LOT_ROWS = 4, 100_000


def _between(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """All distances, by differences and some rows at a time: exact for near rows, and of bounded memory."""
    out, rows = np.empty((len(x), len(y))), max(1, 4_000_000 // max(1, y.size))
    for at in range(0, len(x), rows):
        out[at : at + rows] = np.sqrt(((x[at : at + rows, None, :] - y[None, :, :]) ** 2).sum(axis=2))
    return out


def closest(x: np.ndarray, y: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in x and y and their distances, as _between gives them: of each row of x the k nearest rows of y, and those as near as the last.

    A product of matrices, with a margin for its rounding, leaves few pairs whose distances are summed.
    """
    k, out = min(k, len(y)), []
    with np.errstate(over="ignore"):
        xx, yy = (x * x).sum(axis=1), (y * y).sum(axis=1)
    sure = bool(np.isfinite(4 * (xx.max() + yy.max())))
    slack = 16 * (x.shape[1] + 8) * np.finfo(float).eps * (xx + yy.max()) if sure else xx
    some = max(k, -(-len(y) // 4))  # the bar comes from these
    step = max(1, 2_000_000 // len(y))
    for at in range(0, len(x), step):
        part = x[at : at + step]
        if sure:
            near = part @ y.T
            near *= -2
            near += yy
            near += xx[at : at + step, None]
            bar = np.partition(near[:, :some], k - 1, axis=1)[:, k - 1] + slack[at : at + step]
            a, b = np.nonzero(near <= bar[:, None])
            d = np.concatenate([np.sqrt(((part[a[i : i + 65536]] - y[b[i : i + 65536]]) ** 2).sum(axis=1)) for i in range(0, len(a), 65536)])
        else:
            d = _between(part, y)
            a, b = np.divmod(np.arange(d.size), len(y))
            d = d.ravel()
        order = np.lexsort((d, a))
        a, b, d = a[order], b[order], d[order]
        first = np.searchsorted(a, np.arange(len(part)))
        keep = d <= d[first + k - 1][a]
        out.append((a[keep] + at, b[keep], d[keep]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def asking(between: np.ndarray, sizes: np.ndarray, most: int) -> np.ndarray:
    """For each cell the group that it asks in: cells that follow each other on a way from one to the nearest one left, of at most `most` rows, if they are more than one."""
    group, left = np.zeros(len(sizes), dtype=int), np.ones(len(sizes), dtype=bool)
    at = rows = now = 0
    for _ in range(len(sizes)):
        left[at] = False
        if rows and rows + sizes[at] > most:
            now, rows = now + 1, 0
        group[at] = now
        rows += sizes[at]
        at = int(np.where(left, between[at], np.inf).argmin())
    return group


def _celled(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """vectors (v, id) with cell, the nearest pivot, and far, the distance to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            cell, far = np.zeros(b.num_rows, dtype=np.int32), np.zeros(b.num_rows)
            for at in range(0, b.num_rows, 256):
                d = _between(x[at : at + 256], pivots)
                cell[at : at + 256], far[at : at + 256] = d.argmin(axis=1), d.min(axis=1)
            yield b.append_column("cell", pa.array(cell)).append_column("far", pa.array(far))

    return vectors.mapInArrow(run, "v array<double>, id long, cell int, far double")


def bounds(between: np.ndarray, radius: np.ndarray, least: list[list[float]], k: int) -> np.ndarray:
    """For each cell a distance within which each of its rows has k others: over the k + 1 rows nearest to each pivot, by the way around both pivots."""
    out = np.full(len(radius), np.inf)
    for i in range(len(radius)):
        reach = np.sort(np.concatenate([radius[i] + between[i, j] + np.array(x) for j, x in enumerate(least) if x]))
        if len(reach) > k:
            out[i] = reach[k]  # one of them may be the row itself
    return out


def lots(copies: list[float], parts: list[int], most: float) -> list[list[tuple[int, int, int]]]:
    """Runs of (cell, first part, part after the last) that together cost at most `most`, where each part of cell i costs copies[i], at most `most`."""
    out, room = [], 0.0
    for i, (c, n) in enumerate(zip(copies, parts, strict=True)):
        at = 0
        while c and at < n:
            if not out or room < c:
                out, room = [*out, []], most
            end = min(n, at + max(1, int(room // c)))
            out[-1].append((i, at, end))
            room -= c * (end - at)
            at = end
    return out


def nearest(df: DataFrame, key: str, vector: str, k: int, pivots: int | None = None) -> tuple[DataFrame, int]:
    """key, n (a neighbour's key) and d, the k nearest other rows of each row by Euclidean distance, ties by key; and how many distances at most were computed.

    Equal vectors are one, with their k + 1 smallest keys, so that a vector of a third of the rows costs as much as any. Vectors
    lie in cells around a bounded sample of pivots; the driver has the pivots, and of each cell its size, its
    radius and the k + 1 smallest distances to its pivot. From these a cell knows how far its rows' neighbours can be, and
    a vector is only sent to cells that may need it. Cells meet in blocks of bounded size, which ask in lots, one after the other, so that
    the disk holds the copies of one lot and not of all. Null vectors, and those with null or
    non-finite components, have no neighbours and are none.
    """
    kind = dict(df.dtypes)[key]
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = graph.cut(df.select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v")).where(F.col("v").isNotNull() & finite))
    lead = Window.partitionBy("v").orderBy("k")
    few = rows.withColumn("r", F.row_number().over(lead)).where(F.col("r") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("k")).alias("keys"))
    vectors = graph.cut(few.withColumn("id", F.monotonically_increasing_id()))  # written, so that ids stay
    n = vectors.count()
    if not n:
        return rows.select(F.col("k").alias(key), F.col("k").alias("n"), F.lit(0.0).alias("d")).limit(0), 0
    some = vectors.select("v").orderBy(F.xxhash64("v"), "v").limit(pivots or min(PIVOTS, n // 1024 + 1))
    at = np.array([r["v"] for r in some.collect()])
    celled = graph.cut(_celled(vectors.select("v", "id"), at))
    near = celled.withColumn("r", F.row_number().over(Window.partitionBy("cell").orderBy("far", "id"))).where(F.col("r") <= k + 1).groupBy("cell").agg(F.collect_list("far").alias("least"))
    stats = {r["cell"]: r for r in celled.groupBy("cell").agg(F.max("far").alias("radius"), F.count("*").alias("n")).join(near, "cell").collect()}
    radius = np.array([stats[i]["radius"] if i in stats else 0.0 for i in range(len(at))])
    sizes = np.array([stats[i]["n"] if i in stats else 0 for i in range(len(at))])
    between = _between(at, at)
    reach = bounds(between, radius, [stats[i]["least"] if i in stats else [] for i in range(len(at))], k)
    limit = between - radius[:, None] - reach[:, None] - SLACK * (1 + between)  # of cell i in cell j: rows nearer to j's pivot can't be near
    meet = (sizes[:, None] > 0) & (sizes > 0) & (limit <= radius)
    # where many cells meet, cells ask together, so that fewer copies are sent
    together = asking(between, sizes, BLOCK) if (meet * sizes).sum() > max(LOT_TIMES * n, LOT_ROWS) else np.arange(len(at))
    groups = together.max() + 1
    least = np.array([np.where(meet[together == g], limit[together == g], np.inf).min(axis=0) for g in range(groups)])
    pairs = [(g, j, float(least[g, j])) for g in range(groups) for j in range(len(at)) if least[g, j] < np.inf]
    blocks = np.maximum(1, -(-np.bincount(together, sizes, groups).astype(int) // BLOCK))
    copies = np.where(least < np.inf, sizes, 0).sum(axis=1).astype(float)
    slices = np.maximum(1, -(-copies.astype(int) // (SLICE * BLOCK)))
    count = F.broadcast(df.sparkSession.createDataFrame([(i, int(g), int(blocks[g])) for i, g in enumerate(together)], "cell int, asks int, parts int"))
    block = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    placed = celled.join(count, "cell").withColumn("part", block).select("asks", "part", "id", "v")

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"id": pd.Series([], dtype="int64"), "o": pd.Series([], dtype="int64"), "d": pd.Series([], dtype=float)})
        a, b, d = closest(np.array(left["v1"].tolist()), np.array(right["v"].tolist()), k + 1)  # all at the bar go on, as keys decide
        return pd.DataFrame({"id": left["id1"].to_numpy()[a], "o": right["id"].to_numpy()[b], "d": d})

    group = ["asks", "part", "slice"]
    ranked, compared = None, 0
    for lot in lots(copies.tolist(), blocks.tolist(), max(LOT_TIMES * n, LOT_ROWS)):
        met = df.sparkSession.createDataFrame([p for p in pairs if lot[0][0] <= p[0] <= lot[-1][0]], "asks int, cell int, least double")  # at most PIVOTS squared rows
        turn = F.broadcast(df.sparkSession.createDataFrame([(g, lo, hi, int(slices[g])) for g, lo, hi in lot], "asks int, lo int, hi int, slices int"))
        own = placed.join(turn, "asks").where((F.col("part") >= F.col("lo")) & (F.col("part") < F.col("hi"))).drop("lo", "hi", "slices")
        sent = celled.join(F.broadcast(met), "cell").where(F.col("far") >= F.col("least"))
        sent = sent.join(turn, "asks").withColumn("slice", F.pmod(F.xxhash64("id", F.lit(1)), F.col("slices")).cast("int")).withColumn("part", F.explode(F.sequence(F.col("lo"), F.col("hi") - 1)))
        offered = graph.cut(sent.select("asks", "part", "slice", "id", "v"))
        meets = offered.select("asks", "part", "slice").distinct()
        asked = own.join(meets, ["asks", "part"]).select(*(F.col(c).alias(f"{c}1") for c in ("asks", "part", "slice", "id", "v")))
        found = asked.groupBy(*(f"{c}1" for c in group)).cogroup(offered.groupBy(*group)).applyInPandas(compare, "id long, o long, d double")
        # of each vector the k + 1 nearest vectors, and those as near as the last; each brings its smallest keys
        best = graph.cut(found.withColumn("r", F.rank().over(Window.partitionBy("id").orderBy("d"))).where(F.col("r") <= k + 1))
        compared += offered.groupBy("asks", "part").agg(F.count("*").alias("c")).join(own.groupBy("asks", "part").agg(F.count("*").alias("q")), ["asks", "part"]).agg(F.sum(F.col("c") * F.col("q"))).first()[0] or 0
        ranked = best if ranked is None else ranked.unionByName(best)
        del found, asked, meets
        graph.release(offered)
    keyed = ranked.join(vectors.select(F.col("id").alias("o"), F.explode("keys").alias("n")), "o")
    lists = keyed.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy("d", "n"))).where(F.col("r") <= k + 1).select("id", "n", "d")
    asks = rows.join(vectors.select("v", "id"), "v").select("k", "id").join(lists, "id").where("k <> n")
    best = asks.withColumn("r", F.row_number().over(Window.partitionBy("k").orderBy("d", "n"))).where(F.col("r") <= k)
    return best.select(F.col("k").cast(kind).alias(key), F.col("n").cast(kind).alias("n"), "d"), int(compared)
