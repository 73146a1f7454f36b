"""Shortest paths of large graphs: path counts level by level for many sources at once, and distances by sketches that spread along edges.

Everything per node stays in DataFrames; only counts come to the driver. Graphs are directed and unweighted; loops and repeated edges
change nothing.
"""

import math
import tempfile
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.operators import graph

#: Edges that a task of the sketches holds in memory, beyond which they lie in an unnamed file, and edges that a task joins at once.
EDGES, LOT = 1 << 23, 1 << 22
#: Bytes of registers that a task grows at once; tasks that a component is dealt to, at most; nodes of a component that has tasks of its own.
STATE, PARTS, OWN = 1 << 26, 16, 4096
#: Nodes that a node's sketch tells one by one before it estimates them.
FEW = 384
#: Nodes whose components are broadcast.
SMALL = 1 << 20


def _levels(steps: DataFrame, sources: DataFrame) -> list[DataFrame]:
    """For each depth (source, node, paths): the nodes that are so far from a source, and how many shortest paths lead there."""
    seen = front = graph.cut(sources.select(F.col("node").alias("source"), "node", F.lit(1.0).alias("paths")))
    out = [front]
    while True:
        ways = front.join(steps, front["node"] == steps["src"]).groupBy("source", F.col("dst").alias("to")).agg(F.sum("paths").alias("paths"))
        new = ways.select("source", F.col("to").alias("node"), "paths").join(seen.select("source", "node"), ["source", "node"], "left_anti")
        front = graph.cut(new)
        if front.isEmpty():
            return out
        out.append(front)
        seen = reduce(DataFrame.unionByName, out)


def dependencies(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """source, node, part: the sum over all targets of the shares of shortest paths from the source that lead through the node (Brandes), backward over the levels."""
    steps = graph.cut(edges.where("src <> dst").select("src", "dst").distinct())
    levels = _levels(steps, sources)
    below, done = None, []
    for level in levels[:0:-1]:  # the sources themselves have none
        if below is None:
            here = level.withColumn("part", F.lit(0.0))
        else:
            later = below.select("source", F.col("node").alias("dst"), ((1 + F.col("part")) / F.col("paths")).alias("share"))
            back = later.join(steps, "dst").groupBy("source", F.col("src").alias("node")).agg(F.sum("share").alias("share"))
            here = level.join(back, ["source", "node"], "left").select("source", "node", "paths", (F.col("paths") * F.coalesce("share", F.lit(0.0))).alias("part"))
        below = graph.cut(here)
        done.append(below.select("source", "node", "part"))
    none = levels[0].select("source", "node", F.lit(0.0).alias("part")).limit(0)
    return reduce(DataFrame.unionByName, done, none)


def betweenness(edges: DataFrame, sources: DataFrame | None = None, normalized: bool = True, batch: int = 256) -> DataFrame:
    """node, betweenness and its error. Without sources all nodes are, which is exact: the error is 0.

    With sources (node), a random sample of the nodes, it is the estimate n / k times what the k sources give, and error is
    its standard error, from how the sources differ. Sources go `batch` at a time, so that what a level holds
    is bounded by batch times the nodes; the work is sources times edges in any case.
    """
    every = graph.cut(graph.nodes_of(edges))
    n = every.count()
    asked = graph.cut((every if sources is None else sources.select("node").distinct().join(every, "node", "left_semi")).withColumn("lot", F.xxhash64("node")))
    k = asked.count()
    lots = max(1, -(-k // batch))
    sums = []
    for lot in range(lots if k else 0):
        parts = dependencies(edges, asked.where(F.pmod("lot", F.lit(lots)) == lot).select("node"))
        sums.append(graph.cut(parts.groupBy("node").agg(F.sum("part").alias("s"), F.sum(F.col("part") * F.col("part")).alias("q"))))
    none = every.select("node", F.lit(0.0).alias("s"), F.lit(0.0).alias("q")).limit(0)
    total = reduce(DataFrame.unionByName, sums, none).groupBy("node").agg(F.sum("s").alias("s"), F.sum("q").alias("q"))
    s, q = (F.coalesce(c, F.lit(0.0)) for c in ("s", "q"))
    scale = 1 / ((n - 1) * (n - 2)) if normalized and n > 2 else 1.0
    spread = F.sqrt(F.greatest(q - s * s / k, F.lit(0.0)) / (k - 1)) if k > 1 else F.lit(0.0)
    error = n * spread / k**0.5 * max(0.0, 1 - k / n) ** 0.5 if k else F.lit(0.0)  # without repeats from n nodes
    return every.join(total, "node", "left").select("node", (s * (n / max(k, 1)) * scale).alias("betweenness"), (error * scale).alias("error"))


def _joined(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges, sorted, and the place of the smallest node of each one's component: roots hang on smaller ones, and edges shrink to roots."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    low, a, b = np.arange(len(nodes)), at[: len(a)], at[len(a) :]
    while True:
        a, b = low[a], low[b]
        apart = a != b
        if not apart.any():
            return nodes, low
        a, b = a[apart], b[apart]
        np.minimum.at(low, np.maximum(a, b), np.minimum(a, b))
        while (lower := low[low] != low).any():
            low[lower] = low[low[lower]]


def _labels(steps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """node and component of edges (src, dst) of longs, and the cut table behind them. Each task leaves a star for each component of its edges, until one task has them all; what doesn't shrink goes to graph.components."""
    most = LOT

    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        shrink = lambda: (lambda nodes, low: (nodes, nodes[low]))(*_joined(*(np.concatenate(x) for x in zip(*held, strict=True))))
        for batch in batches:
            held.append(tuple(batch.column(i).to_numpy() for i in range(2)))
            rows += batch.num_rows
            if rows > 2 * most:
                held = [shrink()]
                rows = len(held[0][0])
                if rows > most:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], ["src", "dst"])
                    held, rows = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in shrink()], ["src", "dst"])

    now, size = steps, steps.count()
    while True:
        parts = max(1, -(-size // most))
        new = graph.cut(now.coalesce(parts).mapInArrow(stars, "src long, dst long"))
        if now is not steps:
            graph.release(now)
        now, before, size = new, size, new.count()
        if parts == 1 and size <= most:
            return now.select(F.col("src").alias("node"), F.col("dst").alias("component")), now
        if size > 0.7 * before:
            return graph.components(now), now


class _Edges:
    """Edges of longs that come sorted by dst, as places of nodes: those into node i are at[start[i] : start[i + 1]]. Many of them lie in unnamed files."""

    def __init__(self, most: int):
        self.most, self.rows, self.src, self.dst, self.file = most, 0, [], [], None

    def add(self, src: np.ndarray, dst: np.ndarray) -> None:
        first = np.flatnonzero(np.diff(dst, prepend=dst[0] - 1))
        self.dst.append((dst[first], np.diff(first, append=len(dst))))
        self.src.append(src)
        self.rows += len(src)
        if sum(map(len, self.src)) > self.most:
            self.file = self.file or tempfile.TemporaryFile()
            for x in self.src:
                x.tofile(self.file)
            self.src = []

    def _chunks(self) -> Iterator[np.ndarray]:
        if self.file:
            self.file.flush()
            self.file.seek(0)
            while len(x := np.fromfile(self.file, dtype=np.int64, count=1 << 20)):
                yield x
        yield from self.src

    def done(self) -> None:
        self.nodes = np.unique(np.concatenate([d for d, _ in self.dst]))
        for x in self._chunks():
            self.nodes = np.union1d(self.nodes, x)
        degree = np.zeros(len(self.nodes), dtype=np.int64)
        for d, n in self.dst:
            degree[np.searchsorted(self.nodes, d)] += n  # a node is there once in each of them
        self.start = np.concatenate([[0], np.cumsum(degree)])
        self.at = np.memmap(tempfile.TemporaryFile(), dtype=np.int32, mode="w+", shape=self.rows) if self.file else np.empty(self.rows, dtype=np.int32)
        i = 0
        for x in self._chunks():
            self.at[i : i + len(x)] = np.searchsorted(self.nodes, x)
            i += len(x)
        self.src, self.dst = [], []
        if self.file:
            self.file.close()


def _runs(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[i], start[i] + 1, ... of count[i] places each, one after the other."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + count, count)


def _grown(old: np.ndarray, start: np.ndarray, degree: np.ndarray, at: np.ndarray, rows: np.ndarray, top: np.ndarray, part: np.ndarray) -> np.ndarray:
    """The registers of rows after a round: the largest of their own and those of the nodes at[start : start + degree].

    Rows go in blocks that fit a processor's cache, of like degrees; edge after edge is taken in, and rows that have all that their component has, top, stop.
    """
    new = old.copy()
    rows = rows[np.argsort(-degree[rows], kind="stable")]
    width = old.shape[1]
    block = max(1, (1 << 19) // width)
    for b in range(0, len(rows), block):
        here = rows[b : b + block]
        have, taken = old[here], 0
        while len(here):
            more = np.count_nonzero(degree[here] > taken)  # the first ones
            new[here[more:]] = have[more:]
            here, have = here[:more], have[:more]
            if more and taken in (1, 3, 8, 20, 50):
                short = (have != top[part[here]]).any(axis=1)
                new[here[~short]] = have[~short]
                here, have = here[short], have[short]
            if len(here) * 8 < block or taken >= 64:
                break
            np.maximum(have, old[at[start[here] + taken]], out=have)
            taken += 1
        for i, row in zip(here, have, strict=True):  # few rows, or of many edges
            full, lo, hi, step = top[part[i]], start[i] + taken, start[i] + degree[i], max(1, min(8, block))
            while lo < hi:
                np.maximum(row, old[at[lo : min(hi, lo + step)]].max(axis=0), out=row)
                lo, step = lo + step, block
                if (row == full).all():
                    break
            new[i] = row
    return new


def _rounds(e: _Edges, lo: int, hi: int, precision: int, most_rounds: int, least: int) -> Iterator[pa.RecordBatch]:
    """What registers lo to hi tell of each round: node, t, many (whether more nodes reach it than are told one by one), and by how much nodes, registers at zero and the sum of 2^-register of the others change."""
    n, width = len(e.nodes), hi - lo
    few = max(8, least * width >> precision)
    bits = e.nodes.view(np.uint64)
    place = (bits >> np.uint64(64 - precision)).astype(np.int64) - lo
    tail = bits | np.uint64(1 << (64 - precision))
    rank = np.frexp((tail & (~tail + np.uint64(1))).astype(float))[1].astype(np.uint8)
    mine = (place >= 0) & (place < width)
    half = 0.5 ** np.arange(256, dtype=np.float64)
    half[0] = 0.0
    own = np.flatnonzero(mine)
    now = np.zeros((n, width), dtype=np.uint8)
    now[own, place[own]] = rank[own]
    part = np.zeros(n, dtype=np.int64)
    if not e.file:
        part = np.unique(_joined(np.repeat(np.arange(n), np.diff(e.start)), e.at)[1], return_inverse=True)[1]
    top = np.zeros((part.max() + 1, width), dtype=np.uint8)
    np.maximum.at(top, (part[own], place[own]), rank[own])
    zeros, sums, count, many = np.full(n, width), np.zeros(n), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=bool)
    step = max(1, (1 << 17) // width)

    def summed(x: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z, s = np.empty(len(rows), dtype=np.int64), np.empty(len(rows))
        for i in range(0, len(rows), step):
            y = x[rows[i : i + step]]
            z[i : i + step], s[i : i + step] = width - np.count_nonzero(y, axis=1), half[y].sum(axis=1)
        return z, s

    def same(x: np.ndarray, y: np.ndarray, place: np.ndarray) -> np.ndarray:
        out = np.empty(n, dtype=bool)
        for i in range(0, n, step):
            out[i : i + step] = (x[i : i + step] == y[place[i : i + step]]).all(axis=1)
        return out

    most, every = summed(top, np.arange(len(top))), np.arange(n)

    def told(t: int, rows: np.ndarray, counts: np.ndarray, over: np.ndarray, full: np.ndarray) -> pa.RecordBatch:
        z, s = (x[part[rows]] for x in most)
        less = ~full[rows]
        z[less], s[less] = summed(now, rows[less])
        out = [e.nodes[rows], np.full(len(rows), t, dtype=np.int32), over[rows], counts[rows] - count[rows], z - zeros[rows], s - sums[rows]]
        zeros[rows], sums[rows] = z, s
        return pa.RecordBatch.from_arrays([pa.array(x) for x in out], ["node", "t", "many", "n", "zeros", "sums"])

    full = same(now, top, part)
    yield told(0, own, mine.astype(np.int64), many, full)
    count += mine
    known = fresh = own * n + own  # (node, who reaches it) of nodes that few reach
    changed = mine.copy()
    degree = np.diff(e.start)
    for t in range(1, most_rounds + 1):
        # of the edges those from nodes that changed, some at a time; the other ones tell nothing new
        new, over, found = (now.copy() if t == 1 else now), many.copy(), []
        first = np.searchsorted(fresh, np.arange(n + 1) * n)
        freshes = np.diff(first)
        a = 0
        while a < n:
            b = max(a + 1, int(np.searchsorted(e.start, e.start[a] + EDGES, "right")) - 1)
            at, into = np.asarray(e.at[e.start[a] : e.start[b]]), np.repeat(np.arange(a, b), degree[a:b])
            over[into[many[at]]] = True
            if t == 1:  # every node has one other register to give
                give = mine[at]
                x, y, r = into[give], place[at[give]], rank[at[give]]
                np.maximum.at(new.reshape(-1), x * width + y, r)
                found.append(x * n + at[give])
            else:
                pairs = ~over[into] & (freshes[at] > 0)
                i, j = into[pairs], at[pairs]
                ends = np.cumsum(freshes[j])
                for c in range(0, int(ends[-1]) if len(ends) else 0, LOT):  # by lots of pairs
                    some = slice(np.searchsorted(ends, c, "right"), np.searchsorted(ends, c + LOT, "right"))
                    got = fresh[_runs(first[j[some]], freshes[j[some]])]
                    got = np.unique(np.repeat(i[some], freshes[j[some]]) * n + got % n)
                    spot = np.minimum(np.searchsorted(known, got), len(known) - 1)
                    found.append(got[known[spot] != got])
            a = b
        if t > 1:
            keep = changed[e.at] & np.repeat(~full, degree) if not e.file else None
            if keep is None or keep.all():
                new = _grown(now, e.start, degree, e.at, np.flatnonzero(~full & (degree > 0)), top, part)
            else:
                less = np.bincount(np.repeat(np.arange(n), degree)[keep], minlength=n)
                new = _grown(now, np.concatenate([[0], np.cumsum(less)]), less, e.at[keep], np.flatnonzero(less), top, part)
        fresh = np.concatenate(found) if found else known[:0]
        if t > 1:  # edges differ, pairs of nodes needn't
            fresh = np.unique(fresh)
        counts = count + np.bincount(fresh // n, minlength=n)
        over |= counts > few
        changed = ~same(new, now, every)
        rows = np.flatnonzero(changed | (counts > count) | (over & ~many))
        if not len(rows):
            return
        now, full = new, same(new, top, part)
        yield told(t, rows, counts, over, full)
        count, many = counts, over
        fresh = np.sort(fresh[~many[fresh // n]])
        known = np.union1d(known[~many[known // n]], fresh)


def _growing(precision: int, most_rounds: int, most: int, state: int, least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Grows the sketches of edges (bin, lo, hi, src, dst) that come sorted by dst; a partition has few bins, or few shares of their registers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {}
        for batch in batches:
            bins, lo, hi, src, dst = (batch.column(i).to_numpy() for i in range(5))
            for key in {*zip(bins.tolist(), lo.tolist(), hi.tolist(), strict=True)}:
                rows = (bins == key[0]) & (lo == key[1])
                held.setdefault(key, _Edges(most)).add(src[rows], dst[rows])
        for key in [*held]:
            (_, lo, hi), e = key, held.pop(key)
            e.done()
            for at in range(lo, hi, width := max(1, min(hi - lo, state // len(e.nodes)))):
                yield from _rounds(e, at, min(hi, at + width), precision, most_rounds, least)

    return run


def _estimate(zeros: Column, sums: Column, precision: int) -> Column:
    """How many nodes a sketch has seen, by its registers at zero and the sum of 2^-register of the others (Ertl's estimate, without tables and for every range)."""
    m = 1 << precision
    x = zeros / F.lit(float(m))
    empty = reduce(lambda a, k: a + F.pow(x, F.lit(float(2**k))) * float(2 ** (k - 1)), range(1, precision + 7), x)
    return F.round(F.lit(m * m / (2 * math.log(2))) / (empty * float(m) + sums)).cast("long")


def _spread(edges: DataFrame, precision: int, most_rounds: int) -> tuple[DataFrame, list[tuple[int, float]]]:
    """node, reached and total (about how many nodes reach it, itself included, and the sum of their distances), and about how many pairs lie within each distance.

    A node's sketch holds itself; in each round it takes in those of its predecessors, so that after t rounds it counts the nodes at most t steps away. Up to
    FEW nodes are told one by one; estimates of more err by about 1.04 / 2^(precision / 2). Components don't meet, nor do registers: a task has a large component
    or some small ones, with all registers or some, and goes through all rounds, so that no sketch travels. Nodes are told apart by 64-bit hashes.
    """
    plain = graph.cut(edges.select("src", "dst"))
    steps = graph.cut(plain.select(F.xxhash64("src").alias("src"), F.xxhash64("dst").alias("dst"), F.expr("src IS NULL OR dst IS NULL").alias("none")).where("src <> dst AND NOT none").select("src", "dst").distinct())
    nodes = graph.cut(graph.nodes_of(plain).where("node IS NOT NULL"))
    size = nodes.count()
    graph.release(plain)
    labels, behind = _labels(steps)
    sizes = labels.groupBy("component").agg(F.count("*").alias("n"))
    m, tiny = 1 << precision, F.col("n") <= OWN
    bins = max(1, size * m // STATE)
    tasks = F.when(tiny, 1).otherwise(F.least(F.lit(PARTS), F.lit(m), F.ceil(F.col("n") * m / STATE))).cast("int")
    dealt = graph.cut(labels.join(sizes, "component").select(F.col("node").alias("src"), F.when(tiny, F.pmod(F.xxhash64("component"), F.lit(bins))).otherwise(F.col("component")).alias("bin"), tasks.alias("tasks")))
    graph.release(behind)
    keys = dealt.select("bin", "tasks").distinct().agg(F.coalesce(F.sum("tasks"), F.lit(0))).first()[0]
    sent = steps.join(F.broadcast(dealt) if size <= SMALL else dealt, "src").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)))
    edge = lambda i: F.floor(F.lit(m) * i / F.col("tasks")).cast("int")
    sent = sent.select("bin", edge(F.col("i")).alias("lo"), edge(F.col("i") + 1).alias("hi"), "src", "dst")
    placed = sent.repartition(max(1, min(4 * keys, 20_000)), "bin", "lo").sortWithinPartitions("dst")  # by one number, which needs no comparisons
    told = graph.cut(placed.mapInArrow(_growing(precision, most_rounds, EDGES, STATE, FEW), "node long, t int, many boolean, n long, zeros long, sums double"))
    graph.release(steps, dealt)
    each = told.groupBy("node", "t").agg(F.max("many").alias("many"), *(F.sum(c).alias(c) for c in ("n", "zeros", "sums")))
    w = Window.partitionBy("node").orderBy("t")
    many, n, zeros, sums = F.max("many").over(w), F.sum("n").over(w), F.sum("zeros").over(w), F.sum("sums").over(w)
    counted = each.select("node", "t", many.alias("many"), n.alias("n"), (zeros + m).alias("zeros"), sums.alias("sums"))
    counted = counted.select("node", "t", F.max(F.when(F.col("many"), _estimate(F.col("zeros"), F.col("sums"), precision)).otherwise(F.col("n"))).over(w).alias("n"))
    more = graph.cut(counted.withColumn("more", F.col("n") - F.coalesce(F.lag("n").over(w), F.lit(0))).where("t > 0").select("node", "t", "more"))
    graph.release(told)
    pairs, total = [(0, float(size))], float(size)
    for r in more.groupBy("t").agg(F.sum("more").alias("more")).where("more > 0").orderBy("t").collect():
        pairs.extend((t, total) for t in range(pairs[-1][0] + 1, r["t"]))
        total += r["more"]
        pairs.append((r["t"], total))
    far = more.groupBy(F.col("node").alias("h")).agg(F.sum("more").alias("reached"), F.sum(F.col("t") * F.col("more")).alias("total"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    now = graph.cut(nodes.join(far, F.xxhash64("node") == F.col("h"), "left").select("node", (zero(F.col("reached")) + 1).alias("reached"), zero(F.col("total")).alias("total")))
    graph.release(nodes, more)
    return now, pairs


def closeness(edges: DataFrame, precision: int = 12, most_rounds: int = 1000) -> DataFrame:
    """node, closeness over incoming paths, scaled by the share of nodes that reach it, from sketches and without pairs."""
    now, _ = _spread(edges, precision, most_rounds)
    n = F.broadcast(now.agg(F.count("*").alias("n")))
    value = F.try_divide((F.col("reached") - 1) * (F.col("reached") - 1), F.col("total") * (F.col("n") - 1))
    return now.join(n).select("node", F.coalesce(value, F.lit(0.0)).alias("closeness"))


def neighbourhood(edges: DataFrame, precision: int = 12, most_rounds: int = 1000) -> DataFrame:
    """distance and pairs: about how many (ordered) pairs of nodes, each with itself included, lie within each distance. The last distance is the diameter, as far as sketches tell."""
    now, pairs = _spread(edges, precision, most_rounds)
    graph.release(now)
    return edges.sparkSession.createDataFrame(pairs, "distance int, pairs double")
