"""Graph operators over an edge table (src, dst, weight) and, where needed, a node table (node).

Iterative operators cut their lineage with a written table each few rounds; the frontier, ranks or labels stay distributed and only
counts or sums come to the driver.
"""

import atexit
import contextlib
import tempfile
import uuid
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


_written: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, which all executors share; only where none is set, as in tests, a temporary one is used."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or "file://" + tempfile.mkdtemp(prefix="brindle-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """df written as Parquet to the shared folder and read back: computed once, its size known to the planner, and nothing that a lost executor takes along."""
    if not _written:
        atexit.register(clean_up)
    path = f"{shared_folder(df.sparkSession)}/brindle-{uuid.uuid4().hex}"
    _written.append(path)
    spark, schema = df.sparkSession, df.schema
    df.write.parquet(path)
    back = spark.read.schema(schema).parquet(path)
    back._written = path
    return back


def release(*steps: DataFrame) -> None:
    """Deletes cut tables that nothing reads any more, and the shuffle files behind finished steps: loops hold one round, not all."""
    for step in steps:
        if step._written in _written:
            _written.remove(step._written)
            _delete(step.sparkSession, step._written)
    if steps:
        collect_garbage(steps[0].sparkSession)


def collect_garbage(spark: SparkSession) -> None:
    """Lets Spark's cleaner find the shuffles that nothing refers to, and delete their files."""
    spark.sparkContext._jvm.System.gc()


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def clean_up() -> None:
    """Deletes what was written; runs at exit, or when a caller has consumed the results."""
    spark = SparkSession.getActiveSession()
    while _written:
        path = _written.pop()
        if spark is not None:
            with contextlib.suppress(Exception):  # the JVM may be gone at exit
                _delete(spark, path)


def pinned(df: DataFrame) -> DataFrame:
    """df as a checkpoint in the shared folder, which keeps its partitions and their order."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def interaction_graph(posts: DataFrame, least: int = 1) -> DataFrame:
    """Edges from authors to those they reply to (by the parent post) and mention; loops left out; weight is the count, at least `least`."""
    replies = posts.join(posts.select(F.col("post_id").alias("parent_id"), F.col("author").alias("dst")), "parent_id").select(F.col("author").alias("src"), "dst")
    named = posts.select(F.col("author").alias("src"), F.explode("mentions").alias("dst"))
    both = replies.unionByName(named).where((F.coalesce("src", F.lit("")) != "") & (F.coalesce("dst", F.lit("")) != "") & (F.col("src") != F.col("dst")))
    return both.groupBy("src", "dst").agg(F.count("*").alias("weight")).where(F.col("weight") >= least)


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()


def both_ways(edges: DataFrame) -> DataFrame:
    """Each undirected pair once in either direction, without loops."""
    plain = edges.where("src <> dst").select("src", "dst")
    return plain.unionByName(plain.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def relations(edges: DataFrame, node, kind: str | None = None, direction: str = "both") -> DataFrame:
    typed = edges if kind is None else edges.where(F.col("type") == kind)
    out, into = F.col("src") == F.lit(node), F.col("dst") == F.lit(node)
    return typed.where({"out": out, "in": into, "both": out | into}[direction])


def neighbours(edges: DataFrame, node, kinds: list[str] | None = None, direction: str = "both") -> DataFrame:
    typed = edges if kinds is None else edges.where(F.col("type").isin(kinds))
    out = typed.where(F.col("src") == F.lit(node)).select(F.col("dst").alias("node"))
    into = typed.where(F.col("dst") == F.lit(node)).select(F.col("src").alias("node"))
    return {"out": lambda: out, "in": lambda: into, "both": lambda: out.unionByName(into)}[direction]().distinct()


def latest_relation(edges: DataFrame, arrival: str) -> DataFrame:
    """One edge for each (src, dst): the last that arrived, as a simple digraph keeps it."""
    return edges.withColumn("_n", F.row_number().over(Window.partitionBy("src", "dst").orderBy(F.desc(arrival)))).where("_n = 1").drop("_n")


def merged_relations(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One edge for each (src, type, dst); edges with an endpoint that isn't there are left out."""
    known = edges.join(nodes.select(F.col("node").alias("src")), "src", "left_semi").join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi")
    return known.dropDuplicates(["src", "type", "dst"])


def degrees(edges: DataFrame) -> DataFrame:
    out = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("out_degree"))
    into = edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("in_degree"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.join(into, "node", "full").select("node", zero("in_degree"), zero("out_degree"), (F.coalesce("in_degree", F.lit(0)) + F.coalesce("out_degree", F.lit(0))).alias("degree"))


def statistics(edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, directed density, and the share of edges whose reverse is there."""
    n = nodes_of(edges).agg(F.count("*").alias("nodes"))
    m = edges.agg(F.count("*").alias("edges"))
    back = edges.join(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")).distinct(), ["src", "dst"], "left_semi").agg(F.count("*").alias("mutual"))
    pairs = F.col("nodes") * (F.col("nodes") - 1)
    return n.crossJoin(m).crossJoin(back).select("nodes", "edges", F.coalesce(F.try_divide("edges", pairs), F.lit(0.0)).alias("density"), F.coalesce(F.try_divide("mutual", "edges"), F.lit(0.0)).alias("reciprocity"))  # single rows


def pagerank(edges: DataFrame, alpha: float = 0.85, rounds: int = 20, tolerance: float | None = None, cut_every: int = 5) -> DataFrame:
    """node, rank by power iteration over weights; what dangling nodes hold is spread evenly. Stops after `rounds`, or when the L1 change is below tolerance times the nodes."""
    nodes = cut(nodes_of(edges))
    n = nodes.count()
    if not n:
        return nodes.select("node", F.lit(0.0).alias("rank"))
    share = cut(edges.withColumn("share", F.col("weight") / F.sum("weight").over(Window.partitionBy("src"))).select("src", "dst", "share"))
    ranks = nodes.withColumn("rank", F.lit(1.0 / n))
    for i in range(rounds):
        moved = ranks.join(share, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        kept = moved.agg(F.coalesce(F.sum("got"), F.lit(0.0)).alias("kept"))
        new = nodes.join(moved, "node", "left").join(F.broadcast(kept)).select("node", ((1 - alpha) / n + alpha * (F.coalesce("got", F.lit(0.0)) + (1 - F.col("kept")) / n)).alias("rank"))
        if tolerance is not None or i % cut_every == cut_every - 1:
            new = cut(new)
        if tolerance is not None:
            change = new.join(ranks.withColumnRenamed("rank", "old"), "node").agg(F.sum(F.abs(F.col("rank") - F.col("old"))).alias("d")).first()["d"]
            if change < n * tolerance:
                return new
        ranks = new
    return ranks


def eigenvector(edges: DataFrame, rounds: int = 100, tolerance: float = 1e-6) -> DataFrame:
    """node, centrality over incoming edges, of unit length, by power iteration of A + I, which settles where A alone would swing."""
    nodes = cut(nodes_of(edges))
    n = max(nodes.count(), 1)
    x = nodes.withColumn("x", F.lit(n**-0.5))
    for _ in range(rounds):
        moved = x.join(edges.select("src", "dst"), F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node")).agg(F.sum("x").alias("got"))
        raw = x.join(moved, "node", "left").select("node", F.col("x").alias("old"), (F.col("x") + F.coalesce("got", F.lit(0.0))).alias("raw"))
        norm = raw.agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
        new = cut(raw.join(F.broadcast(norm)).select("node", (F.col("raw") / F.col("norm")).alias("x"), "old"))
        change = new.agg(F.sum(F.abs(F.col("x") - F.col("old"))).alias("d")).first()["d"]
        x = new.select("node", "x")
        if change is None or change < n * tolerance:
            break
    return x.withColumnRenamed("x", "centrality")


def levels(edges: DataFrame, source, most_depth: int | None = None, undirected: bool = False) -> DataFrame:
    """Breadth first: node, level and parent (the smallest node of the level before that leads to it) of all that source reaches."""
    steps = both_ways(edges) if undirected else edges.select("src", "dst").where("src <> dst").distinct()
    spark = edges.sparkSession
    kind = dict(edges.dtypes)["src"]
    seen = spark.range(1).select(F.lit(source).cast(kind).alias("node"), F.lit(0).alias("level"), F.lit(None).cast(kind).alias("parent"))
    front, depth = seen, 0
    while most_depth is None or depth < most_depth:
        depth += 1
        found = front.join(steps, F.col("node") == F.col("src")).groupBy("dst").agg(F.min("src").alias("parent")).select(F.col("dst").alias("node"), F.lit(depth).alias("level"), "parent")
        front = cut(found.join(seen.select("node"), "node", "left_anti"))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def shortest_path(edges: DataFrame, source, target) -> list:
    """One shortest directed path as a list of nodes, [] if there is none: as many rows as the path has nodes come to the driver."""
    found = cut(levels(edges, source))
    path, at = [], target
    while at is not None:
        row = found.where(F.col("node") == F.lit(at)).first()
        if row is None:
            return []
        path.append(at)
        at = row["parent"]
    return path[::-1]


def neighbourhood(edges: DataFrame, node, radius: int = 2, undirected: bool = False) -> DataFrame:
    """Edges among the nodes within so many steps of a node."""
    near = levels(edges, node, radius, undirected).select("node")
    return edges.join(near.withColumnRenamed("node", "src"), "src", "left_semi").join(near.withColumnRenamed("node", "dst"), "dst", "left_semi")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node and component (its smallest node), by alternating stars: each node hangs its larger neighbours, and then its smaller ones, on the smallest it knows.

    A hub's neighbours are reassigned by a join, never gathered; rounds grow about with the logarithm of the longest chain. A
    count and a check sum tell when nothing changes.
    """
    nodes = nodes_of(edges)
    star = cut(edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct())
    before = None
    for _ in range(most_rounds):
        both = star.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(star.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        moved = both.join(least, "u").where("v > u").select(F.col("v").alias("x"), "m").unionByName(least.select(F.col("u").alias("x"), "m")).where("x <> m").distinct()
        low = moved.groupBy("x").agg(F.min("m").alias("to"))
        star = cut(moved.join(low, "x").select("to", F.explode(F.array("m", "x")).alias("y")).where("y <> to").select(F.col("to").alias("a"), F.col("y").alias("b")).distinct())
        state = star.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("the components did not settle")
    return nodes.join(star.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def core_numbers(edges: DataFrame, most_rounds: int = 1000) -> DataFrame:
    """node and core number of the undirected graph without loops.

    Every node's number starts at its degree and becomes, round by round, the largest h such that h of its neighbours have at least
    h, until none changes: that is its core number. Neighbours are counted by their numbers first, so that a hub has as many rows
    as there are numbers around it. Once few numbers fall, only the nodes next to those are looked at.
    """
    plain = cut(edges.select("src", "dst"))
    nodes, steps = cut(nodes_of(plain)), cut(both_ways(plain))
    release(plain)
    near, size = steps, nodes.count()
    core = cut(steps.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("core")))
    for _ in range(most_rounds):
        around = near.join(core.select(F.col("node").alias("dst"), "core"), "dst").groupBy(F.col("src").alias("node"), "core").agg(F.count("*").alias("n"))
        above = around.withColumn("many", F.sum("n").over(Window.partitionBy("node").orderBy(F.desc("core")).rowsBetween(Window.unboundedPreceding, 0)))
        h = above.groupBy("node").agg(F.max(F.least("core", "many")).alias("h"))
        new = cut(core.join(h, "node", "left").select("node", F.least("core", "h").alias("core"), F.coalesce(F.col("h") < F.col("core"), F.lit(False)).alias("fell")))
        fallen = new.where("fell").count()
        release(core, *(() if near is steps else (near,)))
        core = new
        if not fallen:
            release(steps)
            return nodes.join(core.select("node", "core"), "node", "left").select("node", F.coalesce("core", F.lit(0)).alias("core"))
        near = steps
        if fallen * 16 < size:
            touched = steps.join(new.where("fell").select(F.col("node").alias("dst")), "dst", "left_semi").select("src").distinct()
            near = cut(steps.join(touched, "src", "left_semi"))
    raise RuntimeError("the core numbers did not settle")


def label_propagation(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """node, label: in each round all nodes at once take the commonest label of their neighbours, of equally common ones the smallest."""
    plain = cut(edges.select("src", "dst"))
    steps, labels = cut(both_ways(plain)), cut(nodes_of(plain).withColumn("label", F.col("node")))
    release(plain)
    for _ in range(rounds):
        counted = steps.join(labels.withColumnRenamed("node", "dst"), "dst").groupBy("src", "label").agg(F.count("*").alias("n"))
        best = counted.groupBy(F.col("src").alias("node")).agg(F.min_by("label", F.struct((-F.col("n")).alias("n"), "label")).alias("new"))
        before, labels = labels, cut(labels.join(best, "node", "left").select("node", F.coalesce("new", "label").alias("label")))
        release(before)
    release(steps)
    return labels


def communities(labels: DataFrame, edges: DataFrame, least: int = 3) -> DataFrame:
    """label, size and directed density of the communities of at least so many nodes."""
    sizes = labels.groupBy("label").agg(F.count("*").alias("size")).where(F.col("size") >= least)
    inner = edges.join(labels.select(F.col("node").alias("src"), "label"), "src").join(labels.select(F.col("node").alias("dst"), F.col("label").alias("other")), "dst").where("label = other").groupBy("label").agg(F.count("*").alias("edges"))
    return sizes.join(inner, "label", "left").select("label", "size", (F.coalesce("edges", F.lit(0)) / (F.col("size") * (F.col("size") - 1))).alias("density"))


def modularity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: the modularity of a labelling of the undirected graph."""
    steps = both_ways(edges).join(labels.select(F.col("node").alias("src"), F.col("label").alias("a")), "src").join(labels.select(F.col("node").alias("dst"), F.col("label").alias("b")), "dst")
    per = steps.groupBy("a").agg(F.count("*").alias("degree"), F.count_if(F.col("a") == F.col("b")).alias("inside"))
    sums = per.agg(F.sum("degree").alias("total"), F.sum("inside").alias("inside"), F.sum(F.col("degree").cast("double") * F.col("degree")).alias("squares"))
    return sums.select((F.col("inside") / F.col("total") - F.col("squares") / (F.col("total").cast("double") * F.col("total"))).alias("modularity"))


def clustering(edges: DataFrame) -> DataFrame:
    """node, triangles and local clustering coefficient of the undirected graph. Each triangle is found once, from its node of least degree, so that hubs don't pair all their neighbours."""
    steps = both_ways(edges)
    degree = steps.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("d"))
    ranked = steps.join(degree.select(F.col("node").alias("src"), F.col("d").alias("ds")), "src").join(degree.select(F.col("node").alias("dst"), F.col("d").alias("dd")), "dst")
    up = cut(ranked.where(F.struct(F.col("ds").alias("d"), F.col("src").alias("v")) < F.struct(F.col("dd").alias("d"), F.col("dst").alias("v"))).select("src", "dst"))
    wedges = up.select("src", F.col("dst").alias("a")).join(up.select("src", F.col("dst").alias("b")), "src").where("a < b")
    closed = wedges.join(up.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")), ["a", "b"])
    count = closed.select(F.explode(F.array("src", "a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("triangles"))
    t = F.coalesce("triangles", F.lit(0))
    return nodes_of(edges).join(degree, "node", "left").join(count, "node", "left").select("node", t.alias("triangles"), F.when(F.coalesce("d", F.lit(0)) < 2, 0.0).otherwise(2 * t / (F.col("d") * (F.col("d") - 1))).alias("clustering"))


def distances(edges: DataFrame, most_depth: int | None = None) -> DataFrame:
    """src, dst, distance of all reachable pairs: for small graphs, as the result grows with the square of the nodes."""
    steps = edges.select("src", "dst").where("src <> dst").distinct()
    seen = cut(nodes_of(edges).select(F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(0).alias("distance")))
    front, depth = seen, 0
    while most_depth is None or depth < most_depth:
        depth += 1
        step = front.select("src", F.col("dst").alias("via")).join(steps.withColumnRenamed("src", "via"), "via").select("src", "dst").distinct()
        front = cut(step.join(seen.select("src", "dst"), ["src", "dst"], "left_anti").withColumn("distance", F.lit(depth)))
        if front.isEmpty():
            return seen
        seen = seen.unionByName(front)
    return seen


def closeness(edges: DataFrame) -> DataFrame:
    """node, closeness over incoming paths, scaled by the share of nodes that reach it."""
    n = nodes_of(edges).agg(F.count("*").alias("n"))
    sums = distances(edges).groupBy(F.col("dst").alias("node")).agg(F.sum("distance").alias("total"), (F.count("*") - 1).alias("reached"))
    value = F.try_divide(F.col("reached") * F.col("reached"), F.col("total") * (F.col("n") - 1))
    return sums.join(F.broadcast(n)).select("node", F.coalesce(value, F.lit(0.0)).alias("closeness"))


def betweenness(edges: DataFrame, normalized: bool = True, sources: DataFrame | None = None, most_edges: int = 2_000_000) -> DataFrame:
    """node, betweenness of the directed, unweighted graph: the sources (a sample, if given) are dealt to tasks, each of which has the adjacency. Only for graphs of at most `most_edges` edges, counted first; a larger one is an error."""
    pairs = cut(edges.where("src <> dst").select("src", "dst").distinct())
    if (size := pairs.count()) > most_edges:
        raise ValueError(f"{size} edges are more than a task is to hold; give a part of the graph")
    table = pairs.groupBy("src").agg(F.collect_list("dst").alias("to"))
    adjacency = {r["src"]: r["to"] for r in table.toLocalIterator()}
    every = nodes_of(edges)

    def run(batches):
        total: dict = {}
        for b in batches:
            for s in b["node"]:
                order, paths, depth, before = [], {s: 1}, {s: 0}, {}
                line = [s]
                for v in line:
                    order.append(v)
                    for w in adjacency.get(v, ()):
                        if w not in depth:
                            depth[w] = depth[v] + 1
                            line.append(w)
                        if depth[w] == depth[v] + 1:
                            paths[w] = paths.get(w, 0) + paths[v]
                            before.setdefault(w, []).append(v)
                carried = dict.fromkeys(order, 0.0)
                for w in reversed(order):
                    for v in before.get(w, ()):
                        carried[v] += paths[v] / paths[w] * (1 + carried[w])
                    if w != s:
                        total[w] = total.get(w, 0.0) + carried[w]
        yield pd.DataFrame({"node": list(total), "part": list(total.values())}) if total else pd.DataFrame({"node": pd.Series(dtype=object), "part": pd.Series(dtype=float)})

    kind = dict(edges.dtypes)["src"]
    parts = (sources or every).select("node").mapInPandas(run, f"node {kind}, part double")
    summed = parts.groupBy("node").agg(F.sum("part").alias("b"))
    n = every.agg(F.count("*").alias("n"))
    scale = F.when(F.col("n") > 2, 1 / ((F.col("n") - 1) * (F.col("n") - 2)).cast("double")).otherwise(1.0) if normalized else F.lit(1.0)
    return every.join(summed, "node", "left").join(F.broadcast(n)).select("node", (F.coalesce("b", F.lit(0.0)) * scale).alias("betweenness"))


def assortativity(edges: DataFrame, values: DataFrame | None = None) -> DataFrame:
    """One row: the correlation over edges of a numeric attribute (node, value) of both ends; of out- and in-degree if none is given."""
    if values is None:
        d = degrees(edges)
        a, b = d.select(F.col("node").alias("src"), F.col("out_degree").cast("double").alias("a")), d.select(F.col("node").alias("dst"), F.col("in_degree").cast("double").alias("b"))
    else:
        a, b = values.select(F.col("node").alias("src"), F.col("value").cast("double").alias("a")), values.select(F.col("node").alias("dst"), F.col("value").cast("double").alias("b"))
    return edges.join(a, "src").join(b, "dst").agg(F.corr("a", "b").alias("assortativity"))


def mixing(edges: DataFrame, attributes: DataFrame) -> DataFrame:
    """One row: categorical assortativity from the mixing matrix of (node, value)."""
    m = edges.join(attributes.select(F.col("node").alias("src"), F.col("value").alias("a")), "src").join(attributes.select(F.col("node").alias("dst"), F.col("value").alias("b")), "dst").groupBy("a", "b").agg(F.count("*").alias("n"))
    total = m.agg(F.sum("n").alias("t"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    rows, cols = m.groupBy("a").agg(F.sum("n").alias("x")), m.groupBy(F.col("b").alias("a")).agg(F.sum("n").alias("y"))
    ab = rows.join(cols, "a").agg(F.coalesce(F.sum(F.col("x") * F.col("y")), F.lit(0)).alias("ab"))
    e = F.col("ab") / (F.col("t") * F.col("t"))
    return total.crossJoin(ab).select(F.try_divide(F.col("same") / F.col("t") - e, 1 - e).alias("assortativity"))  # single rows


def attribute_groups(edges: DataFrame, attributes: DataFrame, least: int = 2) -> DataFrame:
    """Per attribute value of at least two nodes: size, inner edges, edges that leave it, density and homophily."""
    sizes = attributes.groupBy("value").agg(F.count("*").alias("size")).where(F.col("size") >= least)
    tagged = edges.join(attributes.select(F.col("node").alias("src"), "value"), "src").join(attributes.select(F.col("node").alias("dst"), F.col("value").alias("other")), "dst", "left")
    same = F.coalesce(F.col("value") == F.col("other"), F.lit(False))
    counts = tagged.groupBy("value").agg(F.count_if(same).alias("internal"), F.count_if(~same).alias("external"))
    inner, outer = F.coalesce("internal", F.lit(0)), F.coalesce("external", F.lit(0))
    return sizes.join(counts, "value", "left").select("value", "size", inner.alias("internal"), outer.alias("external"), (inner / (F.col("size") * (F.col("size") - 1))).alias("density"), F.coalesce(F.try_divide(inner, inner + outer), F.lit(0.0)).alias("homophily"))


def bridges(edges: DataFrame) -> DataFrame:
    """src < dst of the bridges of the undirected graph: an edge is one if its ends share no cycle.

    A breadth-first forest is grown from each component's smallest node. Every edge outside it has a random number of 63 bits; a
    tree edge lies on no cycle if the numbers of all edges that leave its lower side cancel out under exclusive or, which is
    right but for a chance of 2**-63 an edge. Numbers go up the tree level by level, all components at once.
    """
    pairs = cut(both_ways(edges))
    seen = cut(components(edges).where("node = component").select("node", F.lit(0).alias("level"), F.lit(None).cast(dict(edges.dtypes)["src"]).alias("parent")))
    front, depth = seen, 0
    while True:
        depth += 1
        found = front.select(F.col("node").alias("src")).join(pairs, "src").groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("parent"))
        front = cut(found.join(seen.select("node"), "node", "left_anti").select("node", F.lit(depth).alias("level"), "parent"))
        if front.isEmpty():
            break
        seen = cut(seen.unionByName(front))
    tree = seen.where("parent IS NOT NULL").select(F.least("node", "parent").alias("src"), F.greatest("node", "parent").alias("dst"))
    other = pairs.where("src < dst").join(tree, ["src", "dst"], "left_anti").withColumn("x", F.xxhash64("src", "dst", F.lit("bridge")))
    marks = other.select(F.explode(F.array("src", "dst")).alias("node"), "x").groupBy("node").agg(F.bit_xor("x").alias("x"))
    sums = cut(seen.join(marks, "node", "left").select("node", "level", "parent", F.coalesce("x", F.lit(0)).alias("x")))
    done = None
    at = sums.where(F.col("level") == depth - 1)
    for level in range(depth - 1, 0, -1):
        here = cut(at.select("node", "parent", "x"))
        done = here if done is None else done.unionByName(here)
        up = here.groupBy(F.col("parent").alias("node")).agg(F.bit_xor("x").alias("more"))
        at = sums.where(F.col("level") == level - 1).join(up, "node", "left").select("node", "parent", F.col("x").bitwiseXOR(F.coalesce("more", F.lit(0))).alias("x"))
    if done is None:
        return tree.limit(0)
    return done.where("x = 0").select(F.least("node", "parent").alias("src"), F.greatest("node", "parent").alias("dst"))


def combined(metrics: dict[str, tuple[DataFrame, float]], k: int = 10) -> DataFrame:
    """The k nodes with the largest weighted sum of metrics: {column: ((node, column) table, weight)}; what is missing counts 0."""
    joined = reduce(lambda a, b: a.join(b, "node", "full"), [m[0].select("node", c) for c, m in metrics.items()])
    score: Column = sum((F.coalesce(c, F.lit(0.0)) * w for c, (_, w) in metrics.items()), F.lit(0.0))
    return joined.withColumn("score", score).orderBy(F.desc("score"), "node").limit(k)


def propagation_speed(times: DataFrame, time: str = "ts") -> DataFrame:
    """One row: mean, max, min, median and population std of 1 / gap over the positive gaps in seconds between successive times. Times are counted by day first, so that no window holds more than a day and its forerunner."""
    us = F.unix_micros(F.col(time).cast("timestamp"))
    seen = times.where(F.col(time).isNotNull()).select(us.alias("u")).distinct().withColumn("day", F.floor(F.col("u") / 86_400_000_000))
    ends = seen.groupBy("day").agg(F.max("u").alias("top"))
    before = ends.select("day", F.lag("top").over(Window.partitionBy(F.lit(0)).orderBy("day")).alias("earlier"))  # one row a day
    gaps = seen.join(before, "day").withColumn("g", F.col("u") - F.coalesce(F.lag("u").over(Window.partitionBy("day").orderBy("u")), "earlier"))
    speed = gaps.where("g > 0").select((1e6 / F.col("g")).alias("s"))
    return speed.agg(F.avg("s").alias("mean"), F.max("s").alias("max"), F.min("s").alias("min"), F.percentile("s", F.lit(0.5)).alias("median"), F.stddev_pop("s").alias("std"))
