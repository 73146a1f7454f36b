"""Communities by modularity, and scores that combine several measures of a node."""

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.operators import graph, neural


def undirected(edges: DataFrame) -> DataFrame:
    """src, dst, weight in either direction, parallel and opposite edges added up; loops are left out."""
    weight = F.col("weight").cast("double") if "weight" in edges.columns else F.lit(1.0)
    plain = edges.where("src <> dst").select("src", "dst", weight.alias("weight"))
    return plain.unionByName(plain.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def quality(edges: DataFrame, labels: DataFrame, resolution: float = 1.0) -> DataFrame:
    """One row: the weighted modularity of (node, community). edges: both directions, a loop's weight counted twice."""
    tagged = edges.join(labels.select(F.col("node").alias("src"), F.col("community").alias("a")), "src").join(labels.select(F.col("node").alias("dst"), F.col("community").alias("b")), "dst")
    per = tagged.groupBy("a").agg(F.sum("weight").alias("degree"), F.sum(F.when(F.col("a") == F.col("b"), F.col("weight")).otherwise(0.0)).alias("inside"))
    sums = per.agg(F.sum("degree").alias("total"), F.sum("inside").alias("inside"), F.sum(F.col("degree") * F.col("degree")).alias("squares"))
    return sums.select(F.coalesce(F.try_divide("inside", "total") - resolution * F.try_divide("squares", F.col("total") * F.col("total")), F.lit(0.0)).alias("modularity"))


def _local_moves(edges: DataFrame, resolution: float, rounds: int) -> DataFrame:
    """node, community after moving nodes to the neighbouring community of the greatest gain, as long as that raises modularity.

    Half of the nodes, another half by a hash each time, may move in a round, so that neighbours don't swap. A round is one aggregate over the edges by node
    and community, with the labels and the communities' sizes joined once; the sums that make up modularity come with it, and the
    labelling of the highest one is kept. It ends once two halves in turn don't move.
    """
    strength = edges.groupBy(F.col("src").alias("node")).agg(F.sum("weight").alias("k"))
    labels = graph.cut(strength.select("node", F.col("node").alias("community"), "k"))
    total = labels.agg(F.sum("k")).first()[0]
    best, most, still = labels, None, 0
    for r in range(rounds + 1):
        sizes = labels.groupBy("community").agg(F.sum("k").alias("size"))
        own = labels.select("node", F.col("community").alias("own"), "k")
        tied = edges.join(labels.select(F.col("node").alias("dst"), "community"), "dst").select(F.col("src").alias("node"), "community", "weight", (F.col("src") == F.col("dst")).alias("loop"))
        ways = tied.unionByName(labels.select("node", "community", F.lit(0.0).alias("weight"), F.lit(True).alias("loop")))  # a node may stay without links
        ways = ways.groupBy("node", "community").agg(F.sum("weight").alias("all"), F.sum(F.when(~F.col("loop"), F.col("weight")).otherwise(0.0)).alias("w")).join(own, "node").join(sizes, "community")
        here = F.col("community") == F.col("own")
        gain = F.col("w") - resolution * F.col("k") * (F.col("size") - F.when(here, F.col("k")).otherwise(0.0)) / total
        pick = ways.withColumn("gain", gain).groupBy("node", "own", "k").agg(F.max(F.when(here, F.col("gain"))).alias("now"), F.min_by("community", F.struct((-F.col("gain")).alias("g"), "community")).alias("to"), F.max("gain").alias("top"), F.sum(F.when(here, F.col("all")).otherwise(0.0)).alias("inside"), F.max(F.when(here, F.col("size"))).alias("size"))
        turn = (F.pmod(F.xxhash64("node", F.lit(r)), F.lit(2)) == 0) & (F.col("top") > F.col("now") + 1e-12)
        new = graph.cut(pick.select("node", F.when(turn, F.col("to")).otherwise(F.col("own")).alias("community"), "k", turn.alias("moved"), (F.col("inside") / total - resolution * F.col("k") * F.col("size") / (total * total)).alias("part")))
        moved, score = new.agg(F.count_if("moved"), F.sum("part")).first()  # the score is that of the labels before this round
        if most is None or score > most + 1e-12:
            best, most = labels, score
        still = 0 if moved else still + 1
        if still == 2:
            break
        labels = new.select("node", "community", "k")
    return best.select("node", "community")


def louvain(edges: DataFrame, resolution: float = 1.0, rounds: int = 10, most_levels: int = 3) -> DataFrame:
    """node, community (its smallest node): moves of single nodes, then of the communities as nodes of a smaller graph, until modularity stops growing.

    Weights of both directions count; a greater resolution gives smaller communities. Only sums come to the driver. No edges:
    every node of a loop is its own community, and an empty table gives no rows.
    """
    level = graph.cut(undirected(edges))
    found = graph.cut(graph.nodes_of(edges).select("node", F.col("node").alias("community")))
    for _ in range(most_levels if not level.isEmpty() else 0):
        moved = _local_moves(level, resolution, rounds)
        if moved.where("node <> community").isEmpty():
            break
        found = graph.cut(found.join(moved.select(F.col("node").alias("community"), F.col("community").alias("to")), "community", "left").select("node", F.coalesce("to", "community").alias("community")))
        side = lambda c: moved.select(F.col("node").alias(c), F.col("community").alias(f"{c}_to"))
        level = graph.cut(level.join(side("src"), "src").join(side("dst"), "dst").groupBy(F.col("src_to").alias("src"), F.col("dst_to").alias("dst")).agg(F.sum("weight").alias("weight")))
    names = found.groupBy("community").agg(F.min("node").alias("name"))
    return found.join(names, "community").select("node", F.col("name").alias("community"))


def greedy_modularity(edges: DataFrame, most_rounds: int = 200) -> DataFrame:
    """node, community (its smallest node): communities merge with the neighbour that raises modularity most, as long as any does.

    In each round all pairs that are each other's best merge, so that the best pair of all always does; ties go to the smaller
    name. Only a count comes to the driver.
    """
    level = graph.cut(undirected(edges))
    found = graph.cut(graph.nodes_of(edges).select("node", F.col("node").alias("community")))
    total = level.agg(F.sum("weight")).first()[0] or 1.0
    for _ in range(most_rounds):
        degree = level.groupBy(F.col("src").alias("c")).agg(F.sum("weight").alias("d"))
        pairs = level.where("src <> dst").join(degree.select(F.col("c").alias("src"), F.col("d").alias("x")), "src").join(degree.select(F.col("c").alias("dst"), F.col("d").alias("y")), "dst")
        gain = pairs.withColumn("gain", F.round(2 * (F.col("weight") / total - F.col("x") * F.col("y") / (total * total)), 12)).where("gain > 0")
        best = gain.groupBy("src").agg(F.min_by("dst", F.struct((-F.col("gain")).alias("g"), F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi"))).alias("dst"))
        mutual = best.join(best.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"]).where("src < dst")
        merged = graph.cut(mutual.select(F.col("dst").alias("community"), F.col("src").alias("to")))
        if merged.isEmpty():
            break
        found = graph.cut(found.join(merged, "community", "left").select("node", F.coalesce("to", "community").alias("community")))
        rename = lambda df, c: df.join(merged.select(F.col("community").alias(c), F.col("to").alias("_to")), c, "left").withColumn(c, F.coalesce("_to", c)).drop("_to")
        level = graph.cut(rename(rename(level, "src"), "dst").groupBy("src", "dst").agg(F.sum("weight").alias("weight")))
    return found


def described(labels: DataFrame, edges: DataFrame, least: int = 3, top: int = 5) -> DataFrame:
    """community, size, directed density and top (its `top` nodes of largest degree within it, ties by name) of communities of at least `least` nodes."""
    named = labels.withColumnRenamed("community", "label")
    sizes = graph.communities(named, edges, least).withColumnRenamed("label", "community")
    inner = edges.join(labels.select(F.col("node").alias("src"), "community"), "src").join(labels.select(F.col("node").alias("dst"), F.col("community").alias("other")), "dst").where("community = other")
    ends = inner.select("community", F.explode(F.array("src", "dst")).alias("node")).groupBy("community", "node").agg(F.count("*").alias("d"))
    ranked = labels.join(ends, ["community", "node"], "left").withColumn("r", F.row_number().over(Window.partitionBy("community").orderBy(F.desc(F.coalesce("d", F.lit(0))), "node"))).where(F.col("r") <= top)
    tops = ranked.groupBy("community").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "node"))), lambda x: x["node"]).alias("top"))
    return sizes.join(tops, "community")


def overlapping(edges: DataFrame, layers: list[tuple[np.ndarray, np.ndarray | None]], threshold: float = 0.5) -> DataFrame:
    """node, community (from 0) and membership: a node is in every community whose membership is over `threshold`, or in none.

    Memberships are the softmax of graph convolutions over the node's degree; layers holds each one's weight (out x in, the first
    has in 1) and bias, the last one's out is the number of communities. Directions, parallel edges, weights and loops don't count. An
    empty table gives no rows.
    """
    linked = graph.cut(undirected(edges).select("src", "dst"))
    x = linked.groupBy(F.col("src").alias("node")).agg((F.count("*") + 1).alias("d"))
    x = x.select("node", "d", F.array((F.col("d") - 1).cast("double")).alias("h"))
    for i, (weight, bias) in enumerate(layers):
        x = neural.gcn(x, linked, weight, bias, "softmax" if i == len(layers) - 1 else "relu")
    return x.select("node", F.posexplode("h").alias("community", "membership")).where(F.col("membership") > threshold)


def overlapping_described(members: DataFrame, edges: DataFrame) -> DataFrame:
    """community, size, directed density (0 for a single node) and mean number of communities of its members; members has node and community, of which a node may have several."""
    often = members.select("node", "community").join(members.groupBy("node").agg(F.count("*").alias("n")), "node")
    sizes = often.groupBy("community").agg(F.count("*").alias("size"), F.avg("n").alias("avg_membership"))
    side = lambda c: members.select(F.col("node").alias(c), "community")
    inner = edges.select("src", "dst").distinct().join(side("src"), "src").join(side("dst"), ["dst", "community"]).groupBy("community").agg(F.count("*").alias("m"))
    density = F.coalesce(F.try_divide("m", F.col("size") * (F.col("size") - 1)), F.lit(0.0))
    return sizes.join(inner, "community", "left").select("community", "size", density.alias("density"), "avg_membership")


def overlap(a: Column, b: Column) -> Column:
    """The members that two communities share, sorted."""
    return F.array_sort(F.array_intersect(a, b))


# ---- scores of nodes


def _degree_share(edges: DataFrame) -> DataFrame:
    d = graph.degrees(edges)
    return d.join(F.broadcast(d.agg(F.max("degree").alias("top")))).select("node", (F.col("degree") / F.col("top")).alias("degree_share"))


def influence_scores(edges: DataFrame, k: int = 100) -> DataFrame:
    """The k nodes with the largest 0.4 PageRank + 0.3 betweenness + 0.2 closeness + 0.1 degree over the largest degree."""
    return graph.combined({"rank": (graph.pagerank(edges), 0.4), "betweenness": (graph.betweenness(edges), 0.3), "closeness": (graph.closeness(edges), 0.2), "degree_share": (_degree_share(edges), 0.1)}, k)


def key_spreaders(edges: DataFrame, k: int = 10) -> DataFrame:
    """The k nodes with the largest 0.5 core number + 0.5 betweenness."""
    return graph.combined({"core": (graph.core_numbers(edges), 0.5), "betweenness": (graph.betweenness(edges), 0.5)}, k)


def key_nodes(edges: DataFrame, k: int = 10, weights: dict[str, float] | None = None) -> DataFrame:
    """The k nodes with the largest weighted sum of five centralities; as a rule each counts a fifth."""
    weights = weights or dict.fromkeys(("rank", "betweenness", "closeness", "centrality", "degree_share"), 0.2)
    tables = {"rank": lambda: graph.pagerank(edges), "betweenness": lambda: graph.betweenness(edges), "closeness": lambda: graph.closeness(edges), "centrality": lambda: graph.eigenvector(edges), "degree_share": lambda: _degree_share(edges)}
    return graph.combined({c: (tables[c](), w) for c, w in weights.items()}, k)


def influencers(edges: DataFrame, k: int = 20, method: str = "composite") -> DataFrame:
    """The k nodes by pagerank, kshell, degree, or composite: 0.35 PageRank, 0.25 betweenness, 0.25 core number over the largest, 0.15 degree share."""
    cores = lambda: graph.core_numbers(edges)
    if method == "composite":
        c = graph.cut(cores())
        shell = c.join(F.broadcast(c.agg(F.max("core").alias("top")))).select("node", F.coalesce(F.try_divide("core", "top"), F.lit(0.0)).alias("shell"))
        return graph.combined({"rank": (graph.pagerank(edges), 0.35), "betweenness": (graph.betweenness(edges), 0.25), "shell": (shell, 0.25), "degree_share": (_degree_share(edges), 0.15)}, k)
    column, table = {"pagerank": ("rank", lambda: graph.pagerank(edges)), "kshell": ("core", cores), "degree": ("degree_share", lambda: _degree_share(edges))}[method]
    return graph.combined({column: (table(), 1.0)}, k)


def central_nodes(scores: DataFrame, column: str, k: int = 10) -> DataFrame:
    """rank (from 1), node and score of the k largest, ties by node."""
    top = scores.select("node", F.col(column).alias("score")).orderBy(F.desc("score"), "node").limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "node"))).select("rank", "node", "score")  # k rows


def centrality_features(edges: DataFrame) -> DataFrame:
    """Per node: degree over the other nodes, betweenness, eigenvector centrality and PageRank."""
    n = graph.nodes_of(edges).agg(F.count("*").alias("n"))
    degree = graph.degrees(edges).join(F.broadcast(n)).select("node", F.coalesce(F.try_divide("degree", F.col("n") - 1), F.lit(0.0)).alias("degree_centrality"))
    return degree.join(graph.betweenness(edges), "node", "left").join(graph.eigenvector(edges), "node", "left").join(graph.pagerank(edges), "node", "left").na.fill(0.0)


def community_features(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Per node: its clustering coefficient, its community's place by size (from 0, ties by name), and its degree over twice the edges."""
    sizes = labels.groupBy("community").agg(F.count("*").alias("size"))
    place = sizes.withColumn("index", F.row_number().over(Window.orderBy(F.desc("size"), "community")) - 1)  # one row a community
    m = edges.agg(F.count("*").alias("m"))
    share = graph.degrees(edges).join(F.broadcast(m)).select("node", (F.col("degree") / (2 * F.col("m"))).alias("degree_share"))
    return graph.clustering(edges).select("node", "clustering").join(labels.join(place.select("community", "index"), "community").select("node", F.col("index").alias("community_index")), "node", "left").join(share, "node", "left")


def dense_ids(df: DataFrame, by: str) -> DataFrame:
    """df with id, numbers from 0 without gaps in the order of `by`: ranges are numbered each for itself, from the counts of those before."""
    placed = graph.pinned(df.repartitionByRange(by).withColumn("_p", F.spark_partition_id()))
    sizes = placed.groupBy("_p").agg(F.count("*").alias("n"))
    before = sizes.select("_p", (F.sum("n").over(Window.orderBy("_p")) - F.col("n")).alias("before"))  # one row a partition
    return placed.withColumn("id", F.row_number().over(Window.partitionBy("_p").orderBy(by)) - 1).join(F.broadcast(before), "_p").withColumn("id", F.col("id") + F.col("before")).drop("_p", "before")


def edge_index(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """src_id, dst_id: edges by dense numbers of the nodes (from 0, in their order); edges with an unknown end are left out."""
    ids = dense_ids(nodes.select("node").distinct(), "node")
    return edges.join(ids.select(F.col("node").alias("src"), F.col("id").alias("src_id")), "src").join(ids.select(F.col("node").alias("dst"), F.col("id").alias("dst_id")), "dst").select("src_id", "dst_id")


def path_steps(path: DataFrame, by: list[str], time: str = "ts") -> DataFrame:
    """Consecutive nodes of a propagation path with the seconds between them."""
    w = Window.partitionBy(*by).orderBy(time, "node")
    us = F.unix_micros(F.col(time).cast("timestamp"))
    return path.select(*by, F.col("node").alias("source"), F.lead("node").over(w).alias("target"), ((F.lead(us).over(w) - us) / 1e6).alias("time_diff")).where("target IS NOT NULL")


def structural_similarity(one: DataFrame, two: DataFrame) -> DataFrame:
    """One row: half of 1 - the difference of two graphs' densities and half of 1 - that of their mean clustering."""
    part = lambda e, n: graph.statistics(e).select(F.col("density").alias(f"d{n}")).crossJoin(graph.clustering(e).agg(F.coalesce(F.avg("clustering"), F.lit(0.0)).alias(f"c{n}")))  # noqa: E731, single rows
    return part(one, 1).crossJoin(part(two, 2)).select((0.5 * (1 - F.abs(F.col("d1") - F.col("d2"))) + 0.5 * (1 - F.abs(F.col("c1") - F.col("c2")))).alias("similarity"))


def network_metrics(edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, density, reciprocity, mean clustering, degree assortativity, and the mean and longest shortest path in the largest strongly connected part (as its pairs are made, for small graphs)."""
    reach = graph.cut(graph.distances(edges))
    back = reach.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    both = reach.join(back, ["src", "dst"])
    part = both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("part"))
    largest = part.groupBy("part").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "part").limit(1).select("part")
    inside = part.join(F.broadcast(largest), "part", "left_semi").select("node")
    paths = reach.where("src <> dst").join(inside.withColumnRenamed("node", "src"), "src", "left_semi").join(inside.withColumnRenamed("node", "dst"), "dst", "left_semi").agg(F.coalesce(F.avg("distance"), F.lit(0.0)).alias("mean_path"), F.coalesce(F.max("distance"), F.lit(0)).cast("long").alias("diameter"))
    return graph.statistics(edges).crossJoin(graph.clustering(edges).agg(F.avg("clustering").alias("mean_clustering"))).crossJoin(graph.assortativity(edges)).crossJoin(paths)  # single rows
