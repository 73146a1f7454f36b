"""Connected components by distributed union-find."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common


def _stars(edges: DataFrame, most_rounds: int) -> DataFrame:
    """Edges (a < b, repeats allowed) as stars: one row (a, b) for each node b that isn't the smallest of its component, a."""
    for _ in range(most_rounds):
        # dealt by b once, for the repeats and for each node's smallest neighbour p
        near = edges.repartition("b").distinct().withColumn("p", F.min("a").over(Window.partitionBy("b")))
        above = edges.groupBy(F.col("b").alias("p")).agg(F.min("a").alias("g"))
        # a node and its other smaller neighbours hang on the smallest neighbour of its smallest one, or on that one if it has none
        moved = near.join(above, "p", "left").select(
            F.coalesce("g", "p").alias("a"), F.when(F.col("a") == F.col("p"), F.col("b")).otherwise(F.col("a")).alias("b"), ((F.col("a") != F.col("p")) | F.col("g").isNotNull()).alias("new")
        )
        last, edges = edges, common.stored(moved, "stars")
        if hasattr(last, "_written"):
            common.release(last)
        if not edges.agg(F.max("new")).first()[0]:
            return edges.select("a", "b")
        written, edges = edges, edges.select("a", "b")
        edges._written = written._written
    raise RuntimeError("the components did not settle")


def components(links: DataFrame, nodes: DataFrame, known: DataFrame | None = None, most_rounds: int = 60) -> DataFrame:
    """doc_id and component (the smallest doc_id reachable, itself included) for every row of `nodes` (distinct doc_id).

    links has columns a, b. In each round every node and its smaller neighbours hang on the smallest neighbour's smallest
    neighbour, until every component is a star around its smallest node; the number of rounds grows about with the logarithm of the
    longest chain. One flag, whether anything moved, comes to the driver. The edges are written to the shared folder each
    round. A node without links is its own component; an empty table stays empty.

    known is the result for the same nodes with other links, which count too: then only its components meet.
    """
    if links.isEmpty():
        return nodes.select("doc_id", F.col("doc_id").alias("component")) if known is None else known
    if known is not None:
        of = lambda c: known.select(F.col("doc_id").alias(c), F.col("component").alias("c" + c))
        links = links.join(of("a"), "a").join(of("b"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    stars = _stars(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b"), most_rounds)
    if known is None:
        return nodes.join(stars.select(F.col("b").alias("doc_id"), F.col("a").alias("component")), "doc_id", "left").select("doc_id", F.coalesce("component", "doc_id").alias("component"))
    return known.join(stars.select(F.col("b").alias("component"), "a"), "component", "left").select("doc_id", F.coalesce("a", "component").alias("component"))
