"""Writing results: formats by name or extension, and graphs as node and edge tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMATS = {"csv": "csv", "json": "json", "parquet": "parquet", "orc": "orc"}


def export(df: DataFrame, path: str, format: str | None = None, mode: str = "overwrite") -> None:
    """Write df as a folder of CSV (with header), JSON lines, Parquet or ORC, told by `format` or the path's extension; any other is an error. Nested columns go to CSV as JSON."""
    kind = (format or path.rsplit(".", 1)[-1]).lower().lstrip(".")
    if kind not in FORMATS:
        raise ValueError(f"can't write the format {kind!r}")
    if kind == "csv":
        nested = [c for c, t in df.dtypes if t.startswith(("array", "map", "struct"))]
        df = df.withColumns({c: F.to_json(c) for c in nested}) if nested else df
        df.write.mode(mode).option("header", True).csv(path)
    else:
        df.write.mode(mode).format(FORMATS[kind]).save(path)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def read_node_link(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and links of a node-link JSON document (one document a file)."""
    doc = spark.read.option("multiLine", True).json(path)
    return doc.select(F.explode("nodes").alias("n")).select("n.*"), doc.select(F.explode("links").alias("l")).select("l.*")
