"""What the operators share: table access, written intermediate tables, labels' folds."""

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor sees: spark.checkpoint.dir. Only where the session has none, as in tests, a temporary one is set."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not folder:
        known = sc._jsc.sc().getCheckpointDir()
        folder = known.get() if known.isDefined() else None
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="brindle-")
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    path = f"{shared_folder(spark)}/brindle-{what}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(clean_up)
    _written.append(path)
    return path


def stored(df: DataFrame, what: str = "step", **options: str) -> DataFrame:
    """Cut the lineage: write df as a Parquet table in the shared folder and read it back. A lost executor costs nothing."""
    spark, schema = df.sparkSession, df.schema
    path = new_path(spark, what)
    df.write.parquet(path, **options)
    del df
    spark.sparkContext._jvm.System.gc()  # lets Spark's cleaner delete the shuffle files behind this step, which nothing reads any more
    back = spark.read.schema(schema).parquet(path)
    back._written = path
    return back


def merged(df: DataFrame) -> DataFrame:
    """df, to be joined by sorting. The planner takes a written table's size from its compressed files, so that hashes of under 10 MB there become tables several times as large in the driver; what grows with the corpus is not broadcast."""
    return df.hint("merge")


def release(*steps: DataFrame) -> None:
    """Delete written steps that nothing reads any more."""
    for step in steps:
        path = step._written
        if path in _written:
            _written.remove(path)
            _delete(step.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def clean_up() -> None:
    """Delete the written steps; runs at exit, or when a caller has consumed the results."""
    spark = SparkSession.getActiveSession()
    while _written:
        path = _written.pop()
        if spark is not None:
            try:
                _delete(spark, path)
            except Exception:  # the JVM may be gone at exit
                return


def fold(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as empty text (0)."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit(""))) % n


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, train: Column, most: int) -> DataFrame:
    """At most `most` labelled documents (text, y), chosen by a hash of the id so that every run takes the same ones; of an id that is repeated the least text.

    The chosen ids, at most `most` rows, are broadcast; the texts are not.
    """
    chosen = (
        labels.where(train & F.col(label).isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most)
    )
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("text", "y")
