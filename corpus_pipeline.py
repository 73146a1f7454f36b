"""The corpus pipeline: from raw documents to packed training sequences, stage by stage.

Each stage works on all that the one before kept, and all but the last return the columns of documents: quality drops documents that
the classifier rejects; lines drops repeated lines; near_duplicates keeps one document of each group; substrings cuts out long
strings that occur elsewhere too; packing places every document's tokens in sequences.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import common, line_dedup, near_dup, packing, quality, suffix_dedup

THRESHOLD = 0.3


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least THRESHOLD."""
    model = quality.fit(docs, common.table(spark, sf_dir, "labels"), "quality", F.lit(True))
    return quality.score(docs, model, out="_quality").where(F.col("_quality") >= THRESHOLD).drop("_quality")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that came before, exactly or nearly; one that loses all its text goes."""
    done = line_dedup.deduplicate(docs, short=True)
    return done.where((F.col("n_removed") == 0) | (F.trim(F.col("text")) != "")).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the smallest doc_id."""
    return near_dup.keep_one(docs, words=5)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the byte strings that start elsewhere too; one that loses all its text goes."""
    return suffix_dedup.cut_texts(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in sequences of at most 2048 tokens."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", quality_stage),
    ("lines", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("substrings", substring_stage),
    ("packing", packing_stage),
]

#: The stages learn a model, verify fuzzy links and run a tokenizer, which SQL can't express; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each stage's result is written to the shared folder as Parquet and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
