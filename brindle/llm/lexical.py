"""Ranked lexical search: Fagin's threshold algorithm over shards of a forward index.

The index holds, for each document, the query terms in it and how often. It is dealt out by documents: each task turns its part, shard by
shard, into impact-sorted lists and a forward table, and runs the threshold algorithm on them with the k best so far as the bar
to pass. A document is in one shard only, so the best of all shards are the best of all documents.
"""

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .near_dup import LOWER, PART, hashed

#: The bytes of a term: digits, a-z (after lower-casing) and all of UTF-8 beyond ASCII.
TERM = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])
SMALL = np.frombuffer(LOWER, dtype=np.uint8)
#: A block of queries ends with so many queries or distinct terms; a shard's forward table has so many cells; first steps down the lists.
BLOCK, BLOCK_TERMS, CELLS, FIRST = 2_000, 50_000, 8_000_000, 64


def terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hashes of all terms of a string array without nulls, in order, and how many each text has."""
    texts = texts.cast(pa.large_binary())
    bounds = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = SMALL[np.frombuffer(data, dtype=np.uint8)[bounds[0] : bounds[-1]]] if data is not None else np.zeros(0, dtype=np.uint8)
    bounds = bounds - bounds[0]
    inner = bounds[(bounds > 0) & (bounds < len(raw))]
    ok = TERM[raw]
    starts, ends = ok.copy(), ok.copy()
    starts[1:] &= ~ok[:-1]
    ends[:-1] &= ~ok[1:]
    starts[inner] = ok[inner]  # a term ends where its text does
    ends[inner - 1] = ok[inner - 1]
    first, last = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    counts = np.diff(np.searchsorted(first, bounds))
    # hashed in parts, so that sums and powers stay as small as a part, or as one term if that is longer
    cuts = np.unique(np.concatenate(([0], np.searchsorted(first, np.arange(PART, max(len(raw), 1), PART)), [len(first)])))
    parts = [hashed(raw[first[i] : last[j - 1]], first[i:j] - first[i], last[i:j] - first[i]) for i, j in zip(cuts[:-1], cuts[1:], strict=True) if j > i]
    return np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64), counts


def slices(texts: pa.Array, most_bytes: int = 8_000_000) -> Iterator[tuple[int, pa.Array]]:
    """(position, part) of parts of a string array of about so many bytes, or of one text if that is longer."""
    size = np.cumsum(pa.compute.binary_length(texts).to_numpy(zero_copy_only=False)) if len(texts) else np.zeros(0)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most_bytes, "right")))
        yield at, texts.slice(at, to - at)
        at = to


def forward_index(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """doc_id, n (all terms), ids and tfs (of its terms in the vocabulary, sorted hashes) of every document with a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(vocabulary)
        for b in batches:
            for at, texts in slices(b.column(1).cast(pa.large_string()).fill_null("")):
                found, n = terms(texts)
                place = np.minimum(np.searchsorted(vocabulary, found), size - 1)
                hit = vocabulary[place] == found
                key, tf = np.unique(np.repeat(np.arange(len(texts), dtype=np.int64), n)[hit] * size + place[hit], return_counts=True)
                lists = np.searchsorted(key, np.arange(len(texts) + 1, dtype=np.int64) * size).astype(np.int32)
                ids, tfs = pa.array((key % size).astype(np.int32)), pa.array(tf.astype(np.int32))
                out = pa.RecordBatch.from_arrays([b.column(0).slice(at, len(texts)), pa.array(n.astype(np.int64)), pa.ListArray.from_arrays(pa.array(lists), ids), pa.ListArray.from_arrays(pa.array(lists), tfs)], names=["doc_id", "n", "ids", "tfs"])
                yield out.filter(pa.array(n > 0))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n long, ids array<int>, tfs array<int>")


class Best:
    """The k best documents of a query so far: largest score first, then smallest doc_id, null ids last."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids, self.null = k, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool)

    @property
    def bar(self) -> int:
        """What a document's score must reach at least."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 1

    def add(self, scores: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        ok = scores >= self.bar
        if ok.any():
            s, i, z = np.concatenate((self.scores, scores[ok])), np.concatenate((self.ids, ids[ok])), np.concatenate((self.null, null[ok]))
            order = np.lexsort((i, z, -s))[: self.k]
            self.scores, self.ids, self.null = s[order], i[order], z[order]


class Shard:
    """Impact-sorted lists of (document, impact) for each term, and the forward table of impacts by document and term."""

    def __init__(self, ids: np.ndarray, null: np.ndarray, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, size: int):
        self.ids, self.null = ids, null
        self.table = np.zeros((len(ids), size), dtype=np.int32)
        self.table[doc, term] = impact
        order = np.argsort(term.astype(np.int64) * (1 << 20) + ((1 << 20) - 1 - impact), kind="stable")
        self.doc, self.impact = doc[order], impact[order]
        self.start = np.searchsorted(term[order], np.arange(size + 1))

    def search(self, terms: np.ndarray, weights: np.ndarray, best: Best) -> int:
        """Fagin's threshold algorithm: all lists go down in turn, each newly met document is scored from the forward table, until no unseen one can reach the bar. Returns how many were scored."""
        lo, hi = self.start[terms], self.start[terms + 1]
        seen, depth, step = np.zeros(len(self.ids), dtype=bool), 0, FIRST
        while True:
            at = lo + depth
            open_ = at < hi
            threshold = int((weights[open_] * self.impact[at[open_]]).sum())  # no document below the lists' depth has more
            if threshold < best.bar:
                return int(seen.sum())
            met = np.zeros(len(self.ids), dtype=bool)
            for a, b in zip(at[open_].tolist(), np.minimum(at + step, hi)[open_].tolist(), strict=True):
                met[self.doc[a:b]] = True
            new = np.flatnonzero(met & ~seen)
            seen |= met
            best.add(self.table[new][:, terms].astype(np.int64) @ weights, self.ids[new], self.null[new])
            depth, step = depth + step, step * 2


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def best_of_parts(index: DataFrame, queries: list[tuple[np.ndarray, np.ndarray]], size: int, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """q (a query's place), doc_id and score: at most k of each query from each task. queries has their terms and weights times repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, rows = [Best(k) for _ in queries], max(1, CELLS // size)
        for b in batches:
            for at in range(0, b.num_rows, rows):
                part = b.slice(at, rows)
                n = part.column(1).to_numpy()
                length = 25 * n * n_docs // n_terms if 25 * int(n.max()) * n_docs < 2**62 else np.array([25 * x * n_docs // n_terms for x in n.tolist()])
                lists = part.column(2)
                doc = np.repeat(np.arange(part.num_rows), pa.compute.list_value_length(lists).to_numpy())
                term, tf = lists.flatten().to_numpy(), part.column(3).flatten().to_numpy().astype(np.int64)
                impact = 1_000_000_000 * tf // (1000 * tf + 12 * (75 + length)[doc])
                ids = part.column(0)
                shard = Shard(ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), doc, term, impact, size)
                for (t, w), top in zip(queries, best, strict=True):
                    shard.search(t, w, top)
        for q, top in enumerate(best):
            if len(top.scores):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(top.scores), q, dtype=np.int32)), pa.array(top.ids, mask=top.null), pa.array(top.scores)], names=["q", "doc_id", "score"])

    return index.mapInArrow(run, "q int, doc_id long, score long")


def top(rows: DataFrame, by: list[str], k: int) -> DataFrame:
    """rank and rows of the k best of each group."""
    w = Window.partitionBy(*by).orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def search_block(docs: DataFrame, block: list[tuple], k: int) -> DataFrame:
    """item_id, rank, doc_id, score for the (item_id, hashes) of one block of queries."""
    spark = docs.sparkSession
    vocabulary = np.unique(np.concatenate([h for _, h in block]))
    index = common.stored(forward_index(docs, vocabulary), "forward")
    n_docs, n_terms = index.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = dict(index.select(F.explode("ids").alias("t")).groupBy("t").count().collect())  # at most the block's terms
    weights = np.array([weight(n_docs, df.get(t, 0)) for t in range(len(vocabulary))], dtype=np.int64)
    queries = []
    for _, hashes in block:
        own, repeats = np.unique(np.searchsorted(vocabulary, hashes), return_counts=True)
        there = np.array([t in df for t in own.tolist()])
        queries.append((own[there], (weights[own] * repeats)[there]))
    found = best_of_parts(index, queries, len(vocabulary), n_docs, max(n_terms, 1), k)
    some = top(found.withColumn("part", F.spark_partition_id() % 256), ["q", "part"], k)  # first the best of 256 groups of tasks
    items = spark.createDataFrame([(q, item) for q, (item, _) in enumerate(block)], "q int, item_id long")
    return common.stored(top(some.select("q", "doc_id", "score"), ["q"], k), "best").join(F.broadcast(items), "q").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """item_id, rank (from 1), doc_id and score of the k documents (doc_id, text) with the largest scores over 0 for each item (item_id, text).

    Items are taken in blocks of bounded size, each of which goes over all documents. A null or empty text has no terms: such
    a document doesn't count and such an item finds nothing. Equal scores go by doc_id, null ids last. A row that is
    there twice is two documents, or two queries with the same results. Empty tables give no rows. Other columns are not read.
    """
    out: DataFrame | None = None
    block: list[tuple] = []
    known: Counter = Counter()
    for item, text in items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text IS NOT NULL").orderBy("item_id").toLocalIterator():
        hashes = terms(pa.array([text]))[0]
        if not len(hashes):
            continue
        if block and (len(block) >= BLOCK or len(known) + len(hashes) > BLOCK_TERMS):
            out, block, known = _both(out, search_block(docs, block, k)), [], Counter()
        block.append((item, hashes))
        known.update(hashes.tolist())
    if block:
        out = _both(out, search_block(docs, block, k))
    return out if out is not None else docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")


def _both(one: DataFrame | None, two: DataFrame) -> DataFrame:
    return two if one is None else one.unionByName(two)


def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents for each benchmark item; nulls, ties, repeats and empty tables: see search."""
    return search(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


def oracle(k: int = 20) -> str:
    """The same in SQL: all scores, then the best of each item."""
    own = "unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term"
    return f"""WITH p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, {own} FROM documents) GROUP BY 1, 2),
 lens AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM p GROUP BY 1),
 t AS (SELECT CAST(count(*) AS BIGINT) AS nd, CAST(sum(n) AS BIGINT) AS l FROM lens),
 w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(nd) + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, t GROUP BY 1),
 q AS (SELECT item_id, term, count(*) AS reps FROM (SELECT item_id, {own} FROM benchmark) GROUP BY 1, 2),
 s AS (SELECT item_id, doc_id, CAST(sum(reps * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nd) // l)))) AS BIGINT) AS score
  FROM q JOIN w USING (term) JOIN p USING (term) JOIN lens USING (doc_id), t GROUP BY 1, 2)
 SELECT item_id, CAST(r AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS r FROM s WHERE score > 0) WHERE r <= {k}"""
