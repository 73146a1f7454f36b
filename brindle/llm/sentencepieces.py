"""SentencePiece encoding and decoding with a byte-pair model: a relational lattice for the corpus' frequent words.

The model at hand is a BPE model: a word's right segmentation is what merging gives, pair by pair in order of score, and not the path of
best total score, so the fold over a word's lattice merges where Viterbi would add up. Words are told apart by the space in front,
which no piece crosses.
"""

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SPACE = "▁"
NEVER = float("-inf")
UNIT = re.compile(f"{SPACE}+[^{SPACE}]*")


class Model:
    """A BPE model's pieces with scores, and the same merging as the lattice's fold for words outside the dictionary."""

    def __init__(self, path: str, memo: int = 300_000):
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if sp.is_byte(i)}
        plain = [i for i in range(len(self.pieces)) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
        self.rank = {self.pieces[i]: (sp.get_score(i), i) for i in plain}
        self.score = {p: s for p, (s, _) in self.rank.items()}.get
        self.longest = max(map(len, self.rank))
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.rank):
            raise ValueError("a piece of this model crosses words")
        of_byte = {i: bytes([b]) for b, i in self.bytes.items()}
        self.raw = [of_byte.get(i, p.replace(SPACE, " ").encode()) if i in of_byte or p in self.rank else b"" for i, p in enumerate(self.pieces)]
        self.memo, self.most = {}, memo

    def merged(self, unit: str) -> bytes:
        """A word's ids, packed."""
        rank, score, parts = self.rank, self.score, list(unit)
        # of every pair of neighbours the score of what it merges to; after a merge only its two neighbours' are looked up
        pairs = [score(x + y, NEVER) for x, y in zip(parts, parts[1:], strict=False)]
        while pairs and (best := max(pairs)) > NEVER:
            at = pairs.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del pairs[at]
            if at:
                pairs[at - 1] = score(parts[at - 1] + parts[at], NEVER)
            if at < len(pairs):
                pairs[at] = score(parts[at] + parts[at + 1], NEVER)
        out = []
        for p in parts:
            got = rank.get(p)
            out += [got[1]] if got is not None else [self.bytes[b] for b in p.encode("utf-8", "surrogatepass")]
        return array("I", out).tobytes()

    def encode(self, text: str, known: dict[str, bytes]) -> bytes:
        if not text:
            return b""
        memo, out = self.memo, []
        if len(memo) > self.most:
            memo.clear()
        for unit in UNIT.findall(SPACE + text.replace(" ", SPACE)):
            got = known.get(unit) or memo.get(unit)
            if got is None:
                got = self.merged(unit)
                if len(unit) < 64:
                    memo[unit] = got
            out.append(got)
        return b"".join(out)

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.raw.__getitem__, ids.tolist())).decode("utf-8", "replace")[1:]


def lattice(words: DataFrame, model: Model, spark: SparkSession) -> DataFrame:
    """word, ids of every distinct word (with its space mark): substrings up to the longest piece, joined to the pieces, grouped by word and folded.

    The piece table, of the model's size, is broadcast. Words are dealt out by hash once; exploding and grouping keep that.
    """
    pieces = spark.createDataFrame([(p, float(s), i) for p, (s, i) in model.rank.items()], "piece string, score double, id int")
    n = F.length("word")
    cuts = words.repartition("word").select("word", F.explode(F.sequence(F.lit(1), n)).alias("i"))
    cuts = cuts.select("word", F.explode(F.transform(F.sequence(F.lit(1), F.least(F.lit(model.longest), n - F.col("i") + 1)), lambda k: F.substring("word", F.col("i"), k))).alias("piece"))
    edges = cuts.distinct().join(F.broadcast(pieces), "piece").groupBy("word").agg(F.map_from_entries(F.collect_list(F.struct("piece", F.struct("score", "id")))).alias("edges"))
    return words.join(edges, "word", "left").select("word", _fold(F.col("word"), F.coalesce("edges", F.map_from_entries(F.array().cast("array<struct<piece: string, e: struct<score: double, id: int>>>"))), model).alias("ids"))


def _fold(word: Column, edges: Column, model: Model) -> Column:
    parts = F.split(word, "")

    def step(got: Column, _: Column) -> Column:
        pairs = F.transform(F.slice(got, 1, F.greatest(F.size(got) - 1, F.lit(0))), lambda x, i: F.struct(F.try_element_at(edges, F.concat(x, F.get(got, i + 1)))["score"].alias("score"), (-i).alias("at")))
        best = F.array_max(F.filter(pairs, lambda p: p["score"].isNotNull()))
        at = -best["at"]
        joined = F.concat(F.slice(got, F.lit(1), at), F.array(F.concat(F.get(got, at), F.get(got, at + 1))), F.slice(got, at + 3, F.size(got)))
        return F.when(best.isNull(), got).otherwise(joined)

    done = F.aggregate(F.sequence(F.lit(1), F.length(word)), parts, step)
    first = min(model.bytes.values())
    if model.bytes != {b: first + b for b in range(256)}:
        raise ValueError("the model's byte pieces do not follow each other")
    codes = lambda p: F.transform(F.split(F.regexp_replace(F.hex(F.encode(p, "UTF-8")), "(..)(?=.)", "$1 "), " "), lambda h: F.conv(h, 16, 10).cast("int") + first)
    return F.flatten(F.transform(done, lambda p: F.when(F.map_contains_key(edges, p), F.array(F.try_element_at(edges, p)["id"])).otherwise(codes(p))))


def dictionary(docs: DataFrame, model: Model, most_words: int = 100_000) -> dict[str, bytes]:
    """Ids of the corpus' `most_words` commonest words, counted over all documents: a bounded table that every task gets."""
    words = docs.select(F.explode(F.split("text", " ")).alias("w")).where((F.length("w") > 0) & (F.length("w") < 64) & ~F.col("w").contains(SPACE))
    top = words.groupBy("w").agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), "w").limit(most_words).select(F.concat(F.lit(SPACE), "w").alias("word"))
    found = lattice(common.stored(top, "words"), model, docs.sparkSession)
    return {r["word"]: np.array(r["ids"], dtype=np.uint32).tobytes() for r in found.toLocalIterator()}


def encode(docs: DataFrame, path: str, most_words: int = 100_000) -> DataFrame:
    """doc_id, ids (array of int) and decoded (the text that the ids give) of every whole text.

    Frequent words' ids come from the lattice, all others from the same merging in the task. Null and empty texts have no ids.
    Repeated rows are encoded each.
    """
    model = Model(path)
    known = docs.sparkSession.sparkContext.broadcast(dictionary(docs, model, most_words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, words = Model(path), known.value
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                ids = [np.frombuffer(own.encode(t.as_py() or "", words), dtype=np.uint32).astype(np.int32) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([own.decode(x) for x in ids])], names=["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of every document's ids, and of the text decoded from them, made where the ids are."""
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    model = Model(path)
    known = spark.sparkContext.broadcast(dictionary(docs, model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, words = Model(path), known.value
        for b in batches:
            n, crc, same = [], [], []
            for t in b.column(1):
                text = t.as_py() or ""
                packed = own.encode(text, words)
                n.append(len(packed) // 4)
                crc.append(zlib.crc32(packed))
                same.append(own.decode(np.frombuffer(packed, dtype=np.uint32)) == text)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(same, pa.bool_())], names=["doc_id", "n_ids", "ids_crc32", "round_trip"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_ids long, ids_crc32 long, round_trip boolean")
