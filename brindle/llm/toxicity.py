"""Toxicity: a second-order factorization machine over hashed terms."""

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

TERM = re.compile(r"[^\W_]+")
BUCKETS = 1 << 18
BEGINNINGS = (3, 4, 5, 6, 7)


class Terms:
    """Hash buckets of a text's distinct lower-case words and of their beginnings, which inflected words share; a memo spares hashing a word again."""

    def __init__(self, most: int = 300_000):
        self.memo: dict[str, tuple[int, ...]] = {}
        self.most = most

    def __call__(self, text: str) -> np.ndarray:
        memo = self.memo
        if len(memo) > self.most:
            memo.clear()
        out: set[int] = set()
        for w in set(TERM.findall(text.lower())):
            h = memo.get(w)
            if h is None:
                parts = (w, *(f"{w[:k]}~" for k in BEGINNINGS if len(w) > k))
                h = tuple(zlib.crc32(p.encode("utf-8", "surrogatepass")) % BUCKETS for p in parts)
                if len(w) < 64:
                    memo[w] = h
            out.update(h)
        return np.sort(np.fromiter(out, dtype=np.int64, count=len(out)))


@dataclass
class FactorizationMachine:
    """y = sigmoid(w0 + sum of w_j + sum over pairs j < k of <v_j, v_k>) over the buckets present in a text.

    Learned by AdaGrad on minibatches of the logistic loss. Only buckets that the training rows show to go with either label
    (by chi-square) have weights; the others are 0. So a pair of terms, such as an insult and a group's name, counts beyond
    what the terms do alone.
    """

    factors: int = 8
    epochs: int = 12
    rate: float = 0.1
    shrink: float = 1e-4
    seed: int = 7
    w0: float = 0.0
    slot: np.ndarray | None = None
    w: np.ndarray | None = None
    v: np.ndarray | None = None

    def fit(self, rows: list[np.ndarray], y: np.ndarray, chosen: np.ndarray) -> "FactorizationMachine":
        """rows: of each text the positions in `chosen`, the sorted buckets that have weights."""
        rng = np.random.default_rng(self.seed)
        self.slot = np.full(BUCKETS, -1, dtype=np.int32)
        self.slot[chosen] = np.arange(len(chosen))
        self.w, self.v = np.zeros(len(chosen) + 1), rng.normal(0, 0.01, (len(chosen) + 1, self.factors))
        share = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.5
        self.w0 = float(np.log(share / (1 - share)))
        if len(np.unique(y)) < 2 or not len(chosen):
            self.v[:] = 0
            return self
        gw, gv, g0 = np.full(self.w.shape, 1e-6), np.full(self.v.shape, 1e-6), 1e-6
        for _ in range(self.epochs):
            order = rng.permutation(len(y))
            for part in np.split(order, range(256, len(order), 256)):
                ids = np.concatenate([rows[i] for i in part])
                doc = np.repeat(np.arange(len(part)), [len(rows[i]) for i in part])
                f, s = self._raw(ids, doc, len(part))
                err = 1 / (1 + np.exp(-f)) - y[part]
                step = err.sum()
                g0 += step * step
                self.w0 -= self.rate * step / np.sqrt(g0)
                used, back = np.unique(ids, return_inverse=True)
                e = err[doc]
                dw = np.bincount(back, e, len(used)) + self.shrink * len(part) * self.w[used]
                one = e[:, None] * (s[doc] - self.v[ids])
                dv = np.stack([np.bincount(back, one[:, k], len(used)) for k in range(self.factors)], axis=1) + self.shrink * len(part) * self.v[used]
                gw[used] += dw * dw
                gv[used] += dv * dv
                self.w[used] -= self.rate * dw / np.sqrt(gw[used])
                self.v[used] -= self.rate * dv / np.sqrt(gv[used])
        return self

    def _raw(self, ids: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        v = self.v[ids]
        s = np.stack([np.bincount(doc, v[:, k], n) for k in range(self.factors)], axis=1)
        return self.w0 + np.bincount(doc, self.w[ids] - 0.5 * (v * v).sum(1), n) + 0.5 * (s * s).sum(1), s

    def scores(self, terms: list[np.ndarray]) -> np.ndarray:
        known = [x[x >= 0] for x in (self.slot[t] for t in terms)]
        ids = np.concatenate([*known, np.zeros(0, dtype=np.int32)]).astype(np.int64)
        doc = np.repeat(np.arange(len(known)), [len(k) for k in known])
        return 1 / (1 + np.exp(-self._raw(ids, doc, len(known))[0]))


def _hashed(df: DataFrame) -> DataFrame:
    """text, y -> y and the text's distinct buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms()
        for b in batches:
            ids = pa.array([terms(t.as_py() or "").astype(np.int32) for t in b.column("text")], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column("y"), ids], names=["y", "ids"])

    return df.mapInArrow(run, "y int, ids array<int>")


def fit(docs: DataFrame, labels: DataFrame, label: str, train: F.Column, most: int = 20_000, terms_kept: int = 4096, least: int = 5, **options: float) -> FactorizationMachine:
    """Fit on at most `most` labelled rows (a bounded sample), chosen by a hash of doc_id.

    Spark counts, for each of the BUCKETS, in how many texts of either label it is; the `terms_kept` with the largest
    chi-square of those in at least `least` texts get weights. What comes to the driver is bounded by BUCKETS and by
    `most` times the kept buckets in a text.
    """
    rows = common.stored(_hashed(common.labelled_sample(docs, labels, label, train, most)), "terms")
    base = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("pos")).first()
    found = rows.select("y", F.explode("ids").alias("id")).groupBy("id").agg(F.count("*").alias("n"), F.sum("y").alias("pos")).where(F.col("n") >= least).toPandas()
    n, pos, total, share = found["n"].to_numpy(float), found["pos"].to_numpy(float), base["n"], base["pos"] / max(base["n"], 1)
    expected = n * share
    chi = (pos - expected) ** 2 / np.maximum(expected * (1 - share) * (1 - n / max(total, 1)), 1e-9)
    chosen = np.sort(found["id"].to_numpy(np.int64)[np.argsort(-chi, kind="stable")[:terms_kept]])
    keep = F.array_intersect("ids", F.lit(chosen.tolist()).cast("array<int>")) if len(chosen) else F.array().cast("array<int>")
    data = rows.select("y", keep.alias("ids")).toPandas()
    return FactorizationMachine(**options).fit([np.searchsorted(chosen, np.array(x, dtype=np.int64)) for x in data["ids"]], data["y"].to_numpy(float), chosen)


def classify(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 4, held: int = 2, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of every document; labels of held-out ids are never read.

    Null texts count as empty, repeated rows are scored each, an empty documents table gives an empty result; without labels
    each score is 0.5.
    """
    docs = docs.select("doc_id", "text")
    model = fit(docs, labels, label, common.fold("doc_id", folds) != held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.scores([terms(t.as_py() or "") for t in b.column(1)]))], names=["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", (common.fold("doc_id", folds) == held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity score by a model learnt from the labelled rows outside the fold. A null or empty text has a score too, a null id falls in the fold of empty text, each of repeated rows is scored, an empty table gives no rows, and no labels give 0.5."""
    return classify(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
