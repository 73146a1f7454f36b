"""Document quality: a generalised additive model with pairwise interactions."""

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Frequent function words of the corpus' languages: fixed values.
FUNCTION_WORDS = frozenset(
    "the of and to in is it that for on as with be by this are was not or an der die das und zu den von mit sich auf ist nicht ein eine im dem le la les de des et en un une que qui dans pour sur par est el los las del se por con una para su al lo como".split()
)
ODD_END = re.compile(r"[^\w\s.,;:!?)\"'»\]]{2,}(?=\s|$)|[!?]{2,}")
FEATURES = (
    "log_bytes", "letter", "upper", "digit", "space", "newline", "punctuation", "symbol", "non_ascii", "pipe", "bang", "log_words", "word_length",
    "distinct_words", "function_words", "one_letter", "odd_ends", "log_lines", "line_length", "distinct_lines", "short_lines", "caps_words", "ended_lines", "top_word",
)


def features(text: str) -> list[float]:
    """Measures of a whole text, in the order of FEATURES. An empty text has zeros."""
    raw = text.encode("utf-8", "surrogatepass")
    n = len(raw) or 1
    c = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    upper, lower, digit = int(c[65:91].sum()), int(c[97:123].sum()), int(c[48:58].sum())
    space, newline, high = int(c[32] + c[9]), int(c[10] + c[13]), int(c[128:].sum())
    marks = int(c[[33, 34, 39, 40, 41, 44, 45, 46, 58, 59, 63]].sum())
    symbols = n - upper - lower - digit - space - newline - high - marks if raw else 0
    words = text.split()
    k = len(words) or 1
    seen: dict[str, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    known = sum(v for w, v in seen.items() if w.lower() in FUNCTION_WORDS)
    caps = sum(v for w, v in seen.items() if len(w) > 1 and w.isupper())
    ones = sum(v for w, v in seen.items() if len(w) == 1)
    lines = [x for x in text.split("\n") if x]
    m = len(lines) or 1
    ended = sum(x[-1] in ".!?:\"'" for x in lines)
    odd = len(ODD_END.findall(text))
    return [
        np.log1p(len(raw)), (upper + lower) / n, upper / (upper + lower or 1), digit / n, space / n, newline / n, marks / n, symbols / n, high / n, c[124] / n, c[33] / n, np.log1p(len(words)), sum(map(len, words)) / k,
        len(seen) / k, known / k, ones / k, odd / k, np.log1p(len(lines)), len(text) / m, len(set(lines)) / m, sum(len(x) < 20 for x in lines) / m, caps / k, ended / m, max(seen.values(), default=0) / k,
    ]


@dataclass
class AdditiveModel:
    """score = sigmoid(intercept + a lookup table for each feature + one for each chosen pair of features).

    The tables are learned by cyclic boosting: in turn, every feature gets a tree of three leaves fitted to the logistic
    gradient over its bins, scaled by `rate`; then the pairs that reduce the remaining gradient most get trees of four
    leaves. A feature's trees add up to its table, so that scoring is one addition a bin. With one class only, or no
    rows, the model is the smoothed share of label 1.
    """

    bins: int = 32
    coarse: int = 8
    rounds: int = 150
    pair_rounds: int = 60
    pairs_kept: int = 10
    rate: float = 0.15
    decay: float = 1.0
    intercept: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    grids: list[np.ndarray] = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray) -> "AdditiveModel":
        share = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.5
        self.intercept = float(np.log(share / (1 - share)))
        d = x.shape[1]
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(d)]
        self.tables = [np.zeros(self.bins) for _ in range(d)]
        if len(np.unique(y)) < 2:
            return self
        b = self.binned(x)
        f = np.full(len(y), self.intercept)
        for _ in range(self.rounds):
            for j in range(d):
                p = 1 / (1 + np.exp(-f))
                step = self.rate * self._leaves(np.bincount(b[:, j], y - p, self.bins), np.bincount(b[:, j], p * (1 - p), self.bins))
                self.tables[j] += step
                f += step[b[:, j]]
        p = 1 / (1 + np.exp(-f))
        g, h, q = y - p, p * (1 - p), b * self.coarse // self.bins
        gains = sorted(((self._gain(q[:, i], q[:, j], g, h), i, j) for i in range(d) for j in range(i)), reverse=True)
        self.pairs = [(i, j) for _, i, j in gains[: self.pairs_kept]]
        self.grids = [np.zeros((self.coarse, self.coarse)) for _ in self.pairs]
        for _ in range(self.pair_rounds):
            for (i, j), grid in zip(self.pairs, self.grids, strict=True):
                p = 1 / (1 + np.exp(-f))
                at = q[:, i] * self.coarse + q[:, j]
                step = self.rate * self._quarters(np.bincount(at, y - p, self.coarse**2), np.bincount(at, p * (1 - p), self.coarse**2))
                grid += step
                f += step[q[:, i], q[:, j]]
        return self

    def _leaves(self, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        """The best tree of at most three leaves over the bins: the best cut, then the best cut of either side."""
        cuts = [0, len(g)]
        for _ in range(2):
            best = (0.0, -1)
            for a, b in zip(cuts, cuts[1:], strict=False):
                gs, hs = np.cumsum(g[a:b]), np.cumsum(h[a:b])
                if b - a > 1:
                    gl, hl = gs[:-1], hs[:-1]
                    gain = gl**2 / (hl + self.decay) + (gs[-1] - gl) ** 2 / (hs[-1] - hl + self.decay) - gs[-1] ** 2 / (hs[-1] + self.decay)
                    k = int(np.argmax(gain))
                    best = max(best, (float(gain[k]), a + k + 1))
            if best[1] > 0:
                cuts = sorted([*cuts, best[1]])
        out = np.zeros(len(g))
        for a, b in zip(cuts, cuts[1:], strict=False):
            out[a:b] = g[a:b].sum() / (h[a:b].sum() + self.decay)
        return out

    def _corners(self, s: np.ndarray) -> list[np.ndarray]:
        """Sums of the four quarters for each cut of a grid."""
        c = s.reshape(self.coarse, self.coarse).cumsum(0).cumsum(1)
        a, rows, cols, all_ = c[:-1, :-1], c[:-1, -1:], c[-1:, :-1], c[-1, -1]
        return [a, rows - a, cols - a, all_ - rows - cols + a]

    def _gain(self, i: np.ndarray, j: np.ndarray, g: np.ndarray, h: np.ndarray) -> float:
        at = i * self.coarse + j
        gs, hs = self._corners(np.bincount(at, g, self.coarse**2)), self._corners(np.bincount(at, h, self.coarse**2))
        return float(sum(a**2 / (b + self.decay) for a, b in zip(gs, hs, strict=True)).max())

    def _quarters(self, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        gs, hs = self._corners(g), self._corners(h)
        gain = sum(a**2 / (b + self.decay) for a, b in zip(gs, hs, strict=True))
        r, c = np.unravel_index(int(np.argmax(gain)), gain.shape)
        leaf = [gs[k][r, c] / (hs[k][r, c] + self.decay) for k in range(4)]
        out = np.empty((self.coarse, self.coarse))
        out[: r + 1, : c + 1], out[: r + 1, c + 1 :], out[r + 1 :, : c + 1], out[r + 1 :, c + 1 :] = leaf
        return out

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1) if len(x) else np.zeros((0, x.shape[1]), dtype=int)

    def scores(self, x: np.ndarray) -> np.ndarray:
        b = self.binned(x)
        f = np.full(len(x), self.intercept)
        for j, t in enumerate(self.tables):
            f += t[b[:, j]]
        q = b * self.coarse // self.bins
        for (i, j), grid in zip(self.pairs, self.grids, strict=True):
            f += grid[q[:, i], q[:, j]]
        return 1 / (1 + np.exp(-f))


def measured(df: DataFrame) -> DataFrame:
    """The features of each `text`, beside the other columns of df (which must not be named `x`)."""
    kinds = df.drop("text").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = pa.array([features(t.as_py() or "") for t in b.column("text")], pa.list_(pa.float64()))
            rest = [n for n in b.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in rest), x], names=[*rest, "x"])

    return df.mapInArrow(run, kinds.add("x", T.ArrayType(T.DoubleType())))


def fit(docs: DataFrame, labels: DataFrame, label: str, train: F.Column, most: int = 20_000, **options: float) -> AdditiveModel:
    """Fit on at most `most` labelled rows (a bounded sample), chosen by a hash of doc_id."""
    rows = measured(common.labelled_sample(docs, labels, label, train, most)).toPandas()
    x = np.array(rows["x"].tolist(), dtype=float).reshape(len(rows), len(FEATURES))
    return AdditiveModel(**options).fit(x, rows["y"].to_numpy(dtype=float))


def score(docs: DataFrame, model: AdditiveModel, text: str = "text", out: str = "score") -> DataFrame:
    """docs with the probability of label 1 as column `out`; every whole text, null as empty."""
    if out in docs.columns:
        raise ValueError(f"column {out} is there already")
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.schema.get_field_index(text))
            x = np.array([features(t.as_py() or "") for t in texts], dtype=float).reshape(b.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(model.scores(x))], names=[*names, out])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields]).add(out, T.DoubleType()))


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 5, held: int = 0, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of every document; labels of held-out ids are never read.

    Repeated rows are scored each; an empty documents table gives an empty result; without labels each score is 0.5.
    """
    docs = docs.select("doc_id", "text")
    model = fit(docs, labels, label, common.fold("doc_id", folds) != held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([features(t.as_py() or "") for t in b.column(1)], dtype=float).reshape(b.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.scores(x))], names=["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", (common.fold("doc_id", folds) == held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score by a model learnt from the labelled rows outside the fold. A null or empty text has a score too, a null id falls in the fold of empty text, each of repeated rows is scored, an empty table gives no rows, and no labels give 0.5."""
    return classify(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
