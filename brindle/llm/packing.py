"""Packing documents into fixed-length training sequences by bin completion."""

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .tokens import WordBpe

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, pid int, nth long"


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Token pieces of every whole text. A document's ids are followed by `end_id`; only longer ones are cut at `capacity`.

    A null or empty text is the single id `end_id`. A null doc_id stays null; repeated rows give repeated pieces.
    pid and nth number the pieces of each length within the task that made them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = WordBpe.open(tokenizer)
        pid, seen, end = TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64), np.uint32(end_id).tobytes()
        for batch in batches:
            cols: list[list] = [[] for _ in range(7)]
            docs_, texts = batch.column(0).to_pylist(), batch.column(1).fill_null("")
            for i, found in bpe.batches(texts):
                doc, ids = docs_[i], memoryview(found.tobytes() + end)
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    n = len(part) // 4
                    for col, v in zip(cols, (doc, k, at // 4, n, zlib.crc32(part), pid, int(seen[n])), strict=True):
                        col.append(v)
                    seen[n] += 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "pid", "nth"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)


class Completion:
    """Bin completion over a histogram of lengths: at most `capacity` numbers, whatever the corpus' size.

    Each step takes the largest length left, enumerates fillings of the room around it with the largest pieces first (so the
    dominating ones come first), prunes those that can't waste less than the best so far, and uses the winner as often as the
    counts allow. Best fit decreasing gives the incumbent; the completion with fewer bins wins.
    """

    def __init__(self, counts: dict[int, int], capacity: int, nodes: int = 4000):
        self.capacity, self.nodes = capacity, nodes
        self.counts = {int(k): int(v) for k, v in counts.items() if v > 0}
        total = sum(k * v for k, v in self.counts.items())
        self.bound = -(-total // capacity)

    def solve(self) -> list[tuple[dict[int, int], int]]:
        """[(filling: length -> how many, number of bins)], each piece of the histogram in exactly one bin."""
        best = self._run(exact=False)
        if self._bins(best) > self.bound:
            best = min(best, self._run(exact=True), key=self._bins)
        return best

    @staticmethod
    def _bins(plan: list[tuple[dict[int, int], int]]) -> int:
        return sum(n for _, n in plan)

    def _run(self, exact: bool) -> list[tuple[dict[int, int], int]]:
        left = np.zeros(self.capacity + 1, dtype=np.int64)
        for k, v in self.counts.items():
            left[k] = v
        plan = []
        while (there := np.flatnonzero(left)).size:
            top = int(there[-1])
            left[top] -= 1
            filling = self._fill(left, self.capacity - top, exact)
            left[top] += 1
            filling[top] = filling.get(top, 0) + 1
            n = min(int(left[k]) // need for k, need in filling.items())
            for k, need in filling.items():
                left[k] -= need * n
            plan.append((filling, n))
        return plan

    def _fill(self, left: np.ndarray, room: int, exact: bool) -> dict[int, int]:
        """The filling of `room` with least waste; among equals the one with the largest pieces."""
        first: dict[int, int] = {}  # best fit decreasing: the incumbent
        r = room
        while r and (fit := np.flatnonzero(left[: r + 1])).size:
            k = int(fit[-1])
            n = min(int(left[k]) - first.get(k, 0), r // k)
            if n <= 0:
                lower = [int(x) for x in fit[:-1] if left[x] > first.get(int(x), 0)]
                if not lower:
                    break
                k = lower[-1]
                n = min(int(left[k]) - first.get(k, 0), r // k)
            first[k] = first.get(k, 0) + n
            r -= n * k
        if not exact or r == 0:
            return first
        best, waste, budget = first, r, self.nodes
        stack: list[tuple[int, int, dict[int, int]]] = [(room, room, {})]
        while stack and waste and budget:
            budget -= 1
            r, most, used = stack.pop()
            fit = np.flatnonzero(left[: min(r, most) + 1])
            if r < waste:
                best, waste = used, r
            again = []
            for k in map(int, fit[::-1][:24]):  # larger ones dominate; the search goes on below them within the node budget
                if used.get(k, 0) < left[k]:
                    rest = r - k
                    if rest and rest <= k and left[rest] > used.get(rest, 0) + (rest == k):
                        return {**used, k: used.get(k, 0) + 1} | {rest: used.get(rest, 0) + 1 + (rest == k)}
                    again.append((rest, k, {**used, k: used.get(k, 0) + 1}))
            stack.extend(reversed(again))
        return best


def slots(plan: list[tuple[dict[int, int], int]]) -> dict[int, list[tuple[int, int, int, int]]]:
    """Of each length, in order of rank: (first rank, first bin, pieces a bin, offset of the first in a bin)."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    first = 0
    for filling, n in plan:
        at = 0
        for k in sorted(filling, reverse=True):
            out.setdefault(k, []).append((used.get(k, 0), first, filling[k], at))
            used[k] = used.get(k, 0) + n * filling[k]
            at += k * filling[k]
        first += n
    return out


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Place every piece of every document in a sequence of at most `capacity` tokens, gapless from 0.

    Texts are tokenised once; only piece lengths go on. The driver sees a histogram of at most `capacity` numbers. A piece's
    rank among those of its length is its number within the task that made it plus the count of the tasks before, so a
    length that a third of all pieces share is never gathered. An empty table gives an empty result.
    """
    made = common.stored(pieces(docs, tokenizer, capacity, end_id), "pieces")
    tally = made.groupBy("length", "pid").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in made.groupBy("length").agg(F.count("*").alias("n")).collect()}
    where = slots(Completion(counts, capacity).solve())
    tables = {k: np.array(v, dtype=np.int64) for k, v in where.items()}
    before = tally.select("length", "pid", (F.sum("n").over(Window.partitionBy("length").orderBy("pid")) - F.col("n")).alias("before"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("rank").to_numpy(zero_copy_only=False)
            seq, off = np.zeros(len(length), dtype=np.int64), np.zeros(len(length), dtype=np.int64)
            for k in np.unique(length):
                mine, t = length == k, tables[int(k)]
                row = t[np.searchsorted(t[:, 0], rank[mine], side="right") - 1]
                nth = rank[mine] - row[:, 0]
                seq[mine] = row[:, 1] + nth // row[:, 2]
                off[mine] = row[:, 3] + nth % row[:, 2] * k
            keep = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(seq), pa.array(off)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = made.join(before, ["length", "pid"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("nth") + F.col("before")).alias("rank"))
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every piece of every document. A null or empty text is one piece of one id, a null id stays null, each of repeated rows has pieces of its own, and an empty table gives no rows. Other columns are not read."""
    import public_tokenizers

    return pack(common.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
