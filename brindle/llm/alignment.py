"""Cross-tokenizer alignment: which tokens of a byte-level BPE and of a SentencePiece model overlap, and how often over a corpus.

Texts are cut into units, as a rule a space and what follows up to the next, whose edges neither tokenizer's tokens cross; a distinct unit is
aligned once for each memo. Pair keys are int64, the second tokenizer's id above the first's. Counts are summed in each task, sorted
globally by ranges, summed run by run, and written as sorted shards that later tasks map into memory and search.
"""

import hashlib
import json
import re
import tempfile
import uuid
from collections import Counter
from collections.abc import Iterator
from pathlib import Path
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .lexical import slices
from .tokens import byte_names

#: Fixed value: the byte-level vocabulary's own splitting.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
UNIT = re.compile(r"[ \n\t]*[^ \n\t]+|[ \n\t]+")
#: White space that some piece may hold together with other characters, and the mark that stands for a space: a text with one is one unit.
ODD = r"[\r\x0b\x0c\x1c-\x1f\x85\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}▁]"
#: Texts whose units are not simply what lies between single spaces.
LOOSE = r"^ |  | $"
#: Distinct units counted at once, characters of units aligned at once and of units remembered, names joined at once, pairs held in a task.
UNITS, AT_ONCE, MEMO, JOINED, PAIRS = 400_000, 250_000, 6_000_000, 1_000_000, 2_000_000


class Pair:
    """Two vocabularies: a is a byte-level BPE of the tokenizers library, b a SentencePiece model."""

    _open: dict[tuple[str, str], "Pair"] = {}

    def __init__(self, a_path: str, b_path: str):
        spec = json.loads(Path(a_path).read_text(encoding="utf-8"))
        names, vocab = byte_names(), spec["model"]["vocab"]
        special = {t["content"] for t in spec["added_tokens"]}
        raw = {bytes(names[c] for c in token): i for token, i in vocab.items() if token not in special}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        if [vocab[x + y] for x, y in merges] != list(range(256, 256 + len(merges))):
            raise ValueError("the merges' order is not that of their ids")
        self.a = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=raw, special_tokens={})
        self.a_length = np.zeros(max(raw.values()) + 1, dtype=np.int64)
        for token, i in raw.items():
            self.a_length[i] = len(token)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        plain = [not (self.b.is_control(i) or self.b.is_unknown(i) or self.b.is_byte(i)) for i in range(len(pieces))]
        if any(ok and len(p) > 1 and re.search("[^▁]▁|[\n\t]", p) for p, ok in zip(pieces, plain, strict=True)):
            raise ValueError("a piece of this model crosses units")
        self.b_raw = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() if ok else b"" for i, (p, ok) in enumerate(zip(pieces, plain, strict=True))]
        self.b_length = np.array([len(p) for p in self.b_raw], dtype=np.int64)

    @classmethod
    def open(cls, a_path: str, b_path: str) -> "Pair":
        if (a_path, b_path) not in cls._open:
            cls._open[a_path, b_path] = cls(a_path, b_path)
        return cls._open[a_path, b_path]


class Aligned:
    """The alignment of some units, one after the other. ok: both tokenizers give back the units' bytes.

    keys: of all links; links: where each unit's begin and end; sizes: each unit's tokens of a and b, groups and links; names: its groups.
    """

    def __init__(self, pair: Pair, units: list[str], named: bool = True):
        # texts of some units each, for they take the tokenizers longer at once; each with a first word, so that what comes next is as within a text
        texts = [" a" + "".join(units[i : i + 50]) for i in range(0, len(units), 50)]
        a = np.array(pair.a.encode_ordinary("".join(texts)), dtype=np.int64)
        b = np.concatenate([np.array(x, dtype=np.int64) for x in pair.b.encode([t[1:] for t in texts], num_threads=1)])
        a_end, b_end = np.cumsum(pair.a_length[a]), np.cumsum(pair.b_length[b])
        size = np.array([len(u.encode()) for u in units], dtype=np.int64)
        size[::50] += 2
        edges = np.concatenate(([0], np.cumsum(size)))
        begin = edges[:-1].copy()
        begin[::50] += 2
        shared = np.concatenate(([0], np.intersect1d(a_end, b_end, assume_unique=True)))
        self.ok = b"".join([pair.b_raw[i] for i in b.tolist()]) == "".join(texts).encode() and bool(np.isin(edges, shared).all() and np.isin(begin, shared).all())
        if not self.ok:
            return
        ends = np.union1d(a_end, b_end)
        own = ~np.isin(ends, begin[::50])  # a link ends there that isn't of the first words
        ends = ends[own]
        self.keys = b[np.searchsorted(b_end, ends)] << 32 | a[np.searchsorted(a_end, ends)]
        self.links = np.searchsorted(ends, edges, "right")
        spans = lambda x: np.searchsorted(x, edges[1:], "right") - np.searchsorted(x, begin, "right")
        self.sizes = np.stack([spans(a_end), spans(b_end), spans(shared), np.diff(self.links)], axis=1)
        if named:
            a_at, b_at = np.searchsorted(a_end, shared, "right").tolist(), np.searchsorted(b_end, shared, "right").tolist()
            sa, sb = list(map(str, a.tolist())), list(map(str, b.tolist()))
            names = [f"{sa[i]}|{sb[k]}" if j - i == 1 == m - k else f"{','.join(sa[i:j])}|{','.join(sb[k:m])}" for i, j, k, m in zip(a_at, a_at[1:], b_at, b_at[1:], strict=False)]
            self.names = [";".join(names[i:j]) for i, j in zip(np.searchsorted(shared, begin).tolist(), np.searchsorted(shared, edges[1:]).tolist(), strict=True)]


def aligned(pair: Pair, units: list[str], named: bool = True, alone: bool = False) -> Iterator[tuple[list[str], Aligned | None]]:
    """Units with their alignment; those that a tokenizer doesn't give back come with None. One of white space alone ends its text, so it is aligned alone."""
    work, some, size = [], [], 0
    for u in units:
        if alone or u.isspace():
            work.append([u])
            continue
        some.append(u)
        size += len(u)
        if size >= AT_ONCE:
            work.append(some)
            some, size = [], 0
    if some:
        work.append(some)
    while work:
        some = work.pop()
        got = Aligned(pair, some, named)
        if got.ok:
            yield some, got
        elif len(some) == 1:
            yield some, None
        else:
            work += [some[: len(some) // 2], some[len(some) // 2 :]]


def pieces(texts: pa.Array) -> Iterator[tuple[np.ndarray, list[str], np.ndarray, np.ndarray, bool]]:
    """rows, distinct units, codes of the rows' units one after the other, where each row's begin and end, and whether the texts are odd; empty texts are left out."""
    odd = pc.match_substring_regex(texts, ODD).to_numpy(zero_copy_only=False)
    loose = pc.match_substring_regex(texts, LOOSE).to_numpy(zero_copy_only=False) & ~odd
    full = pc.binary_length(texts).to_numpy(zero_copy_only=False) > 0
    rows = np.flatnonzero(full & ~odd & ~loose)
    if len(rows):
        words = pc.split_pattern(texts.take(pa.array(rows)), " ")
        coded = words.flatten().dictionary_encode()
        ends = words.offsets.to_numpy()
        yield rows, [" " + w for w in coded.dictionary.to_pylist()], coded.indices.to_numpy(), ends - ends[0], False
    for i in np.flatnonzero(full & (odd | loose)).tolist():
        text = " " + texts[i].as_py()
        found = UNIT.findall(text) if loose[i] else [text]
        place = {u: k for k, u in enumerate(dict.fromkeys(found))}
        yield np.array([i]), list(place), np.array([place[u] for u in found]), np.array([0, len(found)]), bool(odd[i])


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with their summed counts."""
    found, place = np.unique(keys, return_inverse=True)
    out = np.zeros(len(found), dtype=np.int64)
    np.add.at(out, place, counts)
    return found, out


def partial_counts(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """key and n: how many links of the task's texts hold a pair, a row a pair and task, or more if a task holds many pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, known, held = Pair.open(a_path, b_path), Counter(), [(np.zeros(0, dtype=np.int64),) * 2]

        def flush() -> None:
            for some, got in aligned(pair, list(known), named=False):
                if got is None:
                    raise ValueError("this model rewrites texts")
                held.append(summed(got.keys, np.repeat(np.array([known[u] for u in some], dtype=np.int64), np.diff(got.links))))
            known.clear()
            held[:] = [summed(*(np.concatenate(x) for x in zip(*held, strict=True)))]

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], names=["key", "n"])

        for b in batches:
            for _, texts in slices(b.column(0).cast(pa.large_string()).fill_null("")):
                for _, units, codes, _, odd in pieces(texts):
                    if odd:  # a text that doesn't come back has no tokens
                        held.extend(summed(got.keys, np.ones(len(got.keys), dtype=np.int64)) for _, got in aligned(pair, units, False, True) if got is not None)
                        continue
                    for u, n in zip(units, np.bincount(codes, minlength=len(units)).tolist(), strict=True):
                        known[u] += n
                if len(known) >= UNITS:
                    flush()
                if len(held[0][0]) >= PAIRS:
                    yield out()
                    held[:1] = [(np.zeros(0, dtype=np.int64),) * 2]
        flush()
        yield out()

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "key long, n long")


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """A folder's file system, and its path there. Besides local and mounted folders, what pyarrow knows (hdfs, s3, gs, abfs)."""
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    return (pafs.LocalFileSystem(), urlparse(uri).path) if uri.startswith("file:") else pafs.FileSystem.from_uri(uri)


class Shards:
    """Pair counts in sorted files of the shared folder: keys and then counts, as int64. found: (path, rows, first key, last key) of each."""

    def __init__(self, found: list[tuple[str, int, int, int]], best: np.ndarray):
        self.found, self.best = sorted(found, key=lambda x: x[2]), best
        self._open: dict[str, np.ndarray] = {}

    def __getstate__(self):
        return self.__dict__ | {"_open": {}}

    def mapped(self, path: str, rows: int) -> np.ndarray:
        """The two rows of a shard, mapped into memory. One that isn't in a mounted folder is copied first, and the copy has no name any more once it is mapped."""
        if path not in self._open:
            fs, name = file_system(path)
            if isinstance(fs, pafs.LocalFileSystem):
                self._open[path] = np.memmap(name, dtype=np.int64, mode="r", shape=(2, rows))
            else:
                with tempfile.NamedTemporaryFile() as copy, fs.open_input_stream(name) as source:
                    while block := source.read(1 << 24):
                        copy.write(block)
                    copy.flush()
                    self._open[path] = np.memmap(copy.name, dtype=np.int64, mode="r", shape=(2, rows))
        return self._open[path]

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """The counts of keys, all of which are there; shards without any of them are not opened."""
        wanted, place = np.unique(keys, return_inverse=True)
        out = np.zeros(len(wanted), dtype=np.int64)
        for path, rows, first, last in self.found:
            lo, hi = np.searchsorted(wanted, [first, last + 1])
            if lo < hi:
                data = self.mapped(path, rows)
                at = np.searchsorted(data[0], wanted[lo:hi])
                if not np.array_equal(data[0][at], wanted[lo:hi]):
                    raise KeyError("a pair that was not counted")
                out[lo:hi] = data[1][at]
        return out[place]


def count_shards(docs: DataFrame, a_path: str, b_path: str) -> Shards:
    """Counts all documents' pairs. The driver gets a row for each shard and each id of b, never the pairs."""
    spark = docs.sparkSession
    folder = common.new_path(spark, "pairs")
    fs, path = file_system(folder)
    fs.create_dir(path, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = [], []
        for b in batches:  # sorted, so that a run ends where the key changes
            key, n = b.column(0).to_numpy(), b.column(1).to_numpy()
            if not len(key):
                continue
            starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            runs, sums = key[starts], np.add.reduceat(n, starts)
            if keys and keys[-1][-1] == runs[0]:
                counts[-1][-1] += sums[0]
                runs, sums = runs[1:], sums[1:]
            if len(runs):
                keys.append(runs)
                counts.append(sums)
        if not keys:
            return
        keys, counts = np.concatenate(keys), np.concatenate(counts)
        name = f"{folder}/{uuid.uuid4().hex}"  # a name for each attempt; only those of attempts that succeed are told
        fs, path = file_system(name)
        with fs.open_output_stream(path) as sink:
            sink.write(keys.astype("<i8").tobytes())
            sink.write(counts.astype("<i8").tobytes())
        ids = keys >> 32
        starts = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
        most = np.maximum.reduceat(counts, starts)
        of = lambda first, rest: pa.array([first, *[None] * (len(starts) - 1)], rest)
        yield pa.RecordBatch.from_arrays([pa.array(ids[starts]), pa.array(most), of(name, pa.string()), of(len(keys), pa.int64()), of(int(keys[0]), pa.int64()), of(int(keys[-1]), pa.int64())], names=["b", "most", "path", "n", "first", "last"])

    counted = common.stored(partial_counts(docs, a_path, b_path), "counts")  # written, as ranges are sampled before they are dealt out
    ordered = counted.repartitionByRange("key").sortWithinPartitions("key")
    rows = ordered.mapInArrow(run, "b long, most long, path string, n long, first long, last long").collect()
    best = np.zeros(max((r["b"] for r in rows), default=0) + 1, dtype=np.int64)
    for r in rows:
        best[r["b"]] = max(best[r["b"]], r["most"])
    return Shards([(r["path"], r["n"], r["first"], r["last"]) for r in rows if r["path"]], best)


def pair_counts(spark: SparkSession, shards: Shards) -> DataFrame:
    """a, b and n of every pair, read from the shards in tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in b.column(0).to_pylist():
                data = shards.mapped(*shards.found[i][:2])
                for at in range(0, data.shape[1], 100_000):
                    key, n = np.array(data[:, at : at + 100_000])
                    yield pa.RecordBatch.from_arrays([pa.array(key & 0xFFFFFFFF), pa.array(key >> 32), pa.array(n)], names=["a", "b", "n"])

    return spark.range(len(shards.found)).mapInArrow(run, "a long, b long, n long")


class Memo:
    """What each unit adds to its document: tokens, groups, links, best links, the counts' sum, and its groups' names (None if it isn't given back).

    A worker keeps it from task to task for the same shards; it is cleared when it has grown to MEMO characters.
    """

    kept: "Memo | None" = None

    def __init__(self, pair: Pair, shards: Shards):
        self.pair, self.shards = pair, shards
        self.clear()

    @classmethod
    def of(cls, pair: Pair, shards: Shards) -> "Memo":
        if cls.kept is None or cls.kept.pair is not pair or cls.kept.shards.found != shards.found:
            cls.kept = cls(pair, shards)
        return cls.kept

    def clear(self) -> None:
        self.place, self.names, self.numbers, self.size = {}, [], np.zeros((0, 6), dtype=np.int64), 0

    def places(self, units: list[str], alone: bool = False) -> np.ndarray:
        """Where names and numbers of units are, until the next call."""
        new = [u for u in units if u not in self.place]
        if self.size and self.size + sum(map(len, new)) > MEMO:
            self.clear()
            new = units
        rows = [self.numbers]
        for some, got in aligned(self.pair, new, alone=alone):
            self.place |= {u: len(self.names) + i for i, u in enumerate(some)}
            self.size += sum(map(len, some))
            if got is None:
                self.names.append(None)
                rows.append(np.zeros((1, 6), dtype=np.int64))
                continue
            counts = self.shards.counts(got.keys)
            sums = [np.diff(np.concatenate(([0], np.cumsum(x)))[got.links]) for x in (counts == self.shards.best[got.keys >> 32], counts)]
            self.names += got.names
            rows.append(np.column_stack([got.sizes, *sums]))
        self.numbers = np.concatenate(rows)
        return np.array([self.place[u] for u in units], dtype=np.int64)


def align(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every document, over all documents' pair counts.

    Tokens of either tokenizer over a space and the text; groups end where tokens of both do; links are overlapping
    pairs. n_best counts the links whose pair is the commonest of its b id, and count_sum sums the pairs' counts. A null or empty text, or one
    that a tokenizer doesn't give back byte by byte, has zeros and ''. Each row stands for itself, also one that is there twice; ids
    may be null; no documents give no rows. Other columns are not read.
    """
    shards = count_shards(docs, a_path, b_path)
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo.of(Pair.open(a_path, b_path), shards)
        for b in batches:
            numbers, digests = np.zeros((b.num_rows, 6), dtype=np.int64), [""] * b.num_rows
            for start, texts in slices(b.column(1).cast(pa.large_string()).fill_null("")):
                for rows, units, codes, ends, odd in pieces(texts):
                    at = memo.places(units, odd)[codes]
                    sums = np.add.reduceat(memo.numbers[at], ends[:-1], axis=0)
                    for row, total, i, j in zip((start + rows).tolist(), sums, ends.tolist(), ends[1:].tolist(), strict=False):
                        told = [memo.names[x] for x in at[i : min(j, i + JOINED)].tolist()]
                        if None in told:
                            continue
                        digest = hashlib.sha256(";".join(told).encode())
                        for k in range(i + JOINED, j, JOINED):
                            digest.update((";" + ";".join([memo.names[x] for x in at[k : min(j, k + JOINED)].tolist()])).encode())
                        numbers[row], digests[row] = total, digest.hexdigest()
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, numbers.T.copy()), pa.array(digests)], names=["doc_id", *names, "groups_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id long, {', '.join(f'{n} long' for n in names)}, groups_sha256 string")


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's alignment of the two public vocabularies; nulls, repeats and empty tables: see align."""
    import public_tokenizers

    return align(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
