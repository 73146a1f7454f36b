"""Removal of long byte strings that occur more than once: sparse prefix doubling.

Every string of `span` bytes names one anchor inside itself: the leftmost start of its least-hashed gram of `gram` bytes. Equal strings
name the same place, so only anchors have to be ranked, about 2 in `span - gram` positions, instead of every byte. Ranks grow
over longer and longer content, as in prefix doubling, and what is unique drops out at each step:

1. the gram at the anchor (a first rank): anchors whose gram occurs once are done;
2. the gram with everything that the anchor's strings cover (from the first start to the last end): anchors whose context
   occurs again are repeated as a whole, and one of each class goes on, if its gram has other contexts too;
3. blocks of neighbouring strings, by the core that all of a block's strings share: blocks whose core is unique drop out, and
   blocks with equal cores and equal sides are repeated as a whole;
4. every single string of the blocks that are left, by 128 bits of hashes of its core and what it has beside the core.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .near_dup import BYTE, mix

PART = 1 << 18
BLOCK = 16
MASK = np.uint64((1 << 21) - 1)
BASES = (0x9E3779B97F4A7C15 | 1, 0xD1342543DE82EF95 | 1)
TABLES = (BYTE, mix(np.arange(256, dtype=np.uint64), 2))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers_of(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    if which not in _powers or len(_powers[which][0]) < n:
        out = []
        for b in (BASES[which], pow(BASES[which], -1, 2**64)):
            p = np.full(1 << max(12, (n - 1).bit_length()), b, dtype=np.uint64)
            p[0] = 1
            with np.errstate(over="ignore"):
                out.append(np.multiply.accumulate(p))
        _powers[which] = (out[0], out[1])
    up, down = _powers[which]
    return up[:n], down[:n]


class Rolling:
    """Hashes of any substring of a text of bounded length."""

    def __init__(self, raw: np.ndarray, which: int):
        up, self.down = _powers_of(which, len(raw) + 1)
        self.total = np.zeros(len(raw) + 1, dtype=np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(TABLES[which][raw] * up[:-1], out=self.total[1:])

    def of(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.total[last] - self.total[first]) * self.down[first])

    def all(self, n: int) -> np.ndarray:
        """Of every substring of n bytes, not mixed: the high bits are those to compare."""
        with np.errstate(over="ignore"):
            return (self.total[n:] - self.total[:-n]) * self.down[: len(self.total) - n]


def sliding_least(x: np.ndarray, w: int) -> np.ndarray:
    """The minimum of every w neighbours, by block-wise running minima from both sides."""
    n = len(x) - w + 1
    pad = -len(x) % w
    y = np.concatenate((x, np.full(pad, np.uint64(2**64 - 1), dtype=np.uint64))).reshape(-1, w)
    ahead = np.minimum.accumulate(y, axis=1).ravel()
    back = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


def anchors_of(raw: np.ndarray, span: int, gram: int) -> tuple[np.ndarray, ...]:
    """Of each anchor: its gram's hash, its context's hash, its place, and the first and last start of the strings that name it."""
    parts = []
    for at in range(0, max(len(raw) - span + 1, 0), PART):
        piece = raw[at : at + PART + span - 1]
        one, two = Rolling(piece, 0), Rolling(piece, 1)
        grams = one.all(gram)
        packed = (grams & ~MASK) | np.arange(len(grams), dtype=np.uint64)
        named = (sliding_least(packed, span - gram + 1) & MASK).astype(np.int64)
        edge = np.flatnonzero(named[1:] != named[:-1]) + 1
        first, last = np.concatenate(([0], edge)), np.concatenate((edge, [len(named)])) - 1
        place = named[first]
        with np.errstate(over="ignore"):
            context = mix(two.of(first, last + span) + mix(((place - first) * 4096 + (place - last)).astype(np.uint64), 3))
        parts.append((mix(grams[place]).astype(np.int64), context.astype(np.int64), place + at, first + at, last + at))
    if not parts:
        return (np.zeros(0, dtype=np.int64),) * 5
    return tuple(np.concatenate(p) for p in zip(*parts, strict=True))


def _keyed(docs: DataFrame, *more: str, wide: bool = False) -> DataFrame:
    """did, th, raw: a document's identity and bytes, so that null or repeated ids do no harm; rows with both equal have equal texts. wide: by a hash of id and text, where (doc_id, th) doesn't tell texts apart."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    hashed = F.xxhash64(F.col("doc_id").cast("long"), text)
    did = hashed if wide else F.coalesce(F.col("doc_id").cast("long"), hashed)
    th = F.hash(text, F.col("doc_id").isNull())
    return docs.select(did.alias("did"), th.alias("th"), text.cast("binary").alias("raw"), *more)


def ambiguous(docs: DataFrame) -> bool:
    """Whether rows with one doc_id and different texts share a text hash of 32 bits, as in tables that repeat an id very often."""
    told = _keyed(docs).select("did", "th", F.xxhash64("raw", F.length("raw")).alias("h"))
    return not told.groupBy("did", "th").agg(F.min("h").alias("a"), F.max("h").alias("z")).where("a <> z").isEmpty()


ANCHORS = "did long, th int, gram long, context long, place int, first int, last int"


def anchors(docs: DataFrame, span: int, gram: int, wide: bool = False) -> DataFrame:
    """One row for each anchor of each document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [anchors_of(np.frombuffer(t.as_py(), dtype=np.uint8), span, gram) for t in b.column(2)]
            n = [len(x[0]) for x in found]
            cols = [np.repeat(b.column(k).to_numpy(), n) for k in (0, 1)] + [np.concatenate([x[k] for x in found] or [np.zeros(0, dtype=np.int64)]) for k in range(5)]
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c).cast(k) for c, k in zip(cols, kinds, strict=True)], names=["did", "th", "gram", "context", "place", "first", "last"])

    return _keyed(docs, wide=wide).mapInArrow(run, ANCHORS)


def blocks(listed: DataFrame, span: int) -> DataFrame:
    """Blocks of up to BLOCK neighbouring strings of the listed anchors, cut at fixed distances before the anchor.

    All strings of a block share its core, of which two hashes are given. String i of a block is the last i bytes before the core
    (of `before`), the core, and the first BLOCK - 1 - i bytes behind it (of `behind`); those from lo to hi belong to the anchor,
    and string i starts at `at` - i.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide = BLOCK - 1
        around = np.arange(wide)
        for b in batches:
            for did, th, raw, ranges in zip(b.column("did").to_pylist(), b.column("th").to_pylist(), b.column("raw"), b.column("ranges"), strict=True):
                whole = np.frombuffer(raw.as_py(), dtype=np.uint8)
                padded = np.concatenate((np.zeros(wide, dtype=np.uint8), whole, np.zeros(wide, dtype=np.uint8)))
                fields = ranges.values if hasattr(ranges, "values") else pa.array([])
                place, first, last = (fields.field(k).to_numpy().astype(np.int64) for k in ("place", "first", "last"))
                alone = fields.field("alone").to_numpy(zero_copy_only=False)
                low, high = (place - last) // BLOCK, (place - first) // BLOCK
                n = high - low + 1
                which = np.repeat(np.arange(len(place)), n)
                k = np.repeat(low - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
                at = place[which] - BLOCK * k
                lo, hi = np.maximum(at - last[which], 0), np.minimum(at - first[which], wide)
                end = at - wide + span
                h1, h2 = np.empty(len(at), dtype=np.uint64), np.empty(len(at), dtype=np.uint64)
                for part in np.unique(at // PART):
                    mine = at // PART == part
                    piece, shift = whole[part * PART : (part + 1) * PART + span], part * PART
                    h1[mine], h2[mine] = Rolling(piece, 0).of(at[mine] - shift, end[mine] - shift), Rolling(piece, 1).of(at[mine] - shift, end[mine] - shift)
                with np.errstate(over="ignore"):
                    h1, h2 = mix(h1 + k.astype(np.uint64)), mix(h2 ^ k.astype(np.uint64))
                before, behind = (pa.FixedSizeBinaryArray.from_buffers(pa.binary(wide), len(at), [None, pa.py_buffer(padded[x[:, None] + around].tobytes())]).cast(pa.binary()) for x in (at, end + wide))
                cols = [pa.array(np.full(len(at), did, dtype=np.int64)), pa.array(np.full(len(at), th, dtype=np.int32)), *(pa.array(x.astype(np.int64)) for x in (h1, h2)), *(pa.array(x.astype(np.int32)) for x in (at, lo, hi)), before, behind, pa.array(alone[which])]
                yield pa.RecordBatch.from_arrays(cols, names=["did", "th", "h1", "h2", "at", "lo", "hi", "before", "behind", "alone"])

    return listed.select("did", "th", "raw", "ranges").mapInArrow(run, "did long, th int, h1 long, h2 long, at int, lo int, hi int, before binary, behind binary, alone boolean")


def repeated_ranges(docs: DataFrame, span: int = 200, gram: int = 50, wide: bool = False) -> DataFrame:
    """did, th, ranges: of each document with repeated strings, an array of (first start, last start) of those, unordered."""
    found = common.stored(anchors(docs, span, gram, wide), "anchors")
    ranks = found.groupBy("gram").agg(F.count("*").alias("n"), F.min("context").alias("lo"), F.max("context").alias("hi")).where("n > 1")
    # what a hot key joins with is written first: a join of two plain shuffles is one that adaptive execution splits
    ranks = common.stored(ranks.select("gram", (F.col("lo") == F.col("hi")).alias("pure")), "grams")
    again = common.stored(found.join(common.merged(ranks), "gram"), "ranks")
    ranges = ["did", "th", "first", "last"]
    pure = again.where("pure").select(*ranges)
    rest = again.where("NOT pure")
    classes = common.stored(rest.groupBy("gram", "context").agg(F.count("*").alias("n"), F.min(F.struct(*ranges, "place")).alias("one")), "contexts")
    whole = rest.join(common.merged(classes.where("n > 1").select("gram", "context")), ["gram", "context"]).select(*ranges)
    per_text = classes.groupBy("one.did", "one.th").agg(F.collect_list(F.struct("one.place", "one.first", "one.last", (F.col("n") == 1).alias("alone"))).alias("ranges"))
    each = common.stored(blocks(_keyed(docs, wide=wide).join(common.merged(per_text), ["did", "th"]).dropDuplicates(["did", "th"]), span).withColumn("sides", _sides()), "blocks")
    # a block whose core is unique has no repeated string; one whose core and sides occur again has only such
    cores = each.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("sides").alias("a"), F.max("sides").alias("z")).where("n > 1").select("h1", "h2", (F.col("a") == F.col("z")).alias("same"))
    cores = common.stored(cores, "cores")
    shared = common.stored(each.join(common.merged(cores), ["h1", "h2"]), "shared")
    starts = lambda d: d.select("did", "th", (F.col("at") - F.col("hi")).alias("first"), (F.col("at") - F.col("lo")).alias("last"))
    mixed = shared.where("NOT same")
    kinds = common.stored(mixed.groupBy("h1", "h2", "sides").agg(F.count("*").alias("n"), F.min(F.struct("did", "th", "at", "lo", "hi", "before", "behind", "alone")).alias("one")), "sides")
    equal = mixed.where("alone").join(common.merged(kinds.where("n > 1").select("h1", "h2", "sides")), ["h1", "h2", "sides"])
    single = kinds.select("h1", "h2", "one.*", "n").select("*", F.explode(F.sequence("lo", "hi")).alias("i"))
    left, right = F.substring("before", BLOCK - F.col("i"), F.col("i")), F.substring("behind", F.lit(1), BLOCK - 1 - F.col("i"))
    single = single.select("did", "th", (F.col("at") - F.col("i")).alias("first"), (F.col("alone") & (F.col("n") == 1)).alias("alone"), F.xxhash64("h1", "i", left, right).alias("w1"), F.xxhash64("h2", right, left, "i").alias("w2"))
    twice = single.groupBy("w1", "w2").agg(F.count("*").alias("n")).where("n > 1").select("w1", "w2")
    last = single.where("alone").join(common.merged(twice), ["w1", "w2"]).select("did", "th", "first", F.col("first").alias("last"))
    every = pure.unionByName(whole).unionByName(starts(shared.where("same AND alone"))).unionByName(starts(equal)).unionByName(last)
    return every.groupBy("did", "th").agg(F.collect_set(F.struct("first", "last")).alias("ranges"))  # equal rows have equal ranges


def _sides() -> F.Column:
    """A hash of what a block's own strings have beside the core."""
    left, right = F.substring("before", BLOCK - F.col("hi"), F.col("hi")), F.substring("behind", F.lit(1), BLOCK - 1 - F.col("lo"))
    return F.xxhash64("lo", "hi", left, right)


def spans_of(ranges: list[dict] | None, span: int) -> list[tuple[int, int]]:
    """Maximal covered byte runs of ranges of starts."""
    out: list[tuple[int, int]] = []
    for a, z in sorted((r["first"], r["last"] + span) for r in ranges or ()):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(z, out[-1][1]))
        else:
            out.append((a, z))
    return out


def deduplicate(docs: DataFrame, span: int = 200, gram: int = 50) -> DataFrame:
    """doc_id, n_bytes, spans (array of byte runs removed) and kept (binary: what stays) of every row of docs.

    Removes each byte covered by a string of `span` bytes that starts elsewhere too, in the same document or another; judged on
    the input. Null texts count as empty; texts shorter than `span` stay. Repeated rows repeat each other and go as a whole.
    """
    wide = ambiguous(docs)
    marked = _keyed(docs, "doc_id", wide=wide).join(common.merged(repeated_ranges(docs, span, gram, wide)), ["did", "th"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans, kept, sizes = [], [], []
            for raw, ranges in zip(b.column("raw"), b.column("ranges"), strict=True):
                t = raw.as_py()
                gone = spans_of(ranges.as_py(), span)
                at, left = 0, []
                for a, z in gone:
                    left.append(t[at:a])
                    at = z
                left.append(t[at:])
                sizes.append(len(t))
                spans.append([{"first": a, "end": z} for a, z in gone])
                kept.append(b"".join(left))
            kind = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])

    return marked.select(F.col("doc_id").cast("long"), "raw", "ranges").mapInArrow(run, "doc_id long, n_bytes long, spans array<struct<first: long, end: long>>, kept binary")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What goes of every document, and the digest of what stays.

    A null text is empty, a null doc_id stays null, repeated rows repeat each other and go as a whole where they have 200 bytes, and
    an empty table gives no rows. Other columns are not read.
    """
    done = deduplicate(common.table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["first"])
    return done.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(texts: list[bytes], span: int) -> list[tuple[int, int, str]]:
    """n_removed, n_spans and kept digest by counting every string: what tests compare with."""
    counts: dict[bytes, int] = {}
    for t in texts:
        for i in range(len(t) - span + 1):
            counts[t[i : i + span]] = counts.get(t[i : i + span], 0) + 1
    out = []
    for t in texts:
        hit = [i for i in range(len(t) - span + 1) if counts[t[i : i + span]] > 1]
        gone = spans_of([{"first": i, "last": i} for i in hit], span)
        cut = np.ones(len(t), dtype=bool)
        for a, z in gone:
            cut[a:z] = False
        kept = np.frombuffer(t, dtype=np.uint8)[cut].tobytes()
        out.append((len(t) - len(kept), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


def cut_texts(docs: DataFrame, span: int = 200, gram: int = 50) -> DataFrame:
    """docs with the repeated byte strings cut out of `text`, and n_chars, if there is one, made anew.

    A character that loses some of its bytes goes as a whole. A document that loses all its text goes; other rows, null and
    empty texts among them, stay as they are, with all their columns.
    """
    names = docs.columns
    if taken := {"did", "th", "raw", "ranges", "_kept"} & set(names):
        raise ValueError(f"columns {sorted(taken)} are there already")
    wide = ambiguous(docs)
    marked = _keyed(docs, *names, wide=wide).join(common.merged(repeated_ranges(docs, span, gram, wide)), ["did", "th"], "left").select("raw", "ranges", *names)
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, keep = [], []
            for raw, ranges, text in zip(b.column("raw"), b.column("ranges"), b.column("text"), strict=True):
                gone = spans_of(ranges.as_py(), span)
                if gone:
                    t, ends = raw.as_py(), [0, *(z for _, z in gone)]
                    text = b"".join(t[a:z] for a, z in zip(ends, [*(a for a, _ in gone), len(t)], strict=True)).decode("utf-8", "ignore")
                    keep.append(bool(text.strip()))
                    texts.append(text)
                else:
                    keep.append(True)
                    texts.append(text.as_py())
            cols = [b.column(n) for n in names]
            cols[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=names).filter(pa.array(keep, pa.bool_()))

    out = marked.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out
