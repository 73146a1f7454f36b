"""Near-duplicate documents: one-permutation MinHash, banded buckets and star-shaped candidate edges."""

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import components

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
SPACES = np.zeros(256, dtype=bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True


def mix(h: np.ndarray, key: int = 0) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (Stafford's variant 13 of the murmur finaliser)."""
    h = h + np.uint64(key * 0x9E3779B97F4A7C15 & (2**64 - 1))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: A random value for each byte, and powers of an odd base, for sums that hash words at once.
BYTE = mix(np.arange(256, dtype=np.uint64), 1)
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 2**64)
PART = 1 << 20
_powers: list[np.ndarray] = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below n."""
    if len(_powers[0]) < n:
        with np.errstate(over="ignore"):
            for k, b in enumerate((BASE, INVERSE)):
                p = np.full(1 << max(10, (n - 1).bit_length()), b, dtype=np.uint64)
                p[0] = 1
                _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def hashed(raw: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words of raw that lie from first to last."""
    up, down = powers(len(raw) + 1)
    with np.errstate(over="ignore"):
        total = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(BYTE[raw] * up[: len(raw)])))
        return mix((total[last] - total[first]) * down[first] + (last - first).astype(np.uint64))


def shingles(text: bytes, k: int) -> np.ndarray:
    """64-bit hashes of the distinct k-word shingles, sorted; of the whole sequence, if there are fewer words.

    A-Z count as a-z; words are what lies between bytes 9 to 13 and 32. A text without words has none.
    """
    raw = np.frombuffer(text.translate(LOWER), dtype=np.uint8)
    gap = np.concatenate(([True], SPACES[raw], [True]))
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    first, last = edge[::2], edge[1::2]
    if not len(first):
        return np.zeros(0, dtype=np.uint64)
    # words are hashed in parts of the text, so that sums and powers stay as small as a part, or as one word if that is longer
    cuts = np.unique(np.concatenate(([0], np.searchsorted(first, np.arange(PART, len(raw), PART)), [len(first)])))
    word = np.concatenate([hashed(raw[first[i] : last[j - 1]], first[i:j] - first[i], last[i:j] - first[i]) for i, j in zip(cuts[:-1], cuts[1:], strict=True)])
    with np.errstate(over="ignore"):
        n = min(k, len(word))
        h = np.zeros(len(word) - n + 1, dtype=np.uint64)
        for i in range(n):
            h = mix(h + word[i : len(word) - n + 1 + i], i + 1)
        return np.unique(mix(h, n))


@lru_cache
def detours(bins: int) -> tuple[np.ndarray, np.ndarray]:
    """The bins' lower bounds, and for each bin a fixed random order of bins to borrow from."""
    bounds = np.array([i * 2**64 // bins for i in range(bins)], dtype=np.uint64)
    with np.errstate(over="ignore"):
        order = mix(np.arange(bins * 8 * bins, dtype=np.uint64), 77) % np.uint64(bins)
    return bounds, order.reshape(bins, 8 * bins).astype(np.int64)


def sketch(h: np.ndarray, bins: int) -> np.ndarray:
    """One-permutation MinHash of sorted distinct hashes: the least of each bin of the hash range; an empty bin takes that of the first full one in its own fixed random order of bins (optimal densification)."""
    bounds, order = detours(bins)
    at = np.searchsorted(h, bounds)
    full = np.diff(at, append=len(h)) > 0
    out = h[np.minimum(at, len(h) - 1)]
    empty = np.flatnonzero(~full)
    if empty.size:
        for lo, hi in ((0, 16), (16, order.shape[1])):
            tries = order[empty, lo:hi]
            ok = full[tries]
            hit = ok.any(axis=1)
            out[empty[hit]] = mix(out[tries[hit, ok[hit].argmax(axis=1)]], 99)
            empty = empty[~hit]
            if not empty.size:
                break
        else:
            out[empty] = mix(out[np.flatnonzero(full)[:1]], 99)
    return out


def signed(docs: DataFrame, words: int, bins: int, rows: int) -> DataFrame:
    """doc_id, n (set size), two digests of the set, and the bands' keys (null if the set is empty). Whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = mix(np.arange(rows, dtype=np.uint64), 5) | np.uint64(1)
        for b in batches:
            n, d1, d2, keys = [], [], [], []
            for t in b.column(1).cast(pa.large_binary()):
                h = shingles(t.as_py() or b"", words)
                with np.errstate(over="ignore"):
                    n.append(len(h))
                    d1.append(int(mix(h, 11).sum(dtype=np.uint64).astype(np.int64)) if len(h) else 0)
                    d2.append(int(mix(h, 12).sum(dtype=np.uint64).astype(np.int64)) if len(h) else 0)
                    keys.append(mix((sketch(h, bins).reshape(-1, rows) * weights).sum(axis=1, dtype=np.uint64), 13).astype(np.int64) if len(h) else None)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "n", "d1", "d2", "keys"]
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n long, d1 long, d2 long, keys array<long>")


def sets_of(docs: DataFrame, words: int) -> DataFrame:
    """doc_id and the sorted shingle hashes, as packed 64-bit words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            packed = [shingles(t.as_py() or b"", words).tobytes() for t in b.column(1).cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(packed, pa.binary())], names=["doc_id", "set"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, set binary")


def similar(pairs: DataFrame, percent: int) -> DataFrame:
    """Of (a, b, set_a, set_b), the pairs with 100 * |intersection| >= percent * |union| of the full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column("set_a"), b.column("set_b"), strict=True):
                p, q = np.frombuffer(x.as_py(), dtype=np.uint64), np.frombuffer(y.as_py(), dtype=np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True)) if 100 * min(len(p), len(q)) >= percent * max(len(p), len(q)) else 0
                keep.append(both > 0 and 100 * both >= percent * (len(p) + len(q) - both))
            keep_ = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("a").filter(keep_), b.column("b").filter(keep_)], names=["a", "b"])

    return pairs.select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long")


def crossing(here: DataFrame, keyed: DataFrame, sets: DataFrame, percent: int, block: int = 256, hashes: int = 500_000) -> DataFrame:
    """a, b of the similar pairs that share a bucket and are in different components, by comparing all of them.

    here has band, key, doc_id, n and component of whole buckets; keyed has doc_id and all band keys; sets has doc_id and set. A
    bucket's commonest component is its main one, and is only compared with the rest. Both are dealt at random into blocks
    of about `block` members and `hashes` shingles. Two blocks meet in one task, which multiplies their 0/1 matrices, so that
    only similar pairs become rows. A pair counts in the first band that it shares.
    """
    parts = here.groupBy("band", "key", "component").agg(F.count("*").alias("m"), F.sum("n").alias("size"))
    blocks = lambda m, size: F.greatest(F.ceil(m / block), F.ceil(size / hashes), F.lit(1)).cast("int")
    mains = parts.groupBy("band", "key").agg(F.max(F.struct("m", "size", "component")).alias("main"), F.sum("m").alias("m"), F.sum("size").alias("size"), F.count("*").alias("parts")).where("parts > 1")
    mains = mains.select("band", "key", F.col("main.component").alias("main"), blocks(F.col("main.m"), F.col("main.size")).alias("n_main"), blocks(F.col("m") - F.col("main.m"), F.col("size") - F.col("main.size")).alias("n_rest"))
    dealt = here.join(common.stored(mains, "mains"), ["band", "key"]).withColumn("is_main", F.col("component") == F.col("main"))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.when(F.col("is_main"), F.col("n_main")).otherwise(F.col("n_rest"))).cast("int"))
    # the blocks of the rest are 0 to n_rest - 1, and those of the main component follow
    each = lambda lo, hi: F.sequence(F.lit(lo) if isinstance(lo, int) else lo, hi - 1)
    with_main = F.transform(each(0, F.col("n_rest")), lambda i: F.struct(i.alias("i"), (F.col("n_rest") + F.col("own")).alias("j")))
    with_rest = F.transform(each(0, F.col("n_rest") + F.col("n_main")), lambda k: F.struct(F.least(k, F.col("own")).alias("i"), F.greatest(k, F.col("own")).alias("j")))
    placed = dealt.withColumn("ij", F.explode(F.when(F.col("is_main"), with_main).otherwise(with_rest)))
    placed = placed.select("band", "key", "ij.i", "ij.j", F.when(F.col("is_main"), F.col("n_rest") + F.col("own")).otherwise(F.col("own")).alias("own"), "doc_id", "component")
    rows = placed.join(keyed.join(sets, "doc_id"), "doc_id")

    def compare(key: tuple, t: pa.Table) -> pa.Table:
        band, i, j = key[0].as_py(), key[2].as_py(), key[3].as_py()
        own = t.column("own").to_numpy()
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        ids, comp = t.column("doc_id").to_numpy(), t.column("component").to_numpy()
        keys = np.array(t.column("keys").to_pylist(), dtype=np.int64).reshape(len(ids), -1)
        packed = [np.frombuffer(x.as_py(), dtype=np.uint64) for x in t.column("set")]
        size = np.array([len(x) for x in packed])
        fresh = comp[left][:, None] != comp[right][None, :]
        if i == j:
            fresh &= ids[left][:, None] < ids[right][None, :]
        for k in range(band):
            fresh &= keys[left, k][:, None] != keys[right, k][None, :]
        both = np.zeros(fresh.shape, dtype=np.int64)
        if fresh.any():
            _, at, times = np.unique(np.concatenate(packed), return_inverse=True, return_counts=True)
            who = np.repeat(np.arange(len(ids)), size)
            rank = np.cumsum(times > 1) - 1  # hashes of one document alone meet nothing
            common_ = times[at] > 1
            who, at = who[common_], rank[at[common_]]
            order = np.argsort(at, kind="stable")
            who, at = who[order], at[order]
            n = int(at[-1]) + 1 if len(at) else 0
            for lo in range(0, n, 8192):
                a, b = np.searchsorted(at, (lo, lo + 8192))
                m = np.zeros((len(ids), min(8192, n - lo)), dtype=np.float32)
                m[who[a:b], at[a:b] - lo] = 1
                both += (m[left] @ m[right].T).astype(np.int64)
        x, y = np.nonzero(fresh & (both > 0) & (100 * both >= percent * (size[left][:, None] + size[right][None, :] - both)))
        p, q = ids[left[x]], ids[right[y]]
        return pa.table({"a": np.minimum(p, q), "b": np.maximum(p, q)})

    return rows.groupBy("band", "key", "i", "j").applyInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, bands: int = 32, rows: int = 4, rounds: int = 3) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of docs.

    Texts with equal shingle sets form a class, represented by its smallest doc_id; only classes meet. At the threshold of 80 %
    two of them miss all 32 bands of 4 with a chance of 5 in 100 million. A bucket's edges are a star around one member, so a
    bucket of m members has m - 1. An edge is confirmed on full sets. As two similar members may meet only around a third
    that is like neither, further rounds take, of the buckets whose members are still in different components, another
    centre by a new random order, in `rounds` rounds; small buckets (up to 24 members) then compare every remaining pair across
    components, which is at most 23 edges a member, and at last larger ones do so in blocks. No pair that shares a bucket
    stays untested, unless others link its ends.

    Null or empty texts have the set size 0 and their own doc_id as component. A null doc_id has a null component and is
    kept. Repeated ids are one document in links; each row is returned, and of different texts of one id the one whose packed set
    comes first is compared. Other columns are not read.
    """
    made = common.stored(signed(docs, words, bands * rows, rows), "sets")
    real = made.where("doc_id IS NOT NULL AND n > 0")
    classes = common.stored(real.groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("rep")), "classes")  # written, so that adaptive execution can split the join on a hot class
    members = common.stored(real.join(classes, ["n", "d1", "d2"]).select("doc_id", "rep", "n", F.when(F.col("doc_id") == F.col("rep"), F.col("keys")).alias("keys")), "classes")
    reps = members.where("keys IS NOT NULL").select("doc_id", "n", F.posexplode("keys").alias("band", "key")).distinct()
    shared = reps.groupBy("band", "key").agg(F.count("*").alias("m"), F.min("doc_id").alias("centre")).where("m > 1")
    shared = common.stored(shared, "shared")
    buckets = common.stored(reps.join(shared, ["band", "key"]), "buckets")
    sets = common.stored(sets_of(docs.join(buckets.select("doc_id").distinct(), "doc_id", "left_semi"), words).groupBy("doc_id").agg(F.min("set").alias("set")), "members")
    tested = comp = None
    for r in range(rounds + 1):
        if r == 0:
            edges = buckets.where("doc_id <> centre").select(F.col("centre").alias("a"), F.col("doc_id").alias("b")).distinct()
        else:
            here = buckets.where("m > 2").drop("centre").join(comp, "doc_id")  # the one pair of two members has been tested
            mixed = here.groupBy("band", "key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.expr(f"min_by(struct(doc_id, component), xxhash64(doc_id, band, {r}))").alias("c")).where("lo <> hi")
            if r < rounds:
                met = here.join(mixed, ["band", "key"]).where("component <> c.component").select(F.col("doc_id").alias("x"), F.col("c.doc_id").alias("y"))
            else:
                small = here.where("m <= 24").join(mixed.select("band", "key"), ["band", "key"], "left_semi")
                one, two = small.select("band", "key", F.col("doc_id").alias("x"), F.col("component").alias("cx")), small.select("band", "key", F.col("doc_id").alias("y"), F.col("component").alias("cy"))
                met = one.join(two, ["band", "key"]).where("cx < cy").select("x", "y")
            edges = met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct().join(tested, ["a", "b"], "left_anti")
        edges = common.stored(edges, "edges")
        tested = edges if tested is None else tested.unionByName(edges)
        if r and edges.isEmpty():
            continue
        pairs = edges.join(sets.select(F.col("doc_id").alias("a"), F.col("set").alias("set_a")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("set").alias("set_b")), "b")
        new = common.stored(similar(pairs, percent), "links")
        if r and new.isEmpty():
            continue
        comp = common.stored(components(new, buckets.select("doc_id").distinct(), comp), "components")
    here = buckets.where("m > 24").select("band", "key", "doc_id", "n").join(comp, "doc_id")
    mixed = here.groupBy("band", "key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("band", "key")
    here = common.stored(here.join(common.stored(mixed, "mixed"), ["band", "key"]), "mixed")
    if not here.isEmpty():
        keyed = members.where("keys IS NOT NULL").groupBy("doc_id").agg(F.min_by("keys", F.struct("n", F.col("keys")[0])).alias("keys")).join(here.select("doc_id").distinct(), "doc_id", "left_semi")
        new = common.stored(crossing(here, keyed, sets, percent), "links")
        if not new.isEmpty():
            comp = common.stored(components(new, comp.select("doc_id"), comp), "components")
    every = made.select("doc_id", F.col("n").alias("n_shingles"), "d1", "d2")
    rep_of = members.groupBy("doc_id").agg(F.min("rep").alias("rep"))
    found = rep_of.join(comp.withColumnRenamed("doc_id", "rep"), "rep", "left").select(F.col("doc_id"), F.coalesce("component", "rep").alias("component_id"))
    out = every.join(found, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of every document by its 2-word shingles; nulls, empty texts, repeated ids and empty tables as near_duplicates says."""
    return near_duplicates(common.table(spark, sf_dir, "documents"), words=2)


def keep_one(docs: DataFrame, **options: int) -> DataFrame:
    """The rows of docs that near_duplicates keeps, with all their columns. A repeated doc_id keeps its rows together."""
    dropped = near_duplicates(docs, **options).where("NOT kept").select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)
