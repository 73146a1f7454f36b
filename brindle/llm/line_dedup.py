"""Fuzzy line deduplication by MinHash, in DataFrame functions only."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import components


def _keyed(docs: DataFrame) -> DataFrame:
    """did and th name a document, so that null or repeated ids do no harm; rows with both equal have equal texts."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.withColumn("_did", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))).withColumn("_th", F.xxhash64(text, F.length(text)))


def _split(text: str = "text") -> Column:
    return F.split(F.coalesce(F.col(text).cast("string"), F.lit("")), "\n")


def lines_of(docs: DataFrame, least_chars: int) -> DataFrame:
    """did, th, pos, norm and lid (a hash of norm) of every line that is compared; a blank one never is."""
    norm = F.transform(_split(), lambda line: F.lower(F.trim(line)))  # in the array, so that each is made once and not where it is used
    lines = _keyed(docs).select(F.col("_did").alias("did"), F.col("_th").alias("th"), F.posexplode(norm).alias("pos", "norm"))
    return lines.where((F.length("norm") >= least_chars) & F.col("norm").rlike("\\S")).withColumn("lid", F.xxhash64("norm"))


#: Bands of a signature, hashes in a band, and the least hashes of a line that its signature is made of.
BANDS, ROWS, SAMPLE = 16, 5, 64
#: The size of sketches of least hashes and the share of it that linked lines have in common. Only a test still uses them; odd sketches took their place.
SKETCH, SHARE = 64, 0.7


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value made once, however often use names it."""
    return F.get(F.transform(F.array(value), use), 0)


def place_hashes(norm: Column, k: int) -> Column:
    """The hash of the k-character shingle at every place of a line, by slices of its UTF-16 form, where a character has a fixed place."""
    last = lambda w: F.greatest(F.octet_length(w) - (2 * k - 1), F.lit(1))
    return bound(F.encode(norm, "UTF-16BE"), lambda w: F.transform(F.sequence(F.lit(1), last(w), F.lit(2)), lambda i: F.xxhash64(F.substring(w, i, F.lit(2 * k)))))


def least_hashes(norm: Column, k: int, n: int) -> Column:
    """The n least hashes (all, if fewer) of a line's distinct shingles, sorted.

    Of a long line only the hashes under a bound are sorted, of which 2n are expected; if fewer than n are there, as
    shingles repeat, all are sorted.
    """
    limit = lambda h: F.when(F.size(h) <= 2 * n, 2**63 - 1).otherwise((F.lit(2.0**64 * 2 * n) / F.size(h) - 2.0**63).cast("long"))
    low = lambda h: bound(limit(h), lambda most: F.array_distinct(F.filter(h, lambda x: x <= most)))
    some = bound(place_hashes(norm, k), lambda h: bound(low(h), lambda x: F.when((F.size(x) >= n) | (F.size(h) <= 2 * n), x).otherwise(F.array_distinct(h))))
    return F.slice(F.sort_array(some), 1, n)


def signatures(lines: DataFrame, k: int) -> DataFrame:
    """lid and keys (of the bands) of each line; lines has lid, and norm. Shingles at every place of the line count.

    The least hashes are hashed anew, so that they lie all over the range again. A band is the ROWS least of them at or after
    its point, around the circle: two lines agree in it if the least of all their hashes there are in both, however few they have.
    """
    again = lines.select("lid", F.sort_array(F.transform(least_hashes(F.col("norm"), k, SAMPLE), lambda x: F.xxhash64(x))).alias("h"))
    points = [-(2**63) + j * (2**64 // BANDS) for j in range(BANDS)]
    around = F.flatten(F.array_repeat(F.slice("h", 1, ROWS), ROWS))  # a line with fewer hashes goes around more than once
    placed = again.select("lid", F.sort_array(F.concat("h", F.array(*map(F.lit, points)))).alias("m"), F.concat("h", around).alias("h"))
    start = lambda j: F.array_position("m", F.lit(points[j])).cast("int") - j
    key = lambda j: F.xxhash64(F.lit(j), F.slice("h", start(j), F.lit(ROWS))).bitwiseAND(F.lit(-(2**16)))  # noqa: E731  48 bits: the zeros are not paid for on disk
    return placed.select("lid", F.array(*map(key, range(BANDS))).alias("keys"))


def members_of(lines: DataFrame, named: DataFrame, k: int) -> DataFrame:
    """lid, norm, n and odd of the lines that share a bucket; named has distinct lid."""
    return odd_sketches(lines.select("lid", "norm").join(named, "lid", "left_semi").groupBy("lid").agg(F.any_value("norm").alias("norm")), k)


def similar_lines(pairs: DataFrame, members: DataFrame, percent: int, k: int) -> DataFrame:
    """Of the pairs (a, b) of line ids those whose shingle sets have a Jaccard similarity of at least `percent` in 100.

    Odd sketches are compared first, by which no link is lost, and texts travel for the pairs that are left only.
    """
    side = lambda c, x: members.select(F.col("lid").alias(c), F.col("n").alias("n" + x), F.col("odd").alias("o" + x))
    near = common.stored(pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").where(could_link(percent)).select("a", "b", (F.col("nx") + F.col("ny")).alias("total")), "near")
    named = near.select(F.explode(F.array("a", "b")).alias("lid")).distinct()
    texts = members.select("lid", "norm").join(named, "lid", "left_semi")
    text = lambda c: texts.select(F.col("lid").alias(c), F.col("norm").alias("t" + c))
    both = near.join(text("a"), "a").join(text("b"), "b")
    sets = both.select("a", "b", "total", F.array_distinct(place_hashes(F.col("ta"), k)).alias("sa"), F.array_distinct(place_hashes(F.col("tb"), k)).alias("sb"))
    sized = sets.select("a", "b", "total", F.size(F.array_intersect("sa", "sb")).alias("common"))
    return sized.where(F.col("common") * 100 >= percent * (F.col("total") - F.col("common"))).select("a", "b")


#: The most words of 64 bits in an odd sketch.
WORDS = 32


def odd_sketches(lines: DataFrame, k: int) -> DataFrame:
    """lines (lid, norm) with n, how many distinct shingles a line has, and odd: bits that each tell whether an odd number of the shingles' hashes fall on it.

    There are at least twice as many bits as shingles, up to WORDS times 64, and a power of two.
    """
    points = F.array(*[F.lit(-(2**63) + j * (2**64 // WORDS)) for j in range(WORDS)])
    step = lambda n: F.when(n > 512, 1).when(n > 256, 2).when(n > 128, 4).when(n > 64, 8).otherwise(16)
    starts = lambda n: F.transform(F.sequence(F.lit(0), F.lit(WORDS - 1), step(n)), lambda j: F.get(points, j))
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), x.bitwiseAND(F.lit(63)).cast("int"))
    word = lambda hashes: F.aggregate(hashes, F.lit(0).cast("long"), lambda got, x: got.bitwiseXOR(bit(x)))
    places = lambda m, start: F.concat(F.transform(start, lambda x: F.array_position(m, x).cast("int")), F.array(F.size(m) + 1))
    words = lambda m, at: F.transform(F.sequence(F.lit(0), F.size(at) - 2), lambda j: word(F.slice(m, F.get(at, j) + 1, F.get(at, j + 1) - F.get(at, j) - 1)))
    sketch = lambda h, start: bound(F.sort_array(F.concat(h, start)), lambda m: bound(places(m, start), lambda at: words(m, at)))
    both = lambda h: F.struct(F.size(h).alias("n"), bound(starts(F.size(h)), lambda start: sketch(h, start)).alias("odd"))
    return lines.select("lid", "norm", bound(F.array_distinct(place_hashes(F.col("norm"), k)), both).alias("s")).select("lid", "norm", "s.n", "s.odd")


def folded(odd: Column, words: Column) -> Column:
    """An odd sketch in so many words; it has them, or a power of two times as many."""
    share = (F.size(odd) / words).cast("int")
    shorter = F.transform(F.sequence(F.lit(0), words - 1), lambda i: F.aggregate(F.slice(odd, i * share + 1, share), F.lit(0).cast("long"), lambda got, x: got.bitwiseXOR(x)))
    return F.when(F.size(odd) == words, odd).otherwise(shorter)


def could_link(percent: int) -> Column:
    """Whether two lines (nx, ox and ny, oy: n and odd) can have a Jaccard similarity of at least `percent` in 100. No link is lost.

    Shingles in both lines cancel out, so that the bits in which odd sketches differ are no more than the shingles that only one line has.
    """
    words = F.least(F.size("ox"), F.size("oy"))
    bits = F.zip_with(folded(F.col("ox"), words), folded(F.col("oy"), words), lambda a, b: F.bit_count(a.bitwiseXOR(b)))
    differ = F.aggregate(bits, F.lit(0), lambda got, x: got + x)
    return (F.least("nx", "ny") * 100 >= percent * F.greatest("nx", "ny")) & (differ * (100 + percent) <= (100 - percent) * (F.col("nx") + F.col("ny")))


def crossing(buckets: DataFrame, comp: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of lines that share a bucket, are in different components and could be linked. A bucket's commonest component is only paired with the rest.

    Lines are compared as they meet, so that a family of lines just under the threshold makes no rows that grow with its square.
    """
    here = buckets.select("key", "lid").join(comp, "lid")
    parts = here.groupBy("key", "component").agg(F.count("*").alias("m"))
    mains = parts.groupBy("key").agg(F.max_by("component", F.struct("m", "component")).alias("main"), F.count("*").alias("parts")).where("parts > 1").select("key", "main")
    mains = common.stored(mains, "mains")  # written, so that adaptive execution can split the join on a hot key
    places = common.stored(here.join(mains, "key").select("key", "lid", "component", "main"), "places")
    mixed = common.stored(places.join(members.select("lid", "n", "odd"), "lid").select("key", "lid", "component", "main", "n", "odd"), "mixed")
    x = mixed.where("component <> main").select("key", F.col("lid").alias("x"), F.col("component").alias("cx"), F.col("n").alias("nx"), F.col("odd").alias("ox"))
    y = mixed.select("key", F.col("lid").alias("y"), F.col("component").alias("cy"), "main", F.col("n").alias("ny"), F.col("odd").alias("oy"))
    met = x.join(y, (x["key"] == y["key"]) & (F.col("cx") != F.col("cy")) & ((F.col("cy") == F.col("main")) | (F.col("x") < F.col("y"))) & could_link(percent))
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def linked_lines(lines: DataFrame, k: int, percent: int, rounds: int) -> DataFrame:
    """lid and root of every line that is linked with others; lines has lid and norm, lids repeated where lines are equal.

    Buckets of equal band keys give a star of candidate edges around one member, then, where components differ, around another one
    in `rounds` rounds, and at last every pair that shares a bucket and is still in different components.
    """
    texts = lines.groupBy("lid").agg(F.any_value("norm").alias("norm"))  # equal lines are signed once
    signed = common.stored(signatures(texts, k), "signatures", compression="zstd")
    # dealt by key once, for the ends of each bucket and for its lines; a key that is there once is shared by nothing
    bands = signed.select("lid", F.explode("keys").alias("key")).repartition("key")
    ends = bands.groupBy("key").agg(F.min("lid").alias("centre"), F.max("lid").alias("last")).where("centre <> last").select("key", "centre")
    buckets = common.stored(bands.join(ends, "key").select("key", "lid", "centre"), "buckets")
    common.release(signed)
    named = common.stored(buckets.select("lid").distinct(), "nodes")
    members = common.stored(members_of(lines, named, k), "members")
    nodes = named.select(F.col("lid").alias("doc_id"))
    edges = common.stored(buckets.where("lid <> centre").select(F.col("centre").alias("a"), F.col("lid").alias("b")).distinct(), "edges")
    links = common.stored(similar_lines(edges, members, percent, k), "links")
    comp = common.stored(components(links, nodes).withColumnRenamed("doc_id", "lid"), "components")
    for r in range(1, rounds + 1):
        if r < rounds:
            here = buckets.select("key", "lid").join(comp, "lid")
            mixed = here.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min_by(F.struct("lid", "component"), F.xxhash64("lid", F.lit(r))).alias("c")).where("lo <> hi").select("key", "c")
            more = here.join(common.stored(mixed, "mixed"), "key").where("component <> c.component").select(F.least("lid", "c.lid").alias("a"), F.greatest("lid", "c.lid").alias("b")).distinct()
            more = more.join(edges, ["a", "b"], "left_anti")
        else:
            more = crossing(buckets, comp, members, percent)
        new = common.stored(similar_lines(common.stored(more, "pairs"), members, percent, k), "links")
        if not new.isEmpty():
            comp = common.stored(components(new, nodes, comp.withColumnRenamed("lid", "doc_id")).withColumnRenamed("doc_id", "lid"), "components")
    linked = comp.where("lid <> component").select("lid", F.col("component").alias("root"))
    return linked.unionByName(linked.select(F.col("root").alias("lid"), "root").distinct())


def removed_lines(docs: DataFrame, least_chars: int = 20, k: int = 5, percent: int = 80, rounds: int = 2, short: bool = False) -> DataFrame:
    """did, th and gone (the positions of lines to remove) of each document that loses any."""
    roots = common.stored(linked_lines(lines_of(docs, least_chars), k, percent, rounds), "roots")
    places = common.stored(lines_of(docs, 1 if short else least_chars).select("did", "th", "pos", "lid"), "lines", compression="zstd")  # read twice
    firsts = places.groupBy("lid").agg(F.min(F.struct("did", "th", "pos")).alias("at"), F.count("*").alias("n")).join(roots, "lid", "left").where("n > 1 OR root IS NOT NULL")
    firsts = common.stored(firsts.select("lid", "at", F.coalesce("root", "lid").alias("root")), "firsts")
    keep = firsts.groupBy("root").agg(F.min("at").alias("kept"))
    doomed = common.stored(firsts.join(keep, "root").select("lid", "kept"), "doomed")
    gone = places.join(doomed, "lid").where(F.struct("did", "th", "pos") != F.col("kept"))
    return common.stored(gone.groupBy("did", "th").agg(F.collect_set("pos").alias("gone")), "gone")


def deduplicate(docs: DataFrame, **options: int | bool) -> DataFrame:
    """docs without repeated lines, with the columns n_lines and n_removed added and n_chars, if there is one, made anew.

    Lines are compared trimmed and in lower case. Those with fewer than `least_chars` characters then stay, or with `short`
    go if an equal line came before; blank ones stay.
    Two lines are linked if the sets of their `k`-character shingles have a Jaccard similarity of at least `percent` in 100
    (equal lines too). Of each component the line that comes first (by doc_id, then position) stays. Null texts stay null;
    documents that lose all lines keep an empty text. Repeated rows count as one document and keep the same lines; a null
    doc_id comes first. Other columns pass through.
    """
    taken = {"_did", "_th", "_lines", "_gone", "n_lines", "n_removed"} & set(docs.columns)
    if taken:
        raise ValueError(f"columns {sorted(taken)} are there already")
    gone = removed_lines(docs, **options).select(F.col("did").alias("_did"), F.col("th").alias("_th"), F.col("gone").alias("_gone"))
    joined = _keyed(docs).join(gone, ["_did", "_th"], "left").withColumn("_lines", _split())
    kept = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), "_gone")
    text = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda i: F.get("_lines", i)), "\n"))
    out = joined.withColumn("n_lines", F.size("_lines").cast("long")).withColumn("text", text).withColumn("n_removed", F.when(F.col("_gone").isNull(), 0).otherwise(F.size("_gone")).cast("long"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns, "n_lines", "n_removed")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every document the number of its lines, how many go as repeats of earlier ones, and the digest of what stays.

    A null text has one empty line and a null digest, null ids come first, repeated rows lose the same lines, and an empty table gives
    no rows. Other columns are not read.
    """
    done = deduplicate(common.table(spark, sf_dir, "documents").select("doc_id", "text"), short=True)
    return done.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
