"""WARC archives: writing records with revisits, and reading them back by boundary-chain verification."""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

MAGIC = "WARC/1.0\r\n"
HEAD_END = "\r\n\r\n"
URN = "urn:page:"
#: So many repeated payloads are broadcast, of about 80 bytes each, so that no body is shuffled; more are joined by their digests.
MOST_BROADCAST = 200_000


def _digested(pages: DataFrame) -> DataFrame:
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))


def write_archive(pages: DataFrame, path: str, least_revisit: int = 100, records_a_file: int = 4096) -> None:
    """One record per row of (page_id, url, html), as WARC/1.0 in files of at most `records_a_file` records.

    Of the rows with equal payloads of at least `least_revisit` bytes, that with the smallest page_id is a response and the others
    are revisits without a payload of their own, which name it. Rows that repeat the smallest id are responses too. A null id
    counts as larger than any and is left out of the header; revisits of a null id are responses. Null html is an empty
    payload. Records are text, and the text writer ends each with its last byte, a line feed.
    """
    rows = _digested(pages)
    large = F.octet_length("payload") >= least_revisit
    # only digests are shuffled for this; the bodies, which they come from, are not read into it
    firsts = rows.where(large).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL").select("digest", "first")
    firsts = common.stored(firsts, "firsts")
    if firsts.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:
        firsts = F.broadcast(firsts)
    joined = rows.join(firsts, "digest", "left")
    refers = F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first"))
    line = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(name + ": "), value, F.lit("\r\n"))).otherwise(F.lit(""))
    safe_url = F.regexp_replace("url", "[\r\n]", "")
    body = F.when(refers.isNull(), F.col("payload").cast("string")).otherwise(F.lit(""))
    record = F.concat(
        F.lit(MAGIC),
        line("WARC-Type", F.when(refers.isNull(), F.lit("response")).otherwise(F.lit("revisit"))),
        line("WARC-Record-ID", F.concat(F.lit(f"<{URN}"), F.col("page_id").cast("string"), F.lit(">"))),
        line("WARC-Target-URI", safe_url),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        line("WARC-Refers-To", F.concat(F.lit(f"<{URN}"), refers.cast("string"), F.lit(">"))),
        line("Content-Length", F.octet_length(body).cast("string")),
        F.lit("\r\n"),
        body,
        F.lit("\r\n\r"),
    )
    joined.select(record.alias("value")).write.option("lineSep", "\n").option("maxRecordsPerFile", records_a_file).text(path)


def _field(head: Column, name: str) -> Column:
    got = F.regexp_extract(head, rf"(?im)^{name}:[ \t]*([^\r\n]*?)[ \t]*$", 1)
    return F.when(got != "", got)


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """The files cut at every place where the magic stands: file, block, seq (orders the pieces of a block), body (what follows a magic).

    The text reader splits the files at the magic, wherever a task's block ends. seq is the same in every scan of the same files.
    """
    read = spark.read.option("lineSep", MAGIC).text(path)
    return read.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("seq"), F.col("value").cast("binary").alias("body"))


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """Every place in the files where the magic stands: file, at (its offset), seq, size (bytes up to the next place), next (where a record that begins here would end) and its fields.

    Header fields, the payload's length and digest (null where the payload goes beyond the piece) are taken in the scan, so that no
    body leaves it. The bytes before a block are those of the blocks before it, and within a block places follow each
    other, so both offsets are running sums over one block's places, or one file's blocks.
    """
    # the whole body is searched only where the header's end is not near
    end = r"locate('\r\n\r\n', decode({}, 'ISO-8859-1'))"
    near, far = end.format("substring(body, 1, 65536)"), end.format("body")
    cut = pieces(spark, path).withColumn("size", F.octet_length("body").cast("long") + len(MAGIC)).withColumn("cut", F.expr(f"CASE WHEN {near} > 0 THEN {near} ELSE {far} END"))
    head = cut.withColumn("head", F.when(F.col("cut") > 0, F.decode(F.substring("body", F.lit(1), F.col("cut") + 1), "UTF-8")))
    parsed = head.withColumn("length", F.expr("try_cast(nullif(regexp_extract(head, '(?im)^Content-Length:[ \\\\t]*([0-9]+)', 1), '') AS bigint)"))
    whole = F.col("size") - len(MAGIC) >= F.col("cut") + 3 + F.col("length")
    found = common.stored(
        parsed.select(
            "file",
            "block",
            "seq",
            "size",
            "cut",
            "length",
            _field(F.col("head"), "WARC-Type").alias("record_type"),
            _field(F.col("head"), "WARC-Record-ID").alias("record_id"),
            _field(F.col("head"), "WARC-Target-URI").alias("target_uri"),
            F.regexp_replace(_field(F.col("head"), "WARC-Payload-Digest"), "^sha256:", "").alias("digest"),
            _field(F.col("head"), "WARC-Refers-To").alias("refers_to"),
            F.when(whole, F.sha2(F.substring("body", F.col("cut") + 4, F.col("length").cast("int")), 256)).alias("payload_digest"),
        ),
        "places",
    )
    inside = Window.partitionBy("file", "block").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    blocks = found.groupBy("file", "block").agg(F.sum("size").alias("bytes"))
    before = blocks.select("file", "block", F.coalesce(F.sum("bytes").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    # the first piece of a file is what stands before its first magic, and a piece starts after its magic
    at = F.col("before") + F.col("inside") - len(MAGIC)
    placed = found.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(before, ["file", "block"]).withColumn("at", at).where("at >= 0")
    return placed.withColumn("next", F.col("at") + len(MAGIC) + F.col("cut") + 3 + F.col("length") + 4).drop("block", "before", "inside")


def reachable(steps: DataFrame, most_rounds: int = 40) -> DataFrame:
    """file, at of the places on the chain that begins at offset 0 of each file, by pointer jumping.

    steps has file, at and next (where the record that would begin there ends). In each round all places known to be on a
    chain add where their pointers lead, and every pointer is replaced by its target's pointer, so that n records take
    about log2(n) rounds. Each round's pointers are written to the shared folder.
    """
    jumps = steps.select("file", "at", "next").join(steps.select("file", F.col("at").alias("next")), ["file", "next"], "left_semi")
    on = steps.where("at = 0").select("file", "at")
    for _ in range(most_rounds):
        to = jumps.select("file", F.col("at").alias("next"), F.col("next").alias("far"))
        more = on.join(jumps, ["file", "at"]).select("file", F.col("next").alias("at"))
        grown = common.stored(on.unionByName(more).distinct(), "chain")
        jumps = common.stored(jumps.join(to, ["file", "next"]).select("file", "at", F.col("far").alias("next")), "jumps")
        on = grown
        if jumps.isEmpty():
            return on
    raise RuntimeError("a chain is longer than 2 ** most_rounds records")


FIELDS = ("record_type", "record_id", "target_uri", "digest", "refers_to")


def records(spark: SparkSession, path: str) -> DataFrame:
    """The records of uncompressed WARC files without their payloads: file, at, seq, pieces (its places' seq, in order), cut, length (the payload's bytes), header fields, payload_digest (SHA-256 of the payload as read).

    The magic within a payload is no record: a record counts only if the lengths of those before it, from the file's start,
    lead to it. A payload that holds the magic is put together from its pieces, the only bodies that are read again. A file that
    doesn't begin with the magic, and what follows a record whose length is missing or wrong, gives no records. No files: no rows.
    """
    steps = common.stored(candidates(spark, path), "steps")
    chain = reachable(steps.where("next IS NOT NULL")).withColumn("real", F.lit(True))
    # every place belongs to the last record at or before it in its file
    owned = steps.join(chain, ["file", "at"], "left").withColumn("owner", F.last(F.when(F.col("real") & F.col("next").isNotNull(), F.col("at")), True).over(Window.partitionBy("file").orderBy("at")))
    owned = common.stored(owned.where("owner IS NOT NULL"), "owned")
    real = owned.where("at = owner").drop("owner", "real")
    whole = real.where("at + size >= next").withColumn("pieces", F.array("seq"))
    broken = real.where("at + size < next").select("file", F.col("at").alias("owner"), "next")
    inner = common.stored(owned.select("file", "owner", "at", "seq").join(broken, ["file", "owner"]).where("at < next").select("file", "owner", "at", "seq"), "inner")
    if inner.isEmpty():
        return whole
    bodies = inner.join(pieces(spark, path).select("file", "seq", "body"), ["file", "seq"]).groupBy("file", "owner").agg(F.sort_array(F.collect_list(F.struct("at", "seq", "body"))).alias("x"))
    again = real.where("at + size < next").join(bodies.select("file", F.col("owner").alias("at"), F.transform("x", lambda p: p["seq"]).alias("pieces"), _body(F.col("x")).alias("body")), ["file", "at"])
    again = again.withColumn("payload_digest", F.sha2(F.substring("body", F.col("cut") + 4, F.col("length").cast("int")), 256)).drop("body")
    return whole.unionByName(again)


def _body(parts: Column) -> Column:
    """The bodies of a record's pieces, in order, with the magic between them."""
    return F.aggregate(parts, F.lit(b""), lambda a, p: F.when(F.octet_length(a) == 0, p["body"]).otherwise(F.concat(a, F.lit(MAGIC.encode()), p["body"])))


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """The records of uncompressed WARC files with their payloads: file, at, record_type, record_id, target_uri, digest, refers_to, payload (binary). See records."""
    known = records(spark, path).select("file", "at", "cut", "length", *FIELDS, F.posexplode("pieces").alias("n", "seq"))
    found = known.join(pieces(spark, path).select("file", "seq", "body"), ["file", "seq"])
    single = found.where("n = 0")
    many = found.groupBy("file", "at").agg(F.sort_array(F.collect_list(F.struct("n", "body"))).alias("x")).where(F.size("x") > 1).select("file", "at", _body(F.col("x")).alias("more"))
    full = single.join(many, ["file", "at"], "left").withColumn("body", F.coalesce("more", "body"))
    return full.select("file", "at", *FIELDS, F.substring("body", F.col("cut") + 4, F.col("length").cast("int")).alias("payload"))


def page_number(urn: Column) -> Column:
    return F.regexp_extract(urn, rf"<{URN}(-?[0-9]+)>", 1).try_cast("long")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the pages to archives in the shared folder and returns what reading them back gives.

    A revisit has the length of the response that it names with the same digest. Null html is an empty payload, a null page_id
    stays null, repeated rows give a record each, and an empty table gives no rows.
    """
    path = common.new_path(spark, "warc")
    write_archive(common.table(spark, sf_dir, "pages"), path)
    read = records(spark, path).select(
        page_number(F.col("record_id")).alias("page_id"),
        F.col("length").alias("payload_bytes"),
        F.when(F.col("record_type") == "revisit", F.col("digest")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        F.when(F.col("record_type") == "revisit", page_number(F.col("refers_to"))).alias("refers_to"),
    )
    read = common.stored(read, "records")
    responses = read.where("record_type = 'response'")
    full = responses.groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.max("payload_bytes").alias("payload_bytes"))
    revisits = read.where("record_type = 'revisit'").drop("payload_bytes").join(full, ["refers_to", "payload_digest"], "left")
    return responses.unionByName(revisits.select(*responses.columns))


def oracle(least: int = 100) -> str:
    return f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, sha256(b) AS h FROM p),
f AS (SELECT h, min(page_id) AS lo FROM d WHERE n >= {least} GROUP BY h)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d.h AS payload_digest,
  CASE WHEN n >= {least} AND lo <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= {least} AND lo <> page_id THEN lo END AS refers_to
FROM d LEFT JOIN f ON d.h = f.h AND d.n >= {least}"""
