"""WARC archives: writing with revisit records, reading by boundary-chain verification
(operator 4).

Writing.  A first pass takes only each payload's digest, length and id; of records with
equal payloads of at least ``MIN_REVISIT`` bytes the smallest id stays a ``response`` and
the others become ``revisit`` records without payload.  The digests met more than once are written down and
counted: ``BROADCAST_ROWS`` at most are broadcast, so that payloads stay where they are read; beyond that
rows are joined by digest.  Records are lines of Spark's text
writer with ``CRLF CRLF`` as line end, which is just the end of a WARC record, so
Spark's committer makes the files on any file system and repeats lost tasks.

Reading.  Spark's text reader is given the record magic as line separator.  The magic
does not overlap itself, so every split of a file finds the same pieces, and a piece holds
the whole header, of any length, of the candidate record that begins before it.  Tasks emit for each
candidate its offset and that of its successor, told by ``Content-Length``.  Pointer
jumping from each file's start (the set reached doubles its stride every round) keeps the
reachable records; a magic inside a payload is never reached.  Only offsets are shuffled.
A record whose payload holds the magic spans several pieces; those are fetched and
joined, the payload of any other record is read in place.

Edge cases: a null payload is empty; a null url gives no target header; line ends in a url
are percent-encoded; a null id is written as ``null`` and read back as null, and is never the id that
others refer to unless all equal payloads have null ids (then each of these is a response); rows with
the same smallest id and payload are all responses; an empty table gives no records; other
columns are ignored.  A chain that breaks (a truncated file) ends there: records
before the break are returned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .components import dropped, saved

MAGIC = "WARC/1.0\r\n"
END = "\r\n\r\n"
MIN_REVISIT = 100
BROADCAST_ROWS = 200_000  # digests, about 100 bytes each


def write_warc(pages: DataFrame, path: str, id_column: str = "page_id", url_column: str = "url",
               payload_column: str = "html", compression: str = "none") -> None:
    """Write one record per row.  ``compression`` may be any of Spark's text codecs;
    gzip halves the disk and makes each file one split."""
    rows = pages.select(F.col(id_column).cast("long").alias("id"), F.col(url_column).cast("string").alias("url"),
                        F.coalesce(F.col(payload_column).cast("binary"), F.lit(b"")).alias("payload"))
    facts = rows.select("id", F.length("payload").alias("bytes"), F.sha2("payload", 256).alias("digest"))
    first = facts.filter(F.col("bytes") >= MIN_REVISIT).groupBy("digest").agg(F.min("id").alias("first_id"), F.count("*").alias("n"))
    first = saved(first.filter((F.col("n") > 1) & F.col("first_id").isNotNull()).select("digest", "first_id"), "warc-repeated")
    small = F.broadcast(first) if first.count() <= BROADCAST_ROWS else first
    rows = rows.withColumn("digest", F.sha2("payload", 256)).join(small, "digest", "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("id").eqNullSafe(F.col("first_id"))
    clean = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")

    def header(name, value):
        return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))

    head = F.concat(
        F.lit(MAGIC), header("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        header("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("id").cast("string"), F.lit("null")), F.lit(">"))),
        header("WARC-Date", F.lit("1970-01-01T00:00:00Z")),
        F.when(F.col("url").isNotNull(), header("WARC-Target-URI", clean)).otherwise(""),
        header("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(revisit, F.concat(
            header("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("first_id").cast("string"), F.lit(">"))),
            header("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))).otherwise(""),
        header("Content-Type", F.lit("text/html")),
        header("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.length("payload").cast("string"))), F.lit("\r\n"))
    body = F.when(revisit, F.lit(b"")).otherwise(F.col("payload"))
    record = F.concat(head.cast("binary"), body).cast("string")
    rows.select(record).write.option("lineSep", END).option("compression", compression).text(path)
    dropped(first)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """The bytes between magics: file, block (first byte of the split), piece (its rank
    in reading order), raw."""
    text = spark.read.option("lineSep", MAGIC).option("pathGlobFilter", "part-*").text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                       F.monotonically_increasing_id().alias("piece"), F.col("value").cast("binary").alias("raw"))


def _candidates(pieces: DataFrame, keep: list) -> DataFrame:
    """Pieces with the parsed header of the candidate record before them."""
    # cut off as bytes, however long; a byte is a character in ISO-8859-1, so lengths and positions count bytes
    front = F.substring_index(F.col("raw").cast("string"), END, 1).cast("binary")
    parsed = pieces.select("file", "block", "piece", F.length("raw").alias("size"), "raw", front.alias("front"))
    whole = F.length("front") < F.col("size")
    parsed = parsed.withColumn("head", F.when(whole, F.decode("front", "ISO-8859-1"))).drop("front")
    length = F.expr("try_cast(regexp_extract(head, '(?i)(?:^|\\r\\n)Content-Length:[ ]*([0-9]+)', 1) as long)")
    parsed = parsed.withColumn("length", length).withColumn("body_at", (F.length("head") + len(END)).cast("long"))
    field = lambda name: F.nullif(F.regexp_extract("head", rf"(?i)(?:^|\r\n){name}:[ ]*([^\r]*)", 1), F.lit(""))
    names = {"warc_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "refers_to": "WARC-Refers-To", "declared_digest": "WARC-Payload-Digest"}
    return parsed.select("file", "block", "piece", "size", "length", "body_at", *(F.decode(F.encode(field(n), "ISO-8859-1"), "UTF-8").alias(a) if a == "target_uri" else field(n).alias(a) for a, n in names.items()), *keep)


def _offsets(light: DataFrame) -> DataFrame:
    """Adds the absolute offset of the magic before each piece.

    A running sum inside each split, then one over the splits of a file.  A file's
    first piece is the empty text before its first magic; its offset is -len(MAGIC)."""
    step = F.col("size") + len(MAGIC)
    inside = Window.partitionBy("file", "block").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    light = light.withColumn("rel", F.coalesce(F.sum(step).over(inside), F.lit(0)))
    blocks = light.groupBy("file", "block").agg(F.sum(step).alias("total"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("file", "block", (F.coalesce(F.sum("total").over(before), F.lit(0)) - len(MAGIC)).alias("base"))
    return light.join(blocks, ["file", "block"]).withColumn("offset", F.col("base") + F.col("rel")).drop("base", "rel")


def reachable(spark: SparkSession, candidates: DataFrame) -> DataFrame:
    """The offsets reached from offset 0 of each file, by pointer jumping over
    (file, offset, next); ``next`` is null for a piece that is no candidate.

    Neighbours whose successor is just the next piece are first drawn together into runs; a
    run also begins wherever a candidate from elsewhere points.  Round k then adds what lies 2**k
    runs behind the set reached and squares the jump table, so a chain of n runs takes
    about log2(n) rounds.  Each round is written to the shared scratch folder,
    which cuts lineage."""
    w = Window.partitionBy("file").orderBy("offset")
    near = candidates.select("file", "offset", "next", F.lead("offset").over(w).alias("ahead"), F.lag("next").over(w).alias("due"))
    aims = near.filter("next is not null and not (next <=> ahead)").select("file", F.col("next").alias("offset")).distinct().withColumn("aim", F.lit(True))
    begins = F.col("aim").isNotNull() | ~F.col("due").eqNullSafe(F.col("offset"))
    run = F.last(F.when(begins, F.col("offset")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    runs = saved(near.join(aims, ["file", "offset"], "left").select("file", "offset", "next", run.alias("run")), "warc-runs")

    jump = runs.groupBy("file", "run").agg(F.max_by("next", "offset").alias("next"))
    jump = saved(jump.select("file", F.col("run").alias("offset"), "next"), "warc-links")
    seen = saved(jump.filter("offset = 0").select("file", "offset"), "warc-seen")
    while True:
        known = jump.filter("next is not null")
        step = saved(seen.join(known, ["file", "offset"]).select("file", F.col("next").alias("offset")), "warc-step")
        if step.isEmpty():
            dropped(step, jump)
            break
        before, table = seen, jump
        seen = saved(seen.unionByName(step), "warc-seen")
        onward = known.select("file", F.col("offset").alias("next"), F.col("next").alias("after"))
        jump = saved(known.join(onward, ["file", "next"]).select("file", "offset", F.col("after").alias("next")), "warc-jump")
        dropped(before, step, table)
    seen = seen.withColumnRenamed("offset", "run")
    return runs.filter("next is not null").join(seen, ["file", "run"], "left_semi").select("file", "offset")


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """One row per record reached: file, offset, warc_type, record_id, target_uri, refers_to,
    declared_digest, payload_bytes, payload_digest (SHA-256, of the bytes stored) and, on request, payload."""
    body = F.expr("substring(raw, cast(body_at + 1 as int), cast(least(length, size) as int))")
    pieces = _pieces(spark, path)
    facts = _offsets(_candidates(pieces, [F.sha2(body, 256).alias("digest")]))
    facts = saved(facts, "warc-facts")
    end = F.col("offset") + len(MAGIC) + F.col("body_at") + F.col("length") + len(END)
    reached = reachable(spark, facts.select("file", "offset", end.alias("next"))).withColumn("reached", F.lit(True))
    facts = facts.join(reached, ["file", "offset"], "left")
    fields = ["file", "offset", "warc_type", "record_id", "target_uri", "refers_to", "declared_digest"]
    records = facts.filter("reached and body_at + length <= size")
    one = records.select(*fields, F.col("length").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "block", "piece")
    spanning = facts.filter("reached and body_at + length > size")
    many = None
    if not spanning.isEmpty():
        # pieces belong to the last reached record before them
        owner = Window.partitionBy("file").orderBy("offset").rowsBetween(Window.unboundedPreceding, 0)
        owned = facts.withColumn("owner", F.last(F.when(F.col("reached"), F.col("offset")), ignorenulls=True).over(owner))
        parts = owned.join(spanning.select("file", F.col("offset").alias("owner")), ["file", "owner"], "left_semi").select("file", "block", "piece", "owner")
        raw = pieces.join(parts, ["file", "block", "piece"])
        joined = raw.groupBy("file", F.col("owner").alias("offset")).agg(F.sort_array(F.collect_list(F.struct("block", "piece", "raw"))).alias("list"))
        text = F.aggregate(F.slice("list", 2, F.size("list")), F.element_at("list", 1)["raw"], lambda a, x: F.concat(a, F.lit(MAGIC.encode()), x["raw"]))
        many = joined.withColumn("whole", text).join(spanning.select(*fields, "length", "body_at"), ["file", "offset"])
        stored = F.expr("substring(whole, cast(body_at + 1 as int), cast(length as int))")
        many = many.filter(F.length("whole") >= F.col("body_at") + F.col("length"))  # else the file is truncated
        many = many.select(*fields, F.col("length").alias("payload_bytes"), F.sha2(stored, 256).alias("payload_digest"), *([stored.alias("payload")] if payload else []))
    if payload:
        lean = records.select("file", "block", "piece", *fields[1:], "length", "body_at", "size", F.col("digest").alias("payload_digest"))
        one = pieces.join(lean, ["file", "block", "piece"]).select(*fields, F.col("length").alias("payload_bytes"), "payload_digest", body.alias("payload"))
    else:
        one = one.drop("block", "piece")
    return one if many is None else one.unionByName(many)


def page_records(records: DataFrame) -> DataFrame:
    """Records of :func:`write_warc` by page, revisits with the payload facts of the
    record they refer to: page_id, record_type, refers_to, payload_bytes, payload_digest."""
    number = lambda c: F.expr(f"try_cast(regexp_extract({c}, '<urn:page:(.*)>', 1) as long)")
    pages = records.select(number("record_id").alias("page_id"), F.col("warc_type").alias("record_type"), number("refers_to").alias("refers_to"),
                           F.col("declared_digest"), "payload_bytes", "payload_digest")
    out = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    # rows that repeat an id may hold other payloads; the digest names the right one
    full = pages.filter("record_type = 'response'").select(F.col("page_id").alias("refers_to"), F.concat(F.lit("sha256:"), "payload_digest").alias("declared_digest"), "payload_bytes", "payload_digest").distinct()
    revisits = pages.filter("record_type = 'revisit'").drop("payload_bytes", "payload_digest").join(full, ["refers_to", "declared_digest"])
    return pages.filter("record_type = 'response'").select(*out).unionByName(revisits.select(*out))
