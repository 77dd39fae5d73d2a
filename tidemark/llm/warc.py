"""WARC archives of pages: written as plain records, read back by boundary-chain verification.

Writing. One record per page; its header and payload are one string expression, and Spark's text sink ends each with
the two line breaks that close a record. Of the pages with equal payloads the one with the smallest page_id is a
response, the others are revisits without a payload of their own.

Reading. Spark's text source splits the archives at the magic ``WARC/1.1``, in parallel over byte ranges. Every piece
is a candidate: its place is the sum of the lengths before it (inside its range, then over the ranges of its file), and
its header says where its successor should start. The magic may also stand inside a payload, so a candidate is not yet
a record. Pointer jumping decides: from the start of each file the reachable set doubles with every round while each
candidate's pointer comes to skip twice as many records. Only what the chain reaches is a record; a reached record that
covers several pieces is put together from them.

Defined cases: a null html is an empty payload; a null page_id has an empty name in its record and comes back as null,
is a revisit if another page has its payload and a response otherwise; rows that repeat the smallest page_id of a
payload are all responses; line breaks in a url are written as %0D and %0A; a null url is an empty one and comes back as
empty; extra columns are ignored; no pages give no files and no records. A file is read up to the first record whose
header has no length or whose end lies past the end of the file.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidemark.llm.lookup import BROADCAST_ROWS, attach
from tidemark.session import checkpoint_dir, cut_lineage

MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS_PER_FILE = 20_000
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32(hex_digits: Column, n: int = 40) -> Column:
    """Upper-case base32 of ``n`` hex digits (a multiple of five): every five digits are four base32 characters."""
    out = []
    for k in range(1, n + 1, 5):
        v = F.conv(F.substring(hex_digits, k, 5), 16, 10).cast("int")
        out += [F.substring(F.lit(_BASE32), F.shiftright(v, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*out)


def _digest(payload: Column) -> Column:
    return base32(F.sha1(payload))


def classified(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, html, digest, n_bytes, refers_to (null for a response)."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), html.alias("html"))
    rows = rows.withColumn("digest", F.sha1("html")).withColumn("n_bytes", F.octet_length("html").cast("long"))
    copies = rows.where(F.col("n_bytes") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    rows = attach(rows, cut_lineage(copies.where("n > 1")), "digest", "n")
    revisit = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    return rows.withColumn("refers_to", F.when(revisit, F.col("first"))).drop("first")


def write_warc(pages: DataFrame, folder: str, min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", records_per_file: int = RECORDS_PER_FILE) -> None:
    """Writes a record per page into ``folder``; pages with equal payloads of ``min_bytes`` or more are stored once."""
    rows = classified(pages, min_bytes)
    revisit = F.col("refers_to").isNotNull()
    name = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    url = F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    of = F.when(revisit, F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("refers_to").cast("string"), F.lit(f">\r\nWARC-Profile: {PROFILE}\r\n"))).otherwise("")
    head = F.concat(
        F.lit(f"{MAGIC}WARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: <urn:page:"), name, F.lit(f">\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), url, F.lit("\r\n"), of,
        F.lit("WARC-Payload-Digest: sha1:"), base32(F.col("digest")), F.lit("\r\nX-Payload-Length: "), F.col("n_bytes").cast("string"),
        F.lit("\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.when(revisit, "0").otherwise(F.col("n_bytes").cast("string")), F.lit(END),
    )
    value = F.concat(head, F.when(revisit, "").otherwise(F.col("html")))
    rows.select(value.alias("value")).write.option("lineSep", END).option("maxRecordsPerFile", records_per_file).text(folder)


def _pieces(spark: SparkSession, folder: str) -> DataFrame:
    """What stands between two magics, in the order of each byte range."""
    raw = spark.read.option("lineSep", MAGIC).text(folder)
    return raw.select("value", F.unhex(F.md5(F.col("_metadata.file_path"))).alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("file_size"))


def _field(head: Column, name: str, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(head, rf"(?:^|\r\n){name}: {pattern}(?:\r\n|$)", 1), F.lit(""))


def _parsed(pieces: DataFrame) -> DataFrame:
    """Each piece's length and, if it begins with a header, the header's fields and the bytes up to its successor."""
    head = F.when(F.contains("value", F.lit(END)), F.substring_index("value", END, 1))
    rows = pieces.withColumn("head", head)
    rows = rows.withColumn("content", _field(F.col("head"), "Content-Length", "([0-9]{1,15})").cast("long"))
    body = F.octet_length("head") + len(END)
    rows = rows.withColumn("n", F.octet_length("value").cast("long")).withColumn("size", len(MAGIC) + body + F.col("content") + len(END))
    whole = F.col("n") + len(MAGIC) == F.col("size")
    payload = F.substring(F.col("value").cast("binary"), body + 1, F.col("content").cast("int"))
    return rows.select(
        "file", "block", "file_size", "n", "size", "content", whole.alias("whole"), F.when(whole, F.sha1(payload)).alias("sha1"),
        _field(F.col("head"), "WARC-Type", "([a-z]+)").alias("type"),
        _field(F.col("head"), "WARC-Record-ID", "<urn:page:(-?[0-9]+)>").cast("long").alias("page_id"),
        _field(F.col("head"), "WARC-Refers-To", "<urn:page:(-?[0-9]+)>").cast("long").alias("refers_to"),
        _field(F.col("head"), "WARC-Payload-Digest", "sha1:([A-Z2-7]{32})").alias("digest"),
        _field(F.col("head"), "X-Payload-Length", "([0-9]{1,15})").cast("long").alias("length"),
        _field(F.col("head"), "WARC-Target-URI", r"([^\r\n]*)").alias("uri"),
    )


def _placed(found: DataFrame) -> DataFrame:
    """Adds ``at``, the offset of the magic before each piece, to written rows of (file, block, seq, n, ...); the first
    piece of a file has none before it and gets a negative one."""
    step = F.col("n") + len(MAGIC)
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ranges = found.groupBy("file", "block").agg(F.sum(step).alias("bytes"))
    ranges = ranges.withColumn("base", F.coalesce(F.sum("bytes").over(before), F.lit(0))).drop("bytes")
    inside = Window.partitionBy("file", "block").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = found.withColumn("local", F.coalesce(F.sum(step).over(inside), F.lit(0))).join(ranges, ["file", "block"])
    return rows.withColumn("at", F.col("base") + F.col("local") - len(MAGIC)).drop("base", "local")


def candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Every piece with its place ``at`` and ``next``, the offset of its successor (null: it is no record)."""
    rows = _placed(cut_lineage(_parsed(_pieces(spark, folder)).withColumn("seq", F.monotonically_increasing_id())))
    end = F.col("at") + F.col("size")
    next_ = F.when((F.col("at") >= 0) & (end <= F.col("file_size")), end)
    return rows.withColumn("next", next_).drop("block", "seq", "n", "size", "file_size")


def reachable(edges: DataFrame) -> DataFrame:
    """(file, at) of the candidates on each file's chain from offset 0, from (file, at, next)."""
    state = cut_lineage(edges.where("next IS NOT NULL").select("file", "at", F.col("next").alias("jump"), (F.col("at") == 0).alias("live")))
    while not state.where("at = 0 AND jump IS NOT NULL").isEmpty():
        hop = state.select("file", F.col("at").alias("jump"), F.col("jump").alias("far"), F.lit(True).alias("real"))
        moved = state.join(hop, ["file", "jump"], "left")
        ahead = moved.where("live AND real").select("file", F.col("jump").alias("at"), F.lit(None).cast("long").alias("jump"), F.lit(True).alias("live"))
        stay = moved.select("file", "at", F.col("far").alias("jump"), "live")
        state = cut_lineage(stay.unionByName(ahead).groupBy("file", "at").agg(F.max("jump").alias("jump"), F.max("live").alias("live")))
    return state.where("live").select("file", "at")


def _bodies(spark: SparkSession, folder: str, pieces: DataFrame) -> DataFrame:
    """file, at, body: what stands after the magic of each record, put together from its pieces (file, at, record).

    The files that hold any are read once more and their pieces placed anew, since byte ranges may differ from the
    first reading.
    """
    pieces = cut_lineage(pieces)
    raw = _pieces(spark, folder).select("file", "block", "value", F.octet_length("value").cast("long").alias("n"), F.monotonically_increasing_id().alias("seq"))
    texts = cut_lineage(raw.join(pieces.select("file").distinct(), "file", "left_semi"))
    keys = cut_lineage(_placed(texts.drop("value")).join(pieces, ["file", "at"]).select("file", "block", "seq", "at", "record"))
    if keys.count() <= BROADCAST_ROWS:
        keys = F.broadcast(keys)
    parts = texts.join(keys, ["file", "block", "seq"]).groupBy("file", "record").agg(F.sort_array(F.collect_list(F.struct("at", "value"))).alias("parts"))
    return parts.select("file", F.col("record").alias("at"), F.array_join("parts.value", MAGIC).alias("body"))


def read_warc(spark: SparkSession, folder: str, payload: bool = False) -> DataFrame:
    """Records of the archives: file, at, type, page_id, uri, refers_to, digest and length (as written), n_bytes and
    sha1 (of the content read), with ``payload`` also the content itself (bytes)."""
    found = candidates(spark, folder)
    live = reachable(found)
    records = cut_lineage(found.join(live, ["file", "at"]))
    wanted = records if payload else records.where("NOT whole")
    fields = ["file", "at", "type", "page_id", "uri", "refers_to", "digest", "length", F.col("content").alias("n_bytes"), "sha1"]
    if not payload and wanted.isEmpty():
        return records.select(*fields)
    marks = found.where("at >= 0").select("file", "at").join(live.withColumn("record", F.col("at")), ["file", "at"], "left")
    owner = F.last("record", ignorenulls=True).over(Window.partitionBy("file").orderBy("at"))
    marks = marks.join(wanted.select("file").distinct(), "file", "left_semi").withColumn("record", owner)
    ends = wanted.select("file", F.col("at").alias("record"), F.col("next").alias("end"))
    pieces = marks.join(ends, ["file", "record"]).where(F.col("at") < F.col("end")).drop("end")
    start = F.octet_length(F.substring_index("body", END, 1)) + len(END) + 1
    joined = wanted.drop("sha1").join(_bodies(spark, folder, pieces), ["file", "at"])
    joined = joined.withColumn("payload", F.substring(F.col("body").cast("binary"), start, F.col("content").cast("int"))).withColumn("sha1", F.sha1("payload"))
    if payload:
        return joined.select(*fields, "payload")
    return records.where("whole").select(*fields).unionByName(joined.select(*fields))


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Writes the pages into a new folder of the shared one and reads them back: page_id, payload_bytes, payload_digest,
    record_type, refers_to. A response's figures are those of the payload read, a revisit's those in its header."""
    spark = pages.sparkSession
    folder = f"{checkpoint_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write_warc(pages, folder, min_bytes)
    rows = read_warc(spark, folder)
    mine = F.col("type") == "response"
    return rows.select(
        "page_id",
        F.when(mine, F.col("n_bytes")).otherwise(F.col("length")).alias("payload_bytes"),
        F.when(mine, base32(F.col("sha1"))).otherwise(F.col("digest")).alias("payload_digest"),
        F.col("type").alias("record_type"),
        "refers_to",
    )
