"""WARC archives: writing, and reading back with boundary-chain verification.

Writing: each page is one record; the archive is written by Spark's text writer, whose line separator
is the blank lines that end a record, so the bytes are those of an uncompressed WARC file. Pages with
equal payloads of at least ``min_bytes`` are written once, the others are ``revisit`` records without
a body that name the page they repeat. Only ids and digests are shuffled to find them, no bodies.

Reading: the archives are read in splits, cut at the magic ``WARC/1.1`` line. The magic may stand in
a payload as well, so each cut is only a candidate; from its header every candidate's successor
offset is computed. Candidates of a split that follow each other without a gap, and that no other
candidate's successor enters from elsewhere, form a chain link. Pointer jumping over the links from
offset 0 of each file (the reached set and the jump length double in each round) keeps those that the
chain from the file's start reaches. All of this takes offsets and no text. The archive is then read
again: a record that holds no magic is complete in its stretch and stays where it is, and only the
stretches of records with magic inside are brought together.

Both reads cut the files into the same splits and number their stretches alike, as the files and the
settings are the same. Files are told apart by a 64-bit hash of their path.

Null html is an empty payload; a null url gives no target; a null page_id gives a record without an
id. Rows that repeat a page_id are records of their own; of equal payloads, all rows with the smallest
page_id are responses. An empty table gives an empty archive. Other columns, whatever their names, are
ignored. A text of any length is one record; a record with magic inside must fit into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from docloom.llm.common import finished, remove, table, work_dir, written

MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
#: Up to so many revisits (48 bytes each) are broadcast; beyond, records and revisits are joined by a shuffle.
BROADCAST_REVISITS = 200_000
#: Up to so many stretches of records with magic inside (40 bytes each) are broadcast.
BROADCAST_STRETCHES = 200_000
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def records(pages: DataFrame, work: str, min_bytes: int = 100, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """One row per page: the record's text without the blank lines that end it. ``work`` is a folder for a narrow table."""
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(body_col), F.lit("")).alias("body"))
    digest = F.sha2(F.encode("body", "UTF-8"), 256)
    rows = rows.withColumn("digest", digest)
    # ids and digests (32 bytes) alone are shuffled; a payload that very many pages share is aggregated before
    short = rows.where(F.octet_length("body") >= min_bytes).select("id", F.unhex("digest").alias("d"))
    first = short.groupBy("d").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").select("d", "first")
    again = written(short.join(first, "d").where("id > first").select("id", "d", "first").distinct(), f"{work}/again")
    if again.count() <= BROADCAST_REVISITS:
        again = F.broadcast(again)
    rows = rows.withColumn("d", F.unhex("digest")).join(again, ["id", "d"], "left").withColumn("revisit", F.col("first").isNotNull())
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    block = F.when(F.col("revisit"), F.lit("")).otherwise(F.concat(F.lit(HTTP), F.col("body")))
    head = F.concat(
        F.lit(MAGIC), line("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")),
        F.coalesce(line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.col("id").cast("string"), F.lit(">"))), F.lit("")),
        F.coalesce(line("WARC-Target-URI", F.regexp_replace("url", "[\\x00-\\x20\\x7F]", "%20")), F.lit("")),
        F.lit("WARC-Date: 1970-01-01T00:00:00Z\r\n"), line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(F.col("revisit"), F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("first").cast("string"), F.lit(">"))))).otherwise(F.lit("Content-Type: application/http; msgtype=response\r\n")),
        line("Content-Length", F.octet_length(block).cast("string")), F.lit("\r\n"))
    return rows.select(F.concat(head, block).alias("value"))


def write_archives(pages: DataFrame, path: str, work: str, **options) -> None:
    records(pages, work, **options).write.mode("overwrite").option("lineSep", END).text(path)


def _field(head: Column, name: str) -> Column:
    found = F.regexp_extract(head, f"(?:^|\\r\\n){name}: ([^\\r\\n]*)", 1)
    return F.when(found != "", found)


def _stretches(spark, path: str) -> DataFrame:
    """The archives cut at each magic: file, split, place n in the split's order, size in bytes, value, head, and the header's block length."""
    cuts = spark.read.option("lineSep", MAGIC).text(path).select(
        "value", F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.col("_metadata.file_size").alias("file_size"), F.monotonically_increasing_id().alias("n"))
    at = F.instr("value", END)
    cuts = cuts.withColumn("size", F.octet_length("value").cast("long")).withColumn("head", F.when(at > 0, F.substr("value", F.lit(1), at - 1)))
    return cuts.withColumn("length", F.expr("try_cast(regexp_extract(head, '(?:^|\\r\\n)Content-Length: ([0-9]{1,15})', 1) as bigint)"))


def _candidates(cuts: DataFrame) -> DataFrame:
    """(file, split, n, offset, next): each stretch's offset, that of its magic, and where its successor must begin."""
    magic, end = len(MAGIC), len(END)
    small = cuts.select("file", "split", "n", "size", "file_size", F.octet_length("head").alias("head_size"), "length")
    splits = small.groupBy("file", "split").agg(F.sum(F.col("size") + magic).alias("bytes"))
    before = F.coalesce(F.sum("bytes").over(W.partitionBy("file").orderBy("split").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    splits = splits.select("file", "split", before.alias("base"))
    inside = F.sum(F.col("size") + magic).over(W.partitionBy("file", "split").orderBy("n").rowsBetween(W.unboundedPreceding, -1))
    # every byte lies in one stretch; it follows its magic, so its candidate begins that many bytes earlier, and a file's first stretch has no magic and no record
    small = small.withColumn("in_split", F.coalesce(inside, F.lit(0))).join(splits, ["file", "split"])
    small = small.withColumn("offset", F.col("base") + F.col("in_split") - magic)
    after = F.col("offset") + magic + F.col("head_size") + end + F.col("length") + end
    return small.select("file", "split", "n", "offset", F.when(after <= F.col("file_size"), after).alias("next"))


def _reached(known: DataFrame, work: str) -> DataFrame:
    """(file, split, n, offset, found) of ``known``: whether the chain from offset 0 of the file leads to the candidate."""
    own = W.partitionBy("file", "split").orderBy("offset")
    rows = known.withColumn("was", F.lag("next").over(own))
    # successors that are not the stretch behind: there a link begins
    far = rows.withColumn("behind", F.lead("offset").over(own)).where("next is not null and (behind is null or next <> behind)")
    entered = far.select("file", F.col("next").alias("offset"), F.lit(True).alias("entered")).distinct()
    rows = rows.join(entered, ["file", "offset"], "left")
    begins = F.col("entered").isNotNull() | F.col("was").isNull() | (F.col("was") != F.col("offset"))
    rows = written(rows.withColumn("link", F.max(F.when(begins, F.col("offset"))).over(own.rowsBetween(W.unboundedPreceding, 0))).select("file", "split", "n", "offset", "next", "link"), f"{work}/links")

    # after k rounds `jump` leads 2^k links on, and `reached` holds the first 2^k
    jump = rows.groupBy("file", "link").agg(F.max_by("next", "offset").alias("next")).where("next is not null").select("file", F.col("link").alias("offset"), "next")
    reached = rows.where("offset = 0").select("file", "offset")
    jump, total, k = written(jump, f"{work}/jump0"), -1, 0
    while True:
        reached = written(reached.join(jump, ["file", "offset"]).select("file", F.col("next").alias("offset")).union(reached).distinct(), f"{work}/reached{k + 1}")
        remove(known.sparkSession, f"{work}/reached{k}")
        size = reached.count()
        if size == total:
            break
        total = size
        ahead = jump.select("file", F.col("offset").alias("next"), F.col("next").alias("next2"))
        jump = written(jump.join(ahead, ["file", "next"]).select("file", "offset", F.col("next2").alias("next")), f"{work}/jump{k + 1}")
        remove(known.sparkSession, f"{work}/jump{k}")
        k += 1
    # an offset behind a file's last record is reached too, but no link begins there
    true = reached.select("file", F.col("offset").alias("link"), F.lit(True).alias("found"))
    return rows.join(true, ["file", "link"], "left").select("file", "split", "n", "offset", F.coalesce("found", F.lit(False)).alias("found"))


def read_archives(spark, path: str, work: str) -> DataFrame:
    """One row per true record: file (a hash of its path), the header fields, and the block as text.

    Below ``work`` go narrow tables of offsets, of which the result reads some."""
    known = written(_candidates(_stretches(spark, path)), f"{work}/candidates")
    placed = written(_reached(known, work), f"{work}/placed")
    # the record of each stretch: the last true one in its split, or else in the splits before
    last = placed.groupBy("file", "split").agg(F.max(F.when(F.col("found"), F.col("offset"))).alias("last"))
    last = last.select("file", "split", F.max("last").over(W.partitionBy("file").orderBy("split").rowsBetween(W.unboundedPreceding, -1)).alias("earlier"))
    here = F.max(F.when(F.col("found"), F.col("offset"))).over(W.partitionBy("file", "split").orderBy("offset").rowsBetween(W.unboundedPreceding, 0))
    placed = placed.withColumn("here", here).join(last, ["file", "split"]).select("file", "split", "n", "offset", "found", F.coalesce("here", "earlier").alias("record"))
    cut = placed.where("not found and record is not null").select("file", "record").distinct().withColumn("cut", F.lit(True))
    parts = placed.join(cut, ["file", "record"], "left").where("cut or record is null").select("file", "split", "n", "offset", "record")
    parts = written(parts, f"{work}/parts")
    remove(spark, f"{work}/candidates")
    remove(spark, f"{work}/links")

    keyed = ["file", "split", "n"]
    few = parts.count() <= BROADCAST_STRETCHES
    texts = _stretches(spark, path).select(*keyed, "value")
    # what lies in no part is a whole record; parts of no record are what no chain reaches
    whole = texts.join(F.broadcast(parts.select(*keyed)) if few else parts.select(*keyed), keyed, "left_anti").select("file", "value")
    split = parts.where("record is not null")
    split = texts.join(F.broadcast(split) if few else split, keyed)
    split = split.groupBy("file", "record").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("offset", "value"))), lambda x: x["value"]), MAGIC).alias("value"))
    every, end = whole.unionByName(split.select("file", "value")), len(END)
    at = F.instr("value", END)
    fields = {"record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To", "content_length": "Content-Length"}
    every = every.withColumn("head", F.substr("value", F.lit(1), at - 1)).withColumn("rest", F.substr("value", at + end))
    # the rest is the block and the blank lines that end the record
    return every.select("file", *[_field(F.col("head"), v).alias(k) for k, v in fields.items()], F.expr(f"substr(rest, 1, length(rest) - {end})").alias("block"))


def round_trip(pages: DataFrame, path: str, **options) -> DataFrame:
    """Writes the pages' archives below ``path`` and reads them back."""
    write_archives(pages, f"{path}/archive", f"{path}/write", **options)
    return read_archives(pages.sparkSession, f"{path}/archive", f"{path}/read")


def op5_warc_roundtrip(spark, sf_dir: str) -> DataFrame:
    base = work_dir(spark)
    read = round_trip(table(spark, sf_dir, "pages"), base)
    number = lambda c: F.expr(f"try_cast(regexp_extract({c}, '<urn:page:(-?[0-9]+)>', 1) as bigint)")
    payload = F.expr("substr(block, instr(block, '\r\n\r\n') + 4)")
    # what is stored is measured; a revisit's payload is that of the response it names
    read = read.select(number("record_id").alias("page_id"), "record_type", F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha2(F.encode(payload, "UTF-8"), 256).alias("own"), F.substring("payload_digest", 8, 64).alias("digest"), number("refers_to").alias("refers_to"))
    read = written(read, f"{base}/measured")
    kept = read.where("record_type = 'response'").select("page_id", "payload_bytes", F.col("own").alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    again = read.where("record_type = 'revisit'").select("page_id", "digest", "refers_to")
    # many pages may name one response: the ids that are asked for come from the revisits, aggregated before the shuffle
    asked = again.select("refers_to", "digest").distinct()
    targets = kept.select(F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("digest"), "payload_bytes").join(asked, ["refers_to", "digest"], "left_semi").distinct()
    again = again.join(targets, ["refers_to", "digest"], "left").select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), F.lit("revisit").alias("record_type"), "refers_to")
    return finished(kept.unionByName(again), base)


SQL = """
with p as (select page_id, coalesce(html, '') as body, sha256(coalesce(html, '')) as digest from pages),
g as (select *, octet_length(encode(body)) as n, min(page_id) over (partition by digest) as first_id from p)
select page_id, n as payload_bytes, digest as payload_digest,
       case when n >= 100 and page_id > first_id then 'revisit' else 'response' end as record_type,
       case when n >= 100 and page_id > first_id then first_id end as refers_to
from g
"""
