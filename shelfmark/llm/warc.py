"""A content-addressed WARC archive.

Two tables: `payloads` holds each distinct payload once under its SHA-256; `records` holds every record's exact header block
with the digest of its payload. A join of both gives the original records back, byte for byte. Writing verifies that rows
with equal digests have equal lengths and equal second digests; reading recomputes the digest of each stored payload.
A header line can't hold line breaks: those of a target are percent-encoded, and the target itself goes along in base 64.

Records with equal payloads of at least `least_bytes` are one response, that with the largest page id, and revisits of it.

Defined results: null html is an empty payload; null url is an empty target; rows that repeat a page id are each kept, and
where they are the largest of their group all of them are responses; a null page id is never the largest, and a group of
null ids only is all responses; an empty table gives two empty tables; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The digits of base 32 as Spark's conv writes them, and as RFC 4648 does.
CONV_DIGITS, BASE32_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
# Of the WARC 1.1 standard.
VERSION, END, REVISIT_PROFILE = "WARC/1.1", "\r\n", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Of this archive: a target that holds line breaks.
TARGET_BASE64 = "Target-URI-Base64"
DATE = "2000-01-01T00:00:00Z"


def sha1_base32(payload: Column) -> Column:
    """SHA-1 in upper-case base 32: five hexadecimal digits make four."""
    hexed = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hexed, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*parts), CONV_DIGITS, BASE32_DIGITS)


def header_block(kind: Column, page_id: Column, url: Column, n: Column, sha1: Column, refers_to: Column) -> Column:
    """The record's header lines and the empty line after them. Revisits have no block of their own."""
    number = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    line = lambda name, *value: F.concat(F.lit(f"{name}: "), *value, F.lit(END))
    whole = F.coalesce(url, F.lit(""))
    target = F.replace(F.replace(whole, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    exact = F.when(whole.rlike("[\r\n]"), line(TARGET_BASE64, F.translate(F.base64(F.encode(whole, "UTF-8")), "\r\n", ""))).otherwise(F.lit(""))
    is_revisit = kind == "revisit"
    return F.concat(
        F.lit(VERSION + END),
        line("WARC-Type", kind),
        line("WARC-Record-ID", F.lit("<urn:page:"), number(page_id), F.lit(">")),
        line("WARC-Target-URI", target),
        exact,
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Payload-Digest", F.lit("sha1:"), sha1),
        F.when(is_revisit, F.concat(line("WARC-Profile", F.lit(REVISIT_PROFILE)), line("WARC-Refers-To", F.lit("<urn:page:"), number(refers_to), F.lit(">")))).otherwise(F.lit("")),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(is_revisit, F.lit("0")).otherwise(n.cast("string"))),
        F.lit(END),
    )


def write_archive(pages: DataFrame, path: str, least_bytes: int = 0) -> None:
    """Write `path`/payloads and `path`/records."""
    rows = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    second = F.struct(F.octet_length("payload").alias("n"), F.md5("payload").alias("md5"))
    by_digest = rows.groupBy("digest").agg(F.first("payload").alias("payload"), F.min(second).alias("low"), F.max(second).alias("high"))
    same = F.when(F.col("low") == F.col("high"), F.col("digest")).otherwise(F.raise_error(F.lit("two payloads with one digest")))
    by_digest.select(same.alias("digest"), "payload").write.parquet(f"{path}/payloads")

    narrow = rows.select("page_id", "url", "digest", F.octet_length("payload").alias("n"), sha1_base32(F.col("payload")).alias("sha1"))
    newest = narrow.groupBy("digest").agg(F.max("page_id").alias("newest"))
    kind = F.when((F.col("n") >= least_bytes) & (F.coalesce(F.col("page_id") != F.col("newest"), F.col("newest").isNotNull())), "revisit").otherwise("response")
    found = narrow.join(newest, "digest").withColumn("kind", kind)
    found.select(header_block(F.col("kind"), F.col("page_id"), F.col("url"), F.col("n"), F.col("sha1"), F.col("newest")).alias("header"), "digest").write.parquet(f"{path}/records")


def header_value(name: str) -> Column:
    """A header line's value; null if there is no such line."""
    return F.nullif(F.regexp_extract("header", rf"\n{name}: ([^\r\n]*)\r\n", 1), F.lit(""))


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """(header, payload): every record with its payload, checked against its digest. A revisit's payload is the one it refers to.

    A payload that many records share is a skewed key of a plain join, which adaptive execution splits.
    """
    payloads = spark.read.parquet(f"{path}/payloads")
    good = F.when(F.sha2("payload", 256) == F.col("digest"), F.col("payload")).otherwise(F.raise_error(F.lit("stored payload doesn't match its digest")))
    return spark.read.parquet(f"{path}/records").join(payloads.select("digest", good.alias("payload")), "digest").select("header", "payload")


def record_bytes(archive: DataFrame) -> DataFrame:
    """(record, payload): the original records as they stand in a WARC file, and the payload that each is of."""
    block = F.when(header_value("WARC-Type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return archive.select(F.concat(F.col("header").cast("binary"), block, F.lit(END + END).cast("binary")).alias("record"), "payload")


def parsed(archive: DataFrame, id_type: str = "long") -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, header_agrees), read from the rebuilt records.

    header_agrees says that a record's block is as long as its header says, is its payload, or nothing in a revisit, and that the payload has the digest of the header.
    """
    number = lambda name: F.nullif(F.regexp_extract(F.coalesce(header_value(name), F.lit("")), r"^<urn:page:(.*)>$", 1), F.lit("")).cast(id_type)
    records = record_bytes(archive).withColumn("header", F.regexp_extract(F.col("record").cast("string"), r"(?s)^.*?\r\n\r\n", 0))
    length = header_value("Content-Length").cast("int")
    after = F.octet_length("header")
    records = records.withColumn("block", F.substring("record", after + 1, length))
    revisit = header_value("WARC-Type") == "revisit"
    whole = (F.octet_length("record") == after + length + 4) & F.when(revisit, length == 0).otherwise(F.col("block") == F.col("payload"))
    sha1 = sha1_base32(F.col("payload"))
    encoded = header_value(TARGET_BASE64)
    return records.select(
        number("WARC-Record-ID").alias("page_id"),
        F.when(encoded.isNotNull(), F.decode(F.unbase64(encoded), "UTF-8")).otherwise(F.coalesce(header_value("WARC-Target-URI"), F.lit(""))).alias("url"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        sha1.alias("payload_digest"),
        header_value("WARC-Type").alias("record_type"),
        number("WARC-Refers-To").alias("refers_to"),
        (whole & (header_value("WARC-Payload-Digest") == F.concat(F.lit("sha1:"), sha1))).alias("header_agrees"),
    )
