"""A content-addressed WARC archive.

Each different payload is stored once, under its SHA-256; the exact header text of every record is stored apart, with
that address. The first record of a payload (by the caller's order) is a `response`, the others revisit it. Records are
put together again by a join on the address, after each payload has been held against its address, its length and the
SHA-1 that headers state.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlake.llm.common import written

# The words of the format.
VERSION = "WARC/1.1"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LINE, GAP = "\r\n", "\r\n\r\n"
BASE32, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789ABCDEFGHIJKLMNOPQRSTUV"

HEADERS = "record long, address string, header string, http string"
PAYLOADS = "address string, bytes long, sha1 string, payload string"


@dataclass
class Archive:
    """Two tables. headers: record, address, header (the record's own) and http (that of the block); payloads: address,
    bytes, sha1 (base32) and the payload."""

    headers: DataFrame
    payloads: DataFrame


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 of the SHA-1: 40 bits are ten hex digits or eight of base 32, four times."""
    digest = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(digest, 10 * k + 1, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*parts), DIGITS, BASE32)


def one_line(text: Column) -> Column:
    """Line ends would end a header: they are percent-encoded."""
    return F.replace(F.replace(text, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def record_id(page: Column, record: Column) -> Column:
    """`<urn:page:PAGE:RECORD>`; a null page has an empty part."""
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("")), F.lit(":"), record.cast("string"), F.lit(">"))


def field(header: Column, name: str, pattern: str) -> Column:
    """What follows a field's name in a header, or null."""
    return F.nullif(F.regexp_extract(header, rf"\r\n{name}: {pattern}\r\n", 1), F.lit(""))


def page_of(header: Column, name: str) -> Column:
    return field(header, name, r"<urn:page:(-?[0-9]+):[0-9]+>").cast("long")


def write_archive(pages: DataFrame, date: str, page_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> Archive:
    """Writes the records of `pages` to the folder of spark.checkpoint.dir, one a row, repeated rows too.

    Of rows with equal payloads the one with the largest page (a null is least; of equal pages any one) is the response.
    A null payload is empty; empty payloads are equal ones like others. A null URL has no WARC-Target-URI; line ends in
    it are percent-encoded. Other columns aren't read. Payloads that differ in length or SHA-1 under one address end the
    job.

    The rows' narrow columns are written first, so that record numbers stay when a task runs again. Copies are put
    together in each task before payloads are shuffled, so a payload that a third of all rows hold is sent once a task.
    """
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    rows = pages.select(F.col(page_col).cast("long").alias("page"), F.col(url_col).alias("url"), payload.alias("payload"))
    measured = rows.withColumns({"address": F.sha2("payload", 256), "bytes": F.octet_length("payload").cast("long"), "sha1": base32_sha1(F.col("payload"))})
    once = measured.groupBy("address").agg(
        *[F.first(c).alias(c) for c in ("bytes", "sha1", "payload")], F.min("bytes").alias("least"), F.max("bytes").alias("most"), F.min("sha1").alias("low"), F.max("sha1").alias("high"),
    )
    sound = F.when((F.col("least") == F.col("most")) & (F.col("low") == F.col("high")), F.col("address")).otherwise(F.raise_error("two payloads under one address"))
    payloads = written(once.select(sound.alias("address"), "bytes", "sha1", "payload"), "payloads")

    index = written(measured.select(F.monotonically_increasing_id().alias("record"), "page", "url", "address", "bytes", "sha1"), "records")
    first = index.groupBy("address").agg(F.max(F.struct("page", "record")).alias("first"))
    return Archive(written(headed(index.join(first, "address"), date), "headers"), payloads)


def headed(rows: DataFrame, date: str) -> DataFrame:
    """The header texts of rows with `first`, the page and record that they revisit, or are."""
    own = F.col("record") == F.col("first.record")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{LINE}Content-Type: text/html; charset=utf-8{LINE}Content-Length: "), F.col("bytes").cast("string"), F.lit(GAP))
    block = F.octet_length("http") + F.when(own, F.col("bytes")).otherwise(0)
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(LINE))
    header = F.concat(
        F.lit(VERSION + LINE),
        line("WARC-Type", F.when(own, "response").otherwise("revisit")),
        line("WARC-Record-ID", record_id(F.col("page"), F.col("record"))),
        line("WARC-Date", F.lit(date)),
        F.coalesce(line("WARC-Target-URI", one_line(F.col("url"))), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "sha1")),
        F.when(own, "").otherwise(F.concat(line("WARC-Profile", F.lit(SAME_PAYLOAD)), line("WARC-Refers-To", record_id(F.col("first.page"), F.col("first.record"))))),
        line("Content-Type", F.lit("application/http;msgtype=response")),
        line("Content-Length", block.cast("string")),
        F.lit(LINE),
    )
    return rows.withColumn("http", http).select("record", "address", header.alias("header"), "http")


def read_archive(archive: Archive) -> DataFrame:
    """One row for each record, from its header and its payload: page_id, record, record_type, refers_to (the page of the
    response, null for responses), url, header, http, payload, payload_bytes and payload_digest.

    Length and digests are made anew from the stored payload; one that doesn't fit its address, or the digest that the
    header states, ends the job. A query that doesn't ask for `payload` shuffles none.
    """
    data = F.col("payload")
    held = F.when((F.sha2(data, 256) == F.col("address")) & (F.octet_length(data) == F.col("bytes")), F.col("address")).otherwise(F.raise_error("a payload doesn't fit its address"))
    payloads = archive.payloads.select(held.alias("address"), "payload", F.octet_length(data).cast("long").alias("payload_bytes"), base32_sha1(data).alias("payload_digest"))
    rows = archive.headers.join(payloads, "address", "left")
    stated, header = field(F.col("header"), "WARC-Payload-Digest", "sha1:([A-Z2-7]+)"), F.col("header")
    digest = F.when(stated == F.col("payload_digest"), stated).otherwise(F.raise_error("a payload is missing or doesn't fit its header"))
    return rows.select(
        page_of(header, "WARC-Record-ID").alias("page_id"),
        "record",
        field(header, "WARC-Type", "([a-z]+)").alias("record_type"),
        page_of(header, "WARC-Refers-To").alias("refers_to"),
        field(header, "WARC-Target-URI", r"([^\r\n]*)").alias("url"),
        "header",
        "http",
        "payload",
        "payload_bytes",
        digest.alias("payload_digest"),
    )


def record_text(rows: DataFrame) -> DataFrame:
    """Adds `warc`, a record as it stands in a WARC file, without the two line ends after it. Revisits hold no payload."""
    return rows.withColumn("warc", F.concat("header", "http", F.when(F.col("record_type") == "response", F.col("payload")).otherwise("")))


def export_warc(archive: Archive, path: str, gzip: bool = True) -> None:
    """WARC files, one a task: the text writer ends each record with the two line ends that the format asks for."""
    rows = record_text(read_archive(archive)).select("warc")
    rows.write.mode("overwrite").option("lineSep", GAP).option("compression", "gzip" if gzip else "none").text(path)


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes `pages` as an archive and reads it back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    One row for each row of `pages`, repeated ones too: of equal payloads one row is the response, also among rows with
    one id. Null pages are empty payloads. A null page_id stays null and comes before all others, so it is only referred
    to (as null) where no row with that payload has an id. An empty table gives no rows.
    """
    archive = write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"), date="2024-01-01T00:00:00Z")
    return read_archive(archive).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (
  SELECT row_number() OVER () AS record, page_id, coalesce(html, '') AS payload FROM pages
), r AS (
  SELECT *, sha1(payload) AS h, row_number() OVER (PARTITION BY payload ORDER BY page_id DESC NULLS LAST, record) AS place, max(page_id) OVER (PARTITION BY payload) AS response FROM p
)
SELECT page_id, octet_length(encode(payload))::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, 5 * (i // 4)::INTEGER + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INTEGER, 1)), '') AS payload_digest,
  CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN place > 1 THEN response END AS refers_to
FROM r
"""
