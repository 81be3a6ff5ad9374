"""Content-addressed web archive.

``write_archive`` stores two tables below a shared path:

* ``payloads``: every distinct payload once, addressed by its SHA-256 digest;
* ``headers``: the exact header block of every record (WARC headers and the HTTP head),
  with the digest that addresses its payload.

``read_archive`` verifies each stored payload against its address and joins the two, so a
record is ``header ++ payload ++ CRLF CRLF`` (``revisit`` records carry no payload of
their own and resolve to the payload of the record that they refer to).

Payloads are shuffled once, by digest, with map-side combination, so a payload that fills
a third of all rows reaches its reducer once per map task. The join of headers with
addresses moves only digests and headers; Spark splits its skewed partitions.

Defined results: a null payload is the empty payload; a null id sorts after every other
and reads back as null; among equal payloads every row with the smallest id is a response
(repeated rows included), all others revisit it; a payload below ``min_revisit`` bytes is
always a response; line breaks in a URL are percent-encoded and a null URL is ``about:blank``;
columns besides the three named ones are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditframe.llm.common import shared_dir, table

MIN_REVISIT_BYTES = 100
CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _record_name(rec_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(rec_id.cast("string"), F.lit("none")), F.lit(">"))


def _header(url: Column, rec_id: Column, digest: Column, size: Column, revisit: Column, refers_to: Column) -> Column:
    safe_url = F.replace(F.replace(F.coalesce(url, F.lit("about:blank")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK" + CRLF + "Content-Type: text/html; charset=utf-8" + CRLF + "Content-Length: "), size.cast("string"), F.lit(CRLF + CRLF)
    )
    block = F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(size)
    return F.concat(
        F.lit("WARC/1.1" + CRLF + "WARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit(CRLF + "WARC-Record-ID: "), _record_name(rec_id),
        F.lit(CRLF + "WARC-Target-URI: "), safe_url,
        F.lit(CRLF + "WARC-Date: 1970-01-01T00:00:00Z" + CRLF + "WARC-Payload-Digest: sha256:"), digest,
        F.when(revisit, F.concat(F.lit(CRLF + "WARC-Profile: " + PROFILE + CRLF + "WARC-Refers-To: "), _record_name(refers_to))).otherwise(F.lit("")),
        F.lit(CRLF + "Content-Type: application/http; msgtype=response" + CRLF + "Content-Length: "), block.cast("string"),
        F.lit(CRLF + CRLF), http,
    )


def write_archive(
    pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", min_revisit: int = MIN_REVISIT_BYTES
) -> None:
    """Write one record per row of ``pages`` below ``path``."""
    spark = pages.sparkSession
    body = F.coalesce(F.col(body_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("rec_id"), F.col(url_col).cast("string").alias("url"), body.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    key = F.struct(F.col("rec_id").isNull(), "rec_id")  # null ids sort last
    payloads = rows.groupBy("digest").agg(F.min_by("payload", key).alias("payload"), F.min("rec_id").alias("first_id"), F.count("*").alias("uses"))
    payloads.write.option("compression", "zstd").parquet(f"{path}/payloads")
    shared = spark.read.parquet(f"{path}/payloads").filter("uses > 1").select("digest", "first_id")
    lean = rows.select("rec_id", "url", "digest", F.length("payload").alias("size")).join(shared, "digest", "left")
    revisit = (F.col("size") >= min_revisit) & F.col("first_id").isNotNull() & (F.col("rec_id").isNull() | (F.col("rec_id") > F.col("first_id")))
    headers = lean.select("digest", _header(F.col("url"), F.col("rec_id"), F.col("digest"), F.col("size"), revisit, F.col("first_id")).alias("header"))
    headers.write.option("compression", "zstd").parquet(f"{path}/headers")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: fields parsed from its stored header, and its verified payload.

    ``record`` holds the original bytes. Digest and length are taken from the stored bytes
    below the join, and compared above it with those that the header states (a difference
    raises), so a reader that asks only for them verifies every record and moves no payload.
    """
    actual = F.sha2("payload", 256)
    verified = spark.read.parquet(f"{path}/payloads").select(
        "digest",
        "payload",
        F.when(actual == F.col("digest"), actual).otherwise(F.raise_error(F.concat(F.lit("payload is corrupt: "), F.col("digest")))).alias("payload_digest"),
        F.length("payload").cast("long").alias("payload_bytes"),
    )
    header = F.col("header")
    rec_id = F.regexp_extract(header, r"\r\nWARC-Record-ID: <urn:page:(-?[0-9]+)>\r\n", 1)
    refers = F.regexp_extract(header, r"\r\nWARC-Refers-To: <urn:page:(-?[0-9]+)>\r\n", 1)
    kind = F.regexp_extract(header, r"^WARC/1\.1\r\nWARC-Type: ([a-z]+)\r\n", 1)
    records = spark.read.parquet(f"{path}/headers").select(
        "digest",
        "header",
        F.when(rec_id != "", rec_id.cast("long")).alias("rec_id"),
        kind.alias("record_type"),
        F.regexp_extract(header, r"\r\nWARC-Payload-Digest: sha256:([0-9a-f]{64})\r\n", 1).alias("stated_digest"),
        F.regexp_extract(header, r"\r\nContent-Length: ([0-9]+)\r\n\r\n$", 1).cast("long").alias("stated_bytes"),
        (F.regexp_extract(header, r"\r\nContent-Length: ([0-9]+)\r\n\r\nHTTP/", 1).cast("long") - F.octet_length(F.regexp_extract(header, r"\r\n\r\n(HTTP/(?s:.*))$", 1))).alias("stated_own"),
        F.when(refers != "", refers.cast("long")).alias("refers_to"),
    )
    own = F.when(F.col("record_type") == "revisit", F.lit("").cast("binary")).otherwise(F.col("payload"))
    record = F.concat(header.cast("binary"), own, F.lit(CRLF + CRLF).cast("binary"))
    size = F.col("payload_bytes")
    whole = (F.col("stated_digest") == F.col("payload_digest")) & (F.col("stated_bytes") == size) & (F.col("stated_own") == F.when(F.col("record_type") == "revisit", 0).otherwise(size))
    checked = F.when(whole, F.col("payload_digest")).otherwise(F.raise_error(F.concat(F.lit("header and payload differ: "), "header")))
    return records.join(verified, "digest").select("rec_id", "record_type", "refers_to", "payload_bytes", checked.alias("payload_digest"), "payload", "header", record.alias("record"))


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive every page, then read the archive back."""
    path = f"{shared_dir(spark)}/warc"
    write_archive(table(spark, sf_dir, "pages"), path)
    return read_archive(spark, path).select(F.col("rec_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


OP1_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages
), m AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS first_id FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 100 AND page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id > first_id THEN first_id END::BIGINT AS refers_to
FROM m
"""
