"""A content-addressed WARC archive.

Payload bytes are stored once under a strong digest (SHA-256), exact record headers apart from them,
and records come back from joins of the two. Which page of equal payloads owns the stored bytes (the
``response``; the largest page id) is settled on narrow rows; the others are ``revisit`` records
that refer to it. Reading verifies every payload against its digest and every header against its
payload.
"""

from __future__ import annotations

import base64
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.columns import column_function, shared_dir, small_batches

#: Pages carry no date; the records' date is this unless another is given.
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n"
#: Stands for a null page id in joins.
NO_PAGE = -(1 << 63)


def _base32(hexes: list) -> list:
    return [None if h is None else base64.b32encode(bytes.fromhex(h.decode())).decode() for h in hexes]


def _digests(payload) -> list:
    base32 = column_function(lambda: _base32, "string")
    return [F.sha2(payload, 256).alias("sha256"), base32(F.sha1(payload)).alias("sha1"), F.octet_length(payload).cast("bigint").alias("n")]


def _record_id(page, url, sha256) -> F.Column:
    """An id of page, url and payload; rows that repeat all three are one record written again."""
    h = F.md5(F.concat_ws("\n", F.lit("page"), F.coalesce(page.cast("string"), F.lit("none")), sha256, F.coalesce(url, F.lit("none"))))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def headers(rows: DataFrame, date: str = DATE) -> F.Column:
    """The exact header of a record: WARC fields, a blank line, and the HTTP header that starts the block."""
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), F.col("n").cast("string"), F.lit(END + END))
    length = F.length(http) + F.when(F.col("record_type") == "response", F.col("n")).otherwise(0)
    revisit = F.concat(F.lit(f"WARC-Profile: {PROFILE}{END}WARC-Refers-To: "), _record_id(F.col("owner"), F.col("owner_url"), F.col("sha256")), F.lit(END))
    return F.concat(
        F.lit(f"WARC/1.1{END}WARC-Type: "), F.col("record_type"), F.lit(f"{END}WARC-Record-ID: "), _record_id(F.col("page_id"), F.col("url"), F.col("sha256")), F.lit(f"{END}WARC-Date: {date}{END}WARC-Target-URI: "),
        F.replace(F.replace(F.coalesce("url", F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")), F.lit(f"{END}WARC-Payload-Digest: sha1:"), F.col("sha1"), F.lit(END), F.when(F.col("record_type") == "revisit", revisit).otherwise(""),
        F.lit(f"Content-Type: application/http;msgtype=response{END}Content-Length: "), length.cast("string"), F.lit(END + END), http,
    )


def write(pages: DataFrame, path: str, page: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0, date: str = DATE) -> None:
    """Writes the tables ``path/headers`` and ``path/payloads``.

    Null payloads are empty. Payloads under ``min_bytes`` are all responses. Rows that repeat a page
    id and its payload are all responses of that page; their bytes are stored once. Null page ids
    come before all others, so such a row is a response unless a numbered page has its payload. Line
    breaks in a url are percent-encoded, as they would end the header line. Payloads of any length are
    one value. An empty table writes empty tables. Other columns are left out, whatever their names.
    """
    small_batches(pages.sparkSession)
    payload = F.coalesce(F.col(html).cast("string"), F.lit(""))
    rows = pages.select(F.coalesce(F.col(page).cast("bigint"), F.lit(NO_PAGE)).alias("page_key"), F.col(url).cast("string").alias("url"), payload.alias("payload"))
    keyed = rows.select("page_key", "url", *_digests(F.col("payload")))
    owners = rows.select("page_key", "url", F.sha2("payload", 256).alias("sha256")).groupBy("sha256").agg(F.max(F.struct("page_key", "url")).alias("owner"))
    owners = owners.select("sha256", F.col("owner.page_key").alias("owner_key"), F.col("owner.url").alias("owner_url"))
    named = lambda c: F.when(F.col(c) > NO_PAGE, F.col(c))
    typed = keyed.join(owners, "sha256").withColumn("record_type", F.when((F.col("n") < min_bytes) | (F.col("page_key") == F.col("owner_key")), "response").otherwise("revisit"))
    typed = typed.withColumns({"page_id": named("page_key"), "owner": named("owner_key")})
    typed.select("page_id", "sha256", headers(typed, date).alias("header")).write.mode("overwrite").parquet(f"{path}/headers")
    # Payloads are shuffled once: the join's partitions also serve to drop repeated rows.
    stored = rows.withColumn("sha256", F.sha2("payload", 256)).join(owners.withColumnRenamed("owner_key", "page_key"), ["sha256", "page_key"]).dropDuplicates(["sha256", "page_key"])
    stored.select("sha256", named("page_key").alias("stored_by"), F.col("owner_url").alias("stored_url"), "payload").write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/payloads")


def records(spark: SparkSession, path: str) -> DataFrame:
    """The original records, byte for byte: page_id and record, from a join of headers and payloads."""
    parts = spark.read.parquet(f"{path}/headers").join(spark.read.parquet(f"{path}/payloads"), "sha256")
    body = F.when(_field("WARC-Type") == "response", F.col("payload")).otherwise("")
    return parts.select("page_id", F.encode(F.concat("header", body, F.lit(END + END)), "UTF-8").alias("record"))


def _field(name: str):
    return F.regexp_extract("header", rf"\r\n{name}: ([^\r\n]*)\r\n", 1)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Per record: page_id, payload_bytes, payload_digest, record_type, refers_to, from what is stored.

    Fails if stored bytes don't have their digest or a header doesn't fit its payload.
    """
    small_batches(spark)
    stored = spark.read.parquet(f"{path}/payloads")
    sha256, sha1, n = _digests(F.col("payload"))
    stored = stored.select(F.col("sha256").alias("of"), "stored_by", "stored_url", sha256, sha1, n)
    sound = F.assert_true(F.col("of") == F.col("sha256"), F.concat(F.lit("damaged payload "), F.col("of")))
    stored = stored.filter(sound.isNull()).select("sha256", "stored_by", "stored_url", "sha1", "n")
    told = spark.read.parquet(f"{path}/headers").select("page_id", "sha256", _field("WARC-Type").alias("record_type"), F.substring_index(_field("WARC-Payload-Digest"), ":", -1).alias("digest"), F.element_at(F.regexp_extract_all("header", F.lit(r"\r\nContent-Length: (\d+)\r\n"), 1), -1).cast("bigint").alias("length"), _field("WARC-Refers-To").alias("refers"))
    met = told.join(stored, "sha256")
    fits = (F.col("digest") == F.col("sha1")) & (F.col("length") == F.col("n")) & ((F.col("record_type") == "response") | (F.col("refers") == _record_id(F.col("stored_by"), F.col("stored_url"), F.col("sha256"))))
    met = met.filter(F.assert_true(fits, F.concat(F.lit("header and payload differ: "), F.col("sha256"))).isNull())
    return met.select("page_id", F.col("n").alias("payload_bytes"), F.col("sha1").alias("payload_digest"), "record_type", F.when(F.col("record_type") == "revisit", F.col("stored_by")).alias("refers_to"))


def archive(pages: DataFrame, **options) -> DataFrame:
    """Writes the pages to an archive in the shared folder and reads it back."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(pages, path, **options)
    return read(spark, path)
