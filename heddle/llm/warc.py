"""Web archive with content-addressed payloads.

The archive is two tables. ``payloads`` holds each distinct payload once under its
SHA-256 digest; ``headers`` holds one row for each record with its exact header block
(WARC header and HTTP header) and the digest of its payload. The bytes of a record are
the header block, the payload (responses only) and two line ends; reading joins the
tables, rebuilds those bytes and parses them. Digests are computed again from the
stored bytes when read, and a mismatch is an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the base32 alphabet.
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_of_hex(digest: Column) -> Column:
    """Base32 text of a hexadecimal digest whose bits divide by 20; five hex digits are four characters."""
    out = []
    for group in range(8):
        bits = F.conv(F.substring(digest, 5 * group + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            out.append(F.lit(_BASE32).substr(F.shiftright(bits, shift).bitwiseAND(F.lit(31)) + 1, F.lit(1)))
    return F.concat(*out)


def write_archive(df: DataFrame, root: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write ``root/payloads`` and ``root/headers``.

    Of records with equal payloads of at least ``min_bytes``, the one with the smallest id
    is a response and the others are revisits of it; shorter payloads are all responses.
    A null payload is empty, a null URL an empty target. Line ends in a URL are escaped.
    Ids must not be null. Rows that share an id are records of their own, and rows that share the
    smallest id of a payload are all responses; the payload is still stored once. Other columns are not read.
    """
    body = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    pages = df.select(
        F.col(id_col).cast("bigint").alias("id"),
        F.regexp_replace(F.regexp_replace(F.coalesce(F.col(url_col).cast("string"), F.lit("")), "\r", "%0D"), "\n", "%0A").alias("url"),
        body.alias("payload"),
        F.unhex(F.sha2(body, 256)).alias("key"),
        F.octet_length(body).alias("n_bytes"),
    )
    keys = pages.select("id", "url", "key", "n_bytes", F.sha1("payload").alias("sha1"))
    first = keys.groupBy("key", "n_bytes").agg(F.min("id").alias("first_id"))
    records = keys.join(first, ["key", "n_bytes"])
    revisit = (F.col("id") != F.col("first_id")) & (F.col("n_bytes") >= min_bytes)
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n_bytes"), F.lit("\r\n\r\n"))
    block_bytes = F.length(http) + F.when(revisit, 0).otherwise(F.col("n_bytes"))
    header = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "),
        F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: <urn:record:"),
        F.col("id"),
        F.lit(f">\r\nWARC-Date: {date}\r\nWARC-Target-URI: "),
        F.col("url"),
        F.lit("\r\nWARC-Payload-Digest: sha1:"),
        base32_of_hex(F.col("sha1")),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: <urn:record:"), F.col("first_id"), F.lit(">"))).otherwise(""),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        block_bytes,
        F.lit("\r\n\r\n"),
        http,
    )
    records.select("key", header.alias("header")).write.option("compression", "zstd").parquet(f"{root}/headers")
    owners = first.select(F.col("first_id").alias("id"), F.col("key").alias("first_key"))
    # Rows with equal id and payload meet in the join, so that dropping them moves nothing again.
    stored = pages.select("id", "key", "payload").join(owners, "id").where(F.col("key") == F.col("first_key"))
    stored = stored.dropDuplicates(["id", "key"]).select("key", "payload")
    stored.write.option("compression", "zstd").parquet(f"{root}/payloads")


def read_archive(spark: SparkSession, root: str) -> DataFrame:
    """``(record, payload)``: the exact bytes of each record, and the payload it stands for."""
    headers = spark.read.parquet(f"{root}/headers")
    payloads = spark.read.parquet(f"{root}/payloads")
    sound = F.assert_true(F.unhex(F.sha2("payload", 256)) == F.col("key"), F.lit("a stored payload does not match its digest"))
    payloads = payloads.where(sound.isNull())
    is_revisit = F.col("header").startswith("WARC/1.1\r\nWARC-Type: revisit\r\n")
    tail = F.when(is_revisit, F.lit(b"")).otherwise(F.col("payload"))
    return headers.join(payloads, "key", "left").select(
        F.concat(F.col("header").cast("binary"), tail, F.lit(b"\r\n\r\n")).alias("record"), "payload"
    )


def parse_records(records: DataFrame) -> DataFrame:
    """``(record_id, record_type, target_uri, payload_digest, refers_to, content_length, payload)`` from record bytes.

    The header is what precedes the first empty line; a response's payload is what follows its
    HTTP header, and must be the bytes that the digest names. A revisit's payload is the
    one it refers to.
    """
    record = F.col("record")
    field = lambda name, pattern: F.regexp_extract("header", rf"\r\n{name}: {pattern}", 1)
    # The cut is made in bytes; only the header is read as text.
    cut = records.select(F.substring_index(record.cast("string"), "\r\n\r\n", 1).alias("header"), "record", "payload")
    cut = cut.select("header", F.octet_length("header").alias("header_bytes"), "record", "payload")
    parsed = cut.select(
        field("WARC-Record-ID", r"<urn:record:(-?\d+)>").cast("bigint").alias("record_id"),
        field("WARC-Type", r"([^\r]*)").alias("record_type"),
        field("WARC-Target-URI", r"([^\r]*)").alias("target_uri"),
        field("WARC-Payload-Digest", r"sha1:([A-Z2-7]+)").alias("payload_digest"),
        F.expr(r"try_cast(nullif(regexp_extract(header, '\r\nWARC-Refers-To: <urn:record:(-?\\d+)>', 1), '') AS bigint)").alias("refers_to"),
        field("Content-Length", r"(\d+)").cast("bigint").alias("content_length"),
        "header_bytes",
        "record",
        "payload",
    )
    whole = F.octet_length("record") == F.col("header_bytes") + 4 + F.col("content_length") + 4
    stored = F.when(
        F.col("record_type") == "response",
        F.expr("substring(record, cast(header_bytes + 4 + content_length + 1 - octet_length(payload) as int), octet_length(payload))") == F.col("payload"),
    ).otherwise(F.lit(True))
    sound = F.assert_true(whole & stored & (base32_of_hex(F.sha1("payload")) == F.col("payload_digest")), F.lit("a record does not match its header"))
    return parsed.where(sound.isNull()).drop("header_bytes", "record")
