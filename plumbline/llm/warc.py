"""A content-addressed web archive: payloads once by digest, record headers apart.

``write_archive`` makes a WARC 1.1 record of every page. Under the path given,

* ``payloads`` holds (key, payload): each distinct payload once, by its SHA-256;
* ``headers`` holds (key, has_payload, header): every record's exact header bytes
  (WARC fields and, in responses, the HTTP header).

Of records with equal payloads of at least ``min_bytes`` bytes the one with the
largest page_id is a response and the others are revisits that refer to it; all
smaller ones are responses. ``reconstruct`` joins headers with payloads, each
checked against its key, into the records' original bytes; ``read_archive`` parses
those bytes, and raises where a record's length or payload digest isn't what its
header says.

Payloads are grouped by key with a first step before the shuffle, so a payload
that a third of all pages share is one row per task. The page chosen for each key
is written before it is joined back, so a hot key's pages stay where they are or,
beyond what is broadcast, are split by adaptive execution; only responses are
given their payload.

Defined cases: a null html is an empty payload; a null url is written as
urn:x-page:<id>, and control characters in urls are percent-encoded; a null
page_id is kept, and is a revisit wherever a page with an id has the payload, else
a response; repeated pages are repeated records; an empty table gives an empty
archive. Further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MIN_BYTES = 0
DATE = "2024-01-01T00:00:00Z"
CRLF = "\r\n"


def base32_of_hex(digest: Column) -> Column:
    """RFC 4648 base32 of 40 hex digits: 10 of them are 8 symbols."""
    groups = [F.lpad(F.conv(F.substring(digest, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _header(kind: Column) -> Column:
    """The exact header of a record."""
    line = lambda name, value: F.concat(F.lit(name + ": "), value, F.lit(CRLF))
    own = F.concat(F.lit("<urn:x-page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.lit(">"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}"), line("Content-Type", F.lit("text/html; charset=utf-8")), line("Content-Length", F.col("n_bytes").cast("string")), F.lit(CRLF))
    length = F.when(kind == "response", F.octet_length(http) + F.col("n_bytes")).otherwise(0)
    url = F.col("url")
    for code in [*range(32), 127]:
        url = F.replace(url, F.lit(chr(code)), F.lit(f"%{code:02X}")) if code in (0, 9, 10, 13, 127) else url
    refers = F.when(kind == "revisit", F.concat(line("WARC-Refers-To", F.concat(F.lit("<urn:x-page:"), F.col("chosen").cast("string"), F.lit(">"))), line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))).otherwise(F.lit(""))
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", kind),
        line("WARC-Record-ID", own),
        line("WARC-Target-URI", F.coalesce(url, F.concat(F.lit("urn:x-page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none"))))),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        refers,
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", length.cast("string")),
        F.lit(CRLF),
        F.when(kind == "response", http).otherwise(F.lit("")),
    )


def write_archive(pages: DataFrame, path: str, min_bytes: int = MIN_BYTES) -> None:
    """Write every page as a record below path. pages: page_id, url, html."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    keyed = pages.withColumn("key", F.unhex(F.sha2("payload", 256)))
    light = keyed.select("page_id", "url", "key", F.octet_length("payload").cast("long").alias("n_bytes"), base32_of_hex(F.sha1("payload")).alias("digest"))
    light = common.materialize(light, "page-digests")
    chosen = common.materialize(light.groupBy("key").agg(F.max("page_id").alias("chosen")), "chosen-pages")
    kind = F.when((F.col("n_bytes") >= min_bytes) & F.col("chosen").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("chosen")), "revisit").otherwise("response")
    headers = common.join_by_keys(light, chosen, "key", "inner").select("key", (kind == "response").alias("has_payload"), _header(kind).cast("binary").alias("header"))
    headers.write.option("compression", "zstd").parquet(f"{path}/headers")
    common.release(light, chosen)
    keyed.groupBy("key").agg(F.first("payload").alias("payload")).write.option("compression", "zstd").parquet(f"{path}/payloads")


def _records(spark: SparkSession, path: str) -> DataFrame:
    """(record, stored_bytes, stored_digest): every record's bytes, rebuilt by the join, and what its payload is."""
    stored = spark.read.schema("key binary, payload binary").parquet(f"{path}/payloads")
    right = F.unhex(F.sha2("payload", 256)) == F.col("key")
    payload = F.when(right, F.col("payload")).otherwise(F.raise_error(F.lit("a payload differs from its digest")).cast("binary"))
    stored = stored.select("key", payload.alias("payload")).select("key", "payload", F.octet_length("payload").cast("long").alias("stored_bytes"), base32_of_hex(F.sha1("payload")).alias("stored_digest"))
    headers = spark.read.schema("key binary, has_payload boolean, header binary").parquet(f"{path}/headers")
    end = F.lit(CRLF * 2).cast("binary")
    record = F.when(F.col("has_payload"), F.concat("header", "payload", end)).otherwise(F.concat("header", end))
    return headers.join(stored, "key").select(record.alias("record"), "stored_bytes", "stored_digest")


def _head(block: Column) -> Column:
    """What stands before the first empty line of some bytes, as text."""
    return F.substring_index(block.cast("string"), CRLF * 2, 1)


def _field(head: Column, name: str, pattern: str) -> Column:
    return F.regexp_extract(F.concat(head, F.lit(CRLF)), rf"\r\n{name}: {pattern}\r\n", 1)


def reconstruct(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, record): the original bytes of every record."""
    own = F.expr("try_cast(own AS bigint)").alias("page_id")
    return _records(spark, path).select(_field(_head(F.col("record")), "WARC-Record-ID", "<urn:x-page:([^>]*)>").alias("own"), "record").select(own, "record")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Per record: page_id, payload_bytes, payload_digest, record_type, refers_to, url, parsed from the rebuilt record.

    A revisit has no payload of its own; its size is that of the payload it names.
    """
    number = lambda name: F.expr(f"try_cast({name} AS bigint)")
    split = _records(spark, path).withColumn("head", _head(F.col("record"))).withColumn("type", _field(F.col("head"), "WARC-Type", r"(\w+)"))
    # A record is its header, an empty line, as many bytes as the header says, and two line ends.
    start, size = F.octet_length("head") + 4, F.octet_length("record")
    block = split.withColumn("length", size - start - 4).withColumn("block", F.when(F.col("type") == "response", F.expr("substring(record, octet_length(head) + 5, octet_length(record) - octet_length(head) - 8)")))
    http = block.withColumn("http", _head(F.col("block")))
    payload = http.withColumn("payload", F.expr("substring(block, octet_length(http) + 5)"))
    known = payload.select(
        "head", "type", "length",
        F.coalesce(F.octet_length("payload").cast("long"), F.col("stored_bytes")).alias("payload_bytes"),
        F.coalesce(base32_of_hex(F.sha1("payload")), F.col("stored_digest")).alias("payload_digest"),
        F.when(F.col("payload").isNotNull(), _field(F.col("http"), "Content-Length", r"(\d+)").cast("long")).alias("http_length"),
    )
    told = known.select(
        "*", _field(F.col("head"), "WARC-Record-ID", "<urn:x-page:([^>]*)>").alias("own"), _field(F.col("head"), "WARC-Refers-To", "<urn:x-page:([^>]*)>").alias("refers"),
        _field(F.col("head"), "WARC-Target-URI", "([^\r]*)").alias("url"), _field(F.col("head"), "WARC-Payload-Digest", "sha1:(\\w+)").alias("told_digest"), _field(F.col("head"), "Content-Length", "(\\d+)").cast("long").alias("told_length"),
    )
    sound = (F.col("told_length") == F.col("length")) & (F.col("told_digest") == F.col("payload_digest")) & F.coalesce(F.col("http_length") == F.col("payload_bytes"), F.lit(True))
    digest = F.when(sound, F.col("payload_digest")).otherwise(F.raise_error(F.lit("a record differs from its header")).cast("string"))
    return told.select(number("own").alias("page_id"), "payload_bytes", digest.alias("payload_digest"), F.col("type").alias("record_type"), number("refers").alias("refers_to"), "url")


def query(spark, sf_dir: str) -> DataFrame:
    """All of pages, written and read back."""
    path = common.shared_path(spark, "archive")
    write_archive(common.table(spark, sf_dir, "pages"), path)
    return read_archive(spark, path).drop("url")


_B32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(h, {1 + 5 * i}, 5) AS BIGINT) >> {15 - 5 * j}) & 31 AS INTEGER) + 1, 1)" for i in range(8) for j in range(4))
SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT t, max(page_id) AS chosen FROM p GROUP BY t)
SELECT page_id, CAST(octet_length(encode(p.t)) AS BIGINT) AS payload_bytes, {_B32} AS payload_digest,
       CASE WHEN page_id = chosen OR chosen IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = chosen OR chosen IS NULL THEN NULL ELSE chosen END AS refers_to
FROM p JOIN g ON p.t = g.t
"""
