"""A content-addressed WARC archive: payload bytes once per verified SHA-256, exact record headers apart.

``write_archive`` writes two tables: ``headers`` (one row per page: the exact WARC header block as
bytes, and the payload's digest) and ``payloads`` (one row per distinct digest: the bytes).
``read_archive`` joins them back into whole records, parses each header block, hashes the payload
bytes that it found again, and fails where digest or length differ from what the header says.

Of the records with equal payloads of at least ``revisit_from`` bytes, the one with the smallest
page_id is a response; the others are revisits that refer to it. Smaller ones are all responses.

Plan: the digest is taken in the scan. Only (digest, page_id) pairs are aggregated, with partial sums,
so a payload that a third of the pages share is one row per task; so are payload bytes, which move once
by digest. The smallest ids are a table before they are joined, and so are payloads, so adaptive execution can
split a digest that very many pages share in both joins.

Defined cases: a null html is an empty payload; a null page_id sorts after all others, its record is named by
its digest, and where only null ids hold a payload all of its records are responses; a null url is an absent
header field, and line ends in a url are left out; repeated rows with the same page_id and payload are all
responses where that id is the smallest; an empty table gives empty archives; other columns are ignored.
Records carry ``date`` as WARC-Date: pages have no time of their own, and equal tables give equal archives.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import new_path, read_table, written

REVISIT_FROM = 100
#: The profile URI for identical payloads in WARC/1.1, and the record ids' prefix.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "urn:page:"
#: What a record is dated by default.
DATE = "1970-01-01T00:00:00Z"


def _header(date: str) -> F.Column:
    """The header block of a row with page_id, url, digest, length, record_type and refers_to."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    optional = lambda name, value: F.coalesce(line(name, value), F.lit(""))
    plain = F.regexp_replace(F.col("url"), "[\r\n]", "")
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", F.concat(F.lit(f"<{RECORD}"), F.coalesce(F.col("page_id").cast("string"), F.concat(F.lit("none:"), F.col("digest"))), F.lit(">"))),
        line("WARC-Date", F.lit(date)),
        optional("WARC-Target-URI", plain),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        optional("WARC-Refers-To", F.concat(F.lit(f"<{RECORD}"), F.col("refers_to").cast("string"), F.lit(">"))),
        F.when(F.col("record_type") == "revisit", F.lit(f"WARC-Profile: {PROFILE}\r\n")).otherwise(F.lit("")),
        F.when(F.col("record_type") == "response", F.lit("Content-Type: text/html; charset=utf-8\r\n")).otherwise(F.lit("")),
        line("X-Payload-Length", F.col("length").cast("string")),
        line("Content-Length", F.when(F.col("record_type") == "revisit", F.lit("0")).otherwise(F.col("length").cast("string"))),
        F.lit("\r\n"),
    )


def write_archive(pages: DataFrame, path: str, revisit_from: int = REVISIT_FROM, date: str = DATE) -> None:
    """Writes ``path``/headers and ``path``/payloads from rows with page_id, url and html."""
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    narrow = rows.select("page_id", "url", "digest", F.octet_length("payload").cast("long").alias("length"))
    first = written(narrow.groupBy("digest").agg(F.min("page_id").alias("first_id")), "first")
    known = narrow.join(first, "digest")
    is_first = F.col("page_id").eqNullSafe(F.col("first_id")) | (F.col("length") < revisit_from)
    known = known.withColumn("record_type", F.when(is_first, "response").otherwise("revisit"))
    known = known.withColumn("refers_to", F.when(~is_first, F.col("first_id")))
    known.select("page_id", "digest", F.encode(_header(date), "UTF-8").alias("header")).write.parquet(f"{path}/headers")

    # equal digests have equal bytes: a task sends one payload for each, and the bytes move once
    rows.groupBy("digest").agg(F.first("payload").alias("payload")).write.option("compression", "zstd").parquet(f"{path}/payloads")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Whole records: page_id, url, record_type, refers_to, payload_digest, payload, record (the exact WARC bytes)."""
    headers, payloads = (spark.read.parquet(f"{path}/{x}") for x in ("headers", "payloads"))
    text = F.decode("header", "UTF-8")
    field = lambda name, kind: F.regexp_extract(text, f"\r\n{name}: {kind}\r\n", 1)
    number = lambda name: F.expr(f"try_cast({name} as long)")
    parsed = headers.join(payloads, "digest", "left").select(
        "header",
        "payload",
        F.col("page_id").alias("stored_id"),
        field("WARC-Type", "([^\r\n]*)").alias("record_type"),
        field("WARC-Record-ID", f"<{RECORD}([^\r\n]*)>").alias("own"),
        field("WARC-Refers-To", f"<{RECORD}([^\r\n]*)>").alias("other"),
        field("WARC-Target-URI", "([^\r\n]*)").alias("url"),
        field("WARC-Payload-Digest", "sha256:([^\r\n]*)").alias("payload_digest"),
        field("X-Payload-Length", "([^\r\n]*)").alias("says_length"),
    )
    found = F.sha2("payload", 256)
    wrong = F.col("payload").isNull() | (found != F.col("payload_digest")) | (F.octet_length("payload").cast("string") != F.col("says_length"))
    checked = F.when(wrong, F.raise_error(F.concat(F.lit("archive damaged at digest "), F.col("payload_digest")))).otherwise(found)
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.encode(F.lit(""), "UTF-8"))
    return parsed.select(
        number("own").alias("page_id"),
        F.when(F.col("url") != "", F.col("url")).alias("url"),
        "record_type",
        number("other").alias("refers_to"),
        checked.alias("payload_digest"),
        "payload",
        F.concat(F.col("header"), body, F.encode(F.lit("\r\n\r\n"), "UTF-8")).alias("record"),
    )


def op2_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_archive(read_table(spark, sf_dir, "pages"), path)
    return read_archive(spark, path).select("page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


SQL = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p),
r AS (SELECT *, (page_id IS NOT DISTINCT FROM first_id OR payload_bytes < {REVISIT_FROM}) AS whole FROM f)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN whole THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN whole THEN NULL ELSE first_id END AS refers_to FROM r
"""
QUERIES = {"op2_warc_archive": op2_warc_archive}
ORACLES = {"op2_warc_archive": SQL}
