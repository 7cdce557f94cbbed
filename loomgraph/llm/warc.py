"""WARC archives with revisit resolution.

Headers of all records (identity, size and SHA-1 of the payload) are shuffled by payload digest; the record with the
least page_id keeps the payload as a response and the others become revisit records that name it. Decisions go back to
the pages by page_id, so the payloads are shuffled evenly whatever share of them is equal, and the archives are written
with fresh headers. Spark's own writer commits the files: a lost task leaves no part of an archive behind.

An archive is a text file of records, each followed by two CRLF pairs, compressed as a whole. Reading checks lengths
and digests.

Defined cases: a null html is an empty payload; a null url becomes urn:page:<id>; a null page_id comes after all
others; rows that repeat page_id and html have one fate (all response or all revisit); line breaks in a url are
dropped; an empty table gives no archive and no rows.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import written
from loomgraph.session import scratch

#: The alphabet of base32 and the names that the archive format prescribes.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = "\r\n"
SCHEMA = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: eight letters from each ten hex digits."""
    digest = F.sha1(payload)
    parts = []
    for k in range(4):
        value = F.conv(F.substring(digest, 1 + 10 * k, 10), 16, 10).cast("long")
        parts += [F.substr(F.lit(BASE32), (F.shiftright(value, 5 * (7 - j)).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1)) for j in range(8)]
    return F.concat(*parts)


def resolve(headers: DataFrame, least_bytes: int = 0) -> DataFrame:
    """headers: page_id, url, payload_bytes, payload_digest. Adds record_type, refers_to and refers_to_url."""
    place = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "url")
    originals = (
        headers.where(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest").agg(F.min(place).alias("original"))
        .withColumnRenamed("payload_digest", "of")
    )
    joined = headers.join(originals, F.col("payload_digest") == F.col("of"), "left")
    again = F.coalesce(~F.col("page_id").eqNullSafe(F.col("original.page_id")) & F.col("original").isNotNull(), F.lit(False))
    return joined.select(
        *headers.columns,
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("original.page_id")).alias("refers_to"),
        F.when(again, F.col("original.url")).alias("refers_to_url"),
    )


def _uri(url: Column, page_id: Column) -> Column:
    return F.coalesce(F.regexp_replace(url, "[\r\n]", ""), F.concat(F.lit("urn:page:"), F.coalesce(page_id.cast("string"), F.lit(""))))


def _record_id(page_id: Column) -> Column:
    h = F.md5(F.concat(F.lit("page "), F.coalesce(page_id.cast("string"), F.lit(""))).cast("binary"))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _record(date: str) -> Column:
    """The bytes of a record, as a string, without the two CRLF pairs after it."""
    response = F.col("record_type") == "response"
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(CRLF * 2)
    )
    block = F.when(response, F.concat(http, F.col("payload"))).otherwise(http)
    fields = [
        ("WARC-Type", F.col("record_type")),
        ("WARC-Record-ID", _record_id(F.col("page_id"))),
        ("WARC-Date", F.lit(date)),
        ("WARC-Target-URI", _uri(F.col("url"), F.col("page_id"))),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        ("WARC-Profile", F.when(~response, F.lit(PROFILE))),
        ("WARC-Refers-To", F.when(~response, _record_id(F.col("refers_to")))),
        ("WARC-Refers-To-Date", F.when(~response, F.lit(date))),
        ("WARC-Refers-To-Target-URI", F.when(~response, _uri(F.col("refers_to_url"), F.col("refers_to")))),
        ("X-Page-Id", F.col("page_id").cast("string")),
        ("X-Refers-To-Page-Id", F.col("refers_to").cast("string")),
        ("Content-Type", F.lit("application/http; msgtype=response")),
        ("Content-Length", (F.octet_length(http) + F.when(response, F.col("payload_bytes")).otherwise(0)).cast("string")),
    ]
    # a field without a value is left out
    head = F.concat(F.lit(f"WARC/1.1{CRLF}"), *[F.coalesce(F.concat(F.lit(f"{k}: "), v, F.lit(CRLF)), F.lit("")) for k, v in fields], F.lit(CRLF))
    return F.concat(head, block)


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0, records_per_file: int = 5000, date: str = "2024-01-01T00:00:00Z") -> None:
    """pages: page_id, url, html. Deduplicated archives under path."""
    payload = F.coalesce("html", F.lit(""))
    hashed = pages.select("page_id", "url", payload.alias("payload"), F.octet_length(payload).cast("long").alias("payload_bytes"), base32_sha1(payload.cast("binary")).alias("payload_digest"))
    # written, since they are read twice: the payloads are hashed once for them and once for the records
    decided = resolve(written(hashed.drop("payload"), "headers"), least_bytes)
    fate = decided.groupBy(F.col("page_id").alias("p"), F.col("payload_digest").alias("g")).agg(
        F.min("record_type").alias("record_type"), F.min("refers_to").alias("refers_to"), F.min("refers_to_url").alias("refers_to_url")
    )
    same = F.col("page_id").eqNullSafe(F.col("p")) & (F.col("payload_digest") == F.col("g"))
    records = hashed.join(fate, same).select(_record(date).alias("record"))
    (
        records.write.mode("overwrite").option("lineSep", CRLF * 2).option("compression", "gzip")
        .option("maxRecordsPerFile", records_per_file).text(path)
    )


def _parsed(stream):
    """Records of an archive: their fields, HTTP fields and payload."""

    def fields():
        out = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            key, _, value = line.decode("utf-8").partition(":")
            out[key.strip().lower()] = value.strip()
        return out

    while line := stream.readline():
        if line.strip() == b"":
            continue
        if not line.startswith(b"WARC/1."):
            raise ValueError(f"not a record: {line[:40]!r}")
        head = fields()
        block = stream.read(int(head["content-length"]))
        http, _, payload = block.partition(b"\r\n\r\n")
        told = dict(x.lower().split(b": ", 1) for x in http.split(b"\r\n")[1:])
        yield head, told, payload


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """A row for each record: see SCHEMA. payload is null for revisit records."""

    def rows(batches):
        for batch in batches:
            for content in batch["content"]:
                out = []
                for head, told, payload in _parsed(io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content)), 1 << 16)):
                    digest, whole = head["warc-payload-digest"].removeprefix("sha1:"), head["warc-type"] == "response"
                    if whole and (len(payload) != int(told[b"content-length"]) or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
                        raise ValueError(f"{head['warc-record-id']}: the payload does not match its header")
                    number = lambda k: int(head[k]) if k in head else None
                    out.append((number("x-page-id"), head["warc-target-uri"], int(told[b"content-length"]), digest, head["warc-type"], number("x-refers-to-page-id"), payload if whole and with_payload else None))
                    if len(out) >= 1000:
                        yield frame(out)
                        out = []
                yield frame(out)

    def frame(out):
        made = pd.DataFrame(out, columns=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])
        return made.astype({"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "int64"})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").schema("path string, modificationTime timestamp, length long, content binary").load(path)
    return files.select("content").mapInPandas(rows, SCHEMA)


def with_payloads(records: DataFrame) -> DataFrame:
    """records: as of read_archives. Revisit records get the payload of the response that they refer to."""
    originals = records.where("record_type = 'response'").select(F.col("page_id").alias("o"), F.col("payload_digest").alias("g"), F.col("payload").alias("original")).dropDuplicates(["o", "g"])
    same = F.col("refers_to").eqNullSafe(F.col("o")) & (F.col("payload_digest") == F.col("g")) & (F.col("record_type") == "revisit")
    return records.join(originals, same, "left").select(*[F.coalesce("payload", "original").alias(c) if c == "payload" else c for c in records.columns])


#: What the report tells, computed from the pages, for DuckDB.
ORACLE_SQL = f"""WITH hashed AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
coded AS (
  SELECT page_id, payload_bytes, array_to_string(list_transform(range(32),
    lambda i: substr('{BASE32}', ((('0x' || substr(h, (1 + 10 * (i // 8))::INT, 10))::BIGINT >> (5 * (7 - i % 8))::INT) & 31)::INT + 1, 1)), '') AS payload_digest FROM hashed),
firsts AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS original FROM coded)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> original THEN original END AS refers_to FROM firsts"""


def archive_report(pages: DataFrame) -> DataFrame:
    """Writes the pages to archives in the shared folder and tells what is read back."""
    spark = pages.sparkSession
    path = scratch(spark, "warc")
    write_archives(pages.select("page_id", "url", "html"), path)
    return read_archives(spark, path, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
