"""WARC archives with revisit records for repeated payloads.

Headers (page id, address, payload digest and size, no payloads) are grouped
by payload digest; of equal payloads the record of the smallest page becomes
the response, every other a revisit that refers to it. The archives are
written by Spark's text sink: a record ends with an empty line twice, which is
the sink's line separator, so payloads pass through unchanged. Reading goes by
Content-Length, record by record, checks every digest, and joins revisit
headers to the original responses by digest.
"""

from __future__ import annotations

import base64
import gzip
import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tierlens.llm.tables import NO_ID, save
from tierlens.runtime import scratch_dir

#: Payload bytes of one archive file, about, and its records at most: both bound what a reading task holds. A
#: payload beyond SIZES[-1] gets a file of its own.
FILE_BYTES, FILE_RECORDS = 128_000_000, 2000
SIZES = (64_000, 2_000_000)
WARC_DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_END = "\r\n\r\n"
_PARSED = ("page_id long, record_type string, url string, record_id string, payload_digest string, "
           "payload_bytes long, refers_to_id string, payload binary")


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: five hex digits are four base32 digits."""
    digits = [F.lpad(F.conv(F.substring(F.sha1(payload), 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.upper(F.concat(*digits)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _record_id(page: Column, url: Column) -> Column:
    h = F.md5(F.concat_ws("|", page.cast("string"), url))
    return F.concat(F.lit("<urn:uuid:"), *[x for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
                                          for x in ((F.lit("-"),) if a > 1 else ()) + (F.substring(h, a, n),)], F.lit(">"))


def resolve(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Headers of all pages: ``page_id, url, payload_digest, payload_bytes,
    record_type, refers_to`` (and ``mark``, which tells rows of one page apart). The response of a payload of at least
    ``least_bytes`` is its smallest page; smaller payloads are all responses.
    Payloads are equal if SHA-1, SHA-256 and size agree."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    heads = pages.select(F.coalesce(F.col("page_id").cast("bigint"), F.lit(NO_ID)).alias("page_id"), "url",
                         base32_sha1(payload).alias("payload_digest"), F.octet_length(payload).cast("bigint").alias("payload_bytes"),
                         F.unhex(F.sha2(payload, 256)).alias("check"), F.xxhash64(payload).alias("mark"))
    key = ["payload_digest", "payload_bytes", "check"]
    heads = save(heads, "warc-heads")  # about 150 bytes a page: payloads are read and hashed once
    first = heads.groupBy(*key).agg(F.min_by(F.struct("page_id", "url"), "page_id").alias("first"))
    joined = heads.join(first, key)
    again = (F.col("payload_bytes") >= least_bytes) & (F.col("page_id") != F.col("first.page_id"))
    return joined.select("page_id", "url", "payload_digest", "payload_bytes", "mark",
                         F.when(again, "revisit").otherwise("response").alias("record_type"),
                         F.when(again, F.col("first.page_id")).alias("refers_to"),
                         F.when(again, F.col("first.url")).alias("refers_to_url"))


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0, date: str = WARC_DATE) -> None:
    """One WARC/1.1 record per row of ``pages`` (page_id, url, html), gzip files
    of at most :data:`FILE_RECORDS` records and about :data:`FILE_BYTES` bytes:
    payloads of each size class fill files of their own, fewer to a file the
    longer they may be. Null html is an empty payload; a null address or id
    leaves its field out."""
    heads = save(resolve(pages, least_bytes).distinct(), "warc-resolved")
    longest = heads.agg(F.max("payload_bytes")).first()[0] or 0
    low = -1
    for high in (*SIZES, max(longest, SIZES[-1])):
        if low < longest and high > low or low < 0:
            _write_class(pages, heads, low, high, path, date)
        low = high


def _write_class(pages: DataFrame, heads: DataFrame, low: int, high: int, path: str, date: str) -> None:
    """Records whose payloads have more than ``low`` and at most ``high`` bytes."""
    def own(size: Column) -> Column:
        return (size > low) & (size <= high)

    payload = F.coalesce(F.col("html"), F.lit(""))
    bodies = pages.filter(own(F.octet_length(payload))).select(
        F.coalesce(F.col("page_id").cast("bigint"), F.lit(NO_ID)).alias("page_id"), F.col("url").alias("own_url"),
        payload.alias("html"), F.xxhash64(payload).alias("own_mark"))
    heads = heads.filter(own(F.col("payload_bytes"))).withColumnRenamed("payload_digest", "d")
    rows = bodies.join(heads.withColumnRenamed("page_id", "p"), (F.col("page_id") == F.col("p")) & (F.col("own_mark") == F.col("mark"))
                       & F.col("own_url").eqNullSafe(F.col("url"))).withColumn("url", F.regexp_replace("own_url", "[\r\n]", ""))
    revisit = F.col("record_type") == "revisit"
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.col("payload_bytes").cast("string"), F.lit(_END))
    rows = rows.withColumn("block", F.when(revisit, http).otherwise(F.concat(http, F.col("html"))))

    def field(name: str, value: Column) -> Column:
        return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))).otherwise("")

    shown = F.when(F.col("page_id") != NO_ID, F.col("page_id"))
    record = F.concat(
        F.lit("WARC/1.1\r\n"), field("WARC-Type", F.col("record_type")),
        field("WARC-Record-ID", _record_id(F.col("page_id"), F.col("own_url"))), field("WARC-Date", F.lit(date)),
        field("WARC-Target-URI", F.col("url")), field("X-Page-Id", shown.cast("string")),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("d"))),
        field("WARC-Refers-To", F.when(revisit, _record_id(F.col("refers_to"), F.col("refers_to_url")))),
        field("WARC-Refers-To-Target-URI", F.when(revisit, F.regexp_replace("refers_to_url", "[\r\n]", ""))),
        field("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length("block").cast("string"), F.lit(_END), F.col("block"))
    (rows.select(record.alias("value")).write.mode("append").option("lineSep", _END).option("compression", "gzip")
     .option("maxRecordsPerFile", max(1, min(FILE_RECORDS, FILE_BYTES // max(high, 1)))).text(path))


def _parse(raw: bytes):
    """Records of one archive, by Content-Length."""
    at = 0
    while at < len(raw):
        body = raw.index(b"\r\n\r\n", at) + 4
        lines = raw[at:body - 4].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        head = dict(x.split(": ", 1) for x in lines[1:])
        end = body + int(head["Content-Length"])
        block = raw[body:end]
        if raw[end:end + 4] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} does not end with two empty lines")
        at = end + 4
        http = block.index(b"\r\n\r\n") + 4
        digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
        payload = block[http:] if head["WARC-Type"] == "response" else None
        if payload is not None and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
            raise ValueError(f"wrong payload digest in the record at byte {at}")
        page = head.get("X-Page-Id")
        yield (None if page is None else int(page), head["WARC-Type"], head.get("WARC-Target-URI"), head["WARC-Record-ID"], digest,
               None if payload is None else len(payload), head.get("WARC-Refers-To"), payload)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Records of the archives under ``path``, one row each; payload and size
    are null for revisits, a wrong digest or a broken record raises."""
    def run(parts):
        for pdf in parts:
            for content in pdf.content:
                out = pd.DataFrame(list(_parse(gzip.decompress(content))), columns=[c.split()[0] for c in _PARSED.split(", ")])
                yield out.astype({"page_id": "Int64", "payload_bytes": "Int64"})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select("content").mapInPandas(run, _PARSED)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of
    every record: revisits take size and page of the original response with
    their payload digest and the id they refer to."""
    originals = records.filter("record_type = 'response'").select(
        F.col("payload_digest").alias("d"), F.col("record_id").alias("o"), F.col("page_id").alias("original"),
        F.col("payload_bytes").alias("size")).distinct()
    revisits = records.filter("record_type = 'revisit'")
    found = revisits.join(originals, (F.col("payload_digest") == F.col("d")) & (F.col("refers_to_id") == F.col("o")), "left")
    responses = records.filter("record_type = 'response'")
    cols = ["payload_digest", "record_type"]
    return responses.select("page_id", "payload_bytes", *cols, F.lit(None).cast("bigint").alias("refers_to")).unionByName(
        found.select("page_id", F.col("size").alias("payload_bytes"), *cols, F.col("original").alias("refers_to")))


def archive_pages(pages: DataFrame, path: str | None = None, least_bytes: int = 0) -> DataFrame:
    """Write the archives of ``pages`` (a fresh shared folder by default), read
    them back and resolve the revisits. An empty table writes no record and
    gives an empty result; repeated rows of the smallest page are all
    responses; a null page id orders after all others and is shown as null."""
    spark = pages.sparkSession
    path = path or scratch_dir(spark, "warc")
    pages = pages.select("page_id", "url", "html")
    write_archives(pages, path, least_bytes)
    return resolve_revisits(read_archives(spark, path).drop("payload"))
