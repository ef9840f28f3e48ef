"""WARC archives with revisit records.

Payload digests are shuffled without their payloads; of the records with equal payloads the one with the smallest page_id
becomes the response and the others revisit records that refer to it. Archives are written with fresh headers, through
Spark's own writer, so to any store that the cluster reads: a record a row, ended by the record separator, gzip around each
archive. Reading takes whole archives, each of a bounded number of payload bytes, and goes from header to header by
Content-Length, so that payloads may hold anything, record separators included.

Defined results: null html is an empty payload; records of fewer than `least` payload bytes are all responses; rows that
repeat the smallest page_id of a payload are all responses; records whose page_id is null are responses, and none refers
to them; line ends in URLs are percent-encoded; a null URL is about:blank; an
empty table gives one archive without records; columns other than page_id, url and html are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grove.llm.common import buckets_for
from grove.storage import cut, shared_path

CRLF = "\r\n"
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: The time that fresh headers state unless one is given: fixed, so that a task done again writes the same bytes.
DATE = "2024-01-01T00:00:00Z"
#: Payload bytes that an archive holds and that a task writes, about: a task writes several archives.
ARCHIVE_BYTES, TASK_BYTES = 8 << 20, 64 << 20
RECORDS = "page_id bigint, url string, record_type string, payload_digest string, payload_bytes bigint, refers_to bigint, digest_holds boolean"


def base32_sha1(payload: Column) -> Column:
    """SHA-1 of a string's UTF-8 bytes in upper-case base 32: 40 bits at a time from the hexadecimal digits."""
    digits, letters = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    hexadecimal = F.sha1(payload.cast("binary"))
    parts = [F.lpad(F.conv(F.substring(hexadecimal, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), digits, letters)


def resolve(headers: DataFrame, least: int = 0) -> DataFrame:
    """headers (page_id, payload_digest, payload_bytes) with record_type and refers_to."""
    first = headers.where(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    again = first.where("n > 1 AND first_id IS NOT NULL").drop("n")  # a digest seen once needs no join
    met = headers.join(again, "payload_digest", "left")
    revisit = F.coalesce((F.col("payload_bytes") >= least) & (F.col("page_id") > F.col("first_id")), F.lit(False))
    return met.select(
        *headers.columns,
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("first_id")).alias("refers_to"),
    )


def _record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">"))


def write(pages: DataFrame, least: int = 0, date: str = DATE) -> str:
    """Writes the archives of pages (page_id, url, html) and gives the folder they are in."""
    spark = pages.sparkSession
    own = pages.select("page_id", F.coalesce("url", F.lit("about:blank")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    own = own.withColumns({"payload_digest": base32_sha1(F.col("html")), "payload_bytes": F.octet_length("html").cast("long")})
    decided = resolve(own.select("page_id", "payload_digest", "payload_bytes"), least).where("record_type = 'revisit'").select(F.col("page_id").alias("__id"), F.col("payload_digest").alias("__digest"), "refers_to").distinct()
    # payloads move once: what a task joins it writes. Of rows that repeat an id, each meets its own digest only; the digests
    # are compared by instr, as an equality would have the planner deal payloads out anew, by both columns
    size, count = own.agg(F.sum("payload_bytes"), F.count(F.lit(1))).first()
    n = buckets_for(size or 0, TASK_BYTES, 6)
    same = (F.col("page_id") == F.col("__id")) & (F.instr("payload_digest", F.col("__digest")) == 1)
    met = own.repartition(n, "page_id").join(decided.repartition(n, "__id"), same, "left")
    revisit = F.col("refers_to").isNotNull()
    url = F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(CRLF + CRLF))
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("html")))
    header = F.concat(
        F.lit(f"{VERSION}{CRLF}WARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit(f"{CRLF}WARC-Record-ID: "), _record_id(F.col("page_id")),
        F.lit(f"{CRLF}WARC-Date: {date}{CRLF}WARC-Target-URI: "), url,
        F.lit(f"{CRLF}WARC-Payload-Digest: sha1:"), F.col("payload_digest"),
        F.when(revisit, F.concat(F.lit(f"{CRLF}WARC-Profile: {REVISIT_PROFILE}{CRLF}WARC-Refers-To: "), _record_id(F.col("refers_to")))).otherwise(F.lit("")),
        F.lit(f"{CRLF}Content-Type: application/http; msgtype=response{CRLF}Content-Length: "), F.octet_length(block).cast("string"),
    )
    archives = met.select(F.concat(header, F.lit(CRLF + CRLF), block).alias("value"))
    path = shared_path(spark, "warc")
    each = max(1, count * ARCHIVE_BYTES // max(1, size or 0))
    archives.write.option("lineSep", CRLF + CRLF).option("compression", "gzip").option("maxRecordsPerFile", each).text(path)
    return path


def _parsed(data: bytes) -> Iterator[tuple]:
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:end].decode().split(CRLF)
        if version != VERSION:
            raise ValueError(f"a record begins with {version[:40]!r}")
        h = dict(line.split(": ", 1) for line in lines)
        start = end + 4
        at = start + int(h["Content-Length"])
        head = data.index(b"\r\n\r\n", start, at) + 4
        payload = data[head:at]
        number = lambda name: (h[name][len("<urn:page:") : -1] or None) if name in h else None
        digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
        revisit = h["WARC-Type"] == "revisit"
        holds = revisit or base64.b32encode(hashlib.sha1(payload).digest()).decode() == digest
        yield number("WARC-Record-ID"), h["WARC-Target-URI"], h["WARC-Type"], digest, None if revisit else len(payload), number("WARC-Refers-To"), holds, payload
        if data[at : at + 4] != b"\r\n\r\n":
            raise ValueError("a record does not end where its Content-Length says")
        at += 4


def read(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """The records of all archives of a folder; payload_bytes is null for revisits, html only with payloads."""
    names = ["page_id", "url", "record_type", "payload_digest", "payload_bytes", "refers_to", "digest_holds"] + ["html"] * payloads

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                found = [x[:7] + ((x[7].decode(),) if payloads else ()) for x in _parsed(zlib.decompress(content, 31) if content else b"")]
                frame = pd.DataFrame(found, columns=names, dtype=object)
                for c in ("page_id", "payload_bytes", "refers_to"):
                    frame[c] = pd.to_numeric(frame[c]).astype("Int64")
                yield frame

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInPandas(rows, RECORDS + ", html string" * payloads)


def resolved(records: DataFrame) -> DataFrame:
    """Records as read, each revisit joined to the response that it refers to for the size of its payload."""
    originals = records.where("record_type = 'response'").groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.max("payload_bytes").alias("__bytes"))
    met = records.where("record_type = 'revisit'").join(originals, ["refers_to", "payload_digest"], "left")
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "digest_holds")
    return records.where("record_type = 'response'").select(*names).unionByName(met.withColumn("payload_bytes", F.col("__bytes")).select(*names))


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Writes the archives, reads them back and says what each page's record is."""
    path = write(pages, least)
    return resolved(cut(read(pages.sparkSession, path), "warc-records"))
