"""WARC archives: writing page captures as transactions, and assembling transactions read from archives."""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortline.llm.text import whole_text

CRLF = "\r\n"
PROFILE = "http://netpreservefoundation.org/warc/1.1/revisit/identical-payload-digest"
RECORD = (
    "record_id string, type string, concurrent_to string, target_uri string, date string, refers_to string, "
    "payload_bytes bigint, payload_digest string, stated_digest string, fields map<string,string>"
)


@F.pandas_udf(T.StringType())
def base32(digests: pd.Series) -> pd.Series:
    return digests.map(lambda d: base64.b32encode(d).decode())


def _uuid(kind: str, *parts: Column) -> Column:
    """A record id that follows from its parts, so that repeating a lost task gives the same archive."""
    digest = F.md5(F.concat_ws("\x1f", F.lit(kind), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))
    cuts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(digest, a, n) for a, n in cuts]), F.lit(">"))


def _record(type_: Column, record_id: Column, headers: list[tuple[str, Column]], block: Column) -> Column:
    lines = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), type_), F.concat(F.lit("WARC-Record-ID: "), record_id)]
    lines += [F.concat(F.lit(f"{name}: "), value) for name, value in headers]
    lines.append(F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")))
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF * 2), block)


def write_captures(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", min_bytes: int = 0, key: str = "page_id", records_per_file: int = 2000) -> None:
    """Write a request, a response or revisit, and a metadata record for every row (key, url, html).

    Records go through the text sink with a blank line as separator, which is what ends a WARC record, so archives
    land in any store that Spark can write to. Of rows with equal payloads of at least ``min_bytes``, that with the
    largest key (then url) is the response and the others revisit it. Null html is empty, null url is ''. A null key comes
    before all others. Rows that agree in key, url and payload are written once each, with the same record ids.
    """
    url = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x20]", "%20")
    rows = pages.select(F.col(key).alias("key"), url.alias("url"), whole_text("html").alias("html"))
    rows = rows.withColumns({"sha1": F.sha1("html"), "bytes": F.octet_length("html").cast("long")})
    original = rows.filter(F.col("bytes") >= min_bytes).groupBy("sha1").agg(F.max(F.struct("key", "url")).alias("original"))
    rows = rows.join(original, "sha1", "left")
    first = F.col("original").isNull() | (F.col("key").eqNullSafe(F.col("original.key")) & (F.col("url") == F.col("original.url")))
    digest = F.concat(F.lit("sha1:"), base32(F.unhex("sha1")))
    named = rows.withColumns({"first": first, "digest": digest, "id": _uuid("capture", F.col("key"), F.col("url"), F.col("sha1"))})

    common = [("WARC-Target-URI", F.col("url")), ("WARC-Date", F.lit(date))]
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=UTF-8{CRLF}Content-Length: "), F.col("bytes").cast("string"), F.lit(CRLF * 2))
    to_capture = [("WARC-Concurrent-To", F.col("id"))]
    original_id = _uuid("capture", F.col("original.key"), F.col("original.url"), F.col("sha1"))
    capture_headers = [*common, ("WARC-Payload-Digest", F.col("digest")), ("Content-Type", F.lit("application/http; msgtype=response"))]
    response = _record(F.lit("response"), F.col("id"), capture_headers, F.concat(http, "html"))
    revisit = _record(F.lit("revisit"), F.col("id"), [*capture_headers, ("WARC-Profile", F.lit(PROFILE)), ("WARC-Refers-To", original_id)], http)
    asked = F.concat(F.lit("GET "), F.col("url"), F.lit(f" HTTP/1.1{CRLF}Accept: text/html{CRLF * 2}"))
    request = _record(F.lit("request"), _uuid("request", F.col("id")), [*common, *to_capture, ("Content-Type", F.lit("application/http; msgtype=request"))], asked)
    about = F.concat(F.lit("pageId: "), F.coalesce(F.col("key").cast("string"), F.lit("")), F.lit(CRLF))
    metadata = _record(F.lit("metadata"), _uuid("metadata", F.col("id")), [*common, *to_capture, ("Content-Type", F.lit("application/warc-fields"))], about)
    text = F.concat_ws(CRLF * 2, request, F.when(F.col("first"), response).otherwise(revisit), metadata)
    writer = named.select(text.alias("value")).write.option("lineSep", CRLF * 2).option("compression", "gzip")
    writer.option("maxRecordsPerFile", records_per_file).text(path)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of each record of an archive; gzip members are unpacked."""
    if data[:2] == b"\x1f\x8b":
        plain = []
        while data:
            member = zlib.decompressobj(wbits=31)
            plain.append(member.decompress(data))
            data = member.unused_data
        data = b"".join(plain)
    at = data.find(b"WARC/")
    while at >= 0:
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")[1:]
        headers = {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines)}
        start = end + 4
        stop = start + int(headers["content-length"])
        yield headers, data[start:stop]
        at = data.find(b"WARC/", stop)


def read_records(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """One row per record; payloads come along only if asked for.

    ``payload_bytes`` and ``payload_digest`` (base32 SHA-1) are computed from a response's payload; a revisit's come from
    its headers. ``stated_digest`` is the digest header. A folder without archives gives no rows.
    """

    def read(batches):
        for batch in batches:
            for data in batch["content"]:
                rows = []
                for headers, block in parse(data):
                    type_, payload, stated = headers.get("warc-type"), None, headers.get("warc-payload-digest", "").rpartition(":")[2] or None
                    head, _, body = block.partition(b"\r\n\r\n")
                    fields = {}
                    if type_ in ("response", "revisit", "metadata"):
                        for line in (block if type_ == "metadata" else head).decode("utf-8", "replace").split("\r\n"):
                            name, colon, value = line.partition(":")
                            if colon:
                                fields[name.strip().lower()] = value.strip()
                    size = digest = None
                    if type_ == "response":
                        payload, size, digest = body, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode()
                    elif type_ == "revisit":
                        size, digest = int(fields.get("content-length", 0)), stated
                    row = (headers.get("warc-record-id"), type_, headers.get("warc-concurrent-to"), headers.get("warc-target-uri"), headers.get("warc-date"), headers.get("warc-refers-to"), size, digest, stated, fields)
                    rows.append((*row, payload) if payloads else row)
                names = [part.split()[0] for part in RECORD.replace("map<string,string>", "map").split(", ")] + ["payload"] * payloads
                table = pd.DataFrame(rows, columns=names, dtype=object)
                yield table

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(read, RECORD + ", payload binary" * payloads)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: the response or revisit with its ``request`` and ``metadata`` records.

    Requests and metadata name their capture in WARC-Concurrent-To; records without a capture are left out, and a
    capture without one of them has null there. Records with the same reference count once. ``original`` is the
    metadata of the capture that a revisit refers to.
    """
    captures = records.filter("type IN ('response', 'revisit')").drop("concurrent_to")

    def joined_to(type_: str) -> DataFrame:
        part = F.struct("record_id", "date", "fields").alias(type_)
        rows = records.filter((F.col("type") == type_) & F.col("concurrent_to").isNotNull())
        return rows.select(F.col("concurrent_to").alias("record_id"), part).dropDuplicates(["record_id"])

    nested = captures.join(joined_to("request"), "record_id", "left").join(joined_to("metadata"), "record_id", "left")
    originals = joined_to("metadata").select(F.col("record_id").alias("refers_to"), F.col("metadata.fields").alias("original"))
    revisited = nested.filter("refers_to IS NOT NULL").join(originals, "refers_to", "left")
    alone = nested.filter("refers_to IS NULL").withColumn("original", F.lit(None).cast("map<string,string>"))
    return alone.unionByName(revisited)
