"""WARC archives: writing captures, reading records, and assembling transactions.

A capture is a request, a response or revisit, and a metadata record. The response and the metadata
name the request in WARC-Concurrent-To; joining on it gives one nested row per capture.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, stage

#: Records that one archive file holds at most; a file is read by one task, as a stream.
FILE_RECORDS = 6000
#: Payloads of fewer bytes are never turned into revisits.
MIN_REVISIT_BYTES = 0
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NAMESPACE = uuid.UUID(int=0)
_END = "\r\n\r\n"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, record_id: str, fields: dict[str, str | None], block: str) -> str:
    """One record without the two line ends behind it."""
    head = {"WARC-Type": kind, "WARC-Record-ID": f"<{record_id}>", "WARC-Date": DATE} | fields
    head["Content-Length"] = str(len(block.encode()))
    lines = "\r\n".join(f"{k}: {v}" for k, v in head.items() if v is not None)
    return f"WARC/1.1\r\n{lines}{_END}{block}"


def _header_safe(url: str | None) -> str | None:
    return None if url is None else url.replace("\r", "%0D").replace("\n", "%0A")


def capture_records(
    page_id: int | None, url: str | None, html: str | None, first: int | None
) -> list[str]:
    """The three records of a page; ``first`` is the page it revisits, or None."""
    request = uuid.uuid4().urn
    payload, url = html or "", _header_safe(url)
    digest = base32_sha1(payload.encode())
    about = {"WARC-Target-URI": url, "WARC-Concurrent-To": f"<{request}>"}
    try:
        parts = urlsplit(url or "")
        host, path = parts.netloc, parts.path + (f"?{parts.query}" if parts.query else "")
    except ValueError:
        host, path = "", ""
    asked = record("request", request, {
        "WARC-Target-URI": url, "Content-Type": "application/http; msgtype=request"},
        f"GET {path or '/'} HTTP/1.1\r\nHost: {host}{_END}")
    size = len(payload.encode())
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {size}{_END}")
    about |= {"WARC-Payload-Digest": f"sha1:{digest}",
              "Content-Type": "application/http; msgtype=response"}
    if first is None:
        own = uuid.uuid5(_NAMESPACE, str(page_id)).urn
        answer = record("response", own, about, http + payload)
    else:
        answer = record("revisit", uuid.uuid4().urn, about | {
            "WARC-Profile": PROFILE,
            "WARC-Refers-To": f"<{uuid.uuid5(_NAMESPACE, str(first)).urn}>"}, http)
    fields = f"payloadLength: {size}\r\n" + (
        "" if page_id is None else f"pageId: {page_id}\r\n")
    told = record("metadata", uuid.uuid4().urn, {
        "WARC-Target-URI": url, "WARC-Concurrent-To": f"<{request}>",
        "Content-Type": "application/warc-fields"}, fields)
    return [asked, answer, told]


def _write(batches):
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for at in range(0, batch.num_rows, 64):
            lines = [line for row in zip(*(c[at:at + 64] for c in columns), strict=True)
                     for line in capture_records(*row)]
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], ["value"])


def write_archives(pages: DataFrame, path: str, min_revisit_bytes: int = MIN_REVISIT_BYTES) -> None:
    """Write (page_id, url, html) as gzip-compressed archive files below ``path``.

    Of pages with equal payloads of at least ``min_revisit_bytes`` bytes those with the smallest
    page_id are responses, the others revisits of it. The smallest ids of repeated payloads are a
    table of their own, which Spark broadcasts only where its files are small enough; otherwise it
    splits the join where a payload is hot.
    """
    payload = F.coalesce("html", F.lit(""))
    hashed = pages.select("page_id", "url", "html", F.sha1(payload).alias("hex"))
    firsts = stage(
        hashed.where(F.octet_length(payload) >= min_revisit_bytes).groupBy("hex").agg(
            F.min("page_id").alias("first"), F.count(F.lit(1)).alias("uses"))
        .where("uses > 1 AND first IS NOT NULL").select("hex", "first"), "warc-firsts")
    revisited = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    hashed.join(firsts, "hex", "left").select(
        "page_id", "url", "html", revisited.alias("first")).mapInArrow(
        _write, "value string").write.option("lineSep", _END).option(
        "compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


_RECORDS = (
    "record_type string, record_id string, concurrent_to string, refers_to string, "
    "target_uri string, warc_date string, payload_digest string, payload_bytes long, "
    "page_id long, payload binary"
)
_KINDS = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
_SCHEMA = pa.schema([(n, _KINDS[k]) for n, k in (f.split() for f in _RECORDS.split(", "))])
_NAMED = {"WARC-Record-ID": "record_id", "WARC-Concurrent-To": "concurrent_to",
          "WARC-Refers-To": "refers_to", "WARC-Target-URI": "target_uri",
          "WARC-Date": "warc_date"}


def parse_archive(content: bytes):
    """(head, block) of every record of an archive, gzip-compressed (any number of members) or
    plain, as a stream."""
    def pieces():
        if content[:2] != b"\x1f\x8b":
            yield content
            return
        rest = content
        while rest:
            member = zlib.decompressobj(31)
            while rest and not member.eof:
                yield member.decompress(rest, 1 << 20)
                rest = member.unused_data if member.eof else member.unconsumed_tail

    end, held, source = _END.encode(), bytearray(), pieces()

    def upto(size: int) -> bool:
        while len(held) < size:
            more = next(source, None)
            if more is None:
                return False
            held.extend(more)
        return True

    at = 0
    while True:
        stop = held.find(end, at)
        while stop < 0:
            if not upto(len(held) + 1):
                if held[at:].strip():
                    raise ValueError("an archive ends within a record")
                return
            stop = held.find(end, max(at, 0))
        lines = held[at:stop].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record where one should begin: {lines[0][:40]!r}")
        head = dict(line.split(": ", 1) for line in lines[1:])
        begin = stop + len(end)
        last = begin + int(head["Content-Length"])
        if not upto(last + len(end)):
            raise ValueError("an archive ends within a record")
        yield head, bytes(held[begin:last])
        at = last + len(end)
        if at > 1 << 22:
            del held[:at]
            at = 0


def _read(batches):
    for batch in batches:
        for content in batch.column(0):
            rows = []
            for head, block in parse_archive(content.as_py()):
                row = dict.fromkeys(_SCHEMA.names) | {"record_type": head["WARC-Type"]}
                row |= {to: head[k].strip("<>") if k != "WARC-Target-URI" else head[k]
                        for k, to in _NAMED.items() if k in head}
                if row["record_type"] == "response":
                    row["payload"] = block.partition(_END.encode())[2]
                    row["payload_bytes"] = len(row["payload"])
                    row["payload_digest"] = base32_sha1(row["payload"])
                elif row["record_type"] == "revisit":
                    row["payload_digest"] = head["WARC-Payload-Digest"].removeprefix("sha1:")
                elif row["record_type"] == "metadata":
                    told = dict(x.split(": ", 1) for x in block.decode().split("\r\n") if x)
                    row["payload_bytes"] = int(told["payloadLength"])
                    row["page_id"] = int(told["pageId"]) if "pageId" in told else None
                rows.append(row)
                if len(rows) == 256:
                    yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archive files below ``path``; length and digest of a response are
    taken from its payload."""
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(_read, _RECORDS)


def transactions(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id, request, response (or revisit) and metadata.

    The response and the metadata are joined to the request that they are concurrent to. Requests
    without an answer stay, with nulls.
    """
    def of(*kinds: str) -> DataFrame:
        return records.where(F.col("record_type").isin(*kinds))

    requests = of("request").select(F.col("record_id").alias("capture_id"), F.struct(
        "record_id", "target_uri", "warc_date").alias("request"))
    answers = of("response", "revisit").select(
        F.col("concurrent_to").alias("capture_id"), F.struct(
            "record_type", "record_id", "refers_to", "payload_digest", "payload_bytes",
            *(["payload"] if "payload" in records.columns else [])).alias("response"))
    about = of("metadata").select(F.col("concurrent_to").alias("capture_id"), F.struct(
        "record_id", "page_id", "payload_bytes").alias("metadata"))
    return requests.join(answers, "capture_id", "left").join(about, "capture_id", "left")


def archive_and_assemble(
    pages: DataFrame, min_revisit_bytes: int = MIN_REVISIT_BYTES
) -> DataFrame:
    """Write ``pages`` as archives in the shared folder, read them back, and return per capture
    page_id, payload_bytes, payload_digest, record_type and refers_to.

    Null html is an empty payload, a null url has no target, a null page_id comes back as null and
    is never the first of its payload. Rows that repeat the smallest page_id with one payload are
    all responses. An empty table gives no rows. Columns other than page_id, url and html are not
    looked at.
    """
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_archives(pages.select("page_id", "url", "html"), path, min_revisit_bytes)
    records = stage(read_archives(spark, path).drop("payload"), "warc-records")
    captures = transactions(records)
    originals = captures.where("response.record_type = 'response'").groupBy(
        F.col("response.record_id").alias("original")).agg(
        F.min("metadata.page_id").alias("refers_to"))
    return captures.withColumn("original", F.col("response.refers_to")).join(
        originals, "original", "left").select(
        F.col("metadata.page_id").alias("page_id"),
        F.coalesce("response.payload_bytes", "metadata.payload_bytes").alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.record_type").alias("record_type"), "refers_to")


ORACLE_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
h AS (SELECT page_id, strlen(body) AS n, sha1(body) AS hex FROM p),
d AS (SELECT page_id, n, array_to_string(flatten(list_transform(range(0, 8), lambda g:
        list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
          CAST((CAST('0x' || substr(hex, CAST(5 * g + 1 AS INT), 5) AS INT) >> s) & 31 AS INT) + 1,
          1)))), '')
        AS digest FROM h),
f AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
"""
