"""WARC archives: writing pages as segmented records, and reassembling them.

Writing: a page is one ``response`` record whose HTTP body is the html in chunked transfer framing. A
page whose payload equals that of a page with a smaller id is a ``revisit`` without a body. A record
block longer than ``segment_bytes`` is split: the first segment is the record itself, the others are
``continuation`` records naming the origin record and their segment number, and the last one carries
the total length. Archives are gzip files written by Spark's text writer (a record ends in the blank
line that serves as the line separator), so any store Spark writes to will do.

Reading: files are parsed by Content-Length, never by searching for markers, so a payload may hold
anything. Segments meet by origin identifier, are ordered by segment number and must add up to the
total length; then the chunk framing is decoded and the payload digest is checked. Records in one
segment are decoded where they are parsed, and only their figures travel.

Sizes: archives are dealt out by the hash of the record so that a file holds about ``file_bytes`` of
payload; a group in the reassembly is one record.

Defined results: NULL html is the empty payload. A NULL page_id is written as such and read back as
NULL; it never is the smallest id unless all are NULL. A record's id is made of page_id, payload digest
and copy, so rows that repeat page_id, NULL included, are records of their own, whatever their payloads;
those with the same payload are all of the type their id decides. An empty table gives empty archives and no rows. Extra
columns are ignored. A damaged file fails the job.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from veilspark.llm.common import query, table
from veilspark.runtime import materialise, shared_dir

SEGMENT_BYTES = 64 << 10
CHUNK_BYTES = 8 << 10
FILE_BYTES = 16 << 20
END = b"\r\n\r\n"

PARSED = ("record_id string, record_type string, segment int, total long, block binary, payload_bytes long, "
          "payload_digest string, refers_to_id string")
DECODED = ("record_id string, record_type string, refers_to_id string, payload_bytes long, payload_digest string, "
           "payload binary")


def digest(payload: bytes) -> str:
    """Upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def cuts(data: bytes, size: int) -> list[bytes]:
    """Pieces of about ``size`` bytes that end between UTF-8 characters."""
    out, start = [], 0
    while start < len(data):
        end = min(start + size, len(data))
        while end < len(data) and data[end] & 0xC0 == 0x80:
            end += 1
        out.append(data[start:end])
        start = end
    return out


def chunked(payload: bytes) -> bytes:
    """Chunked transfer framing."""
    parts = [b"%x\r\n%s\r\n" % (len(c), c) for c in cuts(payload, CHUNK_BYTES)]
    return b"".join(parts) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        if size == 0:
            return b"".join(out)
        out.append(body[end + 2:end + 2 + size])
        if len(out[-1]) < size or body[end + 2 + size:end + 4 + size] != b"\r\n":
            raise ValueError("broken chunk framing")
        at = end + 4 + size


def _record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + END + block


def page_records(rid: str, url: str, payload: bytes, first: str | None, segment_bytes: int) -> Iterator[bytes]:
    """The records of one page, without their closing blank lines."""
    base = [("WARC-Record-ID", f"<{rid}>"), ("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Target-URI", url),
            ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest(payload)}")]
    status = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if first is not None:
        block = status + b"Content-Length: %d" % len(payload) + END
        yield _record([("WARC-Type", "revisit"), *base, ("WARC-Refers-To", f"<{first}>"), (
            "WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")], block)
        return
    block = status + b"Transfer-Encoding: chunked" + END + chunked(payload)
    pieces = cuts(block, segment_bytes)
    if len(pieces) == 1:
        yield _record([("WARC-Type", "response"), *base], block)
        return
    for n, piece in enumerate(pieces, 1):
        last = [("WARC-Segment-Total-Length", len(block))] if n == len(pieces) else []
        if n == 1:
            yield _record([("WARC-Type", "response"), *base, ("WARC-Segment-Number", 1)], piece)
        else:
            yield _record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"<{rid}:{n}>"),
                           ("WARC-Segment-Origin-ID", f"<{rid}>"), ("WARC-Segment-Number", n), *last], piece)


def write_archives(pages: DataFrame, path: str, segment_bytes: int = SEGMENT_BYTES,
                   file_bytes: int = FILE_BYTES) -> None:
    """Write ``pages`` (page_id, url, html) as WARC files under ``path``."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("sha", F.sha1("payload"))
    ids = rows.select("page_id", "sha", F.length("payload").alias("size"))
    total = ids.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    firsts = ids.groupBy("sha").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    # written, so that Spark knows whether the repeated payloads are few enough to be sent to all tasks
    firsts = materialise(firsts.filter("n > 1").drop("n"))
    again = ids.groupBy("page_id", "sha").count().filter("count > 1").limit(1).count()
    same = W.partitionBy("page_id", "sha").orderBy("url")
    rows = rows.withColumn("copy", F.row_number().over(same) if again else F.lit(1)).join(firsts, "sha", "left")

    def build(batches):
        for batch in batches:
            out = []
            for page, url, payload, sha, copy, first in zip(*(batch.column(i).to_pylist() for i in range(6))):
                link = f"urn:page:{first}:{sha}:1" if first is not None and page != first else None
                address = " ".join((url or "").split())
                out += page_records(f"urn:page:{page}:{sha}:{copy}", address, payload, link, segment_bytes)
                if sum(map(len, out[-64:])) > 8 << 20 or len(out) > 500:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])
                    out = []
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    files = max(1, -(-total // file_bytes))
    records = rows.select("page_id", "url", "payload", "sha", "copy", "first_id").mapInArrow(build, "value binary")
    (records.select(F.col("value").cast("string")).repartition(files, F.xxhash64("value"))
     .write.mode("overwrite").option("lineSep", END.decode()).option("compression", "gzip").text(path))


def parse(data: bytes) -> Iterator[tuple[dict[bytes, bytes], bytes]]:
    """(headers in lower case, block) of each record in an archive."""
    at = 0
    while at < len(data):
        end = data.index(END, at)
        lines = data[at:end].split(b"\r\n")
        if not lines[0].startswith(b"WARC/"):
            raise ValueError("not at the start of a record")
        headers = {k.lower(): v.strip() for k, _, v in (x.partition(b":") for x in lines[1:])}
        size = int(headers[b"content-length"])
        start = end + len(END)
        if data[start + size:start + size + 4] != END:
            raise ValueError("record length does not match")
        yield headers, data[start:start + size]
        at = start + size + 4


def payload_of(block: bytes) -> bytes:
    """Body of an HTTP message, decoded if it is chunked."""
    head, _, body = block.partition(END)
    return dechunked(body) if b"transfer-encoding: chunked" in head.lower() else body


def _name(headers: dict, key: bytes) -> str | None:
    return headers[key].decode().strip("<>") if key in headers else None


def _parsed(headers: dict, block: bytes) -> tuple:
    kind, rid = headers[b"warc-type"].decode(), _name(headers, b"warc-record-id")
    sha = headers.get(b"warc-payload-digest", b"").decode().removeprefix("sha1:") or None
    if kind == "revisit":
        size = dict(x.split(b": ", 1) for x in block.partition(END)[0].split(b"\r\n")[1:])[b"Content-Length"]
        return rid, kind, None, None, None, int(size), sha, _name(headers, b"warc-refers-to")
    if b"warc-segment-number" not in headers:
        payload = payload_of(block)
        if digest(payload) != sha:
            raise ValueError(f"payload of {rid} does not match its digest")
        return rid, kind, None, None, block, len(payload), sha, None
    total = headers.get(b"warc-segment-total-length")
    return (_name(headers, b"warc-segment-origin-id") or rid, kind, int(headers[b"warc-segment-number"]),
            total and int(total), block, None, sha, None)


def read_records(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Whole records: id, type, id referred to, payload length, digest and payload.

    ``payloads=False`` leaves the payload out; then only segments of split records are shuffled.
    """

    def files(batches):
        for batch in batches:
            for data in batch.column(0).to_pylist():
                rows, size = [], 0
                for headers, block in parse(zlib.decompress(data, 31) if data[:2] == b"\x1f\x8b" else data):
                    row = _parsed(headers, block)
                    if row[2] is None and not payloads:
                        row = (*row[:4], None, *row[5:])
                    rows.append(row)
                    size += len(block)
                    if size > 4 << 20 or len(rows) >= 1000:
                        yield _batch(rows, _PARSED)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows, _PARSED)

    def whole(batches):
        for batch in batches:
            rows = []
            for rid, kind, refers, size, sha, total, segments in zip(*(c.to_pylist() for c in batch.columns)):
                block = b"".join(s["block"] for s in segments if s["block"] is not None)
                payload = None
                if segments[0]["segment"] is not None:
                    if [s["segment"] for s in segments] != list(range(1, len(segments) + 1)) or total != len(block):
                        raise ValueError(f"segments of {rid} are not complete")
                    payload = payload_of(block)
                    if digest(payload) != sha:
                        raise ValueError(f"payload of {rid} does not match its digest")
                    size = len(payload)
                elif block:
                    payload = payload_of(block)
                rows.append((rid, kind, refers, size, sha, payload if payloads else None))
                if len(rows) >= 256:
                    yield _batch(rows, _DECODED)
                    rows = []
            if rows:
                yield _batch(rows, _DECODED)

    parsed = spark.read.format("binaryFile").load(path).select("content").mapInArrow(files, PARSED)
    # of a split record the origin comes first, so its type and digest are those of segment 1
    origin = F.when(F.col("record_type") != "continuation", F.col("record_type"))
    return (
        parsed.groupBy("record_id").agg(
            F.max(origin).alias("record_type"), F.max("refers_to_id").alias("refers_to_id"),
            F.max("payload_bytes").alias("payload_bytes"), F.max("payload_digest").alias("payload_digest"),
            F.max("total").alias("total"),
            F.sort_array(F.collect_list(F.struct("segment", "block"))).alias("segments"))
        .mapInArrow(whole, DECODED)
    )


_PARSED = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("segment", pa.int32()),
                     ("total", pa.int64()), ("block", pa.binary()), ("payload_bytes", pa.int64()),
                     ("payload_digest", pa.string()), ("refers_to_id", pa.string())])
_DECODED = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("refers_to_id", pa.string()),
                      ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)


def page_of(col: str):
    """page_id in a record identifier of this module; NULL if the page had none."""
    return F.expr(f"try_cast(split_part({col}, ':', 3) AS bigint)")


OP6_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS payload_bytes, sha1(b) AS h FROM p),
n AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first_id FROM d),
v AS (SELECT *, list_transform(range(8), lambda i: CAST('0x' || substr(h, CAST(i * 5 + 1 AS INTEGER), 5) AS BIGINT)) AS g FROM n)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(g, lambda x: array_to_string(list_transform([15, 10, 5, 0],
    lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((x >> s) & 31) + 1 AS INTEGER), 1)), '')), '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM v"""


@query("op6_warc", OP6_SQL)
def op6(spark, sf_dir):
    """All pages, written to archives in the shared folder and read back."""
    path = f"{shared_dir(spark)}/warc/{uuid.uuid4().hex}"
    write_archives(table(spark, sf_dir, "pages"), path)
    return read_records(spark, path, payloads=False).select(
        page_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        page_of("refers_to_id").alias("refers_to"))
