"""WARC archives: pages written as request, response or revisit, and metadata records, and assembled into captures again.

A record's bytes are one row of text whose line end is the record's last character, so Spark's text writer makes gzipped WARC files of a
bounded number of records. They are read as binary files, inflated and parsed by ``Content-Length``; a payload may hold anything, record
heads included. A capture is its response or revisit joined with the request and the metadata record that name it in ``WARC-Concurrent-To``.

Defined results: a null page is an empty payload; a null url is ``urn:page:<id>``, and characters that would end a header are escaped.
Of equal payloads with at least ``min_bytes`` bytes the one at the largest ``page_id`` is the response and the others revisit it; repeated
rows of that page are all responses, smaller payloads too. A row without an id cannot be named: it is a response. An empty table gives no
capture; other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsift.llm.common import slices
from logsift.operators.ordered import checked_join
from logsift.scratch import saved

WRITTEN = "2024-01-01T00:00:00Z"  # the tables hold no time of capture
VERSION = b"WARC/1.1\r\n"
GZIPPED = b"\x1f\x8b"
RECORDS = (
    "kind string, record_id string, concurrent_to string, refers_to string, target_uri string, payload_digest string, "
    "payload_bytes bigint, payload binary, fields string"
)


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page: str, kind: str, payload_digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{kind} {page} {payload_digest}')}>"


def header_text(value: str) -> str:
    """A value that cannot end its header line."""
    return "".join(f"%{ord(c):02X}" if c < " " or c == "\x7f" else c for c in value)


def record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A whole WARC record, its two closing line ends included."""
    lines = [("WARC-Type", kind), *headers, ("WARC-Date", WRITTEN), ("Content-Length", str(len(block)))]
    return VERSION + "".join(f"{k}: {header_text(v)}\r\n" for k, v in lines).encode() + b"\r\n" + block + b"\r\n\r\n"


def page_records(page: str, url: str | None, payload: bytes, first: str | None) -> list[bytes]:
    """Request, response or revisit (of page ``first``) and metadata of one page."""
    url = header_text(f"urn:page:{page}" if url is None else url)
    sha1 = base32_sha1(payload)
    own = record_id(page, "capture", sha1)
    host = url.split("://")[-1].split("/")[0]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    named = [("WARC-Record-ID", own), ("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha1:{sha1}"), ("Content-Type", "application/http; msgtype=response")]
    beside = lambda kind: [("WARC-Record-ID", record_id(page, kind, sha1)), ("WARC-Concurrent-To", own), ("WARC-Target-URI", url)]
    if first is None:
        capture = record("response", named, http + payload)
    else:
        profile = [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(first, "capture", sha1))]
        capture = record("revisit", named + profile, http)
    request = f"GET {url} HTTP/1.1\r\nHost: {host}\r\n\r\n".encode()
    return [
        record("request", [*beside("request"), ("Content-Type", "application/http; msgtype=request")], request),
        capture,
        record("metadata", [*beside("metadata"), ("Content-Type", "application/warc-fields")], f"page_id: {page}\r\n".encode()),
    ]


def parsed(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of every record of a file, plain or gzipped."""
    at = 0
    if data[:2] == GZIPPED:
        data = gzip.decompress(data)
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if lines[0] != VERSION.decode().strip():
            raise ValueError(f"no WARC record at byte {at}")
        headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
        length = int(headers["content-length"])
        yield headers, data[end + 4 : end + 4 + length]
        at = end + 4 + length + 4


def write_warc(pages: DataFrame, path: str, min_bytes: int = 0, pages_per_file: int = 1000) -> None:
    """Write ``page_id, url, html`` as WARC files of at most ``pages_per_file`` pages each."""

    def records(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in slices(batches, 64):
            columns = [batch.column(k).to_pylist() for k in ("page_id", "url", "html", "first")]
            rows = [r[:-1] for page, url, html, first in zip(*columns, strict=True) for r in page_records(str(page), url, html, None if first is None else str(first))]
            yield pa.RecordBatch.from_arrays([pa.array([r.decode() for r in rows], pa.string())], ["value"])

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce("html", F.lit("")).alias("html"))
    # Equal payloads are found on digests alone; only pages that revisit another one have a row in the table that is joined.
    digest = F.unhex(F.sha2("html", 256))
    digests = saved(rows.where(F.col("page_id").isNotNull() & (F.octet_length("html") >= min_bytes)).select("page_id", digest.alias("sha")), "digests")
    largest = digests.groupBy("sha").agg(F.max("page_id").alias("first"), F.min("page_id").alias("last")).where("first <> last").select("sha", "first")
    revisits = saved(digests.join(saved(largest, "largest"), "sha").where("page_id <> first").distinct(), "revisits")
    # One page may have several rows with other payloads, so the payload decides, too. Up to a counted number of revisits no page is shuffled.
    whole = checked_join(rows.withColumn("sha", digest), revisits, ["page_id", "sha"], F.xxhash64("url"))
    texts = whole.select("page_id", "url", F.col("html").cast("binary"), "first").mapInArrow(records, "value string")
    texts.write.option("maxRecordsPerFile", 3 * pages_per_file).option("compression", "gzip").text(path)


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records of the archives under ``path``. The digest is that of the payload itself where the record has one, else as stated."""

    def records(batches: Iterator) -> Iterator:
        import pyarrow as pa

        schema = pa.schema([(k, {"bigint": pa.int64(), "binary": pa.binary()}.get(t, pa.string())) for k, t in (x.split() for x in RECORDS.split(", "))])

        def one(headers: dict[str, str], block: bytes) -> dict:
            kind = headers["warc-type"]
            http, payload = (block.split(b"\r\n\r\n", 1) if kind in ("response", "revisit") else (b"", b""))
            fields = dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])
            stated = headers.get("warc-payload-digest", "").removeprefix("sha1:") or None
            return {
                "kind": kind, "record_id": headers["warc-record-id"], "concurrent_to": headers.get("warc-concurrent-to"),
                "refers_to": headers.get("warc-refers-to"), "target_uri": headers.get("warc-target-uri"),
                "payload_digest": base32_sha1(payload) if kind == "response" else stated,
                "payload_bytes": len(payload) if kind == "response" else int(fields["Content-Length"]) if kind == "revisit" else None,
                "payload": payload if payloads and kind == "response" else None,
                "fields": block.decode().strip() if kind in ("request", "metadata") else None,
            }

        for batch in slices(batches, 1):
            rows, held = [], 0
            for headers, block in parsed(batch.column("content")[0].as_py()):
                rows.append(one(headers, block))
                held += len(block)
                if held > 1 << 22:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.where("length > 0").select("content").mapInArrow(records, RECORDS)


def assemble(records: DataFrame) -> DataFrame:
    """One row per capture: its own columns and the nested ``request`` and ``metadata`` records that are concurrent to it.

    Repeated request or metadata records of one capture count once. A capture without them has nulls there.
    """
    captures = records.where(F.col("kind").isin("response", "revisit")).drop("concurrent_to", "fields")
    beside = records.where(F.col("kind").isin("request", "metadata") & F.col("concurrent_to").isNotNull())
    by_capture = beside.groupBy(F.col("concurrent_to").alias("record_id")).agg(
        *(F.min(F.when(F.col("kind") == k, F.struct("record_id", "target_uri", "fields"))).alias(k) for k in ("request", "metadata"))
    )
    return captures.join(by_capture, "record_id", "left")


def page_captures(captures: DataFrame) -> DataFrame:
    """Captures with ``page_id`` from their metadata and, for revisits, the page that they refer to."""
    page = F.regexp_extract("metadata.fields", r"page_id: (-?\d+)", 1)
    named = captures.withColumn("page_id", F.when(page != "", page.cast("long")))
    responses = named.where(F.col("kind") == "response").groupBy(F.col("record_id").alias("refers_to")).agg(F.max("page_id").alias("refers_to_page"))
    return named.join(saved(responses, "responses"), "refers_to", "left")
