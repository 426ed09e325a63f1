"""WARC archives: writing captures with revisit records, and assembling transactions.

Each page becomes three records: a request, a response (or a revisit of the response
with the same payload) and a metadata record; request and metadata name the response
in ``WARC-Concurrent-To``.  Reading parses records, then joins the three kinds through
those identifiers into one nested row for each capture.

Every record is a gzip member of its own.  Files are written and read a record at a
time, so memory holds one record, not a file.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, join_sized, scratch

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = (
    "record_id string, type string, concurrent_to string, refers_to string, uri string, payload_digest string, "
    "payload_bytes long, fields map<string,string>, payload binary"
)


def sha1_base32(raw: bytes) -> str:
    return base64.b32encode(hashlib.sha1(raw).digest()).decode()


def _record(kind: str, record_id: str, headers: dict[str, str], block: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", *(f"{k}: {v}" for k, v in headers.items())]
    head = "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""]).encode()
    pack = zlib.compressobj(3, zlib.DEFLATED, 31)
    return pack.compress(head + block + b"\r\n\r\n") + pack.flush()


def capture_records(page_id: int | None, nth: int | str, url: str | None, payload: bytes, refers_to: int | None, date: str) -> Iterator[bytes]:
    """The compressed records of one capture; ``refers_to`` is the page whose response has the same payload."""
    own = f"urn:page:{'' if page_id is None else page_id}:{nth}"
    uri = quote(url or own, safe="".join(map(chr, range(33, 127))))
    common = {"WARC-Date": date, "WARC-Target-URI": uri}
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    of_payload = common | {"WARC-Payload-Digest": f"sha1:{sha1_base32(payload)}", "Content-Type": "application/http;msgtype=response"}
    host = re.sub(r"^\w+://([^/?#]*).*", r"\1", uri)
    get = f"GET {uri} HTTP/1.1\r\nHost: {host}\r\n\r\n".encode()
    beside = common | {"WARC-Concurrent-To": f"<{own}>"}
    yield _record("request", f"{own}:request", beside | {"Content-Type": "application/http;msgtype=request"}, get)
    if refers_to is None:
        yield _record("response", own, of_payload, http + payload)
    else:
        more = {"WARC-Profile": PROFILE, "WARC-Refers-To": f"<urn:page:{refers_to}:0>"}
        yield _record("revisit", own, of_payload | more, http)
    fields = f"page-id: {'' if page_id is None else page_id}\r\n".encode()
    yield _record("metadata", f"{own}:metadata", beside | {"Content-Type": "application/warc-fields"}, fields)


def write_warc(pages: DataFrame, least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", most_bytes: int = 256 << 20) -> DataFrame:
    """Writes ``page_id, url, html`` as archives in the shared folder; a manifest ``path, size, records``.

    Of pages with equal payloads of at least ``least_bytes`` bytes the one with the smallest id is
    the response and the others revisit it.  Payloads count as equal when length, SHA-1 and MD5
    are.  Null html is empty.  Rows that repeat an id are captures of their own; those that also
    repeat the payload of the response stay responses.  A null id is never a revisit.  A task goes on in a new file once one has ``most_bytes`` bytes.
    """
    folder = scratch(pages.sparkSession, "warc")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload")
    )
    keys = rows.select(
        "page_id", F.sha1("payload").alias("sha1"), F.md5("payload").alias("md5"), F.length("payload").alias("n")
    ).where(F.col("n") >= least_bytes)
    firsts = cut(
        keys.groupBy("sha1", "md5", "n")
        .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("of"))
        .where("of > 1"),
        "equal-payloads",
    )
    again = (
        join_sized(keys, firsts, ["sha1", "md5", "n"], "of", F.xxhash64("page_id"))
        .where("page_id <> first")
        .select("page_id", "sha1", "first")
        .distinct()
        .groupBy(F.col("page_id").alias("place"))
        .agg(F.map_from_entries(F.collect_list(F.struct("sha1", "first"))).alias("firsts"))
    )
    # payloads move once, dealt by page; pages without an id are dealt by their content
    placed = rows.withColumn("place", F.coalesce("page_id", F.xxhash64("url", "payload")))
    dealt = placed.repartition("place").join(again, "place", "left").sortWithinPartitions("page_id")
    refers = F.when(F.col("page_id").isNotNull(), F.col("firsts")[F.sha1("payload")])
    dealt = dealt.select("page_id", "url", "payload", refers.alias("refers_to"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, last, nth, records, size, first = None, None, 0, 0, 0, True
        for batch in batches:
            for at in range(batch.num_rows):
                page_id, url, payload, refers_to = (c[at].as_py() for c in batch.columns)
                if out is None:
                    fs, top = pa.fs.FileSystem.from_uri(folder)
                    fs.create_dir(top)
                    name = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
                    out = fs.open_output_stream(f"{top}/{name}", compression=None)
                    raw = _record("warcinfo", f"urn:uuid:{uuid.uuid4()}", {"WARC-Date": date, "Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.1\r\n")
                    out.write(raw)
                    records, size = 0, len(raw)
                nth = nth + 1 if not first and page_id == last else 0
                last, first = page_id, False
                # pages without an id are counted by task
                own = nth if page_id is not None else f"{TaskContext.get().partitionId()}-{nth}"
                for raw in capture_records(page_id, own, url, payload, refers_to, date):
                    out.write(raw)
                    records, size = records + 1, size + len(raw)
                if size >= most_bytes:
                    out.close()
                    yield pa.RecordBatch.from_pylist([{"path": f"{folder}/{name}", "size": size, "records": records}])
                    out = None
        if out:
            out.close()
            yield pa.RecordBatch.from_pylist([{"path": f"{folder}/{name}", "size": size, "records": records}])

    return cut(dealt.mapInArrow(each, "path string, size long, records long"), "warc-files")


def members(stream, chunk: int = 1 << 20, step: int = 1 << 14) -> Iterator[bytes]:
    """The uncompressed gzip members of a stream, one at a time.

    The decompressor gets ``step`` bytes at a time, so that what it hands back after the end of a
    member is never longer than that.
    """
    unpack, parts, raw, at = zlib.decompressobj(31), [], b"", 0
    while True:
        if at == len(raw):
            raw, at = stream.read(chunk), 0
            if not raw:
                return
        given = raw[at : at + step]
        parts.append(unpack.decompress(given))
        at += len(given) - len(unpack.unused_data)
        if unpack.eof:
            yield b"".join(parts)
            unpack, parts = zlib.decompressobj(31), []


def _headers(raw: bytes) -> dict[str, str]:
    found = (line.partition(":") for line in raw.decode("utf-8", "replace").split("\r\n")[1:] if line)
    return {k.strip().lower(): v.strip() for k, _, v in found}


def parse_record(raw: bytes, payloads: bool = True) -> dict:
    """One record; a response's payload digest is computed anew and must agree with its header."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    h = _headers(head)

    block = rest[: int(h["content-length"])]
    bare = lambda k: h[k].strip("<>") if k in h else None
    kind, digest, n, fields, payload = h["warc-type"], h.get("warc-payload-digest", "").removeprefix("sha1:") or None, None, None, None
    if kind in ("response", "revisit"):
        http, _, payload = block.partition(b"\r\n\r\n")
        n = int(_headers(http).get("content-length", len(payload)))
        if kind == "response" and (digest != sha1_base32(payload) or n != len(payload)):
            raise ValueError(f"payload of {h['warc-record-id']} doesn't agree with its header")
        payload = payload if kind == "response" and payloads else None
    elif kind == "metadata":
        fields = list(_headers(b"\r\n" + block).items())
    return {
        "record_id": bare("warc-record-id"), "type": kind, "concurrent_to": bare("warc-concurrent-to"), "refers_to": bare("warc-refers-to"),
        "uri": h.get("warc-target-uri"), "payload_digest": digest, "payload_bytes": n, "fields": fields, "payload": payload,
    }


ARROW = pa.schema(
    [(c, pa.string()) for c in ("record_id", "type", "concurrent_to", "refers_to", "uri", "payload_digest")]
    + [("payload_bytes", pa.int64()), ("fields", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())]
)


def read_records(manifest: DataFrame, payloads: bool = True, rows: int = 256, most_bytes: int = 8 << 20) -> DataFrame:
    """A row for each record of the archives in ``path``; payloads only where wanted."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, name = pa.fs.FileSystem.from_uri(path)
                held, size = [], 0
                with fs.open_input_stream(name, compression=None) as stream:
                    for raw in members(stream):
                        held.append(parse_record(raw, payloads))
                        size += len(held[-1]["payload"] or b"")
                        if len(held) >= rows or size >= most_bytes:
                            yield pa.RecordBatch.from_pylist(held, ARROW)
                            held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, ARROW)

    n = max(1, manifest.count())
    return manifest.select("path").repartition(n, "path").mapInArrow(each, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row for each capture: ``capture_id, response, requests, metadata``.

    Request and metadata records are joined to the response or revisit that their
    ``WARC-Concurrent-To`` names; a response without them has null there.
    """
    main = records.where(F.col("type").isin("response", "revisit")).select(
        F.col("record_id").alias("capture_id"),
        F.struct("type", "uri", "refers_to", "payload_digest", "payload_bytes", "payload").alias("response"),
    )

    def beside(kind: str, out: str, *cols: str) -> DataFrame:
        own = records.where((F.col("type") == kind) & F.col("concurrent_to").isNotNull())
        return own.groupBy(F.col("concurrent_to").alias("capture_id")).agg(F.collect_list(F.struct(*cols)).alias(out))

    return main.join(beside("request", "requests", "record_id", "uri"), "capture_id", "left").join(
        beside("metadata", "metadata", "record_id", "fields"), "capture_id", "left"
    )


def warc_transactions(pages: DataFrame, least_bytes: int = 0, **options) -> DataFrame:
    """Writes pages as archives, reads them back and assembles captures, without payloads.

    ``page_id, payload_bytes, payload_digest, record_type, refers_to``: a row for each row of
    ``pages``.  See ``write_warc`` for nulls, ties and repeated rows; an empty table writes no
    file and gives an empty result; other columns are not read.
    """
    records = cut(read_records(write_warc(pages, least_bytes, **options), payloads=False), "warc-records")
    captures = assemble(records)
    page = F.col("metadata")[0]["fields"]["page-id"]
    return captures.select(
        F.when(page != "", page).cast("long").alias("page_id"),
        F.col("response.payload_bytes").alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.type").alias("record_type"),
        F.regexp_extract("response.refers_to", r"^urn:page:(-?\d+):0$", 1).cast("long").alias("refers_to"),
        F.size("requests").cast("long").alias("n_requests"),
    )
