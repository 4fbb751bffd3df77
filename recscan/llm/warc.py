"""WARC archives: write captures as transactions, read records back, assemble them again.

A capture is three records: a request, a response (or a revisit of an earlier equal payload) and
a metadata record. Request and metadata name the response in ``WARC-Concurrent-To``;
:func:`assemble` joins the three by it and gives one nested row per capture.

Archives are gzip files written by Spark's text writer: a record is one string, and the writer's
separator is the CRLF CRLF that ends a WARC record. Reading splits at what opens the version line
of every record, of any WARC 1 version, and joins what a payload's own such lines split, by
``Content-Length``. So both ways go through Spark's file systems, records stream, and no file is
held in memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recscan.llm.shared import BROADCAST_ROWS, join_groups, materialize, settled, small_batches

CRLF = "\r\n"
VERSION = "WARC/1.1\r\n"
#: Opens a record of any version that is read.
OPENS = "WARC/1."
#: Equal payloads of at least so many bytes are stored once.
REVISIT_MIN = 1000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: WARC wants a date; the pages have none.
DATE = "2024-01-01T00:00:00Z"


def plan_captures(pages: DataFrame, min_bytes: int = REVISIT_MIN) -> DataFrame:
    """Adds what the records need: _row, _digest, _bytes, _type, _refers_row, _refers_id.

    Of the rows with equal payloads of at least ``min_bytes`` bytes the one with the largest
    page_id is the response (of repeated rows the last one), the others revisit it. A null html
    is an empty payload; a null page_id counts as the smallest.

    Texts stay where they are: of each page an id, a digest and a length are written, groups are
    found on those, and only what revisits say comes back to the pages.
    """
    pages = settled(pages, "pages")
    html = F.coalesce("html", F.lit(""))
    own = pages.select(
        "page_id", F.coalesce("url", F.lit("")).alias("url"), html.alias("html"), F.monotonically_increasing_id().alias("_row"),
        F.sha1(html.cast("binary")).alias("_digest"), F.octet_length(html).cast("long").alias("_bytes"),
    )
    narrow = materialize(own.filter(F.col("_bytes") >= min_bytes).select("page_id", "_row", "_digest", "_bytes"), "payloads")
    last = F.max(F.struct("page_id", "_row")).alias("_keep")
    keep = materialize(narrow.groupBy("_digest", "_bytes").agg(last, F.count(F.lit(1)).alias("_n")).filter("_n > 1"), "shared_payloads")
    again = join_groups(narrow, keep, ["_digest", "_bytes"], "_n").filter(F.col("_keep._row") != F.col("_row"))
    again = materialize(again.select("_row", F.col("_keep._row").alias("_refers_row"), F.col("_keep.page_id").alias("_refers_id")), "revisits")
    joined = own.join(F.broadcast(again) if again.count() <= BROADCAST_ROWS else again, "_row", "left")
    kind = F.when(F.col("_refers_row").isNotNull(), "revisit").otherwise("response")
    return joined.select("page_id", "url", "html", "_row", "_digest", "_bytes", kind.alias("_type"), "_refers_row", "_refers_id")


def _record(kind: Column, record_id: Column, fields: list[tuple[str, Column]], mime: str, block: Column) -> Column:
    lines = [("WARC-Type", kind), ("WARC-Record-ID", record_id), ("WARC-Date", F.lit(DATE)), *fields]
    lines += [("Content-Type", F.lit(mime)), ("Content-Length", F.octet_length(block).cast("string"))]
    # a field whose value is null is left out
    head = [F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit("")) for name, value in lines]
    return F.concat(F.lit(VERSION), *head, F.lit(CRLF), block)


def capture_records(captures: DataFrame) -> DataFrame:
    """One row per record: ``value``, the record without the CRLF CRLF that ends it."""
    # a line break would end a header field early; it cannot be in a URI unescaped
    uri = F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    urn = lambda kind, row: F.concat(F.lit(f"<urn:capture:{kind}:"), row.cast("string"), F.lit(">"))
    main = urn("main", F.col("_row"))
    target, digest = ("WARC-Target-URI", uri), ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "_digest"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("_bytes").cast("string"), F.lit(CRLF * 2))
    revisit = F.col("_type") == "revisit"
    refers = [
        ("WARC-Refers-To", urn("main", F.col("_refers_row"))),
        ("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
    ]
    response = _record(
        F.col("_type"), main, [target, digest, *refers], "application/http;msgtype=response",
        F.when(revisit, http).otherwise(F.concat(http, "html")),
    )
    to = ("WARC-Concurrent-To", main)
    request = _record(
        F.lit("request"), urn("request", F.col("_row")), [target, to], "application/http;msgtype=request",
        F.concat(F.lit("GET "), uri, F.lit(f" HTTP/1.1{CRLF * 2}")),
    )
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(CRLF)), F.lit(""))
    metadata = _record(
        F.lit("metadata"), urn("metadata", F.col("_row")), [target, to], "application/warc-fields",
        F.concat(line("pageId", F.col("page_id")), line("payloadLength", F.col("_bytes")), line("refersToPageId", F.col("_refers_id"))),
    )
    return captures.select(F.explode(F.array(request, response, metadata)).alias("value"))


def write_warc(pages: DataFrame, path: str, min_bytes: int = REVISIT_MIN) -> None:
    """Write the archives of ``pages`` (page_id, url, html) into the folder ``path``."""
    records = capture_records(plan_captures(pages, min_bytes))
    records.write.option("lineSep", CRLF * 2).option("compression", "gzip").text(path)


#: What :func:`read_warc` gives of each record; payload_sha1 and payload_bytes are taken from the bytes read.
RECORD_SCHEMA = (
    "record_id string, type string, target_uri string, date string, concurrent_to string, refers_to string, "
    "payload_digest string, http_head string, payload binary, payload_sha1 string, payload_bytes long, fields map<string,string>"
)


def _parse(head: bytes, block: bytes) -> dict:
    named = {}
    for line in head.split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if colon:
            named[name.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
    http, payload, fields = None, None, None
    if named.get("content-type", "").startswith("application/http"):
        first, _, payload = block.partition(b"\r\n\r\n")
        http = first.decode("utf-8", "replace")
    elif named.get("content-type") == "application/warc-fields":
        fields = [(a.decode("utf-8", "replace"), b.strip().decode("utf-8", "replace")) for a, c, b in (x.partition(b":") for x in block.split(b"\r\n")) if c]
    else:
        payload = block
    stored = named.get("warc-type") in ("response", "resource", "conversion")
    return {
        "record_id": named.get("warc-record-id"), "type": named.get("warc-type"), "target_uri": named.get("warc-target-uri"),
        "date": named.get("warc-date"), "concurrent_to": named.get("warc-concurrent-to"), "refers_to": named.get("warc-refers-to"),
        "payload_digest": named.get("warc-payload-digest"), "http_head": http, "payload": payload if stored else None,
        "payload_sha1": hashlib.sha1(payload).hexdigest() if stored else None, "payload_bytes": len(payload) if stored else None, "fields": fields,
    }


def _records(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Pieces between openings, in file order, to records; cut off what follows Content-Length."""
    held: list[bytes] = []
    have, need, file = 0, None, None  # bytes held, bytes that the record has, if its head is complete
    for batch in batches:
        out = []
        for piece, path in zip(batch["value"].to_pylist(), batch["file"].to_pylist(), strict=True):
            if path != file:
                if b"".join(held).strip():
                    raise ValueError(f"{file} ends within a record")
                held, have, need, file = [], 0, None, path
            if held:  # an unfinished record: what opens one stands in its payload
                piece = OPENS.encode() + piece
            elif not piece.strip():
                continue
            held.append(piece)
            have += len(piece)
            if need is None:
                head, blank, _ = b"".join(held).partition(b"\r\n\r\n")
                length = next((int(x[15:]) for x in head.split(b"\r\n") if x[:15].lower() == b"content-length:"), None)
                if blank and length is not None:
                    need = len(head) + 4 + length
            if need is not None and have >= need:
                head, _, rest = b"".join(held)[:need].partition(b"\r\n\r\n")
                out.append(_parse(head, rest))
                held, have, need = [], 0, None
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)
    if b"".join(held).strip():
        raise ValueError(f"{file} ends within a record; are archives gzip files, which Spark does not split?")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the gzip archives in ``path``; see RECORD_SCHEMA.

    Records of WARC 1.0 and 1.1 are read. Bytes of a header that are no UTF-8 are replaced. A record cut short, as by a truncated file, raises an error. An archive without records gives
    no row.
    """
    small_batches(spark)
    types = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "map<string,string>": pa.map_(pa.string(), pa.string())}
    schema = pa.schema([(n, types[t]) for n, t in (x.split() for x in RECORD_SCHEMA.split(", "))])
    raw = spark.read.option("lineSep", OPENS).text(path)
    lines = raw.select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"))
    return lines.mapInArrow(lambda batches: _records(batches, schema), RECORD_SCHEMA)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id, target_uri, request, response, metadata.

    response and revisit records are the captures; request and metadata records join them by the
    record id they are concurrent to. A capture without request or metadata keeps a null there;
    records that are concurrent to nothing known are left out.
    """
    main = records.filter(F.col("type").isin("response", "revisit")).select(
        F.col("record_id").alias("capture_id"), "target_uri",
        F.struct("type", "refers_to", "payload_digest", "http_head", "payload", "payload_sha1", "payload_bytes").alias("response"),
    )
    beside = records.filter(F.col("type").isin("request", "metadata"))
    both = beside.groupBy(F.col("concurrent_to").alias("capture_id")).agg(
        F.max(F.when(F.col("type") == "request", F.struct("record_id", "http_head"))).alias("request"),
        F.max_by(F.struct("record_id", "fields"), F.when(F.col("type") == "metadata", F.col("record_id"))).alias("metadata"),
    )
    return main.join(both, "capture_id", "left").select("capture_id", "target_uri", "request", "response", "metadata")
