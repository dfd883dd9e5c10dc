"""WARC archives: writing captures with revisits, reading archives back, and assembling transactions.

Writing: each page becomes a request, a response (or a revisit, when another page has the same payload) and a metadata
record; request and metadata name the response in ``WARC-Concurrent-To``.  Of pages with equal payloads of at least
``REVISIT_BYTES`` bytes the one with the largest id, and of equal ids the last row, carries the payload.  Records are
built by column functions and written as text whose line separator is the record separator, so archives go wherever
Spark can write; ``PAGES_PER_FILE`` bounds a file.

Reading: archives are read whole, one per row (the reason for the bound), unpacked as a stream (plain, or gzip with any
number of members) and cut at their ``Content-Length``, so payloads may hold anything.

Assembly: request and metadata records find their capture through the identifiers they are concurrent to, directly or
by way of another such record.  One nested row per capture; records that lead to no capture make a row under the first
identifier that they name.  Only small columns are grouped; payloads travel once.

A null payload is empty.  Null urls and line breaks in urls are left out or percent-encoded.  Null and repeated ids make
records of their own, told apart by row.  Records without an identifier stay by themselves.  Other columns are ignored.
"""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ledgerspark.llm.base import materialize

REVISIT_BYTES = 1000
PAGES_PER_FILE = 10_000
CRLF = "\r\n"
SEPARATOR = "\r\n\r\n"
#: Published profile of revisits with an identical payload (fixed value).
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = (
    "type string, id string, uri string, concurrent_to array<string>, refers_to string, payload_digest string, "
    "http string, payload binary, fields map<string,string>"
)


def _uuid(kind: str, row: Column) -> Column:
    digest = F.md5(F.concat_ws(":", F.lit(kind), row.cast("string")).cast("binary"))
    parts = [F.substring(digest, at, size) for at, size in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _record(headers: list[tuple[str, Column | str]], block: Column) -> Column:
    """A record as text; headers without a value are left out."""
    lines = [F.lit("WARC/1.1")]
    for name, value in headers:
        lines.append(F.concat(F.lit(f"{name}: "), value if isinstance(value, Column) else F.lit(value)))
    lines.append(F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")))
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(SEPARATOR), block)


def write_archives(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    date: str = "2024-01-01T00:00:00Z",
    revisit_bytes: int = REVISIT_BYTES,
) -> None:
    """Write the records of all pages as gzip archives under ``path``."""
    rows = pages.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).cast("long").alias("page_id"),
        F.regexp_replace(F.regexp_replace(F.col(url_col).cast("string"), "\r", "%0D"), "\n", "%0A").alias("url"),
        F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"),
    )
    rows = rows.withColumn("size", F.octet_length("html").cast("long")).withColumn("digest", F.sha1(F.col("html").cast("binary")))
    rows = materialize(rows, "warc-pages")
    large = rows.where(F.col("size") >= revisit_bytes)
    holders = large.groupBy("digest").agg(F.max(F.struct("page_id", "row")).alias("holder"), F.count(F.lit(1)).alias("n"))
    holders = materialize(holders.where("n > 1").select(F.col("digest").alias("same"), F.col("holder.row").alias("holder")), "warc-holders")
    rows = rows.join(holders, (F.col("digest") == F.col("same")) & (F.col("size") >= revisit_bytes), "left")
    revisit = F.col("holder").isNotNull() & (F.col("holder") != F.col("row"))

    own, when = _uuid("response", F.col("row")), ("WARC-Date", date)
    uri = ("WARC-Target-URI", F.col("url"))
    digest = ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest")))
    status = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("size").cast("string"), F.lit(SEPARATOR)
    )
    http = ("Content-Type", "application/http; msgtype=response")
    response = _record([("WARC-Type", "response"), ("WARC-Record-ID", own), when, uri, digest, http], F.concat(status, "html"))
    refers = [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", _uuid("response", F.col("holder")))]
    again = _record([("WARC-Type", "revisit"), ("WARC-Record-ID", own), when, uri, digest, *refers, http], status)
    asked = F.concat(F.lit("GET "), F.coalesce("url", F.lit("/")), F.lit(f" HTTP/1.1{SEPARATOR}"))
    request = _record(
        [("WARC-Type", "request"), ("WARC-Record-ID", _uuid("request", F.col("row"))), when, uri, ("WARC-Concurrent-To", own), ("Content-Type", "application/http; msgtype=request")],
        asked,
    )
    fields = F.concat_ws(CRLF, F.concat(F.lit("pageId: "), F.col("page_id").cast("string")), F.concat(F.lit("payloadLength: "), F.col("size").cast("string")), F.lit(""))
    metadata = _record(
        [("WARC-Type", "metadata"), ("WARC-Record-ID", _uuid("metadata", F.col("row"))), when, uri, ("WARC-Concurrent-To", _uuid("request", F.col("row"))), ("Content-Type", "application/warc-fields")],
        fields,
    )
    records = rows.select(F.explode(F.array(request, F.when(revisit, again).otherwise(response), metadata)).alias("value"))
    records.write.option("lineSep", SEPARATOR).option("compression", "gzip").option("maxRecordsPerFile", 3 * PAGES_PER_FILE).text(path)


class _Stream:
    """Bytes of an archive, unpacked as needed."""

    def __init__(self, raw: bytes):
        self.raw, self.at, self.buffer = raw, 0, bytearray()
        self.packed = raw[:2] == b"\x1f\x8b"
        self.unpack = zlib.decompressobj(31) if self.packed else None

    def grow(self) -> bool:
        if self.at >= len(self.raw):
            return False
        piece = self.raw[self.at : self.at + 1_000_000]
        self.at += len(piece)
        while piece:
            if not self.packed:
                self.buffer += piece
                break
            self.buffer += self.unpack.decompress(piece)
            piece = self.unpack.unused_data  # the next member
            if self.unpack.eof:
                self.unpack = zlib.decompressobj(31)
            else:
                break
        return True

    def until(self, mark: bytes) -> bytes | None:
        start = 0
        while (end := self.buffer.find(mark, start)) < 0:
            start = max(0, len(self.buffer) - len(mark))
            if not self.grow():
                return None
        out = bytes(self.buffer[:end])
        del self.buffer[: end + len(mark)]
        return out

    def take(self, size: int) -> bytes:
        while len(self.buffer) < size and self.grow():
            pass
        out = bytes(self.buffer[:size])
        del self.buffer[:size]
        return out

    def skip_breaks(self) -> None:
        while True:
            n = len(self.buffer) - len(self.buffer.lstrip(b"\r\n"))
            del self.buffer[:n]
            if self.buffer or not self.grow():
                return


def parse_archive(raw: bytes):
    """The records of one archive as dictionaries of the columns of ``RECORD``."""
    stream = _Stream(raw)
    while True:
        stream.skip_breaks()
        head = stream.until(b"\r\n\r\n")
        if head is None:
            return
        headers: list[tuple[str, str]] = []
        for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
            name, _, value = line.partition(":")
            headers.append((name.strip().lower(), value.strip()))
        first = dict(reversed(headers))
        block = stream.take(int(first.get("content-length", 0)))
        http, payload, fields = None, block, None
        kind = first.get("content-type", "")
        if kind.startswith("application/http"):
            status, found, body = block.partition(b"\r\n\r\n")
            http, payload = status.decode("utf-8", "replace"), body if found else b""
        elif kind.startswith("application/warc-fields"):
            pairs = (line.partition(":") for line in block.decode("utf-8", "replace").splitlines() if ":" in line)
            fields = [(k.strip(), v.strip()) for k, _, v in pairs]
            fields = list(dict(fields).items())
        yield {
            "type": first.get("warc-type"),
            "id": first.get("warc-record-id"),
            "uri": first.get("warc-target-uri"),
            "concurrent_to": [v for k, v in headers if k == "warc-concurrent-to"],
            "refers_to": first.get("warc-refers-to"),
            "payload_digest": first.get("warc-payload-digest"),
            "http": http,
            "payload": payload,
            "fields": fields,
        }


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """All records under ``path``, with the columns of ``RECORD``."""
    schema = pa.schema(
        [(c, pa.string()) for c in ("type", "id", "uri")]
        + [("concurrent_to", pa.list_(pa.string()))]
        + [(c, pa.string()) for c in ("refers_to", "payload_digest", "http")]
        + [("payload", pa.binary()), ("fields", pa.map_(pa.string(), pa.string()))]
    )

    def run(batches):
        for batch in batches:
            for raw in batch.column(0):
                held, size = [], 0
                for record in parse_archive(raw.as_py()):
                    held.append(record)
                    size += len(record["payload"])
                    if size > 4_000_000 or len(held) >= 2000:
                        yield pa.RecordBatch.from_pylist(held, schema=schema)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema=schema)

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")  # a row is a whole archive
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RECORD)


def assemble(records: DataFrame, nested: tuple[str, ...] = ("type", "refers_to", "payload_digest", "http", "payload")) -> DataFrame:
    """One nested row per capture: ``capture_id, uri, capture`` (its response or revisit), ``request``, ``metadata`` (array).

    ``nested`` names the columns of ``records`` that ``capture`` holds.  ``records`` is read several times; give a
    written table.
    """
    captures = records.where("type in ('response', 'revisit', 'resource')")
    small = [F.col(c) for c in ("type", "id", "uri", "http", "fields")]
    others = records.where("type is null or type not in ('response', 'revisit', 'resource', 'warcinfo')")
    others = others.select(F.struct(*small).alias("record"), F.col("id").alias("own"), F.get("concurrent_to", F.lit(0)).alias("named"), "concurrent_to")
    direct = others.select("own", F.explode("concurrent_to").alias("target"))
    ids = captures.select(F.col("id").alias("capture_id")).distinct()
    # own -> capture, directly; then by way of a record that has one.
    found = direct.join(ids, F.col("target") == F.col("capture_id")).select("own", "capture_id").distinct()
    found = materialize(found, "warc-direct")
    by_way = direct.join(found.select(F.col("own").alias("target"), "capture_id"), "target").select("own", "capture_id").distinct()
    links = materialize(found.unionByName(by_way).distinct(), "warc-links")
    linked = others.join(links, "own", "left").withColumn("root", F.coalesce("capture_id", "named", "own"))
    is_request = F.col("record.type") == "request"
    grouped = linked.groupBy("root").agg(
        F.min(F.when(is_request, F.struct(F.col("record.id").alias("id"), F.col("record.uri").alias("uri"), F.col("record.http").alias("http")))).alias("request"),
        F.collect_list(F.when(~F.coalesce(is_request, F.lit(False)), F.col("record"))).alias("metadata"),
    )
    grouped = materialize(grouped, "warc-attached")
    joined = captures.join(grouped, captures["id"] == grouped["root"], "full")
    return joined.select(
        F.coalesce("id", "root").alias("capture_id"),
        F.coalesce("uri", "request.uri").alias("uri"),
        F.when(F.col("type").isNotNull(), F.struct(*nested)).alias("capture"),
        "request",
        F.coalesce("metadata", F.expr("array()")).alias("metadata"),
    )
