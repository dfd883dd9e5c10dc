"""Archives: round trips, revisits, assembly over identifiers."""

import gzip
import hashlib
import uuid

from ledgerspark.llm import warc
from ledgerspark.llm.base import materialize
from ledgerspark.storage import scratch_path


def round_trip(spark, rows, schema="page_id long, url string, html string"):
    path = scratch_path(spark, "test-warc")
    warc.write_archives(spark.createDataFrame(rows, schema), path)
    return materialize(warc.read_archives(spark, path), "test-warc-records")


def test_round_trip_of_any_payload(spark):
    odd = ["", None, "a\r\n\r\nb", "WARC/1.1\r\nWARC-Type: response\r\n\r\n", "\r\n", "é中\x00\U0001f600", "x" * 3_000_000, "\n" * 50]
    rows = [(i, f"http://h/{i}", p) for i, p in enumerate(odd)]
    captures = {int(r.metadata[0].fields["pageId"]): r for r in warc.assemble(round_trip(spark, rows)).collect()}
    for i, _, payload in rows:
        r = captures[i]
        raw = (payload or "").encode()
        assert bytes(r.capture.payload) == raw and r.uri == f"http://h/{i}"
        assert r.capture.payload_digest == "sha1:" + hashlib.sha1(raw).hexdigest()
        assert r.capture.type == "response" and r.request.http.startswith(f"GET http://h/{i} HTTP/1.1")
        assert r.metadata[0].fields == {"pageId": str(i), "payloadLength": str(len(raw))}


def test_revisits_point_at_the_largest_id(spark):
    same, small = "s" * 1000, "s" * 999
    rows = [(1, "u", same), (9, "u", same), (4, None, same), (2, "u", small), (3, "u", small), (9, "v\r\nX: y", same), (None, "u", same), (None, "u", "other")]
    got = warc.assemble(round_trip(spark, [(*r, "x", 2) for r in rows], "page_id long, url string, html string, size string, row int")).collect()
    kinds = sorted((r.capture.type, r.metadata[0].fields.get("pageId") or "") for r in got if r.metadata[0].fields["payloadLength"] == "1000")
    assert [k for k, _ in kinds].count("response") == 1 and ("response", "9") in kinds
    response = next(r for r in got if r.capture.type == "response" and len(r.capture.payload) == 1000)
    revisits = [r for r in got if r.capture.type == "revisit"]
    assert len(got) == 8 and len(revisits) == 4 and {r.capture.refers_to for r in revisits} == {response.capture_id}
    assert all(r.capture.payload_digest == response.capture.payload_digest and not r.capture.payload for r in revisits)


def test_empty(spark):
    assert warc.assemble(round_trip(spark, [(1, "u", "p")]).limit(0)).collect() == []
    path = scratch_path(spark, "test-warc-empty")
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read_archives(spark, path).collect() == []


def record(kind, ident, block=b"", **headers):
    lines = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: {ident}", f"Content-Length: {len(block)}"]
    lines += [f"{k.replace('_', '-')}: {v}" for k, vs in headers.items() for v in (vs if isinstance(vs, list) else [vs])]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_archives_of_others_and_chains(spark):
    a, b, c, d, e, f = (f"<urn:uuid:{uuid.UUID(int=i)}>" for i in range(6))
    parts = [
        record("warcinfo", f, b"software: x\r\n", Content_Type="application/warc-fields"),
        record("metadata", c, b"k: v\r\n", WARC_Concurrent_To=b, Content_Type="application/warc-fields"),
        record("request", b, b"GET / HTTP/1.0\r\n\r\n", WARC_Concurrent_To=a, Content_Type="application/http;msgtype=request"),
        record("response", a, b"HTTP/1.0 200 OK\r\n\r\n\xff\xfe", Content_Type="application/http;msgtype=response"),
        record("metadata", d, b"o: 1\r\n", WARC_Concurrent_To=["<urn:none>", a], Content_Type="application/warc-fields"),
        record("metadata", e, b"lost", WARC_Concurrent_To="<urn:none>"),
    ]
    for raw in (b"".join(parts), gzip.compress(b"".join(parts)), b"".join(map(gzip.compress, parts))):
        found = list(warc.parse_archive(raw))
        assert [r["type"] for r in found] == ["warcinfo", "metadata", "request", "response", "metadata", "metadata"]
        assert found[3]["payload"] == b"\xff\xfe" and found[3]["http"] == "HTTP/1.0 200 OK"
    rows = [tuple({**r, "fields": r["fields"] and dict(r["fields"])}.values()) for r in found]
    got = {r.capture_id: r for r in warc.assemble(spark.createDataFrame(rows, warc.RECORD)).collect()}
    assert set(got) == {a, "<urn:none>"}
    assert got[a].request.id == b and sorted(m.id for m in got[a].metadata) == [c, d]
    assert got["<urn:none>"].capture is None and [m.id for m in got["<urn:none>"].metadata] == [e]
