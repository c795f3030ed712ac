import gzip
import hashlib
import re
import tracemalloc
import zlib
from pathlib import Path

import pytest
from support import assert_same

from mosaicflow.llm import warc
from mosaicflow.llm.queries import OP3_SQL, op3_warc_chunks

PAGES = "page_id long, url string, html string, payload string, shard int"


def pages(frame, *rows):
    return frame([(i, u, h, "x", 1) for i, u, h in rows], PAGES)


def test_same_as_sql(spark, sf_dir, duck):
    assert_same(op3_warc_chunks(spark, sf_dir), duck, OP3_SQL)


def test_round_trip_with_odd_rows(frame, tmp_path):
    big, text = "é" * 400_000, "y" * 100
    rows = [(1, "http://a/\r\nX: y", big), (2, None, big), (5, "u", text), (3, "u", text), (3, "u", text), (None, "n", text), (7, "u", "short"), (8, "u", "short"), (9, "u", None), (10, "u", "")]
    manifest = warc.write_archives(warc.plan_records(pages(frame, *rows)), str(tmp_path / "warc"))
    chunks = warc.read_chunks(manifest, chunk_bytes=65_536).collect()
    records = {}
    for c in sorted(chunks, key=lambda c: (c.record_id, c.chunk_no)):
        records.setdefault(c.record_id, []).append(c)
    assert len(records) == len(rows)
    for own in records.values():
        assert [c.chunk_no for c in own] == list(range(len(own))) and [c.is_last for c in own] == [False] * (len(own) - 1) + [True]
        payload = b"".join(c.payload for c in own)
        assert all(len(c.payload) <= 65_536 for c in own)
        if own[0].record_type == "response":
            assert len(payload) == own[0].payload_length
            for k, c in enumerate(own):
                assert c.digest_so_far == hashlib.sha256(payload[: c.chunk_offset + c.chunk_bytes]).hexdigest(), k
        else:
            assert payload == b"" and len(own) == 1
    got = sorted(((c.page_id, c.record_type, c.refers_to, c.payload_length) for c in chunks if c.is_last), key=str)
    assert got == sorted([(1, "response", None, 800_000), (2, "revisit", 1, 800_000), (3, "response", None, 100), (3, "response", None, 100), (5, "revisit", 3, 100), (None, "revisit", 3, 100), (7, "response", None, 5), (8, "response", None, 5), (9, "response", None, 0), (10, "response", None, 0)], key=str)


def test_archives_are_plain_warc(frame, tmp_path):
    warc.write_archives(warc.plan_records(pages(frame, (1, "http://a", "z" * 200))), str(tmp_path / "warc"))
    (path,) = Path(tmp_path / "warc").glob("*.warc.gz")
    text = gzip.decompress(path.read_bytes()).decode()
    head, http, rest = text.split("\r\n\r\n", 2)
    assert head.startswith("WARC/1.1\r\nWARC-Type: response") and f"Content-Length: {len(http) + 4 + 200}" in head
    assert rest == "z" * 200 + "\r\n\r\n"


def lines(head):
    first, *rest = head.split("\r\n")
    assert first == "WARC/1.1"
    return dict(x.split(": ", 1) for x in rest)


def test_headers_of_each_kind(frame, tmp_path):
    """What WARC/1.1 asks of responses and revisits."""
    uri, text = str(tmp_path / "warc"), "z" * 200
    rows = [(4, "http://a/ b\r\nX: y", text), (5, None, text), (6, "http://c", "short"), (4, "http://a/ b\r\nX: y", text)]
    warc.write_archives(warc.plan_records(pages(frame, *rows)), uri)
    found = []
    for path in Path(uri).glob("*.warc.gz"):
        data = path.read_bytes()
        while data:  # one member a record
            z = zlib.decompressobj(31)
            head, rest = z.decompress(data).decode().split("\r\n\r\n", 1)
            data = z.unused_data
            found.append(h := lines(head))
            assert rest.endswith("\r\n\r\n") and int(h["Content-Length"]) == len(rest) - 4
    assert len({h["WARC-Record-ID"] for h in found}) == 4
    for h in found:
        assert re.fullmatch(r"<urn:uuid:[0-9a-f-]{36}>", h["WARC-Record-ID"]) and re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", h["WARC-Date"])
        assert re.fullmatch(r"[^\s<>]+:[^\s<>]+", h["WARC-Target-URI"]) and h["Content-Type"] == "application/http;msgtype=response"
    (revisit,) = [h for h in found if h["WARC-Type"] == "revisit"]
    originals = [h for h in found if h["WARC-Record-ID"] == revisit["WARC-Refers-To"]]
    assert len(originals) == 1 and originals[0]["X-Page-Id"] == "4" and originals[0]["WARC-Payload-Digest"] == revisit["WARC-Payload-Digest"]
    assert revisit["WARC-Refers-To-Target-URI"] == "http://a/%20b%0D%0AX:%20y" == originals[0]["WARC-Target-URI"] and revisit["WARC-Refers-To-Date"] == originals[0]["WARC-Date"]
    assert revisit["WARC-Profile"].endswith("/revisit/identical-payload-digest")


def test_archives_of_others(spark, tmp_path):
    def record(kind, block, *more):
        return gzip.compress("\r\n".join(["WARC/1.0", f"WARC-Type: {kind}", *more, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n")

    http = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\nhello"
    data = record("warcinfo", b"software: x\r\n", "Content-Type: application/warc-fields") + record("response", http, "WARC-Record-ID: <urn:x>", "WARC-Target-URI: http://a", "WARC-Payload-Digest: sha1:ABC", "Content-Type: application/http; msgtype=response")
    data += record("metadata", b"") + record("request", b"GET / HTTP/1.1\r\nHost: a\r\n\r\n", "Content-Type: application/http; msgtype=request")
    (tmp_path / "a.warc.gz").write_bytes(data)
    rows = warc.read_chunks(warc.archives(spark, str(tmp_path))).collect()
    assert [(r.record_type, bytes(r.payload), r.payload_length) for r in rows] == [("warcinfo", b"software: x\r\n", 13), ("response", b"hello", 5), ("metadata", b"", 0), ("request", b"", 0)]
    assert (rows[1].record_id, rows[1].target_uri, rows[1].page_id) == ("urn:x", "http://a", None) and rows[1].digest_so_far == hashlib.sha256(b"hello").hexdigest()
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(b"x" * (3 << 20)))
    with pytest.raises(ValueError, match="end"):
        list(warc.chunks_of(str(tmp_path), str(tmp_path / "b.warc.gz"), 0, 1 << 30))


def test_memory_does_not_grow_with_a_payload(tmp_path):
    """200 MB written and read again: beyond the payload itself, a few MB are held."""
    payload, path = bytes(range(256)) * (200 << 12), tmp_path / "a.warc.gz"
    digest = hashlib.sha256(payload).hexdigest()
    tracemalloc.start()
    with path.open("wb") as out:
        warc.write_member(out, warc.record_header(1, "http://a", len(payload), digest, "response", None, None, False, "a", "2020-01-01T00:00:00Z"), payload)
    n = last = 0
    for row in warc.chunks_of(str(tmp_path), str(path), 0, path.stat().st_size):
        n, last = n + row[9], row[10]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == len(payload) and last == digest and peak < 8 << 20


def test_empty_table(frame):
    planned = warc.plan_records(pages(frame, (1, "u", "h")).limit(0))
    assert warc.read_chunks(warc.write_archives(planned)).count() == 0


def test_damage_is_noticed(frame, tmp_path):
    manifest = warc.write_archives(warc.plan_records(pages(frame, (1, "u", "".join(map(str, range(50_000)))))), str(tmp_path / "warc"))
    (path,) = Path(tmp_path / "warc").glob("*.warc.gz")
    data = path.read_bytes()
    path.write_bytes(data[: len(data) // 2])
    with pytest.raises(Exception, match="cut|digest"):
        warc.read_chunks(manifest).collect()
