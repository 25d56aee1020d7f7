import io
import struct

import compare
import pytest
import zstandard

from tidemark.llm import queries, warc
from tidemark.llm.common import scratch
from tidemark.llm.files import stored_file
from tidemark.llm.common import shared_dir  # noqa: F401


def test_query_matches_sql(spark):
    assert compare.check(spark, queries.op7_warc, queries.OP7_SQL) > 1


def archive(records, dictionary=b"", pack=False):
    held = zstandard.ZstdCompressor().compress(dictionary) if pack else dictionary
    c = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, write_checksum=True)
    return struct.pack("<II", warc.SKIPPABLE, len(held)) + held + b"".join(map(c.compress, records))


FIELDS = [("WARC-Type", "response"), ("WARC-Record-ID", "<urn:x>"), ("WARC-Date", "2024-01-01T00:00:00Z")]


def test_frames_and_dictionaries():
    records = [warc.record(FIELDS, bytes([65 + i]) * n) for i, n in enumerate((0, 1, 5000, 1 << 20))]
    for kind in ({}, {"dictionary": b"WARC/1.1 Content-Length: some words " * 20}, {"dictionary": b"WARC-Type: response " * 60, "pack": True}):
        found, out = warc.frames(io.BytesIO(archive(records, **kind)))
        assert found == kind.get("dictionary", b"") and list(out) == records
    assert list(warc.frames(io.BytesIO(archive([])))[1]) == []


def test_broken_archives_are_refused():
    good = archive([warc.record(FIELDS, b"abc" * 999)])
    for bad in (b"", good[:4], good[:-3], b"\0" + good[1:], good[:-6] + b"zzzzzz", good + b"junk", warc.FRAME + b"abc"):
        with pytest.raises(warc.BrokenArchive):
            list(warc.frames(io.BytesIO(bad))[1])


def test_broken_records_are_refused():
    good = warc.record(FIELDS, b"body\r\n\r\nbody")
    assert warc.parse(good)[1] == b"body\r\n\r\nbody"
    for bad in (good[:-1], good + b"x", good.replace(b"WARC/1.1", b"WARC/9"), good.replace(b"Content-Length: 12", b"Content-Length: 11"), good.replace(b"WARC-Date", b"WARC-Dat"), good.replace(b"WARC-Date: 2024", b"2024")):
        with pytest.raises(warc.BrokenArchive):
            warc.parse(bad)


def test_odd_rows(spark):
    long = "<p>" + "é" * 300_000
    rows = [(1, "u", "x" * 1000, 1), (2, None, "x" * 1000, 1), (3, "u\r\nWARC-Type: no", None, 2), (4, "u", "", 3), (5, "u", "x" * 999, 4), (6, "u", "x" * 999, 4), (7, "u", long, 5), (8, "u", long, 5), (8, "u", long, 5), (None, "u", "x" * 1000, 6)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, digest int").selectExpr("*", "1 AS id", "2 AS payload", "3 AS size", "4 AS other", "5 AS keep").repartition(3)
    folder = scratch(spark, "archives")
    warc.write_archives(pages, folder)
    got = warc.read_archives(spark, folder, payloads=True).collect()
    kinds = sorted((r["page_id"] or 0, r["record_type"], r["refers_to"], r["payload_bytes"]) for r in got)
    size = len(long.encode())
    assert kinds == [(0, "revisit", 2, 1000), (1, "revisit", 2, 1000), (2, "response", None, 1000), (3, "response", None, 0), (4, "response", None, 0), (5, "response", None, 999), (6, "response", None, 999), (7, "revisit", 8, size), (8, "response", None, size), (8, "response", None, size)]
    assert {bytes(r["payload"]) for r in got if r["record_type"] == "response"} == {b"", b"x" * 999, b"x" * 1000, long.encode()}
    assert {r["url"] for r in got if r["page_id"] == 3} == {"u%0D%0AWARC-Type: no"}
    empty = scratch(spark, "archives")
    warc.write_archives(pages.where("false"), empty)
    assert warc.read_archives(spark, empty).count() == 0


def test_archives_can_be_read_by_others(spark):
    folder = scratch(spark, "archives")
    warc.write_archives(spark.read.parquet(f"{compare.SF}/pages.parquet"), folder)
    name = warc.listed(spark, folder, ".warc.zst")[0]
    with stored_file(name) as f:
        data = f.read()
    n = struct.unpack("<I", data[4:8])[0]
    d = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + n]))
    with d.stream_reader(io.BytesIO(data[8 + n :]), read_across_frames=True) as r:
        assert r.read().count(b"WARC/1.1\r\n") == spark.read.parquet(f"{compare.SF}/pages.parquet").count()


def test_archives_of_another_writer_are_read(spark, tmp_path):
    """No dictionary, warcinfo and request records, WARC/1.0, names in any case without a space, HTTP messages, base-32 digests."""
    import base64
    import hashlib

    body = b"<html>some page</html>"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + body
    digest = "sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode()
    own = lambda kind, *more: [("WARC-Type", kind), *FIELDS[1:], *more]
    records = [
        warc.record(own("warcinfo", ("Content-Type", "application/warc-fields")), b"software: other\r\n"),
        warc.record(own("request"), b"GET / HTTP/1.1\r\n\r\n"),
        warc.record(own("response", ("WARC-Target-URI", "http://a/"), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", digest)), http).replace(b"WARC/1.1", b"WARC/1.0", 1).replace(b"WARC-Type: ", b"warc-type:", 1),
        warc.record(own("revisit", ("WARC-Target-URI", "http://b/"), ("Content-Type", "application/http"), ("WARC-Payload-Digest", digest)), b"HTTP/1.1 200 OK\r\n\r\n"),
        warc.record(own("metadata"), b""),
    ]
    c = zstandard.ZstdCompressor()
    (tmp_path / "other.warc.zst").write_bytes(b"".join(map(c.compress, records)))
    rows = sorted(warc.read_archives(spark, f"file://{tmp_path}", payloads=True).collect(), key=lambda r: r["url"])
    found = hashlib.sha1(body).hexdigest()
    assert [tuple(r) for r in rows] == [(None, "http://a/", "response", None, found, len(body), body), (None, "http://b/", "revisit", None, found, -1, None)]
    (tmp_path / "bad.warc.zst").write_bytes(b"".join(map(c.compress, [records[2].replace(b"some page", b"same page")])))
    with pytest.raises(Exception, match="BrokenArchive"):
        warc.read_archives(spark, f"file://{tmp_path}").collect()


def test_archives_of_attempts_that_did_not_count_are_not_read(spark):
    folder, pages = scratch(spark, "archives"), spark.createDataFrame([(i, "u", f"page {i}") for i in range(30)], "page_id bigint, url string, html string")
    warc.write_archives(pages, folder)
    name = warc.archives_of(spark, folder).first()["archive"]
    with stored_file(name) as f, warc.new_file(name.replace(".warc.zst", "9.warc.zst")) as out:
        out.write(f.read())
    assert sorted(r["page_id"] for r in warc.read_archives(spark, folder).collect()) == list(range(30))


def test_large_ids_beside_null_stay_exact(spark):
    same = "x" * 2000
    pages = spark.createDataFrame([(2**53, "u", same), (2**53 + 1, "u", same), (None, "u", "y"), (-(2**63), "u", "z")], "page_id bigint, url string, html string").coalesce(1)
    folder = scratch(spark, "archives")
    warc.write_archives(pages, folder)
    rows = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in warc.read_archives(spark, folder).collect()}
    assert rows == {2**53: ("revisit", 2**53 + 1), 2**53 + 1: ("response", None), None: ("response", None), -(2**63): ("response", None)}


def test_paths_named_twice(spark, tmp_path):
    path, page = str(tmp_path / "pages"), "<p>" + "long page " * 200
    spark.createDataFrame([(i, "u", page if i < 2 else "short") for i in range(3)], "page_id bigint, url string, html string").coalesce(1).write.parquet(path)
    warc.write_archives(spark.read.parquet(path, path), str(tmp_path / "out"))
    rows = warc.read_archives(spark, str(tmp_path / "out")).collect()
    assert sorted((r["page_id"], r["record_type"], r["refers_to"]) for r in rows) == [(0, "revisit", 1)] * 2 + [(1, "response", None)] * 2 + [(2, "response", None)] * 2
