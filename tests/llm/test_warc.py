import gzip
import hashlib
import io

import pytest
from pyspark.sql import functions as F

from opsmetrics.llm.warc import chunk_rows, read_archives, read_records, records, write_archives

SCHEMA = "page_id long, url string, html string"


def round_trip(spark, rows, chunk=16, **options):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS id", "2 AS digest", "3 AS size", "4 AS refers_to")
    manifest = write_archives(chunk_rows(records(df), chunk), **options)
    return read_archives(manifest, chunk).orderBy("record_id", "chunk").collect(), manifest


def test_round_trip(spark):
    same, long = "é" * 60, "<p>\r\n\r\n</p>WARC/1.1\r\n" * 4000
    rows = [(5, "http://a/ b\r\nX: y", same), (3, None, same), (9, "u", same), (1, "u", "short"), (2, "u", "short"), (4, "u", None), (7, "u", long)]
    got, manifest = round_trip(spark, rows, chunk=1000)
    payloads = {}
    for r in got:
        payloads[r.record_id] = payloads.get(r.record_id, b"") + bytes(r.data)
        if r.record_type == "response":
            assert len(r.data) <= 1000 and r.digest == hashlib.sha256(payloads[r.record_id]).hexdigest()
    ends = {r.record_id: r for r in got if r.is_last}
    assert {i: (r.record_type, r.refers_to) for i, r in ends.items()} == {
        5: ("revisit", 3), 9: ("revisit", 3), 3: ("response", None), 1: ("response", None), 2: ("response", None),
        4: ("response", None), 7: ("response", None)}
    for i, _, html in rows:
        want = (html or "").encode()
        assert ends[i].digest == hashlib.sha256(want).hexdigest()
        assert ends[i].offset + len(ends[i].data) == len(want)
        assert payloads[i] == (b"" if ends[i].record_type == "revisit" else want)
    assert ends[5].uri == "http://a/%20b%0D%0AX:%20y" and ends[3].uri is None
    assert manifest.agg(F.sum("records")).first()[0] == 7


def test_null_and_repeated_ids(spark):
    page = "x" * 200
    got, _ = round_trip(spark, [(None, "u", page), (1, "u", page), (1, "u", page), (2, "u", page)], chunk=1000)
    assert sorted((r.record_id or 0, r.record_type, r.refers_to) for r in got) == [
        (0, "response", None), (1, "response", None), (1, "response", None), (2, "revisit", 1)]


def test_archives_roll_over_and_are_plain_gzip(spark):
    rows = [(i, "u", "x" * 5000 + str(i)) for i in range(20)]
    got, manifest = round_trip(spark, rows, chunk=1 << 16, archive_bytes=1)
    paths = [r.path for r in manifest.collect()]
    assert len(paths) == 20 and len(got) == 20
    with gzip.open(paths[0]) as f:
        assert f.read(8) == b"WARC/1.1"


def test_empty(spark):
    assert round_trip(spark, [])[0] == []


def test_damage_is_found():
    head = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:record:1>\r\nWARC-Payload-Digest: sha256:%s\r\nContent-Length: 7\r\n\r\nX: y\r\n\r\n" \
        % hashlib.sha256(b"").hexdigest().encode()
    good = head.replace(b"Content-Length: 7", b"Content-Length: 8") + b"\r\n\r\n"
    assert len(list(read_records(io.BytesIO(good)))) == 1
    for bad in (good[:-2], good.replace(b"sha256:e", b"sha256:f"), b"x\r\n" + good):
        with pytest.raises(ValueError):
            list(read_records(io.BytesIO(bad)))
