"""Archives round trip; every payload is held against its digest."""

import gzip
import hashlib
import zlib

import pytest

from rfmlens.llm import warc as W


def digest(b):
    return hashlib.sha256(b).hexdigest()


def rows_of():
    big = "b" * 150
    return [(3, "http://a/", big), (1, "http://a/1", big), (2, None, big), (1, "http://a/1", big), (5, "u\r\nX: y", "short"),
            (6, "u", "short"), (7, "u", None), (8, "u", ""), (None, "u", big), (9, "u", "é" * 60), (10, "u", "x" * 99), (11, "u", "x" * 99)]


def test_round_trip(spark, tmp_path):
    rows = rows_of()
    pages = spark.createDataFrame([(*r, "junk") for r in rows], "page_id long, url string, html string, digest string")
    W.write_archives(pages, str(tmp_path / "w"), shard_bytes=400)
    back = W.read_archives(spark, str(tmp_path / "w"))
    got = sorted((tuple(r) for r in W.page_records(back).collect()), key=str)
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        revisit = h == "b" * 150 and i != 1
        want.append((i, len(b), digest(b), "revisit" if revisit else "response", 1 if revisit else None))
    assert got == sorted(want, key=str)
    by = {r.record_id: r for r in back.collect()}
    assert bytes(by["urn:page:9"].payload) == ("é" * 60).encode() and by["urn:page:2"].target_uri is None
    assert by["urn:page:5"].target_uri == "u%0D%0AX: y"
    for f in (tmp_path / "w").glob("part-*"):  # each file is plain gzip for any other reader
        data = gzip.decompress(f.read_bytes())
        assert data.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo") or not data


def test_empty_table(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    W.write_archives(pages, str(tmp_path / "w"))
    assert W.read_archives(spark, str(tmp_path / "w")).count() == 0


def test_big_member_ends_with_an_empty_one():
    m = W._member(b"x" * (17 << 20), 1)
    end = W._shard_end(m, 1)
    assert m[-1] != 0 and [len(x) for x in W.members(end + b"\x00")] == [17 << 20, 0]


def test_framing_and_digests():
    payload = b"p" * 50
    good = W.record(4, "u", payload, digest(payload), None)
    pack = lambda b: W._member(b, 6)
    (r,) = W.read_records(pack(good))
    assert r["digest_ok"] and r["payload"] == payload and r["record_id"] == "urn:page:4"
    (r,) = W.read_records(pack(good.replace(b"ppp", b"ppq")))
    assert not r["digest_ok"]
    with pytest.raises(ValueError):
        list(W.read_records(pack(good[:-6])))
    with pytest.raises(ValueError):
        list(W.read_records(pack(good)[:-9]))
    with pytest.raises(zlib.error):
        list(W.read_records(b"garbage"))
    assert [len(x) for x in W.members(pack(good) + pack(b""), piece=3)] == [len(good), 0]


def test_query_against_sql(spark):
    from tools.compare_oracle import compare
    assert compare(spark, "/root/testdata/sf0.001", ["op1_warc"]) == {"op1_warc": "ok"}
