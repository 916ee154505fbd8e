import hashlib

import pyarrow as pa
from pyspark.sql import functions as F

from framelens.llm import warc


def archive(n=6, plain=False):
    parts = []
    for i in range(n):
        payload = f"<html>page {i} ".encode() * 40
        r = warc.record("response", i, f"http://a.example/{i}\r\nX: y é", payload, hashlib.sha256(payload).hexdigest(), None)
        parts.append(r if plain else warc.member(r))
    return parts


def read(data: bytes, step=64):
    return list(warc.salvage(warc.Window(pa.BufferReader(data), len(data), step)))


def ids(found):
    return [f.headers["warc-record-id"] for f in found if f.headers is not None]


def gaps(found):
    return [(f.start, f.end) for f in found if f.headers is None]


def test_whole_files():
    for plain in (False, True):
        found = read(b"".join(archive(plain=plain)))
        assert ids(found) == [f"<urn:page:{i}>" for i in range(6)] and gaps(found) == []
        assert "\n" not in found[0].headers["warc-target-uri"]


def test_damage_is_quarantined_and_later_records_recovered():
    for plain in (False, True):
        parts = archive(plain=plain)
        edges = [sum(map(len, parts[:i])) for i in range(7)]
        flipped = bytearray(b"".join(parts))
        flipped[edges[2] + len(parts[2]) // 2] ^= 0xFF
        found = read(bytes(flipped))
        assert ids(found) == [f"<urn:page:{i}>" for i in (0, 1, 3, 4, 5)] and gaps(found) == [(edges[2], edges[3])]
        cut = parts[0] + parts[1][: len(parts[1]) // 2] + parts[2] + b"junk \x1f\x8b\x08 WARC/1.1\r\n more" + parts[3] + parts[4][:-9]
        found = read(cut)
        assert ids(found) == [f"<urn:page:{i}>" for i in (0, 2, 3)]
        assert [z - a for a, z in gaps(found)] == [len(parts[1]) // 2, len(b"junk \x1f\x8b\x08 WARC/1.1\r\n more"), len(parts[4]) - 9]


def test_empty_and_pure_junk():
    assert read(b"") == []
    assert gaps(read(b"\x00" * 200_000)) == [(0, 200_000)]


def test_round_trip_of_awkward_pages(spark):
    same = "x" * 150
    rows = [(3, "u", same), (1, "v", same), (7, None, same), (None, "w", same), (4, "z", "short"), (5, "z", "short"), (6, "e", None), (8, "e", ""), (1, "v", same), (9, "é ", "é" * 60)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string").withColumn("payload", F.encode("html", "UTF-8"))
    got = warc.round_trip(pages).collect()
    kinds = sorted((r.record_id, r.record_type, r.refers_to or "", r.payload_bytes) for r in got)
    first = "<urn:page:1>"
    assert kinds == sorted([("<urn:page:3>", "revisit", first, 150), (first, "response", "", 150), ("<urn:page:7>", "revisit", first, 150), ("<urn:page:>", "revisit", first, 150),
                            ("<urn:page:4>", "response", "", 5), ("<urn:page:5>", "response", "", 5), ("<urn:page:6>", "response", "", 0), ("<urn:page:8>", "response", "", 0),
                            (first, "response", "", 150), ("<urn:page:9>", "response", "", 120)])
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_headers_of_any_length(spark):
    url = "http://a.example/" + "é漢" * 40_000  # 600 KB in percent signs
    for plain in (False, True):
        payload = b"<html>long url</html>"
        long = warc.record("response", 99, url, payload, hashlib.sha256(payload).hexdigest(), None)
        files = archive(plain=plain)
        found = read(b"".join([*files[:3], long if plain else warc.member(long), *files[3:]]))
        assert ids(found) == [f"<urn:page:{i}>" for i in (0, 1, 2, 99, 3, 4, 5)] and gaps(found) == []
    pages = spark.createDataFrame([(1, url, "x"), (2, "http://a.example/" + "x" * 200_000, "y" * 150), (3, "u", "y" * 150)], "page_id long, url string, html string")
    got = warc.round_trip(pages.withColumn("payload", F.encode("html", "UTF-8"))).collect()
    assert sorted(r.record_id or r.gap for r in got) == [f"<urn:page:{i}>" for i in (1, 2, 3)]


def test_long_plain_junk_is_one_gap():
    parts = archive(plain=True)
    junk = b"WARC/1.1\r\nname: " + b"x" * 300_000 + b"\r\n"
    found = read(parts[0] + junk + parts[1] + junk)
    assert ids(found) == ["<urn:page:0>", "<urn:page:1>"] and [z - a for a, z in gaps(found)] == [len(junk)] * 2


def test_every_record_written_must_come_back(spark, monkeypatch):
    import pytest

    pages = spark.createDataFrame([(i, f"http://a/{i}", f"page {i} ".encode() * 30) for i in range(20)], "page_id long, url string, payload binary")
    assert warc.round_trip(pages).count() == 20
    whole = warc.write_archives

    def lossy(*args):
        files = whole(*args)
        return files.withColumn("records", files.records + 1)  # as if a record had been lost

    monkeypatch.setattr(warc, "write_archives", lossy)
    with pytest.raises(RuntimeError, match="were written"):
        warc.round_trip(pages)
