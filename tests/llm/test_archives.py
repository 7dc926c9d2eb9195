import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from autoprofile.llm import archives
from autoprofile.llm.archives import (
    ARC_FIELDS, ArchiveRules, arc_records, archive_pages, read_arc, read_warc, record_id,
    share_payloads, split_http, to_warc, warc_records, write_arc, write_warc,
)

SCHEMA = "page_id long, url string, html string"
LONG = "<html>" + "same page " * 20
PAGES = [
    (4, "http://a.example/x y", LONG), (2, "http://b.example/%20", LONG), (9, None, LONG),
    (5, "", None), (6, "http://c.example/é", ""), (7, "u", "x" * 99), (8, "u", "x" * 99),
    (10, "u", "x" * 100), (11, "u", "x" * 100), (None, "u", LONG), (None, "u", "é" * 50),
    (12, "u", "é" * 50), (13, "u", "WARC/1.1\r\nContent-Length: 5\r\n\r\nHTTP/1.1 x\r\n\r\n" * 9),
    (14, "u", "\r\n\r\n\n" + "y" * 300_000), (15, "new\nline", "line\r\n" * 40), (16, "-", "z"),
    (17, "u", "a" * 100), (17, "u", "a" * 100), (-3, "u", "b" * 200), (-4, "u", "b" * 200),
    (2**62, "u", "c" * 100),
]


def expected(pages):
    rows, first = [], {}
    order = sorted(pages, key=lambda p: (p[0] is None, p[0] or 0))
    for key, _, html in order:
        payload = (html or "").encode()
        again = len(payload) >= 100 and payload in first
        rows.append((
            key, len(payload), hashlib.sha256(payload).hexdigest(),
            "revisit" if again else "response", first[payload] if again else None,
        ))
        first.setdefault(payload, key)
    return sorted(rows, key=str)


def found(df, **rules):
    out = archive_pages(df, ArchiveRules(**rules))
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return sorted(map(tuple, out.select(*names).collect()), key=str)


def test_against_brute_force(spark):
    df = spark.createDataFrame(PAGES, SCHEMA).withColumns({"block": F.lit(1), "key": F.lit("k")})
    assert found(df) == expected(PAGES)
    assert found(df.repartition(5)) == expected(PAGES)


def test_many_files(spark, monkeypatch):
    """Files of a few records, version 1 and 2, batches of a few rows, repeats by shuffle."""
    monkeypatch.setattr(archives, "BATCH_BYTES", 1000)
    monkeypatch.setattr(archives, "BROADCAST_DIGESTS", 0)
    pages = [(i, f"http://x/{i}", f"{i % 40} " * 60) for i in range(200)] + PAGES
    df = spark.createDataFrame(pages, SCHEMA).repartition(3)
    assert found(df, volume_bytes=2000) == expected(pages)


def test_empty_table(spark):
    assert archive_pages(spark.createDataFrame([], SCHEMA)).collect() == []


def test_arc_round_trip(spark, tmp_path):
    folder = str(tmp_path / "arc")
    rules = ArchiveRules(volume_bytes=1500)
    write_arc(spark.createDataFrame(PAGES, SCHEMA).repartition(2), folder, rules)
    rows = read_arc(spark, folder).collect()
    assert {r["version"] for r in rows} == {1, 2}
    assert {r["url"] for r in rows} == {
        "http://a.example/x%20y", "http://b.example/%20", "-", "http://c.example/%C3%A9", "u",
        "new%0Aline",
    }
    payloads = sorted(split_http(bytes(r["block"]))[1] for r in rows)
    assert payloads == sorted((p[2] or "").encode() for p in PAGES)


def arc(version, *records, fields=None):
    body = f"{version} 0 Origin\n{fields or ARC_FIELDS[version]}\n".encode()
    head = f"filedesc://x.arc 0.0.0.0 19960923142103 text/plain {len(body)}\n".encode()
    return head + body + b"\n" + b"\n".join(records)


def parse(data):
    return list(arc_records("x", iter([data[i : i + 7] for i in range(0, len(data), 7)])))


def test_fields_by_version():
    one = b"http://a/ 1.2.3.4 19960923142103 text/html 5\nab\ncd"
    two = b"http://a/b c 1.2.3.4 19961104142103 text/html 200 abc - 0 x.arc 3\nxyz"
    assert parse(arc(1, one, one)) [1][2:] == (
        1, "http://a/", "1.2.3.4", "19960923142103", "text/html", b"ab\ncd"
    )
    assert parse(arc(2, two, two))[0][2:] == (
        2, "http://a/b c", "1.2.3.4", "19961104142103", "text/html", b"xyz"
    )
    own = "URL IP-address Archive-date Content-type Extra Archive-length"
    odd = b"http://a/ 1.2.3.4 19961104142103 text/html 77 2\nhi\n"
    assert parse(arc(2, odd, fields=own))[0][-1] == b"hi"
    # files put one after the other
    assert len(parse(arc(1, one) + b"\n" + arc(2, two))) == 2


def test_broken_archives_are_named():
    with pytest.raises(ValueError, match="x has no record at byte"):
        parse(arc(1, b"http://a/ 1.2.3.4 19960923142103 text/html many\nabc"))
    with pytest.raises(ValueError, match="ends inside"):
        parse(arc(1, b"http://a/ 1.2.3.4 19960923142103 text/html 50\nabc"))


def test_gzip_members():
    record = b"http://a/ 1.2.3.4 19960923142103 text/html 5\nab\ncd\n"
    data = b"".join(gzip.compress(x) for x in (arc(1), record, record))
    assert len(list(arc_records("x", archives._unpacked(data)))) == 2
    with pytest.raises(ValueError, match="inside a gzip member"):
        list(arc_records("x", archives._unpacked(data[:-20])))


def test_equivalent_records(spark):
    """What is no response of a server is a resource, and never a revisit."""
    page = b"HTTP/1.0 200 OK\nX-Page-Id: 3\n\n" + b"p" * 200
    rows = [
        ("f", 0, 1, "dns:a", "1.2.3.4", "19960923142103", "text/dns", b"d" * 200),
        ("f", 9, 1, "dns:a", "1.2.3.4", "199609231421", "text/dns", b"d" * 200),
        ("f", 300, 1, "http://a/", "-", "bad", "text/html", page),
        ("f", 700, 1, "http://b/", "-", "20010203040506", "text/html", page.replace(b"3", b"9")),
        ("f", 900, 1, "http://c/", "-", "20010203040506", "text/html", b"HTTP/1.0 200 OK"),
    ]
    records = to_warc(spark.createDataFrame(rows, archives.ARC_COLUMNS))
    out = {r["record_id"]: r for r in share_payloads(records).collect()}
    dns, again, first, later, bare = (out[record_id("f", r[1])] for r in rows)
    assert [r["type"] for r in (dns, again, first, later, bare)] == [
        "resource", "resource", "response", "revisit", "response"
    ]
    assert (dns["date"], again["date"]) == ("1996-09-23T14:21:03Z", "1996-09-23T14:21:00Z")
    assert first["key"] == 3 and bytes(first["block"]) == page
    assert later["refers_to"] == first["record_id"]
    assert later["refers_to_url"] == "http://a/"
    assert later["payload_digest"] == hashlib.sha256(b"p" * 200).hexdigest()
    assert bytes(later["block"]) == b"HTTP/1.0 200 OK\nX-Page-Id: 9\n\n"
    assert bare["payload_bytes"] == 0 and bare["key"] is None


def test_bytes_survive(spark, tmp_path):
    """Payloads of any bytes come back, and changed ones are noticed."""
    block = b"HTTP/1.1 200 OK\r\n\r\n" + bytes(range(256)) * 4
    row = ("f", 0, 1, "http://a/", "1.2.3.4", "20010203040506", "image/gif", block)
    folder = str(tmp_path / "warc")
    one = spark.createDataFrame([row], archives.ARC_COLUMNS).coalesce(1)
    write_warc(to_warc(one), folder)
    (read,) = read_warc(spark, folder).collect()
    assert bytes(read["block"]) == block
    (file,) = (tmp_path / "warc").glob("part-*")
    data = gzip.decompress(file.read_bytes())
    assert data.endswith(b"\r\n\r\n")
    assert [r["type"] for r in warc_records("x", iter([data]))] == ["warcinfo", "response"]
    with pytest.raises(ValueError, match="was changed"):
        list(warc_records("x", iter([data.replace(bytes(range(256)), bytes(256))])))
