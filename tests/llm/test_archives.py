"""ARC and WARC records, and the pages that go through both."""

import base64
import gzip
import hashlib

import pytest

from tidings.llm import arc

V1 = (
    b"filedesc://one.arc 0.0.0.0 20240102030405 text/plain 77\n1 0 someone\n"
    b"URL IP-address Archive-date Content-type Archive-length\n"
)
V2 = (
    b"filedesc://two.arc 0.0.0.0 20240102030405 text/plain 200 - - 0 two.arc 122\n2 0 someone\n"
    b"URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename"
    b" Archive-length\n"
)


def exact(head: bytes) -> bytes:
    """The version block with the length it has."""
    line, body = head.split(b"\n", 1)
    return line.rsplit(b" ", 1)[0] + b" %d\n" % len(body) + body + b"\n"


def test_versions():
    one = exact(V1) + b"http://a/ 1.2.3.4 20240102030405 text/html 5\nab\ncd\n"
    two = exact(V2) + b"http://b/ 1.2.3.4 2024 text/html 404 - - 9 two.arc 0\n\n"
    found = list(arc.parse_arc(one + two))
    assert [r["version"] for r in found] == [1, 1, 2, 2]
    assert found[1]["body"] == b"ab\ncd" and found[3]["Result-code"] == "404"
    made = arc._equivalent(found[3])
    assert made["date"].startswith("2024-00") or made["date"].endswith("Z")
    for bad in (one[:-3], one + b"http://c/ 1.2.3.4 2024 text/html 404 - - 9 x 0\n", b"x 1\n."):
        with pytest.raises(ValueError):
            list(arc.parse_arc(bad))
    assert arc.unpack(gzip.compress(b"ab") + gzip.compress(b"c")) == b"abc" and arc.unpack(b"zz") == b"zz"


def test_records_without_http():
    record = next(r for r in arc.parse_arc(exact(V1) + b"dns:x 1.2.3.4 20240102030405 text/dns 3\nabc\n") if r["URL"] == "dns:x")
    made = arc._equivalent(record)
    assert made["date"] == "2024-01-02T03:04:05Z" and made["payload_bytes"] == 3 and made["page_id"] is None


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


@pytest.mark.parametrize("least", [0, 4])
def test_pages(spark, least):
    big = "é<p>\r\n\r\nWARC/1.1\r\n" * 3000
    rows = [
        (4, "http://a/?q=1 2\n", "same"), (2, "http://b/", "same"), (9, None, "same"), (3, "", None),
        (5, "http://c/", ""), (6, "http://d/", big), (7, "http://d/", big), (8, "http://e/", "abc"),
        (10, "http://e/", "abc"), (11, "filedesc:x", "HTTP/1.1 200 OK\r\n\r\nx"), (2, "http://b/", "same"),
        (-12, "http://f/", "\n\n\r\n"),
    ]
    pages = spark.createDataFrame(rows, "page_id LONG, url STRING, html STRING")
    pages = pages.where("url IS NULL OR url NOT LIKE 'filedesc%'").selectExpr("*", "'z' AS record_type")
    found = arc.archive_pages(pages, least).collect()
    kept = [r for r in rows if not (r[1] or "").startswith("filedesc")]
    first = {}
    for i, _, html in kept:
        first[html or ""] = min(first.get(html or "", i), i)
    expected = []
    for i, _, html in kept:
        size = len((html or "").encode())
        again = size >= least and first[html or ""] != i
        expected.append((i, size, digest(html), "revisit" if again else "response", first[html or ""] if again else None))
    key = lambda r: tuple(map(str, r))
    got = [tuple(r[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) for r in found]
    assert sorted(got, key=key) == sorted(expected, key=key)


def test_pages_without_an_id(spark):
    rows = [(None, "http://a/", "same"), (4, "http://b/", "same"), (None, "http://c/", "two"),
            (None, "http://d/", "two"), (None, None, None)]
    found = arc.archive_pages(spark.createDataFrame(rows, "page_id LONG, url STRING, html STRING"))
    got = sorted((r["payload_digest"], r["page_id"] or 0, r["record_type"], r["refers_to"] or 0) for r in found.collect())
    want = [(digest("same"), 0, "revisit", 4), (digest("same"), 4, "response", 0), (digest(None), 0, "response", 0)]
    assert got == sorted(want + [(digest("two"), 0, "response", 0)] * 2)


def test_no_pages(spark):
    assert arc.archive_pages(spark.createDataFrame([], "page_id LONG, url STRING, html STRING")).count() == 0
