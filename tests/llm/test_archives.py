import gzip
import hashlib
import random
from collections import defaultdict

import pytest

from tidemark.llm import archives as A

TEXTS = ["x" * 1000, "é" * 500, "x" * 999, None, "", "WARC/1.1\r\nA: b\r\n\r\nrest\r\n\r\n" * 60, "HTTP/1.0 200\n\nhttp://a b 1 2 3\n" * 50, "\n" * 1200, "日本" * 3000, "y" * 3_000_000]
URLS = [None, "", " ", "http://a/b c", "http://é.x/\n"]


def brute(rows):
    groups, out = defaultdict(list), []
    for page, _, html in rows:
        groups[(html or "").encode()].append(page)
    for data, pages in groups.items():
        known = len(data), hashlib.sha1(data).hexdigest()
        if len(data) < 1000:
            out += [(p, *known, "response", None) for p in pages]
            continue
        best = max(pages, key=lambda p: (p is not None, p or 0))
        out.append((best, *known, "response", None))
        pages.remove(best)
        out += [(p, *known, "revisit", best) for p in pages]
    return sorted(out, key=str)


@pytest.mark.parametrize("limit,winners", [(64 << 20, 100_000), (40_000, 0)])
def test_round_trip(spark, monkeypatch, limit, winners):
    monkeypatch.setattr(A, "SMALL_WINNERS", winners)
    draw = random.Random(5)
    rows = [(draw.choice([None, *range(150)]), draw.choice(URLS), draw.choice(TEXTS + [str(draw.random()) * 80] * 3)) for _ in range(300)]
    frame = spark.createDataFrame([(*r, 1, "k") for r in rows], "page_id long, url string, html string, digest int, key string")
    got = A.archive_pages(frame, archive_bytes=limit)
    assert sorted([tuple(r) for r in got.collect()], key=str) == brute(rows)


def test_empty(spark):
    assert A.archive_pages(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_archives_are_whole(spark, tmp_path):
    frame = spark.createDataFrame([(i, f"http://h/{i}", "p" * (1500 if i % 2 else 10)) for i in range(40)], "page_id long, url string, html string").coalesce(1)
    A.write_arc(frame, f"{tmp_path}/arc", archive_bytes=5000)
    heads = {gzip.decompress(f.read_bytes()).split(b"\n")[1][:1] for f in tmp_path.glob("arc/*/*.gz")}
    assert heads == {b"1", b"2"}
    assert all(len(gzip.decompress(f.read_bytes())) < 5500 for f in tmp_path.glob("arc/*/*.gz"))
    A.convert(spark, f"{tmp_path}/arc", f"{tmp_path}/warc")
    rows = A.read_warc(spark, f"{tmp_path}/warc").collect()
    assert len(rows) == len({r.record_id for r in rows}) == 40
    assert [r.page_id for r in rows if r.record_type == "response" and r.bytes == 1500] == [39]
    assert {r.date for r in rows if r.page_id == 7} == {"2000-01-01T00:00:07Z"}
    for r in rows:
        assert (r.payload is None) == (r.record_type == "revisit") and r.bytes in (10, 1500)
    for f in tmp_path.glob("warc/*/*.gz"):
        data = gzip.decompress(f.read_bytes())
        assert data.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo") and data.endswith(b"\r\n\r\n")


def test_legacy_headers():
    one = b"filedesc://a.arc 0.0.0.0 19990101 text/plain 76\n1 0 X\nURL IP-address Archive-date Content-type Archive-length\n"
    one = one.replace(b" 76\n", b" %d\n" % len(one.split(b"\n", 1)[1]))
    body = b"HTTP/1.0 200 OK\r\nA: 1\r\n\r\nhello\nhttp://fake 1 2 3 9\n"
    data = one + b"\nhttp://a/b c 1.2.3.4 19990203040506 text/html %d\n" % len(body) + body + b"\ndns:a 1.2.3.4 1999 text/dns 3\nabc\n\nhttp://cut 1.1.1.1 19990101000000 text/html 50\nshort"
    rows = list(A.parse_arc(data))
    assert [r.uri for r in rows] == ["http://a/b c", "dns:a", "http://cut"]
    assert rows[0].payload == b"hello\nhttp://fake 1 2 3 9\n" and A.warc_date(rows[0].date) == "1999-02-03T04:05:06Z"
    assert rows[1].head == b"" and rows[1].payload == b"abc" and A.warc_date(rows[1].date) == "1999-01-01T00:00:00Z"
    assert [r.truncated for r in rows] == [False, False, True]
    two = b"http://a 1.2.3.4 19990101000000 text/html 200 - - 0 f.arc 5\nabcde\n"
    assert [r.payload for r in A.parse_arc(two)] == [b"abcde"]
    assert list(A.parse_arc(b"")) == [] and list(A.parse_arc(b"no header here\n")) == []
    assert A.warc_date("-") == "1970-01-01T00:00:00Z"


def test_labels():
    digest = hashlib.sha1(b"x").hexdigest()
    assert A.hex_of_label(A.sha1_label(digest)) == digest == A.hex_of_label(f"sha1:{digest.upper()}")
