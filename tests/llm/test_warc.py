"""ARC and WARC by round trip, and the revisit rule by brute force."""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid

import pytest
import zstandard

from tests.compare import check
from tidemark.llm import queries, warc


def plain(rows, least=0):
    best = {}
    for p, h in rows:
        b = (h or "").encode()
        if p is not None and len(b) >= least:
            best[b] = max(best.get(b, p), p)
    out = []
    for p, h in rows:
        b = (h or "").encode()
        ref = best[b] if p is not None and len(b) >= least and p < best[b] else None
        out.append((p, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if ref is None else "revisit", ref))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=str)


def test_query_against_brute_force(spark, sf_dir):
    pages = [(r.page_id, r.html) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    assert rows_of(queries.op9_warc(spark, sf_dir)) == plain(pages)


@pytest.mark.parametrize("version", [1, 2])
@pytest.mark.parametrize("least", [0, 3])
def test_cases(spark, version, least):
    rows = [(1, "same"), (2, "same"), (9, "same"), (9, "same"), (3, None), (4, ""), (5, "ab"), (6, "ab"), (-7, "\r\n\r\nWARC/1.1 é"), (None, "same"), (8, "x" * 200_000)]
    df = spark.createDataFrame([(p, None if p == 5 else f"http://h/{p} a", h, 0) for p, h in rows], "page_id long, url string, html string, digest int").repartition(3)
    assert rows_of(warc.pages_to_warc(df, version, least)) == plain(rows, least)
    assert warc.pages_to_warc(df.limit(0)).count() == 0


def test_arc_versions_and_damage():
    recs = [("http://a", b"HTTP/1.1 200 OK\r\n\r\none\n"), ("http://b", b"HTTP/1.1 200 OK\r\n\r\n")]
    for v, n in ((1, 5), (2, 10)):
        data = warc.write_arc(recs, v)
        got = list(warc.read_arc(data))
        assert [g["body"] for g in got] == [b for _, b in recs] and got[0]["URL"] == "http://a" and len(got[0]) == n + 1
    with pytest.raises(ValueError):
        list(warc.read_arc(data[:-9]))


def test_record_ids_carry_the_page():
    for p in (0, 1, -1, 2**63 - 1, -(2**63)):
        assert warc.page_of(warc.record_id(p, "a/1")) == p
    ids = [warc.record_id(p, f"{a}/{k}") for p in (None, 7) for a in range(40) for k in range(40)]
    assert len(set(ids)) == len(ids) and all(uuid.UUID(x).version == 8 and uuid.UUID(x).variant == uuid.RFC_4122 for x in ids)


def test_record_ids_are_unique(spark):
    df = spark.createDataFrame([(p, f"http://h/{k}", f"text {k % 3}") for k, p in enumerate([1, 1, 1, None, None, None, 2, 3])], "page_id long, url string, html string").repartition(3)
    rows = warc.pages_to_warc(df).collect()
    assert len({r.record_id for r in rows}) == len(rows) == 8


def test_odd_records(spark):
    """What real archives hold: names and URLs with spaces, other protocols, bare newlines, header lines
    without a colon, no header end, short dates, compressed files."""
    recs = [
        ("http://a/x y", b"HTTP/1.0 200 OK\nContent-Type: text/html\n\nbare\nnewlines"), ("dns:a.org", b"20240101\na.org. 300 IN A 1.2.3.4"), ("http://b", b"HTTP/1.1 200 OK\r\nodd line\r\nA:b\r\n\r\nx"),
        ("http://c", b"HTTP/1.1 204 No Content"), ("http://d", b""), ("http://e", b"HTTP/1.1 200 OK\r\nX-Page-Id: 5\r\nContent-Length: many\r\n\r\nsame"), ("http://f", b"HTTP/1.1 200 OK\r\nX-Page-Id: 6\r\n\r\nsame"),
    ]
    data = warc.write_arc(recs).replace(b"http://a/xy ", b"http://a/x y ")
    members = b"".join(gzip.compress(data[a:b]) for a, b in ((0, 300), (300, len(data))))
    want = [(r["URL"], r["body"]) for r in warc.read_arc(data)]
    assert want == recs == [(r["URL"], r["body"]) for r in warc.read_arc(members)] == [(r["URL"], r["body"]) for r in warc.read_arc(zstandard.compress(data))]
    df = spark.createDataFrame([(3, bytearray(members))], "arc long, data binary")
    archive = bytes(warc.convert(df).first().archive)
    got = list(warc.read_warc(archive))
    assert [f["WARC-Type"] for f, _ in got] == ["warcinfo", "response", "resource", "response", "response", "resource", "revisit", "response"]
    assert [b for f, b in got if f["WARC-Type"] in ("response", "resource")] == [b for k, (_, b) in enumerate(recs) if k != 5]
    assert got[2][0]["Content-Type"] == "text/html" and got[1][0]["WARC-Target-URI"] == "http://a/x y" and got[1][0]["WARC-IP-Address"] == "0.0.0.0"
    rows = warc.read_archives(warc.convert(df)).collect()
    assert [(r.page_id, r.payload_bytes, r.refers_to) for r in rows] == [(None, 13, None), (None, 32, None), (None, 1, None), (None, 0, None), (None, 0, None), (5, None, 6), (6, 4, None)]
    assert warc.split_http(recs[0][1])[2] == b"bare\nnewlines" and warc.split_http(recs[2][1])[0] == {"a": "b"}
    assert [warc.warc_date(x) for x in ("20240203040506", "202402030405", "2024", "never")] == ["2024-02-03T04:05:06Z", "2024-02-03T04:05:00Z", "2024-01-01T00:00:00Z", "1970-01-01T00:00:00Z"]


def test_warc_is_checked():
    record = {"URL": "u", "IP-address": "-", "Archive-date": "20240101000000", "Content-type": "text/html", "body": b"HTTP/1.1 200 OK\r\nContent-Length: 1\r\n\r\nx"}
    rec = warc.warc_record(record, warc.record_id(1, "0/0"))
    assert [b for _, b in warc.read_warc(rec + rec)] == [record["body"]] * 2
    damaged = gzip.compress(gzip.decompress(rec).replace(b"\r\n\r\nx", b"\r\n\r\ny"))
    with pytest.raises(ValueError):
        list(warc.read_warc(damaged))


def test_matches_sql(spark, sf_dir):
    assert check(queries.QUERIES["op9_warc"], queries.ORACLE_SQL["op9_warc"], spark, sf_dir) is None


def test_header_lines_are_anchored_on_address_and_date():
    """Content types and URLs with spaces, other addresses; what can't be read is named with its place."""
    for v in (1, 2):
        data = warc.write_arc([("http://a/b", b"one"), ("http://c/d", b"two")], v)
        odd = data.replace(b"http://a/b 0.0.0.0", b"http://a/b c d 2001:db8::1").replace(b"text/html", b"text/html; charset=utf-8")
        got = list(warc.read_arc(odd))
        assert [(r["URL"], r["Content-type"], r["body"]) for r in got] == [("http://a/b c d", "text/html; charset=utf-8", b"one"), ("http://c/d", "text/html; charset=utf-8", b"two")]
        assert got[0]["IP-address"] == "2001:db8::1" and len(got[0]["Archive-date"]) == 14
        for wrong in (data.replace(b" 3\none", b" x3\none"), data.replace(b" 3\none", b" -3\none"), data.replace(b"http://a/b 0.0.0.0", b"http://a/b nowhere"), b"no header\n", b"x 5\nabcde", data[:-9], b"\x00"):
            with pytest.raises(warc.ArcError, match="ARC record at byte"):
                list(warc.read_arc(wrong))
