import gzip
import hashlib

import duckdb
import pytest

from ironlift.llm.archives import arc_blocks, convert, parse_arc, read_arc, read_warc, write_warc
from ironlift.llm.queries import ORACLE_SQL, op3_arc_to_warc

V1 = b"filedesc://a.arc 0.0.0.0 19960923142103 text/plain 76\n1 0 Alexa\nURL IP-address Archive-date Content-type Archive-length\n   \n      \n\nhttp://a.b/x y 1.2.3.4 19961104142103 text/html 24\nHTTP/1.0 200 OK\r\n\r\nhello\n\nhttp://n.o/ 1.2.3.4 19961104142103 image/gif 7\nGIF\n\n\n!\n"
V2 = b"filedesc://a.arc 0.0.0.0 19960923142103 text/plain 200 - - 0 a.arc 122\n2 0 Alexa\nURL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length\n" + b" " * 14 + b"\nhttp://a.b/ 1.2.3.4 19961104142103 text/html 200 abc - 99 a.arc 5\nhello\n"


def pad(data):  # make the first record's declared length right
    head, _, rest = data.partition(b"\n")
    body = rest[: rest.index(b"http://")].rstrip(b"\n") + b"\n"
    return head.rsplit(b" ", 1)[0] + b" %d\n" % len(body) + body + b"\n" + rest[rest.index(b"http://") :]


def test_both_versions():
    a, b = parse_arc(pad(V1))
    assert (a["url"], a["payload"], a["arc_version"], a["http"]) == ("http://a.b/x y", b"hello", 1, b"HTTP/1.0 200 OK\r\n\r\n")
    assert (b["payload"], b["mime"], b["http"]) == (b"GIF\n\n\n!"[:7], "image/gif", b"")
    (c,) = parse_arc(pad(V2))
    assert (c["payload"], c["arc_version"], c["archive_date"]) == (b"hello", 2, "19961104142103")
    with pytest.raises(ValueError):
        list(parse_arc(pad(V2)[:-3]))
    assert list(parse_arc(b"")) == []


def test_files(spark, tmp_path):
    (tmp_path / "a.arc").write_bytes(pad(V1))
    (tmp_path / "b.arc.gz").write_bytes(gzip.compress(pad(V2)))
    out = read_warc(write_warc(convert(read_arc(spark, f"file://{tmp_path}")))).collect()
    assert sorted((r.url, r.record_type, bytes(r.payload)) for r in out) == [("http://a.b/", "resource", b"hello"), ("http://a.b/x y", "response", b"hello"), ("http://n.o/", "resource", b"GIF\n\n\n!")]
    assert {r.date for r in out} == {"1996-11-04T14:21:03Z"} and len({r.record_id for r in out}) == 3


@pytest.mark.parametrize("version", [1, 2])
def test_edges(spark, version):
    big = "<p>é</p>" * 50_000
    rows = [(9, "http://x/ y", big, 1), (4, None, big, 1), (7, "u\nv", "short", 1), (8, "u", "short", 1), (1, "u", None, 1), (2, "u", "", 1), (None, "u", big, 1), (4, "z", big, 1), (11, "h", "HTTP/1.1\r\n\r\n" * 20, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload int")
    out = read_warc(write_warc(convert(arc_blocks(pages, version=version)))).collect()
    assert len(out) == len(rows)
    got = {(r.key, r.record_type, r.refers_to) for r in out}
    assert got == {(9, "revisit", 4), (4, "response", None), (7, "response", None), (8, "response", None), (1, "response", None), (2, "response", None), (None, "revisit", 4), (11, "response", None)}
    for r in out:
        html = {a: c for a, _, c, _ in rows}[r.key] or ""
        assert r.payload_bytes == len(html.encode()) and r.payload_digest == hashlib.sha256(html.encode()).hexdigest()
        assert r.record_type == "revisit" or bytes(r.payload) == html.encode()
    assert read_warc(write_warc(convert(arc_blocks(pages.limit(0))))).count() == 0


def test_query_against_sql(spark):
    d = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{d}/pages.parquet'")
    want = sorted(con.execute(ORACLE_SQL["op3_arc_to_warc"]).fetchall())
    assert sorted(tuple(r) for r in op3_arc_to_warc(spark, d).collect()) == want
