"""ARC and WARC bytes, and the query against hashing by hand."""

import gzip
import hashlib

import pytest

from lorekeep.llm import queries, warc


def test_members_end_as_expected():
    assert gzip.decompress(warc.EMPTY_MEMBER) == b"" and warc.EMPTY_MEMBER.endswith(b"\0")
    assert gzip.decompress(warc.member(b"a") + warc.member(b"b") + warc.EMPTY_MEMBER) == b"ab" == warc.inflated(warc.member(b"a") + warc.member(b"b") + warc.EMPTY_MEMBER)


@pytest.mark.parametrize("version", [1, 2])
def test_versions(version):
    file = b"".join(warc.write_arc([(1, "http://a/ b", b"x\n\nfiledesc://" * 3), (None, None, b"")], version))
    block, first, second = warc.read_arc(file)
    assert block["URL"].startswith("filedesc://") and first["URL"] == "http://a/%20b" and second["URL"] == "urn:page:None"
    (h, body), = warc.read_warc(warc.convert(first))
    assert h["warc-type"] == "response" and h["warc-date"] == "2025-01-01T00:00:00Z" and warc.split_http(body)[1] == b"x\n\nfiledesc://" * 3
    (h, body), = warc.read_warc(warc.convert(first, ("<urn:uuid:x>", "http://a")))
    assert h["warc-type"] == "revisit" and h["warc-refers-to"] == "<urn:uuid:x>" and warc.split_http(body)[1] == b""
    (h, body), = warc.read_warc(warc.convert(block))
    assert h["warc-type"] == "warcinfo"


def test_plain_old_file():
    file = b"filedesc://old.arc 0.0.0.0 19961104142103 text/plain 76\n1 0 Alexa Internet\nURL IP-address Archive-date Content-type Archive-length\n\n"
    body = file.split(b"\n", 1)[1]
    file = b"filedesc://old.arc 0.0.0.0 19961104142103 text/plain %d\n" % len(body) + body + b"\ndns:a.example 1.2.3.4 19961104142104 text/dns 7\n1.2.3.4\n"
    block, dns = warc.read_arc(file)
    (h, got), = warc.read_warc(warc.convert(dns))
    assert (h["warc-type"], h["content-type"], h["warc-date"], got) == ("resource", "text/dns", "1996-11-04T14:21:04Z", b"1.2.3.4")
    with pytest.raises(ValueError):
        list(warc.read_arc(file[:-4]))
    with pytest.raises(ValueError):
        list(warc.read_arc(b"no header\n"))


def test_query(spark, tmp_path):
    big = "päge " * 300
    rows = [(i, f"http://h/{i}", big if i % 3 else f"{i} " + big) for i in range(40)]
    rows += [(100, None, None), (101, "", ""), (102, "http://s", "same"), (103, "http://s", "same"), (104, "u v", "\r\n\r\nWARC/1.1\r\n" * 100), (104, "u v", "\r\n\r\nWARC/1.1\r\n" * 100), (-5, "neg", big), (None, "none", big)]
    spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, body string").repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(map(str, (tuple(r)[:5] for r in queries.op3_warc(spark, str(tmp_path)).collect())))
    best, want = {}, []
    for i, _, html in rows:
        key = (html or "").encode()
        best[key] = max(best.get(key, -(10**9)), -(10**9) if i is None else i)
    for i, _, html in rows:
        key = (html or "").encode()
        revisit = len(key) >= 1000 and best[key] != i
        want.append((i, len(key), hashlib.sha1(key).hexdigest(), "revisit" if revisit else "response", best[key] if revisit else None))
    assert got == sorted(map(str, want))


def test_no_pages(spark, tmp_path):
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert queries.op3_warc(spark, str(tmp_path)).count() == 0
