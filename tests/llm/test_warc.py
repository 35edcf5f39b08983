import gzip
import hashlib
import os

import pytest

from versio.llm import warc
from versio.llm.queries import arc_of_pages


def feed(raw, separator=b"\n"):
    pieces = raw.split(separator)
    return warc._Feed(iter(pieces[:-1] if pieces[-1] == b"" else pieces), separator)


def arc(version, records, fields=None):
    body = b"%d 0 Own\n%b\n\n" % (version, (fields or warc.ARC_FIELDS[version]).encode())
    out = warc.arc_header(version, b"filedesc://x.arc", b"20010203040506", b"text/plain", len(body)) + body + b"\n"
    for url, date, mime, block in records:
        out += warc.arc_header(version, url, date, mime, len(block)) + block + b"\n"
    return out


RECORDS = [(b"http://a/", b"20200102030405", b"text/html", b"HTTP/1.1 200 OK\r\nX-Page-Id: 5\r\n\r\nbody\nwith\r\n\r\nlines\n"), (b"http://a b/", b"199912", b"text/html", b""), (b"dns:a", b"19991231", b"text/dns", b"20200101\na IN A 1.2.3.4\nfiledesc://fake 0 0 0 3\n"), (b"http://c/", b"2020010203", b"-", b"\x00\xff\n\n\n")]


@pytest.mark.parametrize("version", [1, 2])
def test_arc_records(version):
    got = list(warc.arc_records(feed(arc(version, RECORDS))))
    assert [g["url"] for g in got] == ["filedesc://x.arc", "http://a/", "http://a b/", "dns:a", "http://c/"]
    assert [g["block"] for g in got[1:]] == [r[3] for r in RECORDS] and not any(g["truncated"] for g in got)
    assert [g["date"] for g in got[1:]] == [r[1].decode() for r in RECORDS] and len({g["at"] for g in got}) == 5


def test_damaged_arc():
    raw = arc(1, RECORDS[:1]) + b"no header line\n\n" + warc.arc_header(1, b"http://z/", b"20200102030405", b"text/html", 100) + b"cut"
    got = list(warc.arc_records(feed(raw)))
    assert [g["url"] for g in got] == ["filedesc://x.arc", "http://a/", "http://z/"] and got[2]["truncated"] and got[2]["block"].startswith(b"cut")
    assert list(warc.arc_records(feed(b""))) == []


def test_dates_and_http():
    assert warc.warc_date("20200102030405") == "2020-01-02T03:04:05Z" and warc.warc_date("19991231") == "1999-12-31T00:00:00Z"
    assert warc.warc_date("") == warc.warc_date("soon") == "1970-01-01T00:00:00Z"
    assert warc.http_parts(b"HTTP/1.0 200\n\na\r\n\r\nb") == (b"HTTP/1.0 200\n\n", b"a\r\n\r\nb")
    assert warc.http_parts(b"HTTP/1.0 200") == (b"HTTP/1.0 200", b"") and warc.http_parts(b"x") == (b"", b"x")


def test_files_of_both_versions_plain_and_compressed(spark, tmp_path):
    os.makedirs(tmp_path / "in")
    (tmp_path / "in/one.arc").write_bytes(arc(1, RECORDS))
    with gzip.open(tmp_path / "in/two.arc.gz", "wb") as f:
        f.write(arc(2, RECORDS))
    with open(tmp_path / "in/three.arc.gz", "wb") as f:  # a member for each record, as such files often are
        whole = arc(1, RECORDS)
        f.write(gzip.compress(whole[:300]) + gzip.compress(whole[300:]))
    warc.convert(spark, str(tmp_path / "in"), str(tmp_path / "out"), key_header="X-Page-Id", least_bytes=10)
    rows = warc.read_warc(spark, str(tmp_path / "out"), payloads=True).collect()
    assert sorted(r.type for r in rows) == ["resource"] * 9 + ["response"] + ["revisit"] * 2 + ["warcinfo"] * 3
    body = b"body\nwith\r\n\r\nlines\n"
    pages = [r for r in rows if r.type in ("response", "revisit")]
    assert {(r.key, r.payload_bytes, r.payload_digest, r.warc_date) for r in pages} == {(5, len(body), hashlib.sha1(body).hexdigest(), "2020-01-02T03:04:05Z")}
    first = next(r for r in rows if r.type == "response")
    assert bytes(first.payload) == body and {r.refers_to for r in rows if r.type == "revisit"} == {first.record_id} and first.refers_to is None
    assert len({r.record_id for r in rows}) == 15
    assert sorted(bytes(r.payload) for r in rows if r.type == "resource") == sorted(x[3] for x in RECORDS[1:] * 3)


def test_wrong_digest_is_an_error(spark, tmp_path):
    os.makedirs(tmp_path / "w")
    (tmp_path / "w/x.warc").write_bytes(b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:1>\r\nWARC-Payload-Digest: sha1:" + b"A" * 32 + b"\r\nContent-Length: 1\r\n\r\nx\r\n\r\n")
    with pytest.raises(Exception, match="digest"):
        warc.read_warc(spark, str(tmp_path / "w")).collect()


def test_pages_round_trip(spark, tmp_path):
    same = "WARC/1.0\r\n\r\nsame payload\r\n\r\n" * 60
    rows = [(1, "http://a/", same), (9, "http://b/ c\n", same), (4, None, same), (2, "http://d/", None), (3, "http://e/", ""), (5, "http://f/", "short"), (6, "http://g/", "short"), (7, "http://h/", "x" * 2_000_000 + "é\n"), (None, "http://i/", same), (7, "http://h/", "again"), (7, "http://h/", "again")]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id bigint, url string, html string, date int")
    warc.write_arc(arc_of_pages(pages), str(tmp_path / "arc"))
    warc.convert(spark, str(tmp_path / "arc"), str(tmp_path / "warc"), key_header="X-Page-Id")
    got = [r for r in warc.read_warc(spark, str(tmp_path / "warc"), payloads=True).collect() if r.type in ("response", "revisit")]
    digest = {None: hashlib.sha1(b"").hexdigest()}
    assert sorted((r.key is None, r.key, r.payload_bytes, r.payload_digest) for r in got if r.key) == sorted((False, k, len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest()) for k, _, h in rows if k)
    assert {(r.key, r.type, r.refers_to_key) for r in got if r.payload_bytes == len(same)} == {(9, "response", None), (1, "revisit", 9), (4, "revisit", 9), (None, "revisit", 9)}
    assert all(r.type == "response" for r in got if r.payload_bytes != len(same)) and digest
    assert any(bytes(r.payload).decode() == rows[7][2] for r in got)
    warc.write_arc(arc_of_pages(pages.limit(0)), str(tmp_path / "none"))
    warc.convert(spark, str(tmp_path / "none"), str(tmp_path / "none_warc"))
    assert warc.read_warc(spark, str(tmp_path / "none_warc")).where("type <> 'warcinfo'").count() == 0


def test_archives_of_one_name_in_two_folders(spark, tmp_path):
    page = b"HTTP/1.1 200 OK\r\nX-Page-Id: %d\r\n\r\n" + b"same " * 400
    for k, folder in enumerate(("c1", "c2")):
        os.makedirs(tmp_path / "in" / folder)
        (tmp_path / "in" / folder / "x.arc").write_bytes(arc(1, [(b"http://a/", b"20200102030405", b"text/html", page % k), (b"http://b/", b"20200102030405", b"text/html", b"HTTP/1.1 200 OK\r\n\r\nown %d" % k)]))
    warc.convert(spark, str(tmp_path / "in"), str(tmp_path / "out"), key_header="X-Page-Id")
    rows = warc.read_warc(spark, str(tmp_path / "out")).collect()
    assert len({r.record_id for r in rows}) == len(rows) == 6
    assert [(r.key, r.refers_to_key) for r in rows if r.type == "revisit"] == [(0, 1)]
