import base64
import gzip
import hashlib

import pytest

from schemagauge.llm import archives, joins, queries

PAGES = "page_id long, url string, html string"


def converted(spark, folder, rows, schema=PAGES, **options):
    pages = spark.createDataFrame(rows, schema).repartition(3)
    archives.write_arc(pages, f"file://{folder}/arc", **options)
    archives.write_warc(archives.to_warc(spark, f"file://{folder}/arc"), f"file://{folder}/warc")
    return archives.read_warc(spark, f"file://{folder}/warc")


def plain(rows, least=0):
    """(page_id, html) rows to page_id -> (bytes, digest, type, refers_to)."""
    same = {}
    for page, html in rows:
        same.setdefault((html or "").encode(), []).append(page)
    out = {}
    for data, pages in same.items():
        sha = base64.b32encode(hashlib.sha1(data).digest()).decode()
        for page in pages:
            first = page == max(pages) or len(data) < least
            out[page] = (len(data), sha, "response" if first else "revisit", None if first else max(pages))
    return out


ODD = [None, "", "é𝄞" * 40, "\r\n\r\nWARC/1.0\r\n\r\n", "filedesc://x 1 2 3 4\n1 0\n", "\n\n", "\0\1", "x" * 5_000_000, "", None]


@pytest.mark.parametrize("version", [1, 2, None])
def test_pages_come_back(spark, tmp_path, version):
    rows = [(i, f"http://a b/{i}\n", t) for i, t in enumerate(ODD + ["same page"] * 40)]
    rows += [(900, None, "no address"), (901, "", "empty address")]
    found = converted(spark, tmp_path, rows, version=version)
    records = archives.resolved(found).collect()
    got = {r.key: (r.payload_bytes, r.payload_digest, r.type, r.refers_key) for r in records}
    assert len(records) == len(rows) and got == plain([(p, t) for p, _, t in rows])
    texts = {r.key: r.payload for r in found.collect() if r.type == "response"}
    assert all(bytes(texts[r.key]) == (dict((p, t) for p, _, t in rows)[r.key] or "").encode() for r in records if r.type == "response")
    assert {r.target for r in records if r.key == 0} == {"http://a%20b/0%0A"}
    infos = [r for r in found.collect() if r.type == "warcinfo"]
    assert infos and all(bytes(r.payload)[:1] in (b"1", b"2") for r in infos)


def test_hot_payloads_are_dealt_out(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(joins, "SHARE", 7)
    rows = [(i, f"u{i}", "hot" if i % 3 else f"p{i}") for i in range(200)]
    records = archives.resolved(converted(spark, tmp_path, rows)).collect()
    assert {r.key: (r.payload_bytes, r.payload_digest, r.type, r.refers_key) for r in records} == plain([(p, t) for p, _, t in rows])


def test_equal_rows_null_keys_other_columns_and_none(spark, tmp_path):
    rows = [(1, "u", "t", "x"), (1, "u", "t", "x"), (None, "u", "t", None), (None, "v", "only", None)]
    records = archives.resolved(converted(spark, tmp_path / "a", rows, PAGES + ", payload string")).collect()
    assert sorted((str(r.key), r.type, str(r.refers_key)) for r in records) == [
        ("1", "response", "None"), ("1", "revisit", "1"), ("None", "response", "None"), ("None", "revisit", "1"),
    ]
    assert archives.resolved(converted(spark, tmp_path / "b", [])).count() == 0


def test_least_payload(spark, tmp_path):
    archives.write_arc(spark.createDataFrame([(i, "u", "x" * (i // 2)) for i in range(8)], PAGES), f"file://{tmp_path}/arc")
    archives.write_warc(archives.to_warc(spark, f"file://{tmp_path}/arc", least=2), f"file://{tmp_path}/warc")
    records = archives.resolved(archives.read_warc(spark, f"file://{tmp_path}/warc")).collect()
    assert {r.key: r.type for r in records} == {k: "revisit" if k in (4, 6) else "response" for k in range(8)}


OLD = b"""filedesc://old.arc 0.0.0.0 19970211 text/plain 76
1 0 InternetArchive
URL IP-address Archive-date Content-type Archive-length

dns:example.org 10.0.0.1 19970212030405 text/dns 9
10.0.0.1

http://example.org/a b 10.0.0.1 1997021203 text/html 26
HTTP/1.0 200 OK
A: b

text

http://example.org/raw 10.0.0.2 nodate text/html 3
raw
filedesc://new.arc 0 20010203040506 text/plain 200 - - 0 new.arc 122
2 0 Alexa
URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length

http://example.org/c 10.0.0.3 20010203040506 text/html 200 abc - 300 new.arc 33
HTTP/1.0 200 OK
X-Page-Id: 7

c
"""


@pytest.fixture
def old():
    """The same archive with declared lengths that fit."""
    parts = OLD.split(b"\n")
    assert parts[0].endswith(b" 76") and len(b"\n".join(parts[1:3]) + b"\n") == 76
    v2 = b"2 0 Alexa\nURL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length\n"
    http = b"HTTP/1.0 200 OK\nA: b\n\ntext"
    page = b"HTTP/1.0 200 OK\nX-Page-Id: 7\n\nc"
    return OLD.replace(b" 122\n", b" %d\n" % len(v2)).replace(b" 26\n", b" %d\n" % len(http)).replace(b" 33\n", b" %d\n" % len(page))


@pytest.mark.parametrize("packed", [False, True])
def test_foreign_archives(spark, tmp_path, old, packed):
    (tmp_path / "arc").mkdir()
    # One member a record, as archives have it, or no compression.
    cut = old.index(b"dns:")
    (tmp_path / "arc/old.arc").write_bytes(gzip.compress(old[:cut]) + gzip.compress(old[cut:]) if packed else old)
    rows = archives.to_warc(spark, f"file://{tmp_path}/arc").collect()
    found = {r.target: r for r in rows}
    assert {t: r.type for t, r in found.items()} == {
        "filedesc://old.arc": "warcinfo", "dns:example.org": "resource", "http://example.org/a b": "response",
        "http://example.org/raw": "resource", "filedesc://new.arc": "warcinfo", "http://example.org/c": "response",
    }
    assert bytes(found["http://example.org/a b"].payload) == b"text" and found["http://example.org/c"].key == 7
    assert found["http://example.org/a b"].date == "1997-02-12T03:00:00Z"
    assert found["http://example.org/raw"].date == "1970-01-01T00:00:00Z"
    assert found["dns:example.org"].info_id == found["filedesc://old.arc"].record_id
    assert found["http://example.org/c"].info_id == found["filedesc://new.arc"].record_id
    assert len({r.record_id for r in rows}) == 6 and all(r.record_id.startswith("urn:uuid:") for r in rows)


def test_bytes_that_are_no_text_survive(spark, tmp_path):
    block = b"HTTP/1.0 200 OK\r\n\r\n" + bytes(range(256)) * 3
    data = archives.version_block(1, b"n", b"19970101000000") + b"\nu - 19970101000000 image/png %d\n" % len(block) + block
    (tmp_path / "arc").mkdir()
    (tmp_path / "arc/a.arc").write_bytes(data)
    archives.write_warc(archives.to_warc(spark, f"file://{tmp_path}/arc"), f"file://{tmp_path}/warc")
    rows = archives.read_warc(spark, f"file://{tmp_path}/warc").collect()
    assert [bytes(r.payload) for r in rows if r.type == "response"] == [bytes(range(256)) * 3]


@pytest.mark.parametrize("harm", [lambda d: d[:-4], lambda d: d.replace(b"1 0 Int", b"9 0 Int"), lambda d: d[d.index(b"dns:") :],
                                  lambda d: d.replace(b"text/dns 9", b"text/dns x")])
def test_broken_archives_are_errors(spark, tmp_path, old, harm):
    (tmp_path / "arc").mkdir()
    (tmp_path / "arc/old.arc").write_bytes(harm(old))
    with pytest.raises(Exception, match="ends within|unknown version|no version block|broken header"):
        archives.to_warc(spark, f"file://{tmp_path}/arc").collect()


def test_altered_records_are_errors(spark, tmp_path):
    converted(spark, tmp_path, [(1, "u", "some payload")])
    (tmp_path / "bad").mkdir()
    for f in (tmp_path / "warc").glob("part-*"):
        (tmp_path / "bad" / f.stem).write_bytes(gzip.decompress(f.read_bytes()).replace(b"some", b"none"))
    with pytest.raises(Exception, match="altered"):
        archives.read_warc(spark, f"file://{tmp_path}/bad").collect()


def test_query_on_the_table(spark):
    folder = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "html").collect()
    found = queries.op11_warc(spark, folder).collect()
    assert {r.page_id: tuple(r)[1:] for r in found} == plain([tuple(r) for r in rows])
