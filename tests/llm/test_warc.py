"""Round trips through archives, and what the reader skips."""

import gzip  # noqa: F401
import hashlib
import io

import pytest

from phonolake.llm import warc as W

BIG = "<p>" + "é" * 600 + "</p>"
ROWS = [
    (1, "http://a/1", BIG), (2, "http://a/2", BIG), (5, "http://a/5", BIG), (3, None, None), (4, "http://a/4\r\nX: y", ""),
    (6, "http://b", "short"), (7, "http://b", "short"), (None, "http://n", BIG), (8, "http://c", "WARC/1.1\r\nWARC-Type: response\r\n\r\n" * 60),
    (9, "http://d", "x" * 300_000), (5, "http://a/5", BIG), (10, "http://e", "\r\n\r\n" + "y" * 1000),
]


@pytest.fixture
def archive(spark, tmp_path):
    pages = spark.createDataFrame([(*r, "clash", "clash") for r in ROWS], "page_id long, url string, html string, digest string, keep string")
    path = str(tmp_path / "archive")
    W.write(pages.repartition(3), path)
    return path


def test_round_trip(spark, archive):
    want = []
    for page, _, html in ROWS:
        raw = (html or "").encode()
        peers = [p for p, _, h in ROWS if h == html and p is not None] if len(raw) >= 1000 else []
        keep = max(peers) if len([r for r in ROWS if r[2] == html]) > 1 and peers else None
        again = keep is not None and page != keep
        want.append((page, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", keep if again else None))
    got = [tuple(r) for r in W.catalogue(spark, archive).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    bodies = {r.record_id: bytes(r.payload) for r in W.read(spark, archive).filter("payload IS NOT NULL").collect()}
    assert bodies["<urn:page:9>"] == b"x" * 300_000 and bodies["<urn:page:10>"].startswith(b"\r\n\r\n")
    assert W.read(spark, archive).filter("target_uri = 'http://a/4%0D%0AX: y'").count() == 1


def test_predicates_are_pushed(spark, archive, capsys):
    plan = W.read(spark, archive).filter("record_type = 'revisit' AND content_length > 10 AND length(target_uri) > 3")
    assert {r.record_type for r in plan.collect()} == {"revisit"}
    plan.explain()
    kept = capsys.readouterr().out
    assert "revisit" not in kept.partition("Physical Plan")[2].partition("Batch")[0] or "PushedFilters" in kept


def test_unwanted_blocks_are_not_read():
    block = b"HTTP/1.1 200 OK\r\nContent-Length: 50000\r\n\r\n" + b"z" * 50_000
    one = b"WARC/1.1\r\nWARC-Type: %s\r\nContent-Type: application/http\r\nContent-Length: " + str(len(block)).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    read = []

    class Watched(io.BytesIO):
        def read(self, n=-1):
            read.append(n)
            return super().read(n)

    reader = W.WarcReader({"path": "unused"})
    assert list(reader.pushFilters([W.EqualTo(("record_type",), "metadata"), W.EqualTo(("payload",), b"")])) == [W.EqualTo(("payload",), b"")]
    rows = list(reader.scan(Watched(one % b"response" + one % b"metadata" + one % b"request")))
    assert [r[1] for r in rows] == ["metadata"] and read == [50_000]


def test_partitions_follow_file_sizes(archive):
    assert sum(len(p.paths) for p in W.WarcReader({"path": archive}).partitions()) == 3
    assert len(W.WarcReader({"path": "file:" + archive, "splitBytes": "1000"}).partitions()) == 3


def test_empty_table(spark, tmp_path):
    path = str(tmp_path / "none")
    W.write(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert W.catalogue(spark, path).count() == 0
