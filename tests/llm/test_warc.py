from __future__ import annotations

import glob
import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from tallylake.llm import warc

SCHEMA = "page_id long, url string, html string, key string, payload string"
LONG = "<p>" + "lörem ipsum " * 100 + "</p>"


def table(spark, rows):
    return spark.createDataFrame([(i, u, h, "clash", "clash") for i, u, h in rows], SCHEMA)


def plain(rows, least=1000):
    last = {}
    for i, _, h in rows:
        if i is not None and len((h or "").encode()) >= least:
            last[h] = max(i, last.get(h, i))
    out = []
    for i, _, h in rows:
        data = (h or "").encode()
        refers = last.get(h) if len(data) >= least and last.get(h) != i else None
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), "response" if refers is None else "revisit", refers))
    return sorted(out, key=repr)


ROWS = [
    (1, "https://www.example.com/a?x=1#top", LONG), (2, "http://EXAMPLE.com:80/a?x=1", LONG), (9, "http://b.example.com", LONG),
    (3, None, None), (4, "", ""), (5, "no url at all\r\nX-Page-ID: 77", "short"), (6, "http://u:p@c.example.org:8080/ä", "short"),
    (7, "http://z.example.net/", "x" * 999), (8, "http://z.example.net/", "x" * 999), (10, "http://z.example.net/", "y" * 1000),
    (11, "http://z.example.net/", "y" * 1000), (None, "http://n.example/", LONG), (12, "http://r.example/", "r" * 2000),
    (12, "http://r.example/", "r" * 2000), (13, "http://big.example/", "\r\n\r\nWARC/1.1\r\n" * 200_000),
]


def test_read_back_equals_what_was_written(spark):
    got = [tuple(r) for r in warc.written_and_read(table(spark, ROWS)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()]
    assert sorted(got, key=repr) == plain(ROWS)


def test_a_payload_that_most_pages_share(spark):
    rows = [(i, f"http://h{i % 7}.example/{i}", LONG if i % 3 else f"{LONG}{i}") for i in range(600)]
    got = [tuple(r) for r in warc.written_and_read(table(spark, rows).repartition(4)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()]
    assert sorted(got, key=repr) == plain(rows)


def test_index_finds_every_capture_of_a_key(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 1 << 14)
    rows = [(i, "http://hot.example/" if i % 2 else f"http://a{i % 10}.example/{i}", f"{LONG}{i}") for i in range(400)]
    pages = table(spark, rows).repartition(3)
    folder = warc.shared_dir(spark, "warc-test")
    captures = warc.write_archives(warc.records_of(pages), folder)
    index = warc.write_index(captures, folder, index_files=4, block_rows=16, file_rows=100)
    files = index.orderBy("first").collect()
    assert len(files) > 1 and all(a["last"] <= b["first"] for a, b in zip(files, files[1:], strict=False))
    assert sum(f["blocks"] for f in files) >= 400 / 16
    keys = spark.createDataFrame([("example,hot)/",), ("example,a4)/4",), ("example,none)/",), ("zz",), ("",)], "key string")
    found = warc.look_up(keys, index, folder)
    assert found.where("key = 'example,hot)/'").count() == 200 and found.count() == 201
    read = warc.read_records(found, folder).select("page_id", F.decode("payload", "UTF-8").alias("html")).collect()
    assert {(r["page_id"], r["html"]) for r in read} == {(i, h) for i, u, h in rows if "hot" in u or i == 4}


def test_archives_are_gzip_members_of_records(spark):
    folder = warc.shared_dir(spark, "warc-test")
    captures = warc.write_archives(warc.records_of(table(spark, ROWS[:6])), folder).collect()
    data = b"".join(gzip.open(name).read() for name in glob.glob(folder.removeprefix("file://") + "/*.warc.gz"))
    assert data.count(b"WARC/1.1\r\nWARC-Type: response") == 4 and data.count(b"WARC/1.1\r\nWARC-Type: revisit") == 2
    assert b"\r\nX-Page-ID: 77" not in data and b"WARC-Target-URI: no url at all%0D%0AX-Page-ID: 77\r\n" in data
    assert {c["key"] for c in captures} >= {"com,example)/a?x=1", "com,example,b)/", ""}


def test_damage_is_seen():
    digest = hashlib.sha1(b"abc").hexdigest()
    record = warc.build_record(1, "http://a", b"abc", 3, digest, None)
    assert warc.parse_record(record)["payload"] == b"abc"
    with pytest.raises(ValueError):
        warc.parse_record(record.replace(b"abc", b"abd"))
    with pytest.raises(ValueError):
        warc.parse_record(record[:-3])


def test_keys(spark):
    urls = ["https://www2.Sub.Example.COM./P?b=1&a=2#f", "http://h:8080", "ftp://x/y", None, "http://h:443?q"]
    frame = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, url string")
    got = [r["k"] for r in frame.select("i", warc.url_key(F.col("url")).alias("k")).orderBy("i").collect()]
    assert got == ["com,example,sub)/P?b=1&a=2", "h:8080)/", "ftp://x/y", "", "h)/?q"]


def test_empty_table(spark):
    got = warc.written_and_read(table(spark, []))
    assert got.isEmpty() and got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
