import gzip
import hashlib
from pathlib import Path

import pytest

from matchlens.llm import web_archive
from matchlens.llm.queries import QUERIES

SCHEMA = "page_id long, url string, html string, digest string, part string, size string, leader string, key string, file string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z", "l", "k", "f") for r in rows], SCHEMA)


def by_hand(rows):
    largest = {}
    for page_id, _, html in rows:
        payload = (html or "").encode()
        if len(payload) >= 1000 and page_id is not None:
            largest[payload] = max(largest.get(payload, page_id), page_id)
    made = []
    for page_id, _, html in rows:
        payload = (html or "").encode()
        leader = largest.get(payload)
        again = leader is not None and page_id != leader
        made.append((page_id, len(payload), hashlib.sha1(payload).hexdigest(), "revisit" if again else "response", leader if again else None))
    return sorted(made, key=str)


def read(index, given):
    return sorted((tuple(r) for r in index.records(given.select("url")).collect()), key=str)


@pytest.mark.parametrize(
    "url, key",
    [
        ("https://WWW.Example.org/Path?q=1", "org,example,www)/Path?q=1"),
        ("http://user:pw@a.b:8080", "b,a:8080)/"),
        ("http://a.b:80?x", "b,a)/?x"),
        ("//a.b/c d\n", "b,a)/c%20d%0A"),
        ("mailto:me", ")mailto:me"),
        ("", ")"),
        (None, ")"),
    ],
)
def test_capture_key(url, key):
    assert web_archive.capture_key(url) == key


ODD = [
    (1, "http://a.b/c", "x" * 1200 + "é"),
    (2, "http://a.b/c", "x" * 1200 + "é"),
    (2, "http://a.b/c", "x" * 1200 + "é"),
    (None, None, "x" * 1200 + "é"),
    (3, None, None),
    (4, "", ""),
    (5, "weird url\nwith a line", "y" * 999),
    (6, "HTTPS://User@WWW.Ex.org:8080/p q?x=1#f", "y" * 999),
    (None, "z", "q" * 2000),
    (None, "z", "q" * 2000),
    (7, "http://a\x01.b/c", "\r\n\r\nWARC/1.1\r\n" * 100),
    (8, "http://long.org/", "long é " * 300_000),
    *[(k, "http://hot.org/", "same " * 300) for k in range(100, 300)],
    *[(k, f"http://h{k % 7}.org/{k}", f"p{k} " * 400) for k in range(400, 600)],
]


def test_round_trip_of_odd_pages_over_many_files_and_blocks(spark):
    given = pages(spark, ODD).repartition(3)
    archives = web_archive.write_archives(given, archive_bytes=40_000)
    index = web_archive.build_index(archives, block_lines=7, index_lines=50)
    assert len(index.bounds) > 5 and index.directory.count() > 40
    assert read(index, given) == by_hand(ODD)
    # One URL by range reads: all its captures over several blocks and files, and nothing else.
    found = index.fetch("http://hot.org/")
    assert sorted(web_archive._page_of(h["warc-record-id"]) for h, _ in found) == list(range(100, 300))
    assert [h["warc-type"] for h, _ in found].count("response") == 1
    (headers, block), = index.fetch("http://h1.org/400")
    assert block.endswith(b"p400 " * 400) and headers["warc-target-uri"] == "http://h1.org/400"
    assert index.fetch("http://nowhere.org/") == []
    # Any gzip reader reads the files, and each begins with a record about itself.
    files = list(Path(archives.path).glob("part-*"))
    texts = [gzip.decompress(f.read_bytes()) for f in files]
    assert len(files) > 10 and all(t.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo") for t in texts)
    assert sum(t.count(b"\nWARC-Type: re") for t in texts) == len(ODD)


def test_directory_is_sorted(spark):
    index = web_archive.build_index(web_archive.write_archives(pages(spark, ODD).repartition(3)), block_lines=10, index_lines=60)
    rows = [r for name, _, _ in index.bounds for r in index.directory.filter(f"file = '{name}'").orderBy("offset").collect()]
    assert all(a.last_key <= b.first_key for a, b in zip(rows, rows[1:])) and sum(r.n for r in rows) == len(ODD)


def test_empty_table(spark):
    given = pages(spark, [])
    index = web_archive.build_index(web_archive.write_archives(given))
    assert read(index, given) == [] and index.fetch("http://a.b/") == []


def test_members_with_the_separator_inside():
    made = [web_archive.member(b"a" * 50), web_archive.member(b""), web_archive.member(b"b")]
    content = b"".join(m + web_archive.SEPARATOR for m in made)
    assert [c for _, _, c in web_archive.members(content)] == [b"a" * 50, b"", b"b"]


def test_whole_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()]
    assert sorted((tuple(r) for r in QUERIES["op11_capture_index"](spark, sf).collect()), key=str) == by_hand(rows)
