"""Archives and their index: an exact round trip against brute force."""

import base64
import hashlib
from collections import defaultdict

import pytest

from palimpsest.llm import warc
from palimpsest.llm.common import Workspace

PAGES = [
    (5, "http://www.Example.com:80/a?x=1#frag", "<p>one</p>"), (3, "http://example.com/b", "<p>one</p>"), (9, "http://example.com/b", "<p>one</p>"),
    (1, "https://sub.example.org:8080", ""), (2, None, None), (4, "not a url", "\r\n\r\nWARC/1.1 in a payload\r\n\r\n"), (6, "http://[broken", "ünï 東京 \x00"),
    (7, "http://example.com/long", "x" * 3_000_000), (8, "http://example.com/long", "x" * 3_000_000), (5, "http://www.Example.com:80/a?x=1#frag", "<p>other</p>"),
    (10, "http://example.com/b", "<p>other</p>"), (None, "http://example.com/b", "<p>one</p>"), (None, "http://nobody.example/", "alone"), (None, "http://nobody.example/", "alone"),
    (11, "http://example.com/b", "<p>other</p>"), (12, "http://e.com/new\nline", "nl"), (-4, "http://e.com/neg", "neg"), (-5, "http://e.com/neg", "neg")]


def brute(rows, least=0):
    groups = defaultdict(list)
    for i, (p, _, html) in enumerate(rows):
        groups[(html or "").encode()].append((p is None, p or 0, i))
    out = []
    for payload, members in groups.items():
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        first = min(members)
        for m in members:
            new = m == first or len(payload) < least
            to = None if new or first[0] else first[1]
            out.append((None if m[0] else m[1], len(payload), digest, "response" if new else "revisit", to))
    return sorted(out, key=str)


def got(df):
    return sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in df.collect()), key=str)


@pytest.mark.parametrize("least", [0, 5])
def test_edges(spark, crowd, least):
    pages = crowd(spark.createDataFrame(PAGES, "page_id long, url string, html string"))
    assert got(warc.round_trip(pages, least)) == brute(PAGES, least)


def test_query(spark, sf_dir):
    from palimpsest.llm.queries import op1_warc

    rows = [(r["page_id"], r["url"], r["html"]) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    df = op1_warc(spark, sf_dir)
    assert df.dtypes[:5] == [("page_id", "bigint"), ("payload_bytes", "bigint"), ("payload_digest", "string"), ("record_type", "string"), ("refers_to", "bigint")]
    assert got(df) == brute(rows)


def test_like_sql(sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf_dir}/pages.parquet'")
    got = con.execute(warc.ORACLE).fetchall()
    rows = con.execute("SELECT page_id, url, html FROM pages").fetchall()
    assert sorted(got, key=str) == brute(rows)


def test_empty(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_look_up_over_many_blocks(spark):
    urls = [f"http://h{i % 7}.example.com/p{i % 40}" for i in range(400)]
    pages = spark.createDataFrame([(i, u, f"page {i // 3}") for i, u in enumerate(urls)], "page_id long, url string, html string")
    ws = Workspace(spark, "warc-test")
    written = warc.write_archives(ws, pages.repartition(3, "url"))  # shuffled rows are written first
    found = ws.table(warc.captures(written), "captures")
    assert sorted(map(tuple, found.collect()), key=str) == sorted(map(tuple, written.collect()), key=str)
    master = warc.write_index(ws, found, block_lines=9)
    index = warc.CaptureIndex(master)
    assert len(master) > 1 and any(len(index._directory(m)) > 3 for m in master)
    by = defaultdict(list)
    for i, u in enumerate(urls):
        by[u].append(i)
    for u, ids in by.items():
        assert [x[0] for x in index.captures(u)] == ids
        for i in ids[:2]:
            page_id, file, offset, length, kind, digest = index.capture(u, i)
            record = warc.read_record(file, offset, length)
            assert (page_id, record.page_id, record.type) == (i, i, kind) and record.digest == digest
            assert kind == ("response" if i % 3 == 0 else "revisit")
    assert list(index.captures("http://absent.example.com/")) == [] and index.capture(urls[0], 399) is None
    assert [k for k, _ in index.scan(b"")] == sorted(k for k, _ in index.scan(b""))
    some = warc.look_up(spark.createDataFrame([(urls[0],), (urls[0],), ("http://absent/",)], "url string"), master).collect()
    assert sorted(r["page_id"] for r in some) == by[urls[0]]
    assert all(r["payload"] == f"page {r['page_id'] // 3}".encode() for r in some if r["record_type"] == "response")


@pytest.mark.parametrize("url, key", [
    ("http://www.Example.com:80/A?b=1#c", "com,example)/A?b=1"), ("https://a.b.co.uk:8443", "uk,co,b,a:8443)/"), (None, ""), ("mailto:x", "mailto:x"), ("http://[bad", "http://[bad")])
def test_surt(url, key):
    assert warc.surt(url) == key


def test_keys_sort_by_number():
    keys = [warc.capture_key("http://a.b/", i) for i in (-(1 << 63), -5, 0, 7, 10, (1 << 63) - 1, None)]
    assert keys == sorted(keys)


def test_damage_is_seen(tmp_path):
    data = warc.record(1, "http://a/", b"payload", None)
    (tmp_path / "x").write_bytes(data + data[:-4])
    with pytest.raises(ValueError):
        list(warc.read_archive(str(tmp_path / "x")))


def test_steady_rows(spark, sf_dir):
    ws = Workspace(spark, "warc-test")
    files = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    assert warc.steady(ws, files) is files
    moved = files.repartition(4)
    assert warc.steady(ws, moved) is not moved


def test_a_missing_response_is_an_error(spark):
    ws = Workspace(spark, "warc-test")
    pages = spark.createDataFrame([(1, "http://a/", "x"), (2, "http://b/", "x")], "page_id long, url string, html string")
    written = warc.write_archives(ws, pages)
    master = warc.write_index(ws, written.filter("record_type = 'revisit'"))
    with pytest.raises(Exception, match="not in the index"):
        warc.read_back(written, master).collect()
