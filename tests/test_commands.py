"""The command log, in one go and as a stream, and the facade."""

import base64
import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from palimpsest.operators import index
from palimpsest.plans.engine import Engine
from palimpsest.sources.documents import SCHEMA
from palimpsest.streaming import commands


def log(spark, rows):
    return spark.createDataFrame([(q, a, t, i, "", "", x, "Queued") for q, a, t, i, x in rows], commands.LOG)


ROWS = [(1, "add", 1, 1, "a"), (2, "add", 1, 2, "b"), (3, "drop", 1, 1, None), (4, "add", 1, 2, "b2"), (5, "drop", 2, 1, None), (6, "drop", 3, 3, None), (6, "add", 3, 3, "c"), (7, "associate", 1, 1, None), (8, "associate", 1, 2, None)]
START = [(2, 1, "old"), (2, 2, "stays")]
WANT = {(1, 2, "b2"), (3, 3, "c"), (2, 2, "stays")}


def test_fold(spark):
    docs = spark.createDataFrame(START, "doctype long, docid long, text string")
    got = commands.applied(docs, log(spark, ROWS))
    assert {tuple(r) for r in got.collect()} == WANT
    done = {(r["queue_id"], r["action"]): r["status"] for r in commands.finished(log(spark, ROWS), got).collect()}
    assert done[7, "associate"] == "Failed" and done[8, "associate"] == "Finished"
    assert [r["queue_id"] for r in commands.associations_due(log(spark, ROWS), got).collect()] == [8]
    assert [r["action"] for r in commands.listing(log(spark, ROWS), 6, 2).collect()] == ["drop", "add"]
    assert commands.applied(docs, log(spark, []).filter("false")).count() == 2


def test_key():
    assert commands.command_key(4, 1, "add", 2, 1, 1) == "4|00000000000000000001|002|2|0000000001|0000000001||"


def test_stream_equals_one_go(spark, tmp_path):
    docs = spark.createDataFrame(START, "doctype long, docid long, text string")
    versions = commands.Versions(spark, str(tmp_path / "state"))
    docs.write.parquet(str(tmp_path / "state" / "v-1"))
    for i in range(0, len(ROWS), 3):
        log(spark, ROWS[i : i + 3]).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
        commands.run(spark, str(tmp_path / "log"), versions, str(tmp_path / "check"), 1).awaitTermination()
    assert {tuple(r) for r in versions.read().collect()} == WANT
    last = versions.versions()[-1]
    versions.apply(log(spark, ROWS[6:]), last)  # a batch that is run again
    assert {tuple(r) for r in versions.read().collect()} == WANT


def test_numbers_follow_the_order(spark):
    rows = [(i * 7919 % 500, "drop") for i in range(500)]
    got = commands.numbered(spark.createDataFrame(rows, "at long, action string"), 40).collect()
    assert sorted((r["at"], r["queue_id"]) for r in got) == [(i, 41 + i) for i in range(500)]


def test_runs():
    assert commands.runs([(1, "add"), (2, "drop"), (2, "add"), (3, "associate"), (4, "associate"), (5, "load"), (6, "add")]) == [("change", 0, 2), ("associate", 3, 4), ("load", 5, 5), ("change", 6, 6)]
    assert commands.runs([]) == []


def test_cursors(spark):
    some = log(spark, [(q, "drop", 1, q, None) for q in range(1, 26)])
    assert commands.cursors(some, 11, 5) == {"first": 1, "previous": 6, "next": 16, "last": 21, "total": 25}
    assert commands.cursors(some, 1, 100) == {"first": 1, "previous": None, "next": None, "last": 1, "total": 25}
    assert commands.cursors(some.filter("false")) == {"first": None, "previous": None, "next": None, "last": None, "total": 0}


TEXT = "Of this passage every document of the little collection has a copy, word for word."


@pytest.fixture
def engine(spark):
    return Engine(spark, spark.createDataFrame([(1, 1, TEXT, {"title": "A"}), (2, 1, f"Well: {TEXT}", {"title": "B"})], SCHEMA))


def test_engine_reads(engine):
    e = engine
    assert e.search(TEXT).count() == 2 and e.search(TEXT, "2").count() == 1
    assert e.search(TEXT).first()["meta"]["characters"] == str(len(TEXT))
    assert e.text(1, 1).first()[0] == TEXT and e.document(2, 1).first()["meta"]["title"] == "B" and e.text(7, 7).count() == 0
    assert [(r["value"], r["meta"]["docid"]) for r in e.documents(order_by="-title").collect()] == [("B", "1"), ("A", "1")]
    assert e.cursors(order_by="title")["last"]
    for bad in (lambda: e.search(""), lambda: e.search("x", "2-"), lambda: e.text(0, 1), lambda: e.document(1, 0), lambda: e.add(1, ""), lambda: e.add(0, "x"), lambda: e.add(1, "x", 0), lambda: e.associate_all("0"), lambda: e.load("", "1")):
        with pytest.raises(ValueError):
            bad()
    assert "search" in e.describe() and all(e.describe()[n] for n in ("search", "process", "stores"))


def test_answers(engine):
    got = json.loads(engine.search_json(TEXT, "2"))
    row = got["rows"][0]
    assert got["success"] and got["metaData"]["fields"] == ["characters", "docid", "doctype", "title"] and list(row) == ["fragments", "title", "characters", "docid", "doctype"]
    assert row["doctype"] == 2 and row["title"] == "B" and row["fragments"][0][:3] == [0, 6, len(TEXT) - 1]
    page = json.loads(engine.documents_json(order_by="title", limit="x", cursor="a:b:c:d"))
    assert page["total"] == 2 and [r["title"] for r in page["rows"]] == ["A", "B"] and page["cursors"]["current"] == ""


def test_commands_are_applied_in_order(engine):
    e = engine
    e.add(1, f"{TEXT} And more.", title="new", rank="007")
    assert e.add(1, "a short one", associated=True) == 2
    e.drop(2, 1)
    assert e.queue().count() == 4 and e.queue_cursors()["total"] == 4
    assert e.process() == 4 and e.process() == 0
    docs = {(r["doctype"], r["docid"]): r["meta"] for r in e.docs.collect()}
    assert set(docs) == {(1, 1), (1, 2), (1, 3)} and docs[1, 2] == {"title": "new", "rank": "007"} and docs[1, 1] == {"title": "A"}
    assert e.stores().collect()[3]["records"] == 0
    e.associate(1, 2)
    e.associate(9, 9)
    e.process()
    assert {r["queue_id"]: r["status"] for r in e.queue(5).collect()} == {5: "Finished", 6: "Failed"}
    found = e.document(1, 1).first()["associations"]
    assert [(a["doctype"], a["docid"]) for a in found] == [(1, 2)] and found[0]["fragments"][0]["length"] == len(TEXT) - 1
    counts = {r["name"]: r["records"] for r in e.stores().collect()}
    assert counts["Association"] == 2 and counts["Document"] == 3 and counts["Queue"] == 6 and counts["Payload"] == 1
    e.add(1, TEXT, docid=2)  # replaced: its associations and metadata go
    e.process()
    assert e.associations().count() == 0 and e.document(1, 2).first()["meta"].keys() == {"characters", "doctype", "docid"}
    names = {(r["group"], r["name"], r["instance"][:5]) for r in e.performance().collect()}
    assert {("Recent", "change", "Total"), ("Slowest", "associate", "Avera")} <= names


def test_all_pairs_are_saved_once_and_dropped(spark):
    e = Engine(spark, spark.createDataFrame([(1, i, TEXT, None) for i in (1, 2, 3)] + [(2, 1, f"{TEXT} x", None)], SCHEMA))
    e.associate_all()
    e.process()
    assert e.associations().count() == 12
    e.associate_all("1", "2")
    e.process()
    assert e.associations().count() == 12
    for i in (1, 2, 3):
        e.drop(1, i)
    e.process()
    assert e.associations().count() == 0 and e.docs.count() == 1


def test_postings_follow_changes(engine):
    e = engine
    assert e.index(limit=5).count() == 5 and e.store.postings.versions() == [0]
    e.add(3, "Something quite different from all that was there before it came.")
    e.drop(2, 1)
    e.process()
    again = index.postings(e.docs, e.config)
    assert sorted(map(tuple, e.postings().collect())) == sorted(map(tuple, again.collect()))
    assert e.status().first()["doc_count"] == 2 and [h.count() > 0 for h in e.histograms()] == [True, True]
    e.store.clean()
    assert len(e.store.documents.versions()) == 1 and e.docs.count() == 2


def test_a_store_is_opened_again(spark, engine):
    engine.add(5, "kept in the queue")
    engine.queue().count()
    other = Engine(spark, path=engine.store.path)
    assert other.docs.count() == 2 and other.add(5, "second") == 2 and other.process() == 2
    assert {(r["doctype"], r["docid"]) for r in other.docs.filter("doctype = 5").collect()} == {(5, 1), (5, 2)}


def test_loading_from_a_folder_and_from_a_service(spark, engine):
    e = Engine(spark, spark.createDataFrame([(1, 1, "here already", None)], SCHEMA))
    e.load(engine.store.path, "2")
    e.process()
    assert {(r["doctype"], r["docid"], r["meta"]["title"] if r["meta"] else None) for r in e.docs.collect()} == {(1, 1, None), (2, 1, "B")}
    rows = [{"id": i, "doctype": 4, "docid": i, "characters": 9, "title": f"T{i}"} for i in range(1, 24)]
    failures = {"/text/4/3/": 2, "/document/4/": 1}
    asked = []

    class Service(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            path, _, query = self.path.partition("?")
            asked.append((path, self.headers.get("Authorization")))
            if failures.get(path, 0) > 0:
                failures[path] -= 1
                self.send_error(503)
                return
            if path == "/document/4/":
                at = int(dict(x.split("=") for x in query.split("&"))["cursor"] or 0)
                body = json.dumps({"rows": rows[at : at + 10], "cursors": {"next": str(at + 10) if at + 10 < len(rows) else ""}})
            else:
                body = f"text of {path}"
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body.encode())

        def log_message(self, *args):
            pass

    with ThreadingHTTPServer(("127.0.0.1", 0), Service) as server:
        threading.Thread(target=server.serve_forever, daemon=True).start()
        e.load(f"http://me:secret@127.0.0.1:{server.server_port}", "4")
        e.process()
        server.shutdown()
    got = {r["docid"]: (r["text"], r["meta"]) for r in e.docs.filter("doctype = 4").collect()}
    assert got == {i: (f"text of /text/4/{i}/", {"title": f"T{i}"}) for i in range(1, 24)}
    assert asked[0][1] == "Basic " + base64.b64encode(b"me:secret").decode() and not any(failures.values())
    e.load("http://127.0.0.1:1/", "4")
    e.process()
    assert e.queue(3).first()["status"] == "Failed"


def test_many_documents_are_queued_at_once(spark, engine):
    new = spark.createDataFrame([(7, i, f"text {i}", {"n": str(i)}) for i in range(1, 301)], SCHEMA)
    engine.add_all(new)
    assert engine.process(200) == 200 and engine.process(200) == 100
    assert engine.docs.filter("doctype = 7").count() == 300
    assert engine.add(7, "next") == 301
    engine.process()
    assert engine.text(7, 301).first()[0] == "next"
