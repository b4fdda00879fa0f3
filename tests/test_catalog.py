"""Ranges of types, pages and cursors, sources."""

import json

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import catalog, ranges
from palimpsest.sources import documents as src


@pytest.mark.parametrize("spec,n", [("", 0), ("1", 1), ("1-10", 10), ("1-10:21-40", 30), ("6-5", 2), ("6-5:1-10", 10)])
def test_ranges(spec, n):
    assert ranges.size(spec) == n


@pytest.mark.parametrize("spec", ["1:", "0", "1-0", "6-5:1-10:", "6-5-34:1-10", "x", "-1"])
def test_bad_ranges(spec):
    with pytest.raises(ValueError):
        ranges.parse(spec)


@pytest.fixture(scope="module")
def many(spark):
    rows = [(i, j, "This is a test", {"title": f"Test{j:010d}"}) for i in range(1, 5) for j in range(1, 301)]
    return spark.createDataFrame(rows, src.SCHEMA).repartition(3).cache()


@pytest.mark.parametrize("page,want", [
    (catalog.Page("1", "title"), ("", "Test0000000001:1:1", "Test0000000101:1:101", "Test0000000201:1:201")),
    (catalog.Page("1", "-title"), ("", "Test0000000300:1:300", "Test0000000200:1:200", "Test0000000100:1:100")),
    (catalog.Page("2", "-title", "Test0000000201:2:201"), ("", "Test0000000300:2:300", "Test0000000101:2:101", "Test0000000100:2:100")),
])
def test_cursors(many, page, want):
    got = catalog.cursors(many, page)
    assert (got["first"], got["previous"], got["next"], got["last"]) == want


@pytest.mark.parametrize("page,n", [(catalog.Page(), 100), (catalog.Page(limit=1000), 1000), (catalog.Page("1", limit=1000), 300), (catalog.Page(cursor="1:1:2"), 100), (catalog.Page("9"), 0)])
def test_page_sizes(many, page, n):
    assert catalog.page(many, page).count() == n


def test_bare_cursors(spark):
    titles = ["Also a test", "Also a test", "Final test"]
    docs = spark.createDataFrame([(t, i + 1, "x", {"title": titles[i]}) for t in (1, 2) for i in range(3)], src.SCHEMA)
    count = lambda **k: catalog.page(docs, catalog.Page("1-2", **k)).count()
    assert count(order_by="title", cursor="Also a test") == 6
    assert count(order_by="title", cursor="Final test") == 2
    assert count(order_by="-title", cursor="Final test") == 4
    assert count(order_by="missing") == 0
    assert catalog.cursors(docs, catalog.Page(order_by="missing")) == {"first": "", "previous": "", "next": "", "last": ""}


def test_metadata(spark):
    docs = spark.createDataFrame([(1, 2, "äb", {"title": "x", "none": ""}), (1, 3, None, None)], src.SCHEMA)
    got = {(r["docid"], r["key"]): r["value"] for r in catalog.long_form(docs).collect()}
    assert got[2, "characters"] == "3" and got[3, "characters"] == "0" and (2, "none") not in got and got[2, "title"] == "x"


def test_forms_and_folders(spark, tmp_path):
    assert src.form("text=a+b&title=T%20x", 1, 2) == {"doctype": 1, "docid": 2, "text": "a b", "meta": {"title": "T x"}}
    with pytest.raises(ValueError):
        src.form("title=x", 1, 1)
    got = src.forms(spark.createDataFrame([(1, 1, "text=a+b&title=x%3Dy"), (1, 2, "title=z")], "doctype long, docid long, payload string")).collect()
    assert [(r["docid"], r["text"], r["meta"]) for r in got] == [(1, "a b", {"title": "x=y"})]
    for d, names in {"one": ["b.txt", "a.txt"], "two": ["c.txt"]}.items():
        (tmp_path / d).mkdir()
        for n in names:
            (tmp_path / d / n).write_text(f"text of {n}\nsecond line")
    got = sorted((r["doctype"], r["docid"], r["meta"]["title"], r["meta"]["group"]) for r in src.folder(spark, str(tmp_path)).collect())
    assert got == [(1, 1, "a.txt", "one"), (1, 2, "b.txt", "one"), (2, 1, "c.txt", "two")]


def test_new_documents(spark):
    have = spark.createDataFrame([(1, 1, "x", {}), (1, 5, "y", {})], src.SCHEMA)
    new = spark.createDataFrame([(1, 5, "other", {}), (1, 6, "z", {})], src.SCHEMA)
    assert [r["docid"] for r in src.missing_from(new, have).collect()] == [6]
    assert sorted(r["docid"] for r in src.numbered(new.drop("docid"), have).collect()) == [6, 7]
    assert src.as_json(have.select("doctype", "docid").limit(1)).first()[0].startswith('{"doctype":1')


def test_forms_bear_bad_input(spark):
    payloads = ["text=a&k=1&k=2", "text=%zz&x=%41", "k=1", "", None, "&&=x&text=y&k", "text=a&text="]
    got = src.forms(spark.createDataFrame([(1, i, p) for i, p in enumerate(payloads)], "doctype long, docid long, payload string"))
    rows = {r["docid"]: (r["text"], r["meta"]) for r in got.collect()}
    assert rows == {0: ("a", {"k": "2"}), 1: ("%zz", {"x": "A"}), 5: ("y", {"k": ""})}


def test_numbers_within_a_large_type(spark):
    rows = [(1, f"t{i:04d}") for i in range(700)] + [(2, "x"), (2, "a")]
    df = spark.createDataFrame(rows, "g long, t string").repartition(5)
    got = {(r["g"], r["t"]): r["n"] for r in src.ranked_within(df, "g", ["t"], "n").collect()}
    assert got == {**{(1, f"t{i:04d}"): i + 1 for i in range(700)}, (2, "a"): 1, (2, "x"): 2}


def test_other_sources_keep_a_type(spark, tmp_path):
    df = spark.createDataFrame([(0, "a", "en", "src4"), (1, "b", "en", "web"), (2, "c", "en", None)], "doc_id long, text string, lang string, source string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    assert {r["docid"]: r["doctype"] for r in src.corpus(spark, str(tmp_path)).collect()} == {1: 5, 2: src.OTHER, 3: src.OTHER}


def test_parameters_give_way_to_defaults():
    P = catalog.Page
    assert P.asked(None, "a b", "x:y", "ten") == P(None, "doctype", "", 100)
    assert P.asked("1", "-title", "x:1:2", "7") == P("1", "-title", "x:1:2", 7)
    with pytest.raises(ValueError):
        P(order_by="a b")
    with pytest.raises(ValueError):
        P(limit=-1)


def test_typed_metadata(spark):
    docs = spark.createDataFrame([(1, 2, "x", {"title": 'a "b"', "n": "12", "zip": "007", "z": "-", "e": ""})], src.SCHEMA)
    text = catalog.metadata(docs).select(catalog.typed(F.col("meta"))).first()[0]
    got = json.loads("{" + text + "}")
    assert list(got) == ["title", "characters", "docid", "doctype", "n", "z", "zip"]
    assert got == {"title": 'a "b"', "characters": 1, "docid": 2, "doctype": 1, "n": 12, "z": "-", "zip": "007"}
    assert [r["key"] for r in catalog.field_list(docs).orderBy("place").collect()] == ["title", "characters", "docid", "doctype", "n", "z", "zip"]
