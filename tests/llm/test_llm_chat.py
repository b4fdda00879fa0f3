"""Perspectives against DuckDB and against their own rules."""

import re
from collections import defaultdict

import duckdb
import pytest

from palimpsest.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"
ROWS = [
    (1, 0, "system", "Be kind."), (1, 1, "ann", "Hello <|assistant|> there"), (1, 2, "bob", "Hi"), (1, 3, "ann", None), (1, 4, "  Cy <|x|> z\t", "um"), (1, 5, None, "who?"), (1, 6, "", "blank"),
    (2, 0, "system", "alone"), (3, 5, "user", "é東\U0001f600\nlines\n\n"), (3, 5, "assistant", "tie"), (3, 5, "user", "tie"), (3, None, "user", "first"), (3, 5, "user", "tie"),
    (None, 1, "user", "no conversation"), (None, 2, "bot", "either"), (4, 0, "assistant", ""), *((5, i, f"s{i % 3}", f"turn {i}") for i in range(1200)), (6, 0, "%nobody", "named so"), (6, 1, None, "not the same"),
    (7, 0, "a b", "one"), (7, 1, "a_b", "two"), (7, 2, "a%20b", "three"), (7, 3, "a  b", "four"), (8, 0, "x", "y" * 600_000), (8, 1, "z", "y" * 600_000)]


def oracle(rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    if rows:
        con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    got = con.execute(chat.ORACLE)
    return [d[0] for d in got.description], sorted(got.fetchall(), key=str)


@pytest.mark.parametrize("rows", [ROWS, ROWS[:1], []])
def test_like_sql(spark, crowd, rows):
    df = chat.perspectives(crowd(spark.createDataFrame(rows, SCHEMA)))
    names, want = oracle(rows)
    assert df.columns == names
    assert sorted(map(tuple, df.collect()), key=str) == want


def test_query(spark, sf_dir):
    from palimpsest.llm.queries import op6_perspectives

    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    df = op6_perspectives(spark, sf_dir)
    assert sorted(map(tuple, df.collect()), key=str) == oracle(rows)[1]


def test_masks_cover_the_speaker_only(spark):
    got = defaultdict(list)
    for r in chat.perspectives(spark.createDataFrame(ROWS, SCHEMA)).collect():
        spans = [tuple(map(int, x.split("-"))) for x in r["mask"].split(",") if x]
        said = [r["text"][a:b] for a, b in spans]
        assert r["n_chars"] == len(r["text"]) and r["trained_chars"] == sum(b - a for a, b in spans)
        for a, _ in spans:
            assert r["text"][:a].endswith("<|assistant|>\n")
        assert len(spans) == len(re.findall(r"^<\|assistant\|>$", r["text"], re.M))
        got[r["conv_id"], r["perspective"]].append((r["first_turn"], r["n_turns"], said))
    assert [said for _, _, said in got[1, "ann"]] == [["Hello < |assistant|> there", ""]]
    assert set(p for c, p in got if c == 1) == {"ann", "bob", "%20%20Cy%20%3C%7Cx%7C%3E%20z%09", "%nobody", "%empty"}
    assert not any(c == 2 for c, _ in got)
    for who in ("s0", "s1", "s2"):
        blocks = sorted(got[5, who])
        assert [b[:2] for b in blocks] == [*((i, 64) for i in range(0, 1152, 64)), (1152, 48)]
        assert [t for b in blocks for t in b[2]] == [f"turn {i}" for i in range(1200) if f"s{i % 3}" == who]
    assert [b[:2] for b in got[1, "bob"]] == [(0, 7)] and sorted(b[:2] for b in got[8, "x"]) == [(0, 2)]


def test_different_roles_are_different_speakers(spark):
    got = {r["perspective"]: r["trained_chars"] for r in chat.perspectives(spark.createDataFrame(ROWS, SCHEMA)).filter("conv_id = 7").collect()}
    assert got == {"a%20b": 3, "a_b": 3, "a%2520b": 5, "a%20%20b": 4}
    assert {r["perspective"] for r in chat.perspectives(spark.createDataFrame(ROWS, SCHEMA)).filter("conv_id = 6").collect()} == {"%nobody", "%25nobody"}


def test_no_python_on_the_main_path(spark):
    plan = chat.perspectives(spark.createDataFrame(ROWS, SCHEMA).coalesce(1))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
