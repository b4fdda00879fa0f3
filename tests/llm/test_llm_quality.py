"""Quality rules against brute force, and what they keep of labelled documents."""

import math
import re
import struct
from collections import Counter

import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def counted(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), n < 20 or 100 * len(covered) > 30 * n


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def grams(text):
    one = [xxhash.xxh64_intdigest(w.encode(), 42) for w in WORD.findall(text or "")]
    two = [xxhash.xxh64_intdigest(struct.pack("<Q", b), xxhash.xxh64_intdigest(struct.pack("<Q", a), 42)) for a, b in zip(one, one[1:], strict=False)]
    return [signed(h) % quality.BUCKETS for h in one + two]


def brute(rows, trusted):
    raw, good = Counter(), Counter()
    for key, text in rows:
        g = grams(text)
        raw.update(g)
        if key in trusted:
            good.update(g)
    n, m = sum(raw.values()), sum(good.values())
    mu = max(quality.PRIOR * quality.BUCKETS, quality.PRIOR_SHARE * m)
    weight = {b: math.log((good[b] + mu * r / n) / (m + mu) / (r / n)) if m else 0.0 for b, r in raw.items()}
    out = []
    for key, text in rows:
        g, base = grams(text), counted(text)
        llr = sum(weight[b] for b in g) / len(g) if g else 0.0
        out.append((key, *base, llr, not base[-1] and llr >= quality.THRESHOLD))
    return out


def same(got, want):
    assert len(got) == len(want)
    name = lambda x: str(x[:6])
    for g, w in zip(sorted(got, key=name), sorted(want, key=name), strict=True):
        assert g[:7] == w[:7] and abs(g[7] - w[7]) < 1e-6
        assert g[8] == w[8] or abs(w[7] - quality.THRESHOLD) < 1e-6


def pulled(df):
    return [tuple(r) for r in df.select("doc_id", *BASE, "llr", "kept").collect()]


def test_whole_table(documents, document_rows, labels):
    trusted = {r["doc_id"] for r in labels.filter("quality = 1").collect()}
    same(pulled(quality.judge(documents, labels)), brute(document_rows, trusted))


def test_edges(spark, edge, edge_rows):
    lines = [
        (20, "one two three four five six seven eight\n" * 5), (21, "a b c d e f g h " * 3 + " ".join(f"x{i}" for i in range(90))), (22, "a a a a a a a a a b c d e f g h i j k l m"),
        (23, "x\n x\n x\n\n\n\t\nx\r\nx\r\n"), (24, "# * $ % & | < > ##"), (25, "wide space and next\x85line"), (26, " ".join("ab" * 40)), (27, "tie\ntie\ntie")]
    rows = edge_rows + lines
    df = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(21, 1, 0), (21, 1, 0), (20, 0, 0), (None, 1, 1), (999, 1, 0), (4, 1, 0), (5, None, None)], "doc_id long, quality int, toxic int")
    same(pulled(quality.judge(df, marks)), brute(rows, {21, 4}))
    again = quality.judge(edge.withColumn("Kept", edge.doc_id), marks)
    assert again.count() == len(edge_rows) and {c.lower() for c in again.columns} >= {"kept", "llr", "rank", "shard"}
    none = marks.filter("false")
    assert {r["llr"] for r in quality.judge(df, none).collect()} == {0.0}


def test_empty(no_documents, labels):
    assert quality.judge(no_documents, labels).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.sampled_from("ab"), max_size=60), min_size=1, max_size=4))
def test_repeats(spark, texts):
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    got = quality.scored(spark.createDataFrame(rows, "doc_id long, text string"), [0.0] * quality.BUCKETS).collect()
    assert {r["doc_id"]: r["n_repeat_words"] for r in got} == {k: counted(t)[4] for k, t in rows}


def test_query_keeps_clean_documents(spark):
    from palimpsest.llm.queries import op5_quality_rules

    sf = "/root/testdata/sf0.01"
    df = op5_quality_rules(spark, sf)
    assert df.dtypes[:8] == [("doc_id", "bigint"), *[(c, "bigint") for c in BASE[:5]], ("base_failed", "boolean"), ("kept", "boolean")]
    marked = df.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("not base_failed").select("quality", "kept").collect()
    rate = {q: sum(r["kept"] for r in marked if r["quality"] == q) / sum(r["quality"] == q for r in marked) for q in (0, 1)}
    assert rate[1] >= 0.99 and rate[0] <= 0.15


def test_no_python_on_the_main_path(documents, labels):
    plan = quality.judge(documents, labels)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


@pytest.mark.parametrize("raw, good", [([0, 0], [0, 0]), ([3, 0], [0, 0])])
def test_nothing_to_learn_from(raw, good):
    assert quality.ratios(raw, good) == [0.0, 0.0]


def test_ids_beyond_the_broadcast_count_alike(documents, labels, monkeypatch):
    want = quality.log_ratios(documents, labels)
    monkeypatch.setattr(quality, "BROADCAST_IDS", 3)
    assert quality.log_ratios(documents, labels) == want


def test_ratios_settle_as_the_trusted_sample_grows():
    """Ten times as many trusted documents of the same kind, of which there are many, leave every ratio as it was."""
    raw, good = [40_000_000 + i for i in range(1000)], [3_000_000 + 900 * i for i in range(1000)]
    one, ten = quality.ratios([r * 10 for r in raw], good), quality.ratios([r * 100 for r in raw], [g * 10 for g in good])
    assert all(abs(a - b) < 1e-6 for a, b in zip(one, ten, strict=True))
