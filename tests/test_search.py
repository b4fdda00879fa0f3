"""Runs of windows, the index, and all pairs against brute force."""

import random
from collections import defaultdict

import pytest

from palimpsest.config import MatchConfig
from palimpsest.operators import associate, index, search
from palimpsest.operators.fingerprint import hashes_of


def hit_rows(spark, positions):
    return spark.createDataFrame([(1, 1, p, 2, 1) for p in positions], "q_doctype long, q_docid long, pos long, doctype long, docid long")


@pytest.mark.parametrize("first,n,strict,ideal", [(10, 7, 0, 1), (10, 8, 1, 2), (10, 20, 13, 14), (257, 7, 1, 1), (1, 8, 2, 2), (10, 6, 0, 0)])
def test_run_lengths(spark, first, n, strict, ideal):
    rows = hit_rows(spark, range(first, first + n))
    count = lambda c: sum(r["tally"] for r in search.tallies(rows, c).collect())
    assert count(MatchConfig()) == strict
    assert count(MatchConfig(strict=False)) == ideal


def documents(spark, rows):
    return spark.createDataFrame(rows, "doctype long, docid long, text string")


def test_distinct_hashes_and_deletion(spark):
    config = MatchConfig(window=4, posting=4, blank=4, exclude_blank=False)
    docs = documents(spark, [(1, 1, "This is a test"), (1, 2, "This is a test"), (2, 9, "Another test here"), (3, 1, None), (3, 2, "abc")])
    table = index.postings(docs, config)
    assert table.filter("docid = 1").select("hash").distinct().count() == 11
    left = index.without(table, docs.filter("doctype = 2"))
    again = index.postings(docs.filter("doctype <> 2"), config)
    assert sorted(map(tuple, left.collect())) == sorted(map(tuple, again.collect()))
    assert index.postings(docs.filter("false"), config).count() == 0


def test_listing_against_brute_force(spark):
    rng = random.Random(3)
    config = MatchConfig(window=4, posting=4, exclude_blank=False)
    rows = [(rng.randrange(1, 4), i, "".join(rng.choice("ABCD") for _ in range(12))) for i in range(1, 40)]
    lines = defaultdict(set)
    for t, i, x in rows:
        for h in hashes_of(x.encode(), 4, config)[1].tolist():
            lines[h, t].add(i)
    want = [(h, t, len(ids), sorted(ids)) for (h, t), ids in sorted(lines.items())]
    table = index.postings(documents(spark, rows), config)
    got = [(r["hash"], r["doctype"], r["n_docs"], list(r["docids"])) for r in index.listing(table, None, 50).collect()]
    assert got == want[:50]
    start = want[60][0]
    got = [(r["hash"], r["doctype"]) for r in index.listing(table, start, 10).collect()]
    assert got == [w[:2] for w in want if w[0] >= start][:10]
    first = index.listing(table, None, 1).first()
    assert first["bytes"] == sum(max(1, -(-g.bit_length() // 7)) for g in first["gaps"])
    counts = defaultdict(int)
    for _, t, n, _ in want:
        counts[t, n] += 1
    assert {(r["doctype"], r["n_docs"]): r["n_hashes"] for r in index.document_counts(table).collect()} == counts


def test_all_pairs_against_brute_force(spark):
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8))) for _ in range(60)]
    shared = [" ".join(rng.choice(words) for _ in range(14)) for _ in range(4)]
    rows = []
    for i in range(1, 25):
        parts = [" ".join(rng.choice(words) for _ in range(12))]
        if rng.random() < 0.7:
            parts.insert(rng.randrange(2), rng.choice(shared))
        rows.append((1 + i % 3, i, " ".join(parts)))
    config = MatchConfig(results=100)
    want = set()
    for a in rows:
        for b in rows:
            if a[:2] < b[:2]:
                def tally(q, t):
                    pos, h = hashes_of(q[2].encode(), config.short, config)
                    there = set(hashes_of(t[2].encode(), config.short, config)[1].tolist())
                    n, history, last = 0, [], 0
                    for p, x in zip(pos.tolist(), h.tolist(), strict=True):
                        if x in there:
                            history.append((p - last) % 256)
                            last = p
                            n += len(history) >= 7 and history[-7:] == [1] * 7
                    return n
                if (tally(a, b) or tally(b, a)) and (f := associate.fragments(a[2].encode(), b[2].encode(), config)):
                    want.add((*a[:2], *b[:2], len(f), sum(x[2] for x in f)))
    docs = documents(spark, rows)
    got = {tuple(r) for r in associate.summary(associate.associate(docs, docs, config)).collect()}
    assert want and got == want


def test_max_df(spark):
    t = "a line of boilerplate that everybody has at the end of each page"
    docs = documents(spark, [(1, i, t) for i in range(1, 7)])
    assert search.candidates(docs, docs, MatchConfig(max_df=6)).count() == 30
    assert search.candidates(docs, docs, MatchConfig(max_df=5)).count() == 0


def test_both_ways_of_joining_agree(spark, monkeypatch):
    docs = documents(spark, [(1, i, f"number {i} has a passage that is shared by all of them {i % 3}") for i in range(1, 9)])
    a = sorted(map(tuple, search.candidates(docs, docs, MatchConfig()).collect()))
    monkeypatch.setattr(search, "small_hashes", lambda q, limit=0: None)
    assert sorted(map(tuple, search.candidates(docs, docs, MatchConfig()).collect())) == a


@pytest.mark.parametrize("strict", [True, False])
def test_runs_of_windows_tally_alike(spark, strict):
    """Texts of shared and repeated parts, also far into a text and across positions that are alike modulo 256."""
    rng = random.Random(17)
    parts = ["".join(rng.choice("abcdef ") for _ in range(rng.randrange(5, 40))) for _ in range(9)]
    rows = [(1 + i % 3, i, "".join(rng.choice(parts) for _ in range(rng.randrange(1, 30)))) for i in range(1, 40)]
    rows += [(4, 1, rows[0][2] * 12), (4, 2, "x" * 300 + rows[3][2]), (5, 1, None), (5, 2, "short")]
    docs = documents(spark, rows)
    config = MatchConfig(window=10, posting=6, blank=4, strict=strict)
    for query, target in ((docs, None), (docs.filter("doctype < 3"), "2-5")):
        want = sorted(map(tuple, search.tallies(search.hits(query, docs, config, target), config).collect()))
        got = search.run_tallies(query, docs, config, target).select("q_doctype", "q_docid", "doctype", "docid", "tally")
        assert want and sorted(map(tuple, got.collect())) == want


def test_runs_of_windows_bear_empty_tables(spark):
    docs = documents(spark, [(1, 1, "a text that is long enough to have some windows in it")])
    assert search.run_tallies(docs.filter("false"), docs, MatchConfig()).count() == 0
    assert search.run_tallies(docs, docs.filter("false"), MatchConfig()).count() == 0
    assert associate.search(docs, docs, MatchConfig(), many=True).count() == 0


def test_slices_find_what_one_pass_finds(spark):
    """Many candidates whose windows are shared in another order, so none of the first is verified."""
    words = [f"{'abcdefghij'[i]}{i}xyzwv{i}{'klmnopqrst'[i]}" for i in range(10)]
    config = MatchConfig(window=24, posting=8, results=2)
    rng = random.Random(2)
    rows = [(1, 1, " ".join(words))]
    for i in range(2, 60):
        mixed = words[:] * 2
        rng.shuffle(mixed)
        rows.append((1, i, "  ".join(mixed)))
    rows += [(2, 1, f"only {words[3]} {words[4]} here"), (2, 2, f"also {words[5]} {words[6]} there")]
    docs = documents(spark, rows)
    query = docs.filter("doctype = 1 and docid = 1")
    every = associate.verified(search.candidates(query, docs, config).drop("place"), query, docs, config)
    want = sorted((-r["tally"], r["doctype"], r["docid"]) for r in every.collect())[:2]
    got = sorted((-r["tally"], r["doctype"], r["docid"]) for r in associate.search(query, docs, config).collect())
    assert got == want


def test_counts_of_windows(spark):
    from palimpsest.operators.fingerprint import fingerprints

    rng = random.Random(9)
    docs = documents(spark, [(1, i, "".join(rng.choice("ab   ") for _ in range(rng.randrange(0, 90)))) for i in range(1, 30)] + [(2, 1, None)])
    config = MatchConfig(window=12, posting=6)
    got = {(r["doctype"], r["docid"]): (r["n_windows"] - r["n_blank"], r["n_distinct"]) for r in index.windows(docs, config).collect()}
    all_, once = (defaultdict(int), defaultdict(int))
    for counts, distinct in ((all_, False), (once, True)):
        for r in fingerprints(docs, config, distinct=distinct).collect():
            counts[r["doctype"], r["docid"]] += 1
    assert got == {k: (all_[k], once[k]) for k in got} and len(got) == 30
