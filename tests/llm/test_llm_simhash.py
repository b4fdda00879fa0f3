"""SimHash near-duplicates against all pairs."""

import re
from itertools import combinations

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest.llm import simhash
from palimpsest.llm.common import Workspace


def shingles(text, size=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []


def slow_fingerprint(text):
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles(text)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def smallest(keys, linked):
    up = {k: k for k in keys}

    def root(a):
        while up[a] != a:
            a = up[a]
        return a

    for a, b in linked:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {k: root(k) for k in keys}


def brute(rows):
    prints = [(k, slow_fingerprint(t)) for k, t in rows]
    linked = [(a, b) for (a, x), (b, y) in combinations([p for p in prints if p[0] is not None], 2) if bin(x ^ y).count("1") <= 4]
    name = smallest({k for k, _ in prints if k is not None}, linked)
    return sorted((k, f"{fp:016x}", name[k]) for k, fp in prints if k is not None)


@settings(max_examples=100, deadline=None)
@given(st.text(st.sampled_from("aAbÉé \t\nc東"), max_size=80))
def test_fingerprint(text):
    assert simhash.fingerprint(text) == slow_fingerprint(text)


def test_long_text_in_slices():
    text = " ".join(f"w{i * i % 1009}" for i in range(40_000))
    assert simhash.fingerprint(text) == slow_fingerprint(text)


def test_query(spark, sf_dir, document_rows):
    from palimpsest.llm.queries import op8_simhash

    df = op8_simhash(spark, sf_dir)
    assert df.dtypes == [("doc_id", "bigint"), ("fingerprint", "string"), ("component_id", "bigint")]
    assert sorted(map(tuple, df.collect())) == brute(document_rows)


def test_edges(edge, edge_rows):
    got = [tuple(r) for r in simhash.near_duplicates(edge).collect()]
    assert sorted(r for r in got if r[0] is not None) == brute(edge_rows)
    (lone,) = [r for r in got if r[0] is None]
    assert lone[2] is None and lone[1] == f"{slow_fingerprint(edge_rows[0][1]):016x}"


def test_empty(no_documents):
    assert simhash.near_duplicates(no_documents).count() == 0
    assert simhash.deduplicate(no_documents).count() == 0


@pytest.mark.parametrize("tiles, words", [(1, 1), (9, 1), (40, 1), (9, 4)])
def test_tiles_lose_nothing(spark, tiles, words):
    rng = np.random.default_rng(tiles)
    base = rng.integers(0, 1 << 63, (60, words), dtype=np.uint64)
    rows = []
    for i in range(600):
        value = base[i % 60].copy()
        for bit in rng.choice(64 * words, rng.integers(0, 7), replace=False):
            value[bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
        if i % 97 == 0:
            value[:] = 0 if i % 2 else np.uint64((1 << 64) - 1)
        rows.append((1000 - i, value.astype(">u8").tobytes()))
    numbers = [(k, int.from_bytes(fp, "big")) for k, fp in rows]
    name = smallest([k for k, _ in rows], [(a, b) for (a, x), (b, y) in combinations(numbers, 2) if bin(x ^ y).count("1") <= 4])
    ws = Workspace(spark, "simhash-test")
    prints = ws.table(spark.createDataFrame(rows, "doc_id long, fp binary"), "prints")
    got = {bytes(r["fp"]): r["component"] for r in simhash.components(ws, prints, words=words, tiles=tiles).collect()}
    assert all(got[fp] == name[k] for k, fp in rows)


def test_skipped_blocks_are_far():
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 1 << 63, (50, 1), dtype=np.uint64), rng.integers(0, 1 << 63, (50, 1), dtype=np.uint64)
    qa, qb = simhash._quarters(a), simhash._quarters(b)
    least = min(int(np.bitwise_count(x ^ y)) for x in a[:, 0] for y in b[:, 0])
    assert simhash._gap(qa.min(axis=0), qa.max(axis=0), qb.min(axis=0), qb.max(axis=0)) <= least
    for x, y in zip(a, b, strict=True):
        q, r = simhash._quarters(x[None]), simhash._quarters(y[None])
        assert simhash._gap(q[0], q[0], r[0], r[0]) <= int(np.bitwise_count(x ^ y)[0])


@pytest.mark.parametrize("block", [3, 1000])
def test_forest_connects_like_all_pairs(block):
    rng = np.random.default_rng(block)
    values = (rng.integers(0, 1 << 9, (80, 1)).astype(np.uint64) << np.uint64(20)) | np.uint64(7)
    for split in (None, 30):
        ok = lambda i, j, split=split: split is None or (i < split) != (j < split)
        want = smallest(range(80), [(i, j) for i, j in combinations(range(80), 2) if ok(i, j) and bin(int(values[i, 0] ^ values[j, 0])).count("1") <= 1])
        child, root = simhash.forest(values, split, 1, block)
        assert smallest(range(80), zip(child.tolist(), root.tolist(), strict=True)) == want and len(child) == 80 - len(set(want.values()))


def similarity(a, b):
    x, y = set(shingles(a, 5)), set(shingles(b, 5))
    return len(x & y) / len(x | y) if x | y else 1.0


def test_deduplicate(spark, crowd):
    rng = np.random.default_rng(2)
    text = lambda n: [f"word{i}" for i in rng.integers(0, 3000, n)]
    rows, near = [], {}
    for g in range(40):
        words = text(int(rng.integers(120, 600)))
        rows.append((g * 10 + 5, " ".join(words)))
        for c in range(1, 4):
            other = words.copy()
            for at in rng.choice(len(words), max(1, len(words) // 100), replace=False):
                other[at] = "changed"
            rows.append((g * 10 + 5 + c, " ".join(other)))
            near[g * 10 + 5 + c] = g * 10 + 5
    assert all(similarity(dict(rows)[a], dict(rows)[b]) >= 0.8 for a, b in near.items())
    shared = text(60)
    rows += [(2000 + i, " ".join(text(150) + shared + text(150))) for i in range(20)]  # a passage in common is no copy
    rows += [(3000, None), (3001, ""), (3002, " "), (None, "kept as it is"), (None, "kept as it is"), (5, dict(rows)[5])]
    df = crowd(spark.createDataFrame(rows, "doc_id long, text string"))
    kept = simhash.deduplicate(df)
    assert kept.columns == df.columns
    got = sorted((r["doc_id"] for r in kept.collect()), key=str)
    assert got == sorted([None, None, 3000, *(g * 10 + 5 for g in range(40)), *range(2000, 2020)], key=str)


def components_by_sets(rows, limit=0.8):
    """The smallest key of each key's component over all pairs of the similarity, by brute force."""
    sets = {k: set(shingles(t, 5)) for k, t in rows}
    linked = [(a, b) for a, b in combinations(sorted(sets), 2) if (len(sets[a] & sets[b]) >= limit * len(sets[a] | sets[b]) - 1e-9)]
    return smallest(sorted(sets), linked)


def test_deduplicate_whole_table(documents, document_rows):
    """No link at the similarity is missed, and none below it is made."""
    kept = {r["doc_id"] for r in simhash.deduplicate(documents).select("doc_id").collect()}
    assert kept == set(components_by_sets(document_rows).values())


@pytest.mark.parametrize("tiles", [1, 5])
def test_links_are_those_of_the_sets(spark, monkeypatch, tiles):
    """Families around the similarity, of short and long texts, that no SimHash tells apart; blocks of few rows."""
    monkeypatch.setattr(simhash, "VERIFY_BLOCK", 16)
    monkeypatch.setattr(simhash, "COLUMNS", 50)
    rng = np.random.default_rng(tiles)
    rows = []
    for g in range(60):
        n = int(rng.integers(5, 24)) if g % 3 == 0 else int(rng.integers(30, 200))
        words = [f"w{i}" for i in rng.integers(0, 5000, n)]
        for _ in range(6):
            other = words.copy()
            for at in rng.choice(n, int(rng.integers(0, max(2, n // 25))), replace=False):
                other[at] = f"x{rng.integers(0, 9)}"
            cut = int(rng.integers(0, max(1, n // 6)))
            rows.append((len(rows), " ".join(other[cut:])))
    want = components_by_sets(rows)
    assert 60 < len(set(want.values())) < len(rows) - 60
    ws = Workspace(spark, "simhash-test")
    df = spark.createDataFrame([(k, k, t) for k, t in rows], "r long, k long, t string")
    prints = ws.table(simhash.shingle_sets(df, 5, 16), "prints")
    found = simhash.duplicate_groups(ws, prints, 0.8, 16, tiles)
    got = {r["k"]: r["component"] for r in prints.join(found, "cid").select("k", "component").collect()}
    assert got == want


def test_verified_links_against_all_pairs(monkeypatch):
    monkeypatch.setattr(simhash, "COLUMNS", 7)
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 1 << 40, 40).astype(np.uint64)
    sets = [np.unique(pool[rng.choice(40, int(rng.integers(0, 12)), replace=False)]) for _ in range(80)]
    want = smallest(range(80), [(i, j) for i, j in combinations(range(80), 2) if len(set(sets[i]) & set(sets[j])) >= 0.5 * len(set(sets[i]) | set(sets[j]))])
    child, root = simhash.verified_links(sets, 0.5)
    assert smallest(range(80), zip(child.tolist(), root.tolist(), strict=True)) == want
    assert [len(x) for x in simhash.verified_links([], 0.5)] == [0, 0]


def test_sets_are_kept_whole():
    hashes = np.unique(np.random.default_rng(1).integers(0, 1 << 64, 1000, dtype=np.uint64))
    packed = np.ascontiguousarray(hashes.astype(">u8").view(np.uint8).reshape(-1, 8)[:, : simhash.HASH_BYTES]).tobytes()
    assert (simhash._set(packed) == hashes >> np.uint64(64 - 8 * simhash.HASH_BYTES)).all() and len(simhash._set(b"")) == 0


@pytest.mark.parametrize("shared, left, right", [(4, 1, 0), (8, 1, 1), (16, 2, 2), (100, 13, 12), (1, 0, 0)])
def test_bits_that_differ(shared, left, right):
    rng = np.random.default_rng(shared)
    s, x, y = (rng.integers(0, 2, (n, 200_000)).sum(axis=0) for n in (shared, left, right))
    got = ((2 * (s + x) > shared + left) != (2 * (s + y) > shared + right)).mean()
    assert simhash.differ(shared, left, right) == pytest.approx(got, abs=0.004)


def test_radius():
    assert simhash.radius_for(1.0, 8) == 0
    mean = 1024 * simhash.differ(4, 1, 0)  # the worst that sets of this similarity come to
    assert simhash.radius_for(0.8, 16, 0.0) == mean and simhash.radius_for(0.8, 16) == np.ceil(mean + 5 * (mean * (1 - mean / 1024)) ** 0.5)
    large = 1024 * np.arccos(0.8 * 2 / 1.8) / np.pi
    assert simhash.radius_for(0.8, 16) > large + 5 * (large * (1 - large / 1024)) ** 0.5


def test_deduplicate_counts_repeated_lines_once(spark):
    """Near copies of which one repeats a sentence have nearly the same shingle sets."""
    rng = np.random.default_rng(7)
    rows = []
    for g in range(20):
        words = [f"word{i}" for i in rng.integers(0, 100_000, 200)]
        line = [f"line{i}" for i in rng.integers(0, 100_000, 10)]
        rows += [(2 * g, " ".join(words)), (2 * g + 1, " ".join(words + line * 6))]
    assert all(similarity(rows[i][1], rows[i + 1][1]) >= 0.9 for i in range(0, len(rows), 2))
    kept = simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(0, len(rows), 2))


def test_distinct_sketch_of_a_long_text():
    words = [f"w{i}" for i in range(40_000)]
    once, thrice = " ".join(words), " ".join(words * 3)
    a, b = simhash.sketch(once, 5, 4, True), simhash.sketch(thrice, 5, 4, True)
    assert (simhash.sketch(once, 5, 4) == a).all() and int(np.bitwise_count(a ^ b).sum()) <= 4


def test_near_counts_all_words():
    """Bits that differ may stand in any words, all of a word's too."""
    rng = np.random.default_rng(4)
    radius, words = 179, 16
    a = rng.integers(0, 1 << 64, (300, words), dtype=np.uint64)
    b = rng.integers(0, 1 << 64, (200, words), dtype=np.uint64)
    for i in range(200):  # 100 pairs at the radius and 100 a bit beyond
        heads = 64 if i % 4 < 2 else int(rng.integers(0, 40))
        bits = [*range(heads), *(64 + rng.choice(960, radius + i % 2 - heads, replace=False)).tolist()]
        b[i] = a[i]
        for bit in bits:
            b[i, bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    want = [(i, i) for i in range(0, 200, 2)]
    u, v = simhash._near(a, b, radius)
    assert sorted(zip(u.tolist(), v.tolist(), strict=True)) == want
    child, root = simhash.forest(np.concatenate([a, b]), 300, radius)
    assert list(zip(root.tolist(), (child - 300).tolist(), strict=True)) == want
    u, v, met = simhash.near_links(np.concatenate([a, b]), 300, radius - 20, wide=radius)
    assert len(u) == 0 and met.tolist() == sorted([*range(0, 200, 2), *range(300, 500, 2)])
    u, v, _ = simhash.near_links(np.concatenate([a, b]), 300, radius)
    assert sorted(zip(u.tolist(), (v - 300).tolist(), strict=True)) == want


@pytest.mark.parametrize("split", [None, 40])
def test_near_links_are_links(split):
    rng = np.random.default_rng(12)
    values = (rng.integers(0, 1 << 9, (90, 1)).astype(np.uint64) << np.uint64(20)) | np.uint64(7)
    apart = lambda i, j: bin(int(values[i, 0] ^ values[j, 0])).count("1")
    ok = lambda i, j: (split is None or (i < split) != (j < split)) and apart(i, j) <= 1
    u, v, _ = (x.tolist() for x in simhash.near_links(values, split, 1, 16))
    assert all(ok(i, j) for i, j in zip(u, v, strict=True))
    want = smallest(range(90), [p for p in combinations(range(90), 2) if ok(*p)])
    assert smallest(range(90), zip(u, v, strict=True)) == want and len(u) == 90 - len(set(want.values()))


def test_deduplicate_compares_no_tiles(spark, monkeypatch):
    """Unrelated texts never meet: sketches compared by pairs of tiles make the time grow with the square of the texts."""

    def all_pairs(*_):
        raise AssertionError("texts are compared by all pairs of tiles")

    made = []
    candidates = simhash._candidates
    monkeypatch.setattr(simhash, "_tile_table", all_pairs)
    monkeypatch.setattr(simhash, "_candidates", lambda *a: made.append(candidates(*a)) or made[-1])
    rng = np.random.default_rng(5)
    shared = "words that stand in every text of this table and make no copies of them"
    rows = [(i, f"{' '.join(f'w{x}' for x in rng.integers(0, 100_000, 150))} {shared}") for i in range(300)]
    rows += [(300 + i, f"{rows[i][1]} more") for i in range(20)]
    kept = simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(300))
    assert [x.count() for x in made] == [20, 0]


@pytest.mark.parametrize("similarity", [0.5, 0.8, 1.0])
def test_first_shingles_find_every_pair(similarity):
    """Sets at the similarity share as many first elements as is asked of them, in any order that they agree on."""
    rng = np.random.default_rng(8)
    pool, met = np.unique(rng.integers(0, 1 << 40, 2000).astype(np.uint64)), 0
    frequent = np.sort(rng.choice(pool, 300, replace=False))
    counts = rng.integers(2, 9, 300)
    for _ in range(4000):
        a = np.sort(rng.choice(pool, int(rng.integers(1, 120)), replace=False))
        more = rng.choice(pool, int(rng.integers(0, 1 + len(a) // 4)), replace=False)
        b = np.unique(np.concatenate([rng.choice(a, max(1, len(a) - int(rng.integers(0, 1 + len(a) // 4))), replace=False), more]))
        shared = len(np.intersect1d(a, b))
        if not simhash.alike(shared, len(a), len(b), similarity):
            continue
        met += 1
        x, y = (simhash.first_shingles(s, similarity, frequent, counts) for s in (a, b))
        assert len(x) == simhash.first_length(len(a), similarity) and len(np.intersect1d(x, y)) >= simhash.first_shared(len(a), len(b), similarity)
        assert simhash.first_shared(len(a), len(b), similarity) >= min(simhash.SHARED, simhash.least_shared(min(len(a), len(b)), similarity))
    assert met > 100


@pytest.mark.parametrize("long_run", [2, 1000])
def test_pairs_of_different_groups(monkeypatch, long_run):
    monkeypatch.setattr(simhash, "LONG_RUN", long_run)
    monkeypatch.setattr(simhash, "PAIRS", 10)
    rng = np.random.default_rng(long_run)
    rows = sorted({(int(t), int(r)) for t, r in rng.integers(0, 30, (200, 2))})
    size, group = rng.integers(10, 20, 30), rng.integers(0, 4, 30)
    t, n, r = (np.array(x) for x in zip(*sorted((t, int(size[r]), r) for t, r in rows), strict=True))
    fits = lambda i, j: t[i] == t[j] and group[r[i]] != group[r[j]] and min(n[i], n[j]) >= 0.8 * max(n[i], n[j]) - 1e-9
    want = [(i, j) for i, j in combinations(range(len(t)), 2) if fits(i, j)]
    made = lambda following: sorted((int(i), int(j)) for x, y in simhash._pairs(t, r, n, group[r], 0.8, following) for i, j in zip(x, y, strict=True))
    assert made(None) == want
    some = made(1)
    assert len(some) == len(set(some)) and set(some) < set(want)


def test_large_family_around_the_similarity(spark, monkeypatch):
    """Many texts of one origin, of which some pairs are at the similarity and others just below, with runs of all kinds."""
    monkeypatch.setattr(simhash, "LONG_RUN", 8)
    monkeypatch.setattr(simhash, "SAMPLE", 20)
    rng = np.random.default_rng(9)
    base, rows = [f"w{i}" for i in range(150)], []
    for k in range(120):
        words = base.copy()
        for at in rng.choice(150, int(rng.integers(0, 9)), replace=False):
            words[at] = f"x{rng.integers(0, 40)}"
        rows.append((k, " ".join(words)))
    want = components_by_sets(rows)
    assert 1 < len(set(want.values())) < 100
    kept = simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want.values()))
