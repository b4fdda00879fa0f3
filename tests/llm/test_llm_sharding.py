"""Shards: counts, slots, digests, and how many copies are parted."""

import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from palimpsest.llm import sharding
from palimpsest.llm.common import Workspace


def checked(got, rows, shards):
    """The law of equal counts, slots, sizes and digests; for each text, the rows outside its largest shard."""
    want = Counter((k, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for k, t in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        assert r["law"] == "rows" and r["grown_shard"] is None
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values()) and slots.keys() <= set(range(shards))
    counts = [len(slots[s]) for s in range(shards)]
    assert max(counts) - min(counts) <= 1
    by = defaultdict(Counter)
    for r in got:
        by[r["text_crc32"], r["size"]][r["shard"]] += 1
    return {k: sum(c.values()) - max(c.values()) for k, c in by.items()}


def test_query(spark, sf_dir, document_rows):
    from palimpsest.llm.queries import op4_sharding

    df = op4_sharding(spark, sf_dir)
    assert dict(df.dtypes) == {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"}
    assert sum(checked(df.collect(), document_rows, 40).values()) == 0  # every group is smaller than a shard, and whole


def test_edges(edge, edge_rows):
    checked(sharding.shard_rows(edge, shards=5).collect(), edge_rows, 5)
    checked(sharding.shard_rows(edge).collect(), edge_rows, 40)


def test_empty(no_documents):
    assert sharding.shard_rows(no_documents).count() == 0


@pytest.mark.parametrize("shards", [7, 10])
def test_hot_group_and_many_small_ones(spark, shards):
    texts = ["hot"] * 400 + [f"group {i}" for i in range(90) for _ in range(6)] + [f"alone {i}" for i in range(260)]
    rows = list(enumerate(texts))
    got = sharding.shard_rows(spark.createDataFrame(rows, "doc_id long, text string"), shards=shards).collect()
    parted = checked(got, rows, shards)
    hot = zlib.crc32(b"hot"), len("hot") + 16
    room = len(rows) // shards
    assert parted.pop(hot) <= 400 - room  # a group larger than a shard fills one
    assert sum(parted.values()) <= 6


def test_propagation_gathers_what_is_scattered(spark):
    """Groups dealt round the shards come together, and no shard's count changes."""
    ws = Workspace(spark, "sharding-test")
    rows = [(i, i % 4, i // 8 if i < 160 else None) for i in range(400)]
    base = ws.table(spark.createDataFrame(rows, "node long, shard int, hub long"), "base")
    nodes = base.select("node", "shard", F.col("hub").isNull().alias("free"))
    after = sharding.propagate(ws, nodes, base.filter("hub is not null").select("node", "hub"))
    got = {r["node"]: r["shard"] for r in after.collect()}
    assert Counter(got.values()) == Counter(s for _, s, _ in rows)
    outside = lambda at: sum(8 - max(Counter(at[i] for i, _, h in rows if h == g).values()) for g in range(20))
    assert outside(got) == 0


def test_propagation_over_edges(spark):
    """Single edges are hubs of two."""
    ws = Workspace(spark, "sharding-test")
    nodes = ws.table(spark.createDataFrame([(0, 0, False), (1, 1, False), (2, 0, True), (3, 1, True)], "node long, shard int, free boolean"), "nodes")
    after = sharding.propagate(ws, nodes, spark.createDataFrame([(0, 9), (1, 9)], "node long, hub long"))
    got = {r["node"]: r["shard"] for r in after.collect()}
    assert got[0] == got[1] and Counter(got.values()) == {0: 2, 1: 2}


def test_quotas_keep_counts():
    wanted, free = {(0, 1): 5, (1, 0): 3, (2, 0): 4, (1, 2): 1}, {0: 1, 1: 9, 2: 0}
    linked, loose = sharding.quotas(wanted, free)
    change = Counter()
    for (a, b), n in [*linked.items(), *loose.items()]:
        change[a] -= n
        change[b] += n
    assert not any(change.values())
    assert all(n <= wanted[k] for k, n in linked.items())
    out = Counter()
    for (a, _), n in loose.items():
        out[a] += n
    assert all(n <= free[a] for a, n in out.items())


def test_rounds_cut_fewer_links_from_a_neutral_start(spark):
    texts = ["hot"] * 900 + [f"group {i}" for i in range(60) for _ in range(2 + i % 9)] + [f"alone {i}" for i in range(1400)]
    rows, report = list(enumerate(texts)), []
    got = sharding.shard_rows(spark.createDataFrame(rows, "doc_id long, text string"), shards=8, report=report).collect()
    assert len(report) > 1 and all(a > b for a, b in zip(report, report[1:], strict=False))
    parted = checked(got, rows, 8)
    hot = Counter(r["shard"] for r in got if r["text_crc32"] == zlib.crc32(b"hot"))
    room = len(rows) // 8
    assert sum(n > 0.9 * room for n in hot.values()) == 900 // room  # as many shards as it fills, and a rest
    parted.pop((zlib.crc32(b"hot"), 19))
    assert sum(parted.values()) <= 0.02 * len(rows)
    pairs = lambda c: sum(c.values()) ** 2 - sum(n * n for n in c.values())
    by = defaultdict(Counter)
    for r in got:
        by[r["text_crc32"], r["size"]][r["shard"]] += 1
    assert report[-1] == sum(map(pairs, by.values())) // 2
