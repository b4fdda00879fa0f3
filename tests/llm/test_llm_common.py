"""Joins, ranks, positions and components that stay even, against brute force."""

import gc
import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from palimpsest.llm import common


def smallest_reachable(edges):
    up = {}

    def root(a):
        up.setdefault(a, a)
        while up[a] != a:
            up[a] = up[up[a]]
            a = up[a]
        return a

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {a: root(a) for a in up}


def test_components(spark):
    rng = random.Random(3)
    chain = [(i, i + 1) for i in range(1000, 1080)]
    star = [(5000, 5000 + i) for i in range(1, 60)]
    loose = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)]
    edges = chain + star + loose + loose[:20] + [(7, 7)]
    ws = common.Workspace(spark, "test")
    got = common.connected_components(ws, spark.createDataFrame(edges, "u long, v long"), "cc")
    want = smallest_reachable([e for e in edges if e[0] != e[1]])
    assert {r["node"]: r["component"] for r in got.collect()} == want
    assert got.count() == len(want)


def test_no_edges(spark):
    ws = common.Workspace(spark, "test")
    assert common.connected_components(ws, spark.createDataFrame([], "u long, v long"), "cc").count() == 0


def test_ranked(spark):
    rows = [("a", i) for i in range(500)] + [(None, i) for i in range(50)] + [("b", 1)] * 3
    ws = common.Workspace(spark, "test")
    df = ws.table(spark.createDataFrame(rows, "g string, i long"), "rows")
    got = common.ranked(df, ["g"], [F.col("i")], "place", 8).collect()
    by = defaultdict(list)
    for r in got:
        by[r["g"]].append(r["place"])
    assert {g: sorted(x) for g, x in by.items()} == {g: list(range(n)) for g, n in Counter(g for g, _ in rows).items()}


def test_sorted_positions(spark):
    rows = [(1, i) for i in range(400)] + [(None, 3), (0, 9), (2, 1), (2, 1)]
    random.Random(1).shuffle(rows)
    ws = common.Workspace(spark, "test")
    got = common.sorted_positions(ws, spark.createDataFrame(rows, "a long, b long"), [F.col("a"), F.col("b")], "sorted", "at").collect()
    ordered = sorted(got, key=lambda r: r["at"])
    assert [r["at"] for r in ordered] == list(range(len(rows)))
    assert [(r["a"], r["b"]) for r in ordered] == sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1]))


def test_skew_join(spark):
    left = spark.createDataFrame([(1, i) for i in range(100)] + [(2, 0), (None, 5)], "k long, i long")
    right = spark.createDataFrame([(1, "x"), (3, "y"), (None, "z")], "k long, name string")
    got = common.skew_join(left, right, ["k"], "left")
    assert got.count() == 102 and got.filter("name = 'x'").count() == 100 and got.filter("k is null and name is not null").count() == 0
    assert set(got.columns) == {"k", "i", "name"}


def test_unique_name(spark):
    assert common.unique_name(spark.createDataFrame([], "Rank long, _rank long"), "rank") == "__rank"


def test_give_back(spark):
    """Here the one JVM is the executor too: what it holds after a gigabyte and more of rubbish goes back to the machine."""
    heap = spark._jvm.java.lang.Runtime.getRuntime()
    rubbish = [spark._jvm.java.nio.ByteBuffer.allocate(256 << 20) for _ in range(6)]
    before = heap.totalMemory()
    assert before - heap.freeMemory() > 1536 << 20
    del rubbish
    gc.collect()
    common.give_back(spark)
    assert heap.totalMemory() < before - (256 << 20)
