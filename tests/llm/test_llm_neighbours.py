"""The permutation index against brute force."""

import math
from collections import defaultdict

import numpy as np
import pytest

from palimpsest.llm import neighbours

SCHEMA = "vec_id long, embedding array<float>"


def recall(rows, want):
    found, asked = defaultdict(dict), defaultdict(dict)
    for q, _, k, s in rows:
        found[q][k] = s
    for q, _, k, s in want:
        asked[q][k] = s
    assert found.keys() == asked.keys()
    hit = 0
    for q, own in asked.items():
        edge = min(own.values())
        assert len(found[q]) == len(own)
        hit += sum(s >= edge - 1e-12 for s in found[q].values())  # a tie with the last is as near
    return hit / sum(map(len, asked.values()))


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_query(spark, sf):
    from palimpsest.llm.queries import op9_neighbours

    df = op9_neighbours(spark, sf)
    assert df.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "double")]
    vectors = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    by = dict(vectors)
    rows = sorted(map(tuple, df.collect()))
    assert recall(rows, list(neighbours.exact(vectors))) >= 0.95
    for q, rank, k, s in rows:
        assert s == pytest.approx(math.fsum(a * b for a, b in zip(by[q], by[k], strict=True)), abs=1e-12)
    for a, b in zip(rows, rows[1:], strict=False):
        if a[0] == b[0]:
            assert b[1] == a[1] + 1 and (a[3], -a[2]) > (b[3], -b[2])
        else:
            assert b[1] == 1


def test_random_vectors(spark):
    """Nothing to cluster by: the hardest case for pivots."""
    rng = np.random.default_rng(4)
    vectors = [(i, [float(x) for x in rng.normal(size=32).astype(np.float32)]) for i in range(3000)]
    got = neighbours.nearest(spark.createDataFrame(vectors, SCHEMA), block=1000, query_block=60)
    assert recall([tuple(r) for r in got.collect()], list(neighbours.exact(vectors))) >= 0.9


def test_edges(spark, crowd):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (20, [1.0, 0.0]), (3, [0.5, 0.5]), (3, [0.5, 0.5]), (4, [-1.0, 0.0]), (5, None), (6, [0.0, 0.0]), (7, [nan, 1.0]), (8, [inf, 1.0]),
        (9, [None, 1.0]), (None, [1.0, 0.0]), (40, [0.0, 0.0]), (10, [1.0, 2.0, 3.0]), (60, [1.0, 0.0, 0.0]), (80, []), (100, None), (-20, [0.0, 1.0])]
    df = crowd(spark.createDataFrame(rows, SCHEMA))
    got = sorted(tuple(r) for r in neighbours.nearest(df).collect())
    want = sorted([
        (0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 20, 1.0), (0, 4, 3, 0.5), (0, 5, -20, 0.0), (0, 6, 4, -1.0), (20, 1, 0, 1.0), (20, 2, 1, 1.0), (20, 3, 2, 1.0), (20, 4, 3, 0.5),
        (20, 5, -20, 0.0), (20, 6, 4, -1.0), (60, 1, 10, 1.0), (-20, 1, 3, 0.5), (-20, 2, 0, 0.0), (-20, 3, 1, 0.0), (-20, 4, 2, 0.0), (-20, 5, 4, 0.0), (-20, 6, 20, 0.0)])
    assert got == want


def test_a_crowd_of_copies(spark):
    rows = [(i, [1.0, 0.0]) for i in range(3000)] + [(3000, [2.0, 0.0]), (3020, [0.0, 1.0])]
    got = defaultdict(list)
    for q, rank, k, s in sorted(map(tuple, neighbours.nearest(spark.createDataFrame(rows, SCHEMA)).collect())):
        got[q].append((k, s))
    assert len(got) == 152
    assert got[0] == [(3000, 2.0), *((k, 1.0) for k in range(1, 20))] and got[20] == [(3000, 2.0), *((k, 1.0) for k in range(19))]
    assert got[3000] == [(k, 2.0) for k in range(20)]
    assert got[3020] == [(k, 0.0) for k in range(20)]


def test_empty(spark):
    assert neighbours.nearest(spark.createDataFrame([], SCHEMA)).count() == 0
    assert neighbours.nearest(spark.createDataFrame([(1, [1.0])], SCHEMA)).count() == 0
    assert neighbours.nearest(spark.createDataFrame([(20, [1.0])], SCHEMA)).count() == 0


def test_footrule():
    """Posted lists give the footrule distance of the orders, up to a constant of the query."""
    rng = np.random.default_rng(1)
    pivots, prefix, n = 12, 5, 40
    orders = np.array([rng.permutation(pivots)[:prefix] for _ in range(n)], np.int16)
    query = rng.permutation(pivots)[:prefix]

    def slow(o):
        a, b = ({p: i for i, p in enumerate(x.tolist())} for x in (query, o))
        return sum(abs(a.get(p, prefix) - b.get(p, prefix)) for p in range(pivots))

    got = neighbours.Postings(orders, pivots).shared(query)
    assert (got == prefix * (prefix + 1) - np.array([slow(o) for o in orders])).all()


@pytest.mark.parametrize("sigma", [0, 0.5, 1])
def test_recall_of_one_block(sigma):
    """The share of SHARE alone, with nothing to cluster by and lengths from alike to very unlike."""
    rng = np.random.default_rng(8)
    n, dim, pivots = 6000, 64, 750
    v = rng.normal(size=(n, dim))
    v *= (rng.lognormal(0, sigma, n) / np.linalg.norm(v, axis=1))[:, None]
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    orders = neighbours._orders(unit, unit[:pivots], neighbours.PREFIX)
    asked = np.arange(0, n, 40)
    hit = 0
    for q, (at, _) in zip(asked, neighbours.search_block(v, orders, v[asked], orders[asked], pivots, 21, least=0), strict=True):
        want = np.argsort(-(v @ v[q]), kind="stable")[:21]
        hit += len(set(at.tolist()) & set(want.tolist()))
    assert hit / (21 * len(asked)) >= 0.9


def test_vectors_of_unlike_lengths(spark):
    rng = np.random.default_rng(6)
    v = rng.normal(size=(4000, 64)) * rng.lognormal(0, 1, 4000)[:, None]
    vectors = [(i, [float(x) for x in row.astype(np.float32)]) for i, row in enumerate(v)]
    got = neighbours.nearest(spark.createDataFrame(vectors, SCHEMA), block=2000)
    assert recall([tuple(r) for r in got.collect()], list(neighbours.exact(vectors))) >= 0.95
