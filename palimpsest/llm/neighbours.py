"""Approximate nearest neighbours by a permutation index.

Every vector is represented by its nearest pivots in order. Blocks of vectors post them in inverted files, one list
for each pivot, with the pivot's place in the vector's order. A query reads the lists of its own nearest pivots alone
and adds up how much each place differs from its own: the footrule distance of the two orders, a pivot missing from
one counting as beyond its end. Orders tell angles and not lengths, while the inner product grows with the length, so
vectors are ranked by what their order shares with the query's times their length. In every block the best are ranked
again by the exact inner product.

Queries meet every block, so work grows with queries x vectors: a query reads PREFIX / pivots of a block's postings
and SHARE of its vectors. Nothing larger than a block of vectors and a block of queries is in memory. Identical
vectors are one class, searched once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from palimpsest.llm.common import Workspace, skew_join

#: Pivots at least and at most, if there are as many vectors; between them one for every PER_PIVOT vectors.
LEAST_PIVOTS = 256
PIVOTS = 1024
PER_PIVOT = 8
#: Nearest pivots that represent a vector.
PREFIX = 64
#: Share of each block, and least number, that is ranked again exactly.
SHARE = 0.1
LEAST = 64
#: Classes of vectors in a block, and queries in one.
BLOCK = 32_768
QUERY_BLOCK = 32_768
#: Blocks at least, so that small tables spread over tasks too.
LEAST_BLOCKS = 12
QUERY_EVERY = 20
NEAREST = 20


def _orders(vectors: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """Numbers of each vector's nearest pivots in order, ties to the smaller number."""
    out = np.empty((len(vectors), prefix), np.int16)
    for at in range(0, len(vectors), 1024):  # all distances to the pivots of so many vectors are in memory
        out[at : at + 1024] = np.argsort(-(vectors[at : at + 1024] @ pivots.T), axis=1, kind="stable")[:, :prefix]
    return out


class Postings:
    """The inverted files of a block: for each pivot the vectors that have it among their nearest, and its places."""

    def __init__(self, orders: np.ndarray, pivots: int):
        self.n, self.prefix = orders.shape
        flat = orders.ravel()
        by = np.argsort(flat, kind="stable")
        bounds = np.searchsorted(flat[by], np.arange(pivots + 1)).tolist()
        rows, places = (by // self.prefix).astype(np.int32), (by % self.prefix).astype(np.int32)
        self.rows = [rows[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        self.places = [places[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]

    def shared(self, order: np.ndarray) -> np.ndarray:
        """What each vector's order shares with a query's: the footrule distance of orders without a common pivot less
        that of these two.

        A pivot that one of them alone has adds prefix - place. One that both have would add (prefix - place) twice
        over and adds the difference of its places instead, so it saves twice prefix less the larger place."""
        own = order.tolist()
        rows = [self.rows[p] for p in own]
        mine = np.repeat(np.arange(len(own), dtype=np.int32), [len(r) for r in rows])
        saved = 2 * (self.prefix - np.maximum(mine, np.concatenate([self.places[p] for p in own])))
        return np.bincount(np.concatenate(rows), weights=saved, minlength=self.n)


def search_block(vectors: np.ndarray, orders: np.ndarray, queries: np.ndarray, query_orders: np.ndarray, pivots: int, keep: int, share: float = SHARE, least: int = LEAST):
    """For each query (rows of the block, exact inner products) of its `keep` best among the candidates by footrule
    and length."""
    n = len(orders)
    posts = Postings(orders, pivots)
    lengths = np.linalg.norm(vectors, axis=1)
    wanted = min(n, max(least, int(np.ceil(share * n))))
    for q, order in zip(queries, query_orders, strict=True):
        if wanted < n:
            near = posts.shared(order) * lengths
            at = np.sort(np.argpartition(near, n - wanted)[n - wanted :])
        else:
            at = np.arange(n)
        scores = (vectors[at] * q).sum(axis=1)  # one order of additions for every row
        if len(at) > keep:
            edge = np.partition(scores, len(at) - keep)[len(at) - keep]
            chosen = scores >= edge
            at, scores = at[chosen], scores[chosen]
        yield at, scores


def clean(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(k, v): rows whose vector takes part: not null, not zero, all components finite; a null key takes no part."""
    v = F.col(vector).cast("array<double>")
    d = df.select(F.col(key).cast("long").alias("k"), v.alias("v")).filter(F.col("k").isNotNull() & F.col("v").isNotNull())
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return d.filter(fine & F.exists("v", lambda x: x != 0))


def nearest(df: DataFrame, key: str = "vec_id", vector: str = "embedding", every: int = QUERY_EVERY, count: int = NEAREST,
            pivots: int | None = None, prefix: int = PREFIX, share: float = SHARE, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, key, score): the `count` nearest rows found for each row whose key is divisible by `every`.

    Nearness is the largest inner product in double precision; ties go to the smaller key. A query's own key is no
    candidate. Vectors that are null, zero or hold null or non-finite components take no part, nor do rows with a
    null key; vectors of each number of components are searched among themselves; repeated rows (the same
    key and vector) count once. With fewer candidates than `count`, all are returned; other columns, texts of any
    length among them, are ignored; an empty table gives none.
    """
    spark = df.sparkSession
    ws = Workspace(spark, "neighbours")
    rows = ws.table(clean(df, key, vector).withColumn("dim", F.size("v")).withColumn("c", F.sha2(F.concat_ws(",", F.transform("v", lambda x: F.hex(F.encode((x + 0.0).cast("string"), "UTF-8")))), 256)), "rows")
    # A class is one vector; of its keys the count + 1 smallest can be among any query's nearest. They are gathered in
    # two steps, so one class may hold any share of the rows.
    keys = rows.select("c", "k").distinct().withColumn("salt", F.pmod(F.xxhash64("k"), F.lit(64)).cast("int"))
    first = keys.withColumn("r", F.row_number().over(Window.partitionBy("c", "salt").orderBy("k"))).filter(F.col("r") <= count + 1)
    some = ws.table(first.groupBy("c").agg(F.slice(F.sort_array(F.collect_list("k")), 1, count + 1).alias("keys")), "keys")
    classes = ws.table(rows.groupBy("c", "dim").agg(F.any_value("v").alias("v")), "classes")
    parts = [r["dim"] for r in classes.select("dim").distinct().orderBy("dim").collect()]  # one, but for stray lengths
    found = [_nearest_of(ws, rows.filter(F.col("dim") == d), classes.filter(F.col("dim") == d), some, d, every, count, pivots, prefix, share, block, query_block) for d in parts]
    if not found:
        found = [spark.createDataFrame([], "query_id long, rank int, k long, score double")]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.select("query_id", "rank", F.col("k").alias(key), "score")


def _nearest_of(ws: Workspace, rows: DataFrame, classes: DataFrame, some: DataFrame, dim: int, every: int, count: int, pivots: int | None, prefix: int, share: float, block: int, query_block: int) -> DataFrame:
    n = classes.count()
    pivots = pivots or min(PIVOTS, max(LEAST_PIVOTS, n // PER_PIVOT))
    # A bounded sample of distinct vectors: those with the smallest hashes.
    sample = classes.orderBy(F.xxhash64("c"), "c").limit(pivots).select("v").collect()
    base = np.array([r["v"] for r in sample], float).reshape(len(sample), dim)
    base = base / np.maximum(np.linalg.norm(base, axis=1, keepdims=True), 1e-300)
    prefix = min(prefix, len(base))
    blocks = max(LEAST_BLOCKS, -(-n // block))
    asked = rows.filter(F.col("k") % every == 0).select(F.col("k").alias("q"), "v").distinct()
    query_blocks = -(-max(asked.count(), 1) // query_block)
    posted = classes.select("c", "v", F.pmod(F.xxhash64("c"), F.lit(blocks)).cast("int").alias("b")).withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    sent = asked.select("q", "v", F.pmod(F.xxhash64("q"), F.lit(query_blocks)).cast("int").alias("a")).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    keep = count + 1  # a class may hold nothing but the query itself

    def search(key, left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if left.num_rows and right.num_rows:
            order = np.argsort(np.array(left.column("c").to_pylist()))
            names = np.array(left.column("c").to_pylist())[order]
            matrix = lambda t: np.asarray(t.column("v").combine_chunks().flatten()).reshape(-1, dim)
            vectors, queries, ids = matrix(left)[order], matrix(right), right.column("q").to_pylist()
            unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
            got = search_block(vectors, _orders(unit(vectors), base, prefix), queries, _orders(unit(queries), base, prefix), len(base), keep, share)
            for q, (at, scores) in zip(ids, got, strict=True):
                out[0] += [q] * len(at)
                out[1] += names[at].tolist()
                out[2] += scores.tolist()
        return pa.table({"q": pa.array(out[0], pa.int64()), "c": pa.array(out[1], pa.string()), "score": pa.array(out[2], pa.float64())})

    near = posted.groupBy("a", "b").cogroup(sent.groupBy("a", "b")).applyInArrow(search, "q long, c string, score double")
    near = near.withColumn("r", F.rank().over(Window.partitionBy("q").orderBy(F.desc("score")))).filter(F.col("r") <= keep).drop("r")
    hits = skew_join(near, some, ["c"], "inner").select("q", "score", F.explode("keys").alias("k")).filter(F.col("k") != F.col("q"))
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "k"))
    hits = hits.groupBy("q", "k").agg(F.max("score").alias("score"))
    return hits.withColumn("rank", place).filter(F.col("rank") <= count).select(F.col("q").alias("query_id"), "rank", "k", "score")


def exact(rows: list[tuple[int, list[float]]], every: int = QUERY_EVERY, count: int = NEAREST) -> Iterator[tuple[int, int, int, float]]:
    """Brute force over rows that take part, for measuring recall."""
    ids, v = np.array([k for k, _ in rows]), np.array([x for _, x in rows], float)
    for i in np.flatnonzero(ids % every == 0):
        s = (v * v[i]).sum(axis=1)
        order = np.lexsort((ids, -s))
        order = order[ids[order] != ids[i]][:count]
        yield from ((int(ids[i]), r + 1, int(ids[j]), float(s[j])) for r, j in enumerate(order))
