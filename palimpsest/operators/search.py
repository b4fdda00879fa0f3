"""Candidate search: which documents share runs of windows with a query."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.config import MatchConfig
from palimpsest.functions import text as tx
from palimpsest.operators import segments
from palimpsest.operators.fingerprint import fingerprints
from palimpsest.operators.ranges import within
from palimpsest.sources.store import staged

#: A query side with no more distinct hashes than this is sent to every task; beyond it both sides are shuffled.
SMALL = 2_000_000

#: Bytes of query texts from which on all pairs are tallied by segments of text.
LARGE_BYTES = 16_000_000
#: Rows of runs and documents that one query is tallied by at once.
ROWS_AT_ONCE = 1 << 22
RUNS = "q_doctype long, q_docid long, pos long, n long, df long, c1 long, c2 long, members binary"
PLACES = "q_doctype long, q_docid long, doctype long, docid long, tally long, place int, many int"

TALLY = "q_doctype long, q_docid long, doctype long, docid long, tally long"


def small_hashes(query: DataFrame, limit: int = SMALL):
    """The query's distinct hashes as a broadcast sorted array, if they are few; else None."""
    got = query.select("hash").distinct().limit(limit + 1).toArrow().column(0).to_numpy()
    if len(got) > limit:
        return None
    return query.sparkSession.sparkContext.broadcast(np.sort(got.astype(np.int64)))


def hits(query: DataFrame, docs: DataFrame, config: MatchConfig, target: str | None = None) -> DataFrame:
    """(q_doctype, q_docid, pos, doctype, docid): each query position whose window a document has, bar the query
    itself."""
    asked = fingerprints(query, config)
    few = small_hashes(asked)
    searched = docs.filter(within(F.col("doctype"), target))
    have = fingerprints(searched, config, distinct=True, only=few).select("hash", "doctype", "docid")
    if config.max_df is not None:
        counts = have.groupBy("hash").agg(F.count(F.lit(1)).alias("df"))
        have = have.join(counts.filter(F.col("df") <= config.max_df).select("hash"), "hash", "left_semi")
    left = asked.select(F.col("doctype").alias("q_doctype"), F.col("docid").alias("q_docid"), "pos", "hash")
    # Few hashes may still stand at many positions; the planner broadcasts a side by its measured size only.
    joined = have.join(left, "hash", "inner")
    return joined.filter((F.col("q_doctype") != F.col("doctype")) | (F.col("q_docid") != F.col("docid"))).select("q_doctype", "q_docid", "pos", "doctype", "docid")


def tallies(found: DataFrame, config: MatchConfig) -> DataFrame:
    """(q_doctype, q_docid, doctype, docid, tally > 0): positions that close a run.

    strict: seven differences of one, modulo 256, to the position before, the first counting from 0. Otherwise the
    position six rows before lies six before: seven windows in a row."""
    w = Window.partitionBy("q_doctype", "q_docid", "doctype", "docid").orderBy("pos")
    if config.strict:
        step = F.pmod(F.col("pos") - F.lag("pos", 1, 0).over(w), F.lit(256)) == 1
        rows = found.withColumn("one", step.cast("int"))
        closes = F.sum("one").over(w.rowsBetween(-6, 0)) == 7
    else:
        rows = found
        closes = F.col("pos") - F.lag("pos", 6).over(w) == 6
    rows = rows.withColumn("closes", F.coalesce(closes, F.lit(False)))
    return rows.filter("closes").groupBy("q_doctype", "q_docid", "doctype", "docid").agg(F.count(F.lit(1)).alias("tally"))


def run_tallies(query: DataFrame, docs: DataFrame, config: MatchConfig, target: str | None = None) -> DataFrame:
    """What `tallies` makes of `hits`, for many queries: exact, but by runs of windows instead of single ones.

    Windows that stand in the same set of documents are one class, known by two digests of the set that no task has to
    hold. A passage that many documents share is then one run of a class in each query, and meets each document once,
    however long it is; the pairs of runs are chained by position as single windows would be."""
    if config.hash_width is None and large(query):
        return places(met_runs(query, docs, config, target), config).drop("place", "many")
    asked = fingerprints(query, config).select(F.col("doctype").alias("q_doctype"), F.col("docid").alias("q_docid"), "pos", "hash")
    have = staged(fingerprints(docs.filter(within(F.col("doctype"), target)), config, distinct=True, only=small_hashes(asked)).select("hash", "doctype", "docid"), "postings")
    digest = lambda salt: F.bit_xor(F.xxhash64("doctype", "docid", F.lit(salt)))
    classes = have.groupBy("hash").agg(F.count(F.lit(1)).alias("df"), digest(1).alias("c1"), digest(2).alias("c2"), F.min(F.struct("doctype", "docid")).alias("one"))
    if config.max_df is not None:
        classes = classes.filter(F.col("df") <= config.max_df)
    own = ["q_doctype", "q_docid"]
    placed = asked.join(classes, "hash", "inner")
    # A window that the query alone has tells nothing.
    placed = placed.filter((F.col("df") > 1) | (F.col("one.doctype") != F.col("q_doctype")) | (F.col("one.docid") != F.col("q_docid"))).select(*own, "pos", "df", "c1", "c2", "hash")
    w = Window.partitionBy(*own).orderBy("pos")
    same = (F.lag("pos").over(w) == F.col("pos") - 1) & (F.lag("c1").over(w) == F.col("c1")) & (F.lag("c2").over(w) == F.col("c2")) & (F.lag("df").over(w) == F.col("df"))
    marked = placed.withColumn("new", (~F.coalesce(same, F.lit(False))).cast("int")).withColumn("run", F.sum("new").over(w))
    runs = staged(marked.groupBy(*own, "run", "df", "c1", "c2").agg(F.min("pos").alias("pos"), F.count(F.lit(1)).alias("n"), F.min("hash").alias("hash")), "runs")
    # Any window of a class stands for it.
    named = runs.groupBy("df", "c1", "c2").agg(F.min("hash").alias("hash"))
    members = have.join(named, "hash", "inner").select("df", "c1", "c2", "doctype", "docid")
    pairs = runs.select(*own, "pos", "n", "df", "c1", "c2").join(members, ["df", "c1", "c2"], "inner")
    pairs = pairs.filter((F.col("q_doctype") != F.col("doctype")) | (F.col("q_docid") != F.col("docid")))
    p = Window.partitionBy(*own, "doctype", "docid").orderBy("pos")
    gap = F.col("pos") - F.coalesce(F.lag("pos").over(p) + F.lag("n").over(p) - 1, F.lit(0) if config.strict else F.lit(None))
    linked = F.coalesce(F.pmod(gap, F.lit(256)) == 1 if config.strict else gap == 1, F.lit(False)).cast("int")
    chained = pairs.withColumn("linked", linked).withColumn("chain", F.sum(1 - F.col("linked")).over(p))
    # Of a chain's windows those from the seventh step of one on close a run; the first of a run is a step if linked.
    steps = chained.groupBy(*own, "doctype", "docid", "chain").agg(F.sum(F.col("n") - 1 + F.col("linked")).alias("steps"))
    closing = F.greatest(F.col("steps") - (6 if config.strict else 5), F.lit(0))
    return steps.groupBy(*own, "doctype", "docid").agg(F.sum(closing).alias("tally")).filter("tally > 0")


def large(query: DataFrame) -> bool:
    """Whether the texts of `query` are many, so that their windows had better not be rows."""
    return (query.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0) >= LARGE_BYTES


def met_runs(query: DataFrame, docs: DataFrame, config: MatchConfig, target: str | None = None) -> DataFrame:
    """RUNS, written: the runs of `run_tallies` with the documents of their class, sorted and compressed. No window is a
    row: windows meet as segments of text, and what no other document has ends there."""

    def work(slices: Iterator[segments.Windows]) -> Iterator[pa.RecordBatch]:
        told: set[tuple[int, int, int]] = set()
        for w in slices:
            there = w.side == 0
            doctype, docid, h = w.doctype[there], w.docid[there], w.hash[there]
            order = np.lexsort((docid, doctype, h)) if len(h) else np.zeros(0, np.int64)
            doctype, docid, h = doctype[order], docid[order], h[order]
            at = segments.groups(h)
            if len(at) < 2:
                continue
            first, df = at[:-1], np.diff(at)
            c1, c2 = (np.bitwise_xor.reduceat(_mixed(doctype, docid, salt), first).view(np.int64) for salt in (1, 2))
            q_doctype, q_docid, pos, asked = (x[~there] for x in (w.doctype, w.docid, w.pos, w.hash))
            g = np.minimum(np.searchsorted(h[first], asked), len(first) - 1)
            use = (h[first][g] == asked) & ((df[g] > 1) | (doctype[first][g] != q_doctype) | (docid[first][g] != q_docid))
            if config.max_df is not None:
                use &= df[g] <= config.max_df
            q_doctype, q_docid, pos, g = q_doctype[use], q_docid[use], pos[use], g[use]
            order = np.lexsort((pos, q_docid, q_doctype))
            q_doctype, q_docid, pos, g = q_doctype[order], q_docid[order], pos[order], g[order]
            runs = segments.groups(q_doctype, q_docid, c1[g], c2[g], df[g], pos - np.arange(len(pos)))
            s, n = runs[:-1], np.diff(runs)
            if not len(s):
                continue
            cols = [q_doctype[s], q_docid[s], pos[s], n, df[g[s]], c1[g[s]], c2[g[s]]]
            yield pa.RecordBatch.from_arrays([*(pa.array(c.astype(np.int64, copy=False)) for c in cols), pa.nulls(len(s), pa.binary())], names=_names(RUNS))
            keys, blobs = [], []
            for i in np.unique(g[s]).tolist():
                key = (int(df[i]), int(c1[i]), int(c2[i]))
                if key not in told:
                    told.add(key)
                    keys.append(key)
                    blobs.append(_members(doctype[at[i] : at[i + 1]], docid[at[i] : at[i + 1]]))
            if keys:
                own = np.array(keys, np.int64)
                yield pa.RecordBatch.from_arrays([*(pa.nulls(len(keys), pa.int64()) for _ in range(4)), *(pa.array(own[:, i]) for i in range(3)), pa.array(blobs, pa.binary())], names=_names(RUNS))

    searched = docs.filter(within(F.col("doctype"), target))
    rows = segments.packed(searched, config, distinct=True).unionByName(segments.packed(query, config, distinct=False, side=1))
    made = staged(segments.met(rows, config.short, work, RUNS), "runs")
    own, kind = ["q_doctype", "q_docid"], ["df", "c1", "c2"]
    w = Window.partitionBy(*own).orderBy("pos")
    same = F.lag("pos").over(w) + F.lag("n").over(w) == F.col("pos")
    for c in kind:
        same = same & (F.lag(c).over(w) == F.col(c))
    marked = made.filter("members is null").withColumn("new", (~F.coalesce(same, F.lit(False))).cast("int")).withColumn("run", F.sum("new").over(w))
    runs = marked.groupBy(*own, "run", *kind).agg(F.min("pos").alias("pos"), F.sum("n").alias("n"))
    classes = made.filter("members is not null").groupBy(*kind).agg(F.first("members").alias("members"))
    return staged(runs.join(classes, kind).select(*_names(RUNS)), "met")


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _mixed(doctype: np.ndarray, docid: np.ndarray, salt: int) -> np.ndarray:
    return tx.fmix(docid.view(np.uint64) ^ tx.fmix(doctype.view(np.uint64) + np.uint64(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)))


def _members(doctype: np.ndarray, docid: np.ndarray) -> bytes:
    return pa.compress(np.concatenate([np.diff(doctype, prepend=0), np.diff(docid, prepend=0)]).tobytes(), "zstd", asbytes=True)


def _tally(pos: np.ndarray, n: np.ndarray, df: np.ndarray, blobs: list[bytes], own: tuple[int, int], strict: bool) -> list[np.ndarray]:
    """(doctype, docid, tally > 0) of one query's runs, in order, with the documents that have them."""
    parts = -(-int(df.sum()) // ROWS_AT_ONCE)
    found = []
    for part in range(parts):  # documents by number, so each is whole in one part
        kinds, ids, of = [], [], []
        for i, (m, blob) in enumerate(zip(df.tolist(), blobs, strict=True)):
            both = np.frombuffer(pa.decompress(blob, 16 * m, "zstd", asbytes=True), np.int64)
            t, d = np.cumsum(both[:m]), np.cumsum(both[m:])
            use = (t != own[0]) | (d != own[1])
            if parts > 1:
                use &= d % parts == part
            kinds.append(t[use]), ids.append(d[use]), of.append(np.full(int(use.sum()), i))
        t, d, i = np.concatenate(kinds), np.concatenate(ids), np.concatenate(of)
        if not len(t):
            continue
        order = np.lexsort((d, t))
        t, d, i = t[order], d[order], i[order]
        pairs = segments.groups(t, d)[:-1]
        begins, size = pos[i], n[i]
        gap = begins - np.r_[0, begins[:-1] + size[:-1] - 1]
        gap[pairs] = begins[pairs] if strict else 0
        linked = gap % 256 == 1 if strict else gap == 1
        new = ~linked
        new[pairs] = True
        chains = np.flatnonzero(new)
        steps = np.add.reduceat(size - 1 + linked, chains)
        tally = np.add.reduceat(np.maximum(steps - (6 if strict else 5), 0), np.searchsorted(chains, pairs))
        some = tally > 0
        found.append((t[pairs][some], d[pairs][some], tally[some]))
    return [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 3


def places(runs: DataFrame, config: MatchConfig, low: int = 0, high: int | None = None) -> DataFrame:
    """PLACES of RUNS: candidates of every query with their places above `low` and up to `high`, and how many there are.
    A query is tallied by one task, in parts of ROWS_AT_ONCE; pairs beyond the places asked for are not rows anywhere."""
    names = _names(PLACES)
    strict = config.strict

    def one(own: tuple[int, int], rows: list[tuple]) -> pa.RecordBatch:
        pos, n, df = (np.array([r[i] for r in rows], np.int64) for i in range(3))
        t, d, tally = _tally(pos, n, df, [r[3] for r in rows], own, strict)
        order = np.lexsort((d, t, -tally))[low:high]
        k = len(order)
        cols = [np.full(k, own[0]), np.full(k, own[1]), t[order], d[order], tally[order]]
        return pa.RecordBatch.from_arrays([*(pa.array(c.astype(np.int64, copy=False)) for c in cols), pa.array(np.arange(low + 1, low + k + 1), pa.int32()), pa.array(np.full(k, len(t)), pa.int32())], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, rows = None, []
        for b in batches:
            for r in zip(*(b.column(c).to_pylist() for c in range(6)), strict=True):
                if r[:2] != own:
                    if rows:
                        yield one(own, rows)
                    own, rows = r[:2], []
                rows.append(r[2:])
        if rows:
            yield one(own, rows)

    own = ["q_doctype", "q_docid"]
    parts = int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = runs.select(*own, "pos", "n", "df", "members").repartition(4 * parts, *own).sortWithinPartitions(*own, "pos")
    return laid.mapInArrow(run, PLACES)


def candidates(query: DataFrame, docs: DataFrame, config: MatchConfig, target: str | None = None, many: bool = False) -> DataFrame:
    """Ranked candidates of every query: tallies plus place, from 1, by tally, then document. `many` queries, such as a
    whole collection, are tallied by runs of windows; the result is the same."""
    got = run_tallies(query, docs, config, target) if many else tallies(hits(query, docs, config, target), config)
    w = Window.partitionBy("q_doctype", "q_docid").orderBy(F.desc("tally"), "doctype", "docid")
    return got.withColumn("place", F.row_number().over(w))


def counters(query: DataFrame, docs: DataFrame, config: MatchConfig, windows) -> DataFrame:
    """What a search counts for each query: its windows, those that are blank, documents that share any window, and
    those that are candidates. `windows` counts the windows of texts."""
    own = windows(query, config).select("doctype", "docid", "n_windows", "n_blank")
    found = staged(hits(query, docs, config), "hits")
    mine = [F.col("q_doctype").alias("doctype"), F.col("q_docid").alias("docid")]
    any_ = found.select(*mine, F.col("doctype").alias("d"), F.col("docid").alias("i")).distinct().groupBy("doctype", "docid").agg(F.count(F.lit(1)).alias("documents"))
    ranked = tallies(found, config).select(*mine).groupBy("doctype", "docid").agg(F.count(F.lit(1)).alias("results"))
    out = own.join(any_, ["doctype", "docid"], "left").join(ranked, ["doctype", "docid"], "left")
    return out.fillna(0, ["documents", "results"])
