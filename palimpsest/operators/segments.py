"""Windows of a collection brought together by their bytes, without a row for each.

A window goes to the part that the least hash of its short byte runs names (its minimizer), so equal windows meet. As
neighbouring windows mostly share it, they travel as one segment of text, some four bytes a window, and many segments as
one compressed row. What meets in a part is worked on in numpy, in slices by the minimizer, so a task holds a bounded
number of window rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.config import MatchConfig
from palimpsest.functions import text as tx
from palimpsest.operators.fingerprint import hashes_of, spread

#: Bytes of the runs that minimizers are taken from, at most.
RUN = 8
#: Windows that a task packs together, and those that are worked on at once in a part, about.
PACKED, AT_ONCE = 1 << 22, 1 << 20
#: Slices of a part.
SLICES = 256
SCHEMA = "part int, side int, docs int, segments int, size int, packed binary"


@dataclass
class Windows:
    """Windows that met: a row each, with its document, its place there (if asked for), its hash and the side of the
    table that it comes from. Windows of the same document and hash are on one side one row, if that was packed distinct."""

    side: np.ndarray
    doctype: np.ndarray
    docid: np.ndarray
    pos: np.ndarray
    hash: np.ndarray


def minimizers(norm: np.ndarray, width: int) -> np.ndarray:
    """For each window of `width` bytes the least mixed value of its runs of RUN bytes."""
    run = min(RUN, width)
    n = len(norm) - run + 1
    v = np.zeros(n, np.uint64)
    for k in range(run):
        v |= norm[k : k + n].astype(np.uint64) << np.uint64(8 * k)
    v = tx.fmix(v)
    wide, have = width - run + 1, 1
    while have < wide:
        step = min(have, wide - have)
        v = np.minimum(v[:-step], v[step:])
        have += step
    return v


def gathered(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices of slices that begin at `starts` and are `sizes` long, one slice after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


def packed(docs: DataFrame, config: MatchConfig, distinct: bool, side: int = 0, parts: int | None = None) -> DataFrame:
    """SCHEMA: the windows of `docs` that say something, as segments, some of one part in each row. distinct: each window
    of a document once."""
    width = config.short
    parts = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    picked = spread(docs.select("doctype", "docid", "text").filter("doctype is not null and docid is not null"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[tuple[int, int]] = []
        cols: list[tuple[np.ndarray, ...]] = []
        texts: list[np.ndarray] = []
        held = base = 0

        def flush() -> pa.RecordBatch:
            key, doc, pos, n, at = (np.concatenate([c[i] for c in cols]) for i in range(5))
            data = np.concatenate(texts)
            part, sub = (key % np.uint64(parts)).astype(np.int64), ((key >> np.uint64(40)) % np.uint64(SLICES)).astype(np.uint8)
            order = np.lexsort((pos, doc, sub, part))
            part, sub, doc, pos, n, at = (x[order] for x in (part, sub, doc, pos, n, at))
            own = np.array(keys, np.int64)
            edges = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True])
            rows: list[list] = [[] for _ in range(6)]
            for low, high in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                named, local = np.unique(doc[low:high], return_inverse=True)
                body = [own[named, 0], own[named, 1], np.diff(local, prepend=0).astype(np.int32), n[low:high].astype(np.int32), sub[low:high]]
                body += [] if distinct else [pos[low:high].astype(np.int32)]
                body += [data[gathered(at[low:high], n[low:high] + width - 1)]]
                raw = b"".join(x.tobytes() for x in body)
                for column, x in zip(rows, (int(part[low]), side, len(named), high - low, len(raw), pa.compress(raw, "zstd", asbytes=True)), strict=True):
                    column.append(x)
            kinds = [pa.int32()] * 5 + [pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], names=["part", "side", "docs", "segments", "size", "packed"])

        for b in batches:
            for a, d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                text = (t.as_py() or "").encode("utf-8", "surrogatepass")
                pos, h = hashes_of(text, width, config)
                if not len(h):
                    continue
                if distinct:
                    pos = pos[np.sort(np.unique(h, return_index=True)[1])]
                norm = tx.NORMAL[np.frombuffer(text, np.uint8)]
                least = minimizers(norm, width)[pos]
                first = np.flatnonzero(np.r_[True, (least[1:] != least[:-1]) | (np.diff(pos) != 1)])
                n = np.diff(np.r_[first, len(pos)])
                cols.append((least[first], np.full(len(first), len(keys)), pos[first], n, pos[first] + base))
                keys.append((a, d))
                texts.append(norm)
                base += len(norm)
                held += len(pos)
                if held >= PACKED:
                    yield flush()
                    keys.clear(), cols.clear(), texts.clear()
                    held = base = 0
        if cols:
            yield flush()

    return picked.mapInArrow(run, SCHEMA)


def met(rows: DataFrame, width: int, work: Callable[[Iterator[Windows]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What `work` makes of the windows of each part of packed `rows`, which it gets slice by slice; equal windows are in
    one slice."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[Windows]:
        got: list[list[np.ndarray]] = [[] for _ in range(7)]
        for b in batches:
            for r in range(b.num_rows):
                side, docs, k, size = (b.column(c)[r].as_py() for c in (1, 2, 3, 4))
                raw = pa.decompress(b.column(5)[r].as_py(), size, "zstd", asbytes=True)
                at = 0

                def take(kind, n):
                    nonlocal at
                    out = np.frombuffer(raw, kind, n, at)
                    at += out.nbytes
                    return out

                types, ids = take(np.int64, docs), take(np.int64, docs)
                local, n, sub = np.cumsum(take(np.int32, k)), take(np.int32, k), take(np.uint8, k)
                whole = int(n.sum()) + k * (width - 1)
                pos = take(np.int32, k) if size - at > whole else np.zeros(k, np.int32)
                for column, x in zip(got, (np.full(k, side, np.int8), types[local], ids[local], n, sub, pos, take(np.uint8, whole)), strict=True):
                    column.append(x)
        if not got[0]:
            return
        side, doctype, docid, n, sub, pos, data = (np.concatenate(x) for x in got)
        for x in got:
            x.clear()
        sizes = n.astype(np.int64) + width - 1
        starts = np.cumsum(sizes) - sizes
        order = np.argsort(sub, kind="stable")
        heavy = np.cumsum(np.bincount(sub, weights=n, minlength=SLICES))
        group = (heavy / AT_ONCE).astype(np.int64)[sub[order]]
        edges = np.flatnonzero(np.r_[True, group[1:] != group[:-1], True])
        for low, high in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            some = order[low:high]
            text = data[gathered(starts[some], sizes[some])].tobytes()
            begin = np.cumsum(sizes[some]) - sizes[some]
            each = n[some]
            h = tx.window_hashes(text, width, None, tx.WIDE_BASE)[0][gathered(begin, each)].view(np.int64)
            yield Windows(np.repeat(side[some], each), np.repeat(doctype[some], each), np.repeat(docid[some], each), gathered(pos[some].astype(np.int64), each), h)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(slices(batches))

    return rows.repartition(parts, "part").mapInArrow(run, schema)


def groups(*columns: np.ndarray) -> np.ndarray:
    """Places, in sorted columns, where a new combination of values begins, and the end."""
    new = np.zeros(len(columns[0]), bool)
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    new[:1] = True
    return np.r_[np.flatnonzero(new), len(new)]


def parted(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the hashes that stand once, and of the others. Most stand once and need no further sort."""
    order = np.argsort(h)
    at = groups(h[order])
    once = np.repeat(np.diff(at) == 1, np.diff(at))
    return order[once], order[~once]


def tallied(columns: list[np.ndarray], n: np.ndarray) -> list[np.ndarray]:
    """Distinct combinations of the columns' values and the sums of `n` over each."""
    order = np.lexsort(columns[::-1])
    columns, n = [c[order] for c in columns], n[order]
    at = groups(*columns)
    return [*(c[at[:-1]] for c in columns), np.add.reduceat(n, at[:-1]) if len(n) else n]


def counted(rows: DataFrame, width: int, count: Callable[[Windows], list[np.ndarray]], names: list[str]) -> DataFrame:
    """Sums of what `count` makes of each slice: columns of keys, then of numbers, all long."""

    def work(slices: Iterator[Windows]) -> Iterator[pa.RecordBatch]:
        parts: list[list[np.ndarray]] = []
        held = 0
        for w in slices:
            parts.append(count(w))
            held += len(parts[-1][0])
            if held > AT_ONCE:
                parts = [_summed(parts)]
                held = 0
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64, copy=False)) for c in _summed(parts)], names=names)

    got = met(rows, width, work, ", ".join(f"{n} long" for n in names))
    return got.groupBy(*names[:-1]).agg(F.coalesce(F.sum(names[-1]), F.lit(0)).cast("long").alias(names[-1]))


def _summed(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
    *keys, n = (np.concatenate([p[i] for p in parts]) for i in range(len(parts[0])))
    return tallied(keys, n) if keys else [n.sum(keepdims=True)]
