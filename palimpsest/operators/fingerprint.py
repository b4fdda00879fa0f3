"""Window fingerprints of documents: the one operator that leaves the JVM, in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from palimpsest.config import MatchConfig
from palimpsest.functions import text as tx

SCHEMA = "doctype long, docid long, pos long, hash long"
#: Window rows in one batch that leaves a worker, about.
ROWS = 1 << 18
#: Bytes of a collection, by Catalyst's estimate, below which it is dealt to more tasks than its files make.
SMALL_BYTES = 1 << 30


def hashes_of(data: bytes, width: int, config: MatchConfig) -> tuple[np.ndarray, np.ndarray]:
    """(position, hash) of the windows of one text that say something. Texts shorter than config.window have none."""
    if len(data) < config.window:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    base = tx.WIDE_BASE if config.hash_width is None else tx.BASE
    h, many = tx.window_hashes(data, width, config.threshold if config.exclude_blank else None, base)
    if config.hash_width is not None:
        h = tx.folded(h & np.uint64(0xFFFFFFFF), config.hash_width)
    pos = np.flatnonzero(~many)
    return pos, h[pos].view(np.int64)


def spread(docs: DataFrame) -> DataFrame:
    """`docs` in as many partitions as a shuffle makes, where a file read makes fewer: a window row is ten times as
    large as the byte that it begins at, so few large partitions keep few workers busy for long."""
    spark = docs.sparkSession
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return docs.repartition(4 * spark.sparkContext.defaultParallelism) if size < SMALL_BYTES else docs


def window_counts(docs: DataFrame, config: MatchConfig) -> DataFrame:
    """(doctype, docid, n_windows, n_blank, n_distinct) of the indexed windows of each document."""
    names = ["doctype", "docid", "n_windows", "n_blank", "n_distinct"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list[int]] = [[], [], []]
            for t in b.column(2):
                data = (t.as_py() or "").encode("utf-8", "surrogatepass")
                _, h = hashes_of(data, config.short, config)
                total = len(data) - config.short + 1 if len(data) >= config.window else 0
                for column, n in zip(out, (total, total - len(h), len(np.unique(h))), strict=True):
                    column.append(n)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, pa.int64()) for c in out)], names=names)

    return spread(docs.select("doctype", "docid", "text")).mapInArrow(run, ", ".join(f"{n} long" for n in names))


def fingerprints(docs: DataFrame, config: MatchConfig, width: int | None = None, distinct: bool = False, only=None, fold=None) -> DataFrame:
    """(doctype, docid, pos, hash) of every window of `docs` (doctype, docid, text), `width` bytes wide.

    distinct: one row for each hash of a document, at its first position. only: a broadcast variable with a sorted
    array of hashes; others are left out in the worker, before they reach the JVM. fold: what a worker makes of its batches,
    of the same columns.
    """
    width = width or config.short
    picked = spread(docs.select("doctype", "docid", "text").filter("doctype is not null and docid is not null"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = only.value if only is not None else None
        parts: list[tuple[int, int, np.ndarray, np.ndarray]] = []
        held = 0

        def flush() -> pa.RecordBatch:
            n = [len(p) for _, _, p, _ in parts]
            cols = [np.repeat([x[i] for x in parts], n) for i in (0, 1)] + [np.concatenate([x[i] for x in parts]) for i in (2, 3)]
            parts.clear()
            return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64, copy=False)) for c in cols], names=["doctype", "docid", "pos", "hash"])

        for b in batches:
            for a, d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                pos, h = hashes_of((t or "").encode("utf-8", "surrogatepass"), width, config)
                if wanted is not None and len(h):
                    at = np.searchsorted(wanted, h)
                    hit = wanted[np.minimum(at, len(wanted) - 1)] == h if len(wanted) else np.zeros(len(h), bool)
                    pos, h = pos[hit], h[hit]
                if distinct and len(h):
                    h, first = np.unique(h, return_index=True)
                    pos = pos[first]
                if len(h):
                    parts.append((a, d, pos, h))
                    held += len(h)
                if held >= ROWS:
                    yield flush()
                    held = 0
        if parts:
            yield flush()

    return picked.mapInArrow(run if fold is None else lambda batches: fold(run(batches)), SCHEMA)
