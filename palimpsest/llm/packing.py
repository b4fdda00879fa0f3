"""Packing of documents into sequences by length patterns.

Documents become token ids, each followed by an end id; only those longer than a sequence are cut. The histogram of
piece lengths, at most one row per length, decides everything: patterns of a few coarse lengths that fill a sequence
are enumerated, non-negative least squares fits how often each is used, and the counts are rounded down and filled
with real lengths that leave next to nothing free. What no pattern took is fitted again with more slack. The shortest
pieces take no part in this: with whatever else is left they are packed by best fit into open and new sequences.
Pieces then find their places by their rank among the pieces of the same length.
"""

from __future__ import annotations

import json
import re
import sys
import zlib
from array import array
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from palimpsest.llm.common import Workspace, frugal, ranked, unique_name

SEQUENCE = 2048
END_ID = 0
#: Coarse lengths in a full sequence, and documents in a pattern.
GRAINS = 64
PATTERN_DOCS = 4
#: Ids left free at most in a sequence that a pattern fills, in each fit after the other.
SLACKS = (0, 8, 32)
#: Pieces of this share of a sequence and shorter ones are kept from the patterns, to fill gaps.
FILLERS = 3 / 64
#: Pieces of one length that are ranked together, at most; and parts that the rarest split makes.
PART_ROWS = 200_000
LEAST_PARTS = 1024
#: Bytes of chunks and ids that a worker remembers, about: half of them new, half those that it had before, of which it
#: keeps what it meets again.
CACHE_BYTES = 192 << 20
#: Places, one byte each, that tell whether a chunk may have been met before; only those are remembered.
MET = 1 << 22
_ODD = re.compile("[\x1c-\x1f]")
_BEYOND = re.compile("[^\x00-ɏ]")
#: Chunks of these characters alone are normalised by lower-casing, and Python's classes tell their letters and digits.
_PLAIN = re.compile("[\x00-\x7fÀ-ÖØ-öø-įı-ɏ]+")
_PRETOKEN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
#: What the split pattern must be for _PRETOKEN to stand in for it.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class ChunkTokenizer:
    """Ids of whole texts from remembered ids of their chunks between white space.

    The tokenizer's pre-tokens never cross white space and its normalisation works within a chunk, so a text's ids
    are those of its chunks in a row. Texts with separators that count as white space here only are encoded whole.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            raw = f.read()
        try:  # all but the vocabulary, which is by far the most of the file and stands last in it
            spec = json.loads(raw[: raw.find('"model"')].rstrip().rstrip(",") + "}")
        except ValueError:
            spec = json.loads(raw)
        del raw
        kinds = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        self.lower = "Lowercase" in kinds
        # Chunks are independent only for a tokenizer that drops white space.
        self.chunked = bool(spec.get("pre_tokenizer")) and "Removed" in json.dumps(spec["pre_tokenizer"]) and spec.get("post_processor") is None
        split = [p.get("pattern", {}).get("Regex") for p in (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        self.plain = self.chunked and kinds == ["NFC", "Replace", "Lowercase"] and split == [_SPLIT, None]
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        #: How all special tokens begin. They are sought in the text as it stands, before it is normalised.
        self.mark = commonprefix(self.special)
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        self.table = {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.cache: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.old: tuple[dict[str, bytes], dict[str, bytes]] = ({}, {})
        self.held = 0
        self.met = bytearray(MET)
        self.tokenize = self.tokenizer.model.tokenize

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        """Ids of a chunk that is not among the new ones. The pre-tokens of a plain one go to the model by themselves."""
        ids = self.old[0].get(chunk)
        if ids is not None:
            self._remember(self.cache, chunk, ids)
            return ids
        if self.plain and _PLAIN.fullmatch(chunk) and not ("<" in chunk and any(x in chunk for x in self.special)):
            out = []
            for word in _PRETOKEN.findall(chunk.lower()):
                got = self.words.get(word)
                if got is None:
                    got = self.old[1].get(word)
                    if got is None:
                        mapped = word if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(self.table)
                        got = array("I", [t.id for t in self.tokenize(mapped)]).tobytes()
                    if len(word) <= 64:
                        self._remember(self.words, word, got)
                out.append(got)
            ids = out[0] if len(out) == 1 else b"".join(out)
        else:
            ids = self._whole(chunk)
        at = hash(chunk) & MET - 1
        if self.met[at] and len(chunk) <= 64:
            self._remember(self.cache, chunk, ids)
        self.met[at] = 1
        return ids

    def _remember(self, where: dict[str, bytes], text: str, ids: bytes) -> None:
        where[text] = ids
        self.held += 160 + len(text) + len(ids)  # objects and dictionaries take some 160
        if 2 * self.held > CACHE_BYTES:
            self.old = (self.cache, self.words)
            self.cache, self.words, self.held, self.met = {}, {}, 0, bytearray(MET)

    def encode(self, text: str) -> bytes:
        """Little-endian 32-bit ids of a text."""
        if not self.chunked or _ODD.search(text):
            return self._whole(text)
        if self.lower and not (self.special and self.mark in text) and not _BEYOND.search(text):
            text = text.lower()
        chunks = text.split()
        ids = list(map(self.cache.get, chunks))
        if None in ids:
            ids = [self._chunk(c) if i is None else i for c, i in zip(chunks, ids, strict=True)]
        return b"".join(ids)


_LOADED: dict[str, ChunkTokenizer] = {}


def loaded(path: str) -> ChunkTokenizer:
    """The tokenizer of `path`, read once by each worker process."""
    if path not in _LOADED:
        _LOADED[path] = ChunkTokenizer(path)
    return _LOADED[path]


def pieces(df: DataFrame, path: str, key: str, text: str, size: int, with_ids: bool = False) -> DataFrame:
    """(key, piece, start, length, ids_crc32[, ids]): the pieces of every document, null texts as empty ones."""
    picked = df.select(F.col(key).alias("k"), F.col(text).alias("t"))
    out = picked.select(F.col("k").alias(key), F.lit(0).alias("piece"), *[F.lit(0).cast("long").alias(c) for c in ("start", "length", "ids_crc32")])
    if with_ids:
        out = out.withColumn("ids", F.lit(b""))
    schema, names = out.schema, out.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = loaded(path)
        end = np.array([END_ID], "<u4").tobytes()
        if sys.byteorder != "little":
            raise RuntimeError("ids are packed on little-endian machines only")
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                b = batch.slice(at, 256)
                row, piece, start, length, crc, ids = [], [], [], [], [], []
                for i, t in enumerate(b.column(1).to_pylist()):
                    data = tokens.encode(t or "") + end
                    for p, s in enumerate(range(0, len(data), 4 * size)):
                        own = data[s : s + 4 * size]
                        row.append(i)
                        piece.append(p)
                        start.append(s // 4)
                        length.append(len(own) // 4)
                        crc.append(zlib.crc32(own))
                        if with_ids:
                            ids.append(own)
                cols = [b.column(0).take(pa.array(row, pa.int32())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
                yield pa.RecordBatch.from_arrays(cols + [pa.array(ids, pa.binary())] * with_ids, names=names)

    return picked.mapInArrow(frugal(run), schema)


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 400) -> np.ndarray:
    """argmin |ax - b| over x >= 0 by the active-set method of Lawson and Hanson."""
    m, n = a.shape
    x, passive = np.zeros(n), np.zeros(n, bool)
    gram, w = a.T @ a, a.T @ b
    tiny = 1e-9 * max(1.0, float(np.abs(w).max(initial=0)))
    for _ in range(rounds):
        gain = np.where(passive, -np.inf, w - gram @ x)
        j = int(gain.argmax())
        if gain[j] <= tiny or passive.sum() >= m:
            break
        passive[j] = True
        while True:
            at = np.flatnonzero(passive)
            z = np.zeros(n)
            z[at] = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            if (z[at] > 0).all():
                x = z
                break
            low = at[z[at] <= 0]
            step = np.min(x[low] / np.maximum(x[low] - z[low], 1e-300))
            x = x + step * (z - x)
            passive &= x > 1e-12
            x[~passive] = 0
            if not passive.any():
                break
    return x


def patterns(grains: int, docs: int) -> list[tuple[int, ...]]:
    """All descending tuples of at most `docs` positive numbers that add up to `grains`."""
    out: list[tuple[int, ...]] = []

    def extend(head: tuple[int, ...], left: int) -> None:
        if not left:
            out.append(head)
        elif len(head) < docs:
            for g in range(min(left, head[-1] if head else left), 0, -1):
                extend((*head, g), left - g)

    extend((), grains)
    return out


class _Plan:
    """Groups of sequences that are filled alike: (lengths in order, how many)."""

    def __init__(self, counts: np.ndarray, size: int):
        self.left, self.size = counts.astype(np.int64).copy(), size
        self.open: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)  # by free space
        self.spaces = np.zeros(size + 1, np.int64)

    def put(self, lengths: tuple[int, ...], times: int) -> None:
        if times:
            space = self.size - sum(lengths)
            self.open[space].append((lengths, times))
            self.spaces[space] += 1

    def take(self, lengths: tuple[int, ...], limit: int) -> int:
        """Use `lengths` together as often as the counts allow, at most `limit` times."""
        need = defaultdict(int)
        for n in lengths:
            need[n] += 1
        times = min([limit, *(int(self.left[n]) // k for n, k in need.items())])
        for n, k in need.items():
            self.left[n] -= k * times
        self.put(lengths, times)
        return times

    def best_fit(self) -> None:
        """Pack what is left, longest first, each into the open sequence that it fills best."""
        for n in range(self.size, 0, -1):
            while c := int(self.left[n]):
                fits = np.flatnonzero(self.spaces[n:])
                if not len(fits):
                    per = self.size // n
                    self.put((n,) * per, c // per)
                    if c % per:
                        self.put((n,) * (c % per), 1)
                    self.left[n] = 0
                    break
                space = n + int(fits[0])
                lengths, times = self.open[space].pop()
                self.spaces[space] -= 1
                per = space // n
                use = min(times, c // per)
                if not use:
                    per, use = c, 1
                self.put(lengths, times - use)
                self.put(lengths + (n,) * per, use)
                self.left[n] -= per * use

    def groups(self) -> list[tuple[tuple[int, ...], int]]:
        return sorted((g for gs in self.open.values() for g in gs), key=lambda g: (tuple(-n for n in g[0]), g[1]))


def _filled(left: np.ndarray, shape: tuple[int, ...], members: list[list[int]], size: int, slack: int) -> tuple[int, ...] | None:
    """Lengths that there are, of the grains in `shape`, that leave `slack` free at most and as little as can be: the
    longest of each grain, but the last but one is tried with every partner for the last, of any grain."""
    head: list[int] = []
    used: dict[int, int] = defaultdict(int)

    def there(n: int) -> bool:
        return bool(left[n] > used[n])

    for g in shape[:-2]:
        n = next((n for n in members[g] if there(n)), 0)
        if not n:
            return None
        head.append(n)
        used[n] += 1
    best: tuple[int, ...] | None = None
    least = slack + 1
    for n in members[shape[-2]] if len(shape) > 1 else [0]:
        free = size - sum(head) - n
        if free < 0 or n and not there(n):
            continue
        used[n] += bool(n)
        for last in range(free, max(0, free - least), -1):
            if there(last):
                best, least = (*head, *[n] * bool(n), last), free - last
                break
        used[n] -= bool(n)
        if not least:
            break
    return best


def plan(counts: np.ndarray, size: int = SEQUENCE, grains: int = GRAINS, docs: int = PATTERN_DOCS, report: dict | None = None) -> list[tuple[tuple[int, ...], int]]:
    """Groups (lengths, times) that together use each length counts[length] times; counts[0] is ignored.

    `report`, if given, gets the number of pieces and those that patterns placed, and the number of sequences and the
    least that there can be."""
    grain = -(-size // grains)
    lengths = np.arange(size + 1)
    of = np.clip((lengths + grain // 2) // grain, 1, grains)
    members = [[int(n) for n in lengths[:0:-1] if of[n] == g] for g in range(grains + 1)]
    shapes = patterns(grains, docs)
    a = np.zeros((grains, len(shapes)))
    for j, shape in enumerate(shapes):
        for g in shape:
            a[g - 1, j] += 1
    packed = _Plan(counts, size)
    packed.left[0] = 0
    fillers = packed.left.copy()
    fillers[int(size * FILLERS) + 1 :] = 0
    packed.left -= fillers
    total, placed = int(packed.left.sum() + fillers.sum()), 0
    for slack in SLACKS:
        coarse = np.bincount(of, weights=packed.left, minlength=grains + 1)
        scale = max(coarse.sum(), 1.0)
        times = np.floor(nnls(a, coarse[1:] / scale) * scale + 1e-6).astype(np.int64)
        for j in sorted(np.flatnonzero(times), key=lambda j: shapes[j], reverse=True):
            want = int(times[j])
            while want > 0 and (chosen := _filled(packed.left, shapes[j], members, size, slack)):
                done = packed.take(chosen, want)
                want -= done
                placed += done * len(chosen)
    packed.left += fillers
    packed.best_fit()
    groups = packed.groups()
    if report is not None:
        least = -(-int((counts[1:] * lengths[1:]).sum()) // size)
        report.update(pieces=total, by_patterns=placed, sequences=sum(t for _, t in groups), least=least)
    return groups


def _places(groups: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[list[int], list[int], list[int]]]:
    """For each length: first ranks, first sequences and offsets of the runs of its places."""
    out: dict[int, tuple[list[int], list[int], list[int]]] = defaultdict(lambda: ([], [], []))
    given: dict[int, int] = defaultdict(int)
    base = 0
    for lengths, times in groups:
        offset = 0
        for n in lengths:
            ranks, bases, offsets = out[n]
            ranks.append(given[n])
            bases.append(base)
            offsets.append(offset)
            given[n] += times
            offset += n
        base += times
    return dict(out)


def pack(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", size: int = SEQUENCE, with_ids: bool = False) -> DataFrame:
    """Per piece: key, piece, start, length, ids_crc32, sequence_id and offset (and its ids in binary, if asked for).

    Null and empty texts are documents of the end id alone; very long texts are cut into pieces of `size` ids;
    repeated rows and null keys are packed like any other; other columns are ignored; an empty table gives none.
    """
    spark = df.sparkSession
    ws = Workspace(spark, "packing")
    found = ws.table(pieces(df, path, key, text, size, with_ids), "pieces")
    counts = np.zeros(size + 1, np.int64)
    for r in found.groupBy("length").count().collect():  # `size` rows at most
        counts[r["length"]] = r["count"]
    places = _places(plan(counts, size)) if counts.any() else {}
    at = unique_name(found, "rank")
    # Rows that are alike in all of these are interchangeable, so any order among them gives the same result.
    order = [F.col(c) for c in (key, "piece", "ids_crc32")]
    # Only lengths of many pieces are split. All parts together number size + LEAST_PARTS, or size + pieces / PART_ROWS
    # where that is more, and none grows beyond PART_ROWS.
    rows = int(min(PART_ROWS, max(16, counts.sum() // LEAST_PARTS)))
    salts = F.element_at(F.lit([max(1, -(-int(c) // rows)) for c in counts]), F.col("length").cast("int") + 1)
    numbered = ranked(found, ["length"], order, at, salts)
    result = numbered.withColumn("sequence_id", F.lit(0).cast("long")).withColumn("offset", F.lit(0).cast("long")).drop(at)
    schema, names = result.schema, result.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = lambda c: b.column(b.schema.get_field_index(c))  # noqa: E731, B023
            sequence, offset = [], []
            for n, r in zip(col("length").to_pylist(), col(at).to_pylist(), strict=True):
                ranks, bases, offsets = places[n]
                i = bisect_right(ranks, r) - 1
                sequence.append(bases[i] + r - ranks[i])
                offset.append(offsets[i])
            cols = [col(c) for c in names[:-2]]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], names=names)

    return numbered.mapInArrow(run, schema)
