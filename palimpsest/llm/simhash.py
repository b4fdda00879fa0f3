"""SimHash near-duplicates by tiled exact comparison.

Every text gets a 64-bit SimHash of its word shingles. Distinct fingerprints are sorted by the population
counts of their four 16-bit quarters and cut into tiles; two tiles are compared, exclusive-or and bit count in
numpy, only if their population counts can be within the radius. The comparison is exact: no link between two
fingerprints within the radius is lost. Each compared pair of tiles reports a spanning forest of its links
instead of all pairs, which leaves connectivity as it is. Copies share a fingerprint and are never compared.

Cost: the number of tile pairs grows with the square of the number of *distinct* fingerprints, less what the
population counts rule out; the shuffle carries each fingerprint once per partner tile.

`deduplicate` finds near-duplicates by the similarity of shingle sets, without any SimHash and without comparing all
texts: sets at the similarity must share some of their first shingles in any order that all sets agree on (the prefix
filter of set-similarity joins), so only texts that do are candidates, and every link is then verified on the sets.
The order puts frequent shingles last, so nearly all first ones are a text's own. Links between texts that are next to
each other in size come first; what they connect is one group in the second round, in which all candidates between
groups are verified, so a group of near copies does not meet itself again. No link is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from palimpsest.llm.common import Workspace, connected_components, frugal, input_partitions, only_ids, release, skew_join, sorted_positions, unique_name

RADIUS = 4
SHINGLE = 4
SEED = 42
#: Shingles of a text that are hashed and counted at once.
STEP = 1 << 14
#: Tiles at least and at most. Each fingerprint is sent once for each partner tile, so there are only as many as give
#: work to many tasks: from some 400,000 fingerprints on they grow as the cube root of their number, and tiles grow too.
LEAST_TILES = 12
MAX_TILES = 512
#: 64-bit words in a tile, beyond which there are more tiles (up to MAX_TILES); a task holds two tiles.
TILE_WORDS = 1 << 24
#: Rows and columns of one numpy comparison.
BLOCK = 1024
#: Rows of such a comparison whose counts are held at once.
STRIP = 128
#: Texts, about, whose shingles are counted for the order of all shingles, and the frequent ones of these that go to
#: the workers, 12 bytes each. Both bear on the time only: any order gives the same links.
SAMPLE = 1 << 14
FREQUENT = 1 << 18
#: First shingles that two sets at the similarity have in common at least (if they share so many at all). More make
#: candidates fewer and first shingles more.
SHARED = 6
#: First shingles that one task sorts, about, and those that one task collects before it sends them off.
DEALT = 1 << 19
PENDING = 1 << 18
#: Texts that each text with a first shingle is compared to in the first round: those that follow in order of size, and
#: those with the smallest ids.
FOLLOWING = 4
HUBS = 4
#: Texts with a first shingle, beyond which its pairs are made text by text.
LONG_RUN = 64
#: Candidate pairs that are made before equal ones are counted.
PAIRS = 1 << 21
#: Rows of a block of sets that are verified at once.
VERIFY_BLOCK = 256
#: Bytes of a shingle's hash that tell it from others when links are verified.
HASH_BYTES = 5
#: Texts whose sets are held at once.
SLICE = 256
#: Columns of one matrix of documents by shingles.
COLUMNS = 8192
_MASK16 = np.uint64(0xFFFF)


def _hashes(tokens: list[bytes], size: int) -> Iterator[np.ndarray]:
    """XXH64 of the `size`-word shingles with repeats, in slices, so memory is bounded."""
    digest = xxhash.xxh64_intdigest
    n = max(1, len(tokens) - size + 1)
    for at in range(0, n, STEP):
        part = tokens[at : at + STEP + size - 1]
        m = max(1, len(part) - size + 1)
        shingles = map(b" ".join, zip(*(part[k : k + m] for k in range(size)), strict=True)) if len(part) >= size else [b" ".join(part)]
        yield np.fromiter((digest(x, SEED) for x in shingles), np.uint64, m)


def sketch(text: str | None, size: int = SHINGLE, words: int = 1, distinct: bool = False) -> np.ndarray:
    """SimHash of one text in `words` 64-bit words: A-Z lower-cased, words split at ASCII white space, `size`-word
    shingles with repeats (or each once, if `distinct`), XXH64 with seed 42, and a bit set where it is set in over
    half of the hashes. No words: 0.

    The first 64 bits come from the hashes themselves, further ones from hashes mixed with the word's number."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.zeros(words, np.uint64)
    slices = _hashes(tokens, size)
    if distinct:
        once = np.unique(np.concatenate(list(slices)))
        slices = (once[at : at + STEP] for at in range(0, len(once), STEP))
    n = 0
    total = np.zeros(64 * words, np.int64)
    for hashes in slices:
        m = len(hashes)
        columns = np.empty((m, words), np.uint64)
        columns[:, 0] = hashes
        for k in range(1, words):
            columns[:, k] = _mixed(hashes, k)
        bits = np.unpackbits(columns.astype("<u8", copy=False).view(np.uint8).reshape(m, 8 * words), axis=1, bitorder="little")
        total += np.add.reduce(bits, axis=0, dtype=np.uint32)
        n += m
    return np.packbits(2 * total > n, bitorder="little").view("<u8").astype(np.uint64)


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """The finaliser of SplitMix64 over h + k steps: another hash of the same shingle."""
    z = h + np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """The 64-bit fingerprint of one text as an integer."""
    return int(sketch(text, size)[0])


def fingerprints(df: DataFrame, text: str = "text", out: str = "fp", size: int = SHINGLE, words: int = 1, distinct: bool = False) -> DataFrame:
    """`df` without its text, plus the fingerprint in binary, big-endian words, the first word first."""
    keep = [c for c in df.columns if c != text]
    schema = df.select(*keep).withColumn(out, F.lit(b"")).schema
    names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.schema.get_field_index(text))
            got = [sketch(t.as_py(), size, words, distinct).astype(">u8").tobytes() for t in texts]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in keep), pa.array(got, pa.binary())], names=names)

    return df.mapInArrow(frugal(run), schema)


def _quarters(values: np.ndarray) -> np.ndarray:
    """Population counts of the four quarters of each row's bits."""
    n, words = values.shape
    if words % 4 == 0:
        return np.bitwise_count(values).reshape(n, 4, words // 4).sum(axis=2, dtype=np.int64)
    parts = np.stack([np.bitwise_count((values >> np.uint64(s)) & _MASK16) for s in (48, 32, 16, 0)], axis=2)
    return parts.sum(axis=1, dtype=np.int64)


def _gap(low_a, high_a, low_b, high_b) -> int:
    """Least sum of differences between population counts of two boxes: a lower bound of the distance."""
    return int(np.maximum(0, np.maximum(low_a - high_b, low_b - high_a)).sum())


def _near(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rows of a and b within the radius, by exclusive-or and bit counts of one word after another.

    The words so far bound the distance from below, so a pair is left as soon as they differ in more than the radius,
    and no sooner. Unrelated rows differ in 32 bits of a word or so; the words that nearly all of them need to get
    beyond the radius are counted for whole strips, the others only for the pairs that are still there."""
    words = a.shape[1]
    if words == 1:
        return np.nonzero(np.bitwise_count(a[:, 0][:, None] ^ b[:, 0][None, :]) <= radius)
    whole = min(words, radius // 32 + 2)
    columns = np.ascontiguousarray(b[:, :whole].T)
    found = []
    for at in range(0, len(a), STRIP):
        strip = a[at : at + STRIP]
        bits = np.zeros((len(strip), len(b)), np.uint16)
        for k in range(whole):
            bits += np.bitwise_count(strip[:, k][:, None] ^ columns[k][None, :])
        u, v = np.nonzero(bits <= radius)
        rest = bits[u, v].astype(np.int64)
        u = u + at
        for k in range(whole, words):
            rest += np.bitwise_count(a[u, k] ^ b[v, k])
            keep = rest <= radius
            u, v, rest = u[keep], v[keep], rest[keep]
        found.append((u, v))
    empty = np.zeros(0, np.int64)
    return np.concatenate([empty, *(u for u, _ in found)]), np.concatenate([empty, *(v for _, v in found)])


def forest(values: np.ndarray, split: int | None, radius: int, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest (child, root as indexes) of the links within `radius` among the rows of `values` (rows by
    64-bit words), or, if `split` is given, between values[:split] and values[split:]. Blocks too far apart in
    population counts are skipped."""
    n = len(values)
    label = np.arange(n)
    boxes = {}

    def box(lo: int, hi: int):
        if (lo, hi) not in boxes:
            q = _quarters(values[lo:hi])
            boxes[lo, hi] = q.min(axis=0), q.max(axis=0)
        return boxes[lo, hi]

    cuts = lambda lo, hi: [(x, min(x + block, hi)) for x in range(lo, hi, block)]
    if split is None:
        spans = cuts(0, n)
        pairs = ((a, b) for i, a in enumerate(spans) for b in spans[i:])
    else:
        right = cuts(split, n)
        pairs = ((a, b) for a in cuts(0, split) for b in right)
    for a, b in pairs:
        if _gap(*box(*a), *box(*b)) > radius:
            continue
        u, v = _near(values[a[0] : a[1]], values[b[0] : b[1]], radius)
        u, v = u + a[0], v + b[0]
        while True:  # hang larger roots under smaller ones until the ends of every link agree
            ru, rv = label[u], label[v]
            differ = ru != rv
            if not differ.any():
                break
            u, v, ru, rv = u[differ], v[differ], ru[differ], rv[differ]
            np.minimum.at(label, np.maximum(ru, rv), np.minimum(ru, rv))
            while True:
                up = label[label]
                if (up == label).all():
                    break
                label = up
    child = np.flatnonzero(label != np.arange(n))
    return child, label[child]


def near_links(values: np.ndarray, split: int | None, radius: int, block: int = BLOCK, wide: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Like `forest`, but pairs that are themselves within `radius`: a row's links to its nearest come first within a
    block of comparisons, and links that close a ring are left out. Also the rows that are within `wide` (at least
    `radius`) of any other."""
    n = len(values)
    label, met = np.arange(n), np.zeros(n, bool)
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for u, v in _block_pairs(values, split, radius if wide is None else wide, block):
        met[u] = True
        met[v] = True
        apart = np.concatenate([np.zeros(0, np.int64), *(np.bitwise_count(values[u[x : x + block]] ^ values[v[x : x + block]]).sum(axis=1, dtype=np.int64) for x in range(0, len(u), block))])
        use = apart <= radius
        u, v, apart = u[use], v[use], apart[use]
        while True:
            high, low = np.maximum(label[u], label[v]), np.minimum(label[u], label[v])
            differ = high != low
            if not differ.any():
                break
            u, v, apart, high, low = u[differ], v[differ], apart[differ], high[differ], low[differ]
            order = np.lexsort((low, apart, high))
            first = order[np.concatenate([[True], np.diff(high[order]) != 0])]
            out.append((u[first], v[first]))  # each group hangs under a smaller one by one link
            label[high[first]] = low[first]
            while not (label[label] == label).all():
                label = label[label]
    empty = np.zeros(0, np.int64)
    return np.concatenate([empty, *(u for u, _ in out)]), np.concatenate([empty, *(v for _, v in out)]), np.flatnonzero(met)


def _block_pairs(values: np.ndarray, split: int | None, radius: int, block: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows within `radius`, by blocks, as in `forest`; u < v."""
    n = len(values)
    cuts = lambda lo, hi: [(x, min(x + block, hi)) for x in range(lo, hi, block)]
    left = cuts(0, n if split is None else split)
    right = left if split is None else cuts(split, n)
    boxes = {s: (q.min(axis=0), q.max(axis=0)) for s in {*left, *right} for q in (_quarters(values[s[0] : s[1]]),)}
    for i, a in enumerate(left):
        for b in right[i if split is None else 0 :]:
            if _gap(*boxes[a], *boxes[b]) > radius:
                continue
            u, v = _near(values[a[0] : a[1]], values[b[0] : b[1]], radius)
            u, v = u + a[0], v + b[0]
            yield (u[u < v], v[u < v]) if a == b else (u, v)


def _tile_table(ws: Workspace, distinct: DataFrame, name: str, radius: int, words: int, tiles: int | None) -> DataFrame:
    """`distinct` (rep long, fp binary, each fp once) with its tile and, a row for each, the pairs of tiles that may hold
    links within the radius: (rep, fp, tile, pair)."""
    step = 2 * words  # bytes in a quarter of the bits; a word's quarters for a single word
    count = lambda i: sum((F.bit_count(F.conv(F.hex(F.substring("fp", i * step + k + 1, 1)), 16, 10).cast("int")) for k in range(step)), F.lit(0))
    ordered = distinct.select("rep", "fp", *[count(i).alias(f"q{i}") for i in range(4)])
    order = [F.col(c) for c in ("q0", "q1", "q2", "q3", "fp")]
    placed = sorted_positions(ws, ordered, order, f"{name}-sorted", "at")
    n = distinct.count()
    tiles = min(MAX_TILES, tiles or max(LEAST_TILES, round(n ** (1 / 3) / 6), -(-n * words // TILE_WORDS)))
    rows = max(1, -(-n // tiles))
    tiled = placed.withColumn("tile", F.floor(F.col("at") / rows).cast("int"))
    # One row for each tile, MAX_TILES at most.
    boxes = tiled.groupBy("tile").agg(*[f(f"q{i}").alias(f"{k}{i}") for i in range(4) for k, f in (("lo", F.min), ("hi", F.max))]).collect()
    lows = {r["tile"]: np.array([r[f"lo{i}"] for i in range(4)]) for r in boxes}
    highs = {r["tile"]: np.array([r[f"hi{i}"] for i in range(4)]) for r in boxes}
    numbers = sorted(lows)
    partners: dict[int, list[int]] = {t: [] for t in numbers}
    for i, a in enumerate(numbers):
        for b in numbers[i:]:
            if _gap(lows[a], highs[a], lows[b], highs[b]) <= radius:
                pair = a * MAX_TILES * 2 + b
                partners[a].append(pair)
                if b != a:
                    partners[b].append(pair)
    table = ws.spark.createDataFrame([(t, p) for t, ps in partners.items() for p in ps], "tile int, pair int")
    return tiled.select("rep", "fp", "tile").join(F.broadcast(table), "tile", "inner")


def _unpacked(group: pa.Table, words: int) -> tuple[np.ndarray, int | None, np.ndarray]:
    """(fingerprints, where the second tile begins, order of the group's rows) of a pair of tiles. In a tile, rows with
    close counts lie together."""
    tile, rep = group.column("tile").to_numpy(), group.column("rep").to_numpy()
    fp = np.frombuffer(b"".join(group.column("fp").to_pylist()), ">u8").astype(np.uint64).reshape(-1, words)
    q = _quarters(fp)
    order = np.lexsort((rep, fp[:, 0], q[:, 3], q[:, 2], q[:, 1], q[:, 0], tile))
    split = int(np.searchsorted(tile[order], tile[order][0], "right"))
    return fp[order], None if split == len(fp) else split, order


def links(ws: Workspace, distinct: DataFrame, name: str, radius: int = RADIUS, words: int = 1, tiles: int | None = None) -> DataFrame:
    """(u, v): links that connect the same rows as all pairs of `distinct` (rep long, fp binary, each fp once)
    within `radius` do."""
    dealt = _tile_table(ws, distinct, name, radius, words, tiles)

    def compare(group: pa.Table) -> pa.Table:
        fp, split, order = _unpacked(group, words)
        rep = group.column("rep").to_numpy()[order]
        child, root = forest(fp, split, radius)
        return pa.table({"u": pa.array(rep[child]), "v": pa.array(rep[root])})

    return dealt.groupBy("pair").applyInArrow(compare, "u long, v long")


def components(ws: Workspace, prints: DataFrame, key: str = "doc_id", radius: int = RADIUS, words: int = 1, tiles: int | None = None) -> DataFrame:
    """(fp, component) for every fingerprint of `prints` (key, fp): the smallest key reachable over links."""
    classes = ws.table(prints.groupBy("fp").agg(F.min(key).alias("rep")), "classes")
    # A class whose keys are all null has no name and is no stepping stone; its component is null.
    named = classes.filter(F.col("rep").isNotNull())
    edges = ws.table(links(ws, named, "tiles", radius, words, tiles), "edges")
    found = connected_components(ws, edges, "rounds")
    return classes.join(found, F.col("rep") == F.col("node"), "left").select("fp", F.coalesce("component", "rep").alias("component"))


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS, size: int = SHINGLE) -> DataFrame:
    """Every row's key, fingerprint (16 hex digits) and component_id, the smallest key in its component.

    Rows link when their fingerprints differ in at most `radius` bits. Null and empty texts have fingerprint zero
    and link like any other; repeated rows stay and share a component; a null key takes part but is never a
    component's name (null if nothing else is reachable). Very long texts count whole. Other columns are ignored; an empty table gives none.
    """
    spark = df.sparkSession
    ws = Workspace(spark, "simhash")
    prints = ws.table(fingerprints(df.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")), "t"), "prints")
    found = components(ws, prints, "k", radius)
    joined = skew_join(prints, found, ["fp"], "inner")
    return joined.select(F.col("k").alias(key), F.lower(F.hex("fp")).alias("fingerprint"), F.col("component").alias("component_id"))


def differ(shared: int, left: int, right: int) -> float:
    """How likely a bit of the SimHashes of two sets differs that share so many elements and have so many of their own:
    each hash has the bit with probability a half, and the bit is set in the SimHash if over half of the hashes have it."""
    pascal = lambda n: np.array([comb(n, i) for i in range(n + 1)], float) / 2.0**n
    s, x, y = pascal(shared), pascal(left), pascal(right)
    at = np.arange(shared + 1)
    over = lambda own, p: np.array([p[2 * (k + np.arange(own + 1)) > shared + own].sum() for k in at])
    a, b = over(left, x), over(right, y)
    return float((s * (a * (1 - b) + b * (1 - a))).sum())


def radius_for(similarity: float, words: int, slack: float = 5.0) -> int:
    """Bits of 64 * words in which sets of this Jaccard similarity or more differ at most, plus `slack` standard
    deviations: of sets of any size, of which small ones differ in more bits than the angle between them tells."""
    shared = 2 * similarity / (1 + similarity)
    worst = float(np.arccos(min(1.0, shared)) / np.pi)
    for s in range(1, 40):
        own = int(s / similarity - s + 1e-9)  # elements that one of them alone has, in all
        worst = max([worst, *(differ(s, x, own - x) for x in range(own // 2 + 1))])
    n = 64 * words
    return int(np.ceil(n * worst + slack * (n * worst * (1 - worst)) ** 0.5))


def shingle_sets(df: DataFrame, size: int, words: int = 0) -> DataFrame:
    """(r, k, t) to (r, k, fp, cid, sh): the SimHash of a text's distinct shingles (empty for no words), a digest of
    their set, and the set: HASH_BYTES of each shingle's hash, in order."""
    names = ["r", "k", "fp", "cid", "sh"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(at, SLICE) for whole in batches for at in range(0, whole.num_rows, SLICE)):
            out: list[list[bytes]] = [[], [], []]
            for t in b.column(2):
                tokens = (t.as_py() or "").encode("utf-8", "surrogatepass").lower().split()
                once = np.unique(np.concatenate(list(_hashes(tokens, size)))) if tokens else np.zeros(0, np.uint64)
                out[0].append(_bits(once, words).astype(">u8").tobytes() if words else b"")
                out[1].append(xxhash.xxh3_128_digest(once.tobytes()))
                out[2].append(np.ascontiguousarray(once.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :HASH_BYTES]).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(x, pa.binary()) for x in out)], names=names)

    return df.select("r", "k", "t").mapInArrow(frugal(run), "r long, k long, fp binary, cid binary, sh binary")


def _bits(once: np.ndarray, words: int) -> np.ndarray:
    """SimHash of hashes."""
    total = np.zeros(64 * words, np.int64)
    for at in range(0, len(once), STEP):
        hashes = once[at : at + STEP]
        columns = np.stack([hashes, *(_mixed(hashes, k) for k in range(1, words))], axis=1)
        bits = np.unpackbits(columns.astype("<u8", copy=False).view(np.uint8).reshape(len(hashes), 8 * words), axis=1, bitorder="little")
        total += np.add.reduce(bits, axis=0, dtype=np.uint32)
    return np.packbits(2 * total > len(once), bitorder="little").view("<u8").astype(np.uint64)


def _set(data: bytes) -> np.ndarray:
    """The numbers that HASH_BYTES each stand for, in order."""
    raw = np.frombuffer(data, np.uint8).reshape(-1, HASH_BYTES)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, 8 - HASH_BYTES :] = raw
    return wide.view(">u8")[:, 0].astype(np.uint64)


def alike(shared, left, right, similarity: float):
    """Whether sets of sizes left and right that share so many elements have the Jaccard similarity."""
    return shared >= similarity * (left + right - shared) - 1e-9


def verified_links(sets: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Links (indexes) that connect the same sets as all pairs of the given Jaccard similarity do."""
    n = len(sets)
    sizes = np.array([len(x) for x in sets], np.int64)
    row = np.repeat(np.arange(n), sizes)
    _, column, count = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_inverse=True, return_counts=True)
    use = count[column] > 1
    row, column = row[use], np.unique(column[use], return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    shared = np.zeros((n, n), np.float32)
    width = int(column[-1]) + 1 if len(column) else 0
    for at in range(0, width, COLUMNS):
        lo, hi = np.searchsorted(column, [at, at + COLUMNS])
        part = np.zeros((n, min(COLUMNS, width - at)), np.float32)
        part[row[lo:hi], column[lo:hi] - at] = 1
        shared += part @ part.T
    linked = alike(shared.astype(np.int64), sizes[:, None], sizes[None, :], similarity)
    u, v = np.nonzero(np.triu(linked, 1))
    label = np.arange(n)
    while True:
        high, low = np.maximum(label[u], label[v]), np.minimum(label[u], label[v])
        if (high == low).all():
            break
        np.minimum.at(label, high, low)
        while not (label[label] == label).all():
            label = label[label]
    child = np.flatnonzero(label != np.arange(n))
    return child, label[child]


def least_shared(size, similarity: float):
    """Elements that a set of this size shares at least with any set at the Jaccard similarity to it."""
    return np.ceil(similarity * np.asarray(size) - 1e-9).astype(np.int64)


def first_length(size, similarity: float):
    """How many elements of a set are its first ones."""
    return np.minimum(size, np.asarray(size) - least_shared(size, similarity) + SHARED)


def first_shared(left, right, similarity: float):
    """First elements that two sets of these sizes at the similarity have in common at least. Of the set whose first
    ones end sooner in the order, all that are in the other are among the other's first ones, so whatever else the two
    share is in the rest of that set."""
    rest = np.maximum(left - first_length(left, similarity), right - first_length(right, similarity))
    both = np.ceil(similarity / (1 + similarity) * (np.asarray(left) + right) - 1e-9).astype(np.int64)
    return np.maximum(1, both - rest)


def first_shingles(whole: np.ndarray, similarity: float, frequent: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first elements of a set, by counts (0 for those not in `frequent`, which is in order) and value."""
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, whole), len(frequent) - 1)
        whole = whole[np.argsort(np.where(frequent[at] == whole, counts[at], 0), kind="stable")]
    return whole[: int(first_length(len(whole), similarity))]


def _dealt(sets: DataFrame, parts: int, first: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(part, data): the shingles `first` of each set in `sets` (r, sh), dealt to parts by their value. `data` packs
    shingles, their texts' r and the sizes of their sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: list[tuple[np.ndarray, int, int]] = []
        held = 0

        def packed() -> pa.RecordBatch:
            t = np.concatenate([x for x, _, _ in pending])
            r, n = (np.repeat(np.array([x[i] for x in pending], kind), [len(x[0]) for x in pending]) for i, kind in ((1, "<i8"), (2, "<i4")))
            part = (t % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            cuts = np.flatnonzero(np.diff(part[order], prepend=-1))
            spans = [order[lo:hi] for lo, hi in zip(cuts, [*cuts[1:], len(order)], strict=True)]
            data = [t[x].astype("<u8").tobytes() + r[x].tobytes() + n[x].tobytes() for x in spans]
            return pa.RecordBatch.from_arrays([pa.array(part[order[cuts]], pa.int32()), pa.array(data, pa.binary())], names=["part", "data"])

        for b in batches:
            for r, sh in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                whole = _set(sh.as_py())
                if len(whole):
                    pending.append((first(whole), r, len(whole)))
                    held += len(pending[-1][0])
                if held >= PENDING:
                    yield packed()
                    pending, held = [], 0
        if held:
            yield packed()

    return sets.select("r", "sh").mapInArrow(frugal(run), "part int, data binary")


def _undealt(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingles, texts and sizes of a part."""
    out: tuple[list[np.ndarray], ...] = ([], [], [])
    for x in group.column("data"):
        data = x.as_py()
        m = len(data) // 20
        for into, kind, at in zip(out, ("<u8", "<i8", "<i4"), (0, 8 * m, 16 * m), strict=True):
            into.append(np.frombuffer(data, kind, m, at))
    t, r, n = (np.concatenate(x) for x in out)
    return t.astype(np.uint64), r.astype(np.int64), n.astype(np.int64)


def frequent_shingles(sets: DataFrame, texts: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that most of about SAMPLE of the sets have, in order, and how many of these have each."""
    some = sets if texts <= SAMPLE else sets.filter(F.pmod(F.xxhash64("r"), F.lit(-(-texts // SAMPLE))) == 0)
    most = max(1, 4 * FREQUENT // parts)

    def count(group: pa.Table) -> pa.Table:
        t, n = np.unique(_undealt(group)[0], return_counts=True)
        t, n = t[n > 1], n[n > 1]
        top = np.argsort(-n, kind="stable")[:most]
        release()
        return pa.table({"t": pa.array(t[top].astype(np.int64)), "n": pa.array(n[top].astype(np.int64))})

    found = _dealt(some, parts, lambda whole: whole).groupBy("part").applyInArrow(count, "t long, n long").orderBy(F.desc("n"), "t").limit(FREQUENT).toArrow()
    t, n = found.column("t").to_numpy(), found.column("n").to_numpy()
    order = np.argsort(t)
    return t[order].astype(np.uint64), n[order]


def _pairs(t: np.ndarray, r: np.ndarray, n: np.ndarray, g: np.ndarray, similarity: float, following: int | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indexes of rows (shingle, text, size, group) that have a shingle in common, are of different groups, and of sizes
    that the similarity allows, a slice at a time: of each row and the next `following` ones with its shingle in order
    of size, and the HUBS smallest texts with it, or all. Rows are in order of shingle and size."""
    start = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]])[: len(t)])
    length = np.diff(np.append(start, len(t)))
    end = np.repeat(start + length, length)
    fits = lambda i, j: n[i] >= similarity * n[j] - 1e-9
    whole = following is None
    at = np.flatnonzero(np.repeat(length <= LONG_RUN, length)) if whole else np.arange(len(t))
    for k in range(1, (LONG_RUN if whole else following) + 1):
        at = at[at + k < end[at]]
        at = at[fits(at, at + k)]  # sizes grow, so what does not fit never will
        for x in range(0, len(at), PAIRS):
            i = at[x : x + PAIRS]
            i = i[g[i] != g[i + k]]
            yield i, i + k
    if not whole:
        order, run = np.lexsort((r, t)), np.repeat(np.arange(len(start)), length)
        for k in range(HUBS):
            hub = order[np.minimum(start + k, start + length - 1)][run]
            at = np.flatnonzero((k < length[run]) & (r > r[hub]) & (abs(hub - np.arange(len(t))) > following) & (g != g[hub]))
            low, high = np.minimum(at, hub[at]), np.maximum(at, hub[at])
            use = fits(low, high)
            yield low[use], high[use]
        return
    for lo, m in zip(start[length > LONG_RUN], length[length > LONG_RUN], strict=True):
        names, count = np.unique(g[lo : lo + m], return_counts=True)
        other = g[lo : lo + m] != names[np.argmax(count)]  # rows out of the largest group meet all, and each other once
        for i in np.flatnonzero(other):
            j = np.flatnonzero((g[lo : lo + m] != g[lo + i]) & ~(other & (np.arange(m) <= i)))
            low, high = lo + np.minimum(i, j), lo + np.maximum(i, j)
            use = fits(low, high)
            yield low[use], high[use]


def _candidates(shared: DataFrame, parts: int, similarity: float, following: int | None) -> DataFrame:
    """(u, v): pairs of texts in `shared` (t, r, n, c, g) that have as many first shingles in common as the similarity
    asks for, by `_pairs`; c is how many of a text's first shingles any other text has. With all pairs of different
    groups, none at the similarity is missing."""

    def meet(group: pa.Table) -> Iterator[pa.RecordBatch]:
        t, r, n, g, c = (group.column(x).to_numpy() for x in ("t", "r", "n", "g", "c"))
        order = np.lexsort((r, n, t))
        t, r, n, g, c = t[order], r[order], n[order], g[order], c[order]
        kept: list[np.ndarray] = []
        held = 0

        def counted() -> pa.RecordBatch:
            rows = np.concatenate(kept)
            rows = rows[np.lexsort(rows.T)]
            new = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]).any(axis=1)]))
            names = ["u", "v", "need", "n"]
            return pa.RecordBatch.from_arrays([*(pa.array(rows[new, i]) for i in range(3)), pa.array(np.diff(np.append(new, len(rows))).astype(np.int64))], names=names)

        for i, j in _pairs(t, r, n, g, similarity, following):
            need = first_shared(n[i], n[j], similarity)
            use = np.minimum(c[i], c[j]) >= need
            i, j, need = i[use], j[use], need[use] if following is None else np.minimum(need[use], SHARED)  # not all are seen
            kept.append(np.stack([np.minimum(r[i], r[j]), np.maximum(r[i], r[j]), need], axis=1))
            held += len(i)
            if held >= PAIRS:
                yield counted()
                kept, held = [], 0
        if held:
            yield counted()
        release()

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from meet(pa.Table.from_batches(found))

    batches.__annotations__ = {"found": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}  # Spark reads the types, not their names
    met = shared.groupBy(F.pmod("t", F.lit(parts)).alias("part")).applyInArrow(batches, "u long, v long, need long, n long")
    return met.groupBy("u", "v", "need").agg(F.sum("n").alias("n")).filter("n >= need").select("u", "v")


def _verified(ws: Workspace, pairs: DataFrame, sets: DataFrame, similarity: float, name: str) -> DataFrame:
    """The pairs (u, v), a written table, whose sets in `sets` (r, sh) have the similarity."""
    ids = ws.table(pairs.select(F.col("u").alias("r")).unionByName(pairs.select(F.col("v").alias("r"))).distinct(), f"{name}-ids")
    mine = ws.table(only_ids(sets, ids, "r"), f"{name}-sets")
    both = skew_join(pairs, mine.select(F.col("r").alias("u"), F.col("sh").alias("a")), ["u"], "inner")
    both = skew_join(both, mine.select(F.col("r").alias("v"), F.col("sh").alias("b")), ["v"], "inner")

    def true(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = _set(x.as_py()), _set(y.as_py())
                keep.append(bool(alike(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y), similarity)))
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(keep)), b.column(1).filter(pa.array(keep))], names=["u", "v"])

    return ws.table(both.select("u", "v", "a", "b").mapInArrow(frugal(true), "u long, v long"), name)


def duplicate_groups(ws: Workspace, prints: DataFrame, similarity: float, words: int = 0, tiles: int | None = None) -> DataFrame:
    """(cid, component) of every class of equal shingle sets in `prints` (r, k, fp, cid, sh): the smallest r reachable
    over pairs of sets at the similarity. Sketches of `words` words in `prints` are not looked at; first shingles are
    dealt to `tiles` parts, or to as many as their number asks for."""
    classes = ws.table(prints.groupBy("cid").agg(F.min("r").alias("rep"), F.first(F.length("sh")).alias("bytes")), "classes")
    sets = only_ids(prints.select("r", "sh"), classes.select("rep"), "r")
    texts, elements = classes.agg(F.count(F.lit(1)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    parts = tiles or max(4 * input_partitions(prints), int((1 - similarity) * elements / HASH_BYTES + SHARED * texts) // DEALT + 1)
    frequent, counts = frequent_shingles(sets, texts, parts)
    firsts = _dealt(sets, parts, lambda whole: first_shingles(whole, similarity, frequent, counts))

    def repeated(group: pa.Table) -> pa.Table:
        t, r, n = _undealt(group)
        order = np.argsort(t, kind="stable")
        same = t[order[1:]] == t[order[:-1]]
        use = order[np.concatenate([[False], same]) | np.concatenate([same, [False]])] if len(t) > 1 else order[:0]
        release()
        return pa.table({"t": pa.array(t[use].astype(np.int64)), "r": pa.array(r[use]), "n": pa.array(n[use])})

    met = ws.table(firsts.groupBy("part").applyInArrow(repeated, "t long, r long, n long"), "met")
    # A text whose first shingles are too few in other texts for any pair is no candidate.
    counted = met.withColumn("c", F.count(F.lit(1)).over(Window.partitionBy("r")))
    shared = ws.table(counted.filter(F.col("c") >= F.least(F.lit(SHARED), F.ceil(similarity * F.col("n") - 1e-9))), "shared")
    next_ones = ws.table(_candidates(shared.withColumn("g", F.col("r")), parts, similarity, FOLLOWING), "next")
    sure = _verified(ws, next_ones, sets, similarity, "sure")
    groups = ws.table(connected_components(ws, sure, "first"), "groups")
    named = shared.join(groups, F.col("r") == F.col("node"), "left").select("t", "r", "n", "c", F.coalesce("component", "r").alias("g"))
    # What the first round has compared needs no second look.
    between = ws.table(_candidates(named, parts, similarity, None).join(next_ones, ["u", "v"], "left_anti"), "between")
    more = _verified(ws, between, sets, similarity, "more")
    ends = connected_components(ws, sure.unionByName(more), "rounds")
    return classes.join(ends, F.col("rep") == F.col("node"), "left").select("cid", F.coalesce("component", "rep").alias("component"))


def deduplicate(df: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = 0.8, size: int = 5) -> DataFrame:
    """The rows of `df` without near-duplicates: of each component the row with the smallest key stays.

    Texts link when their sets of `size`-word shingles have the given Jaccard similarity or more: candidates are all texts
    that share enough of their rarest shingles, and each link is verified on the sets, so none is false or missed. Rows with a null key stay as they are, having no name to be compared by; of
    rows that repeat the kept key, one stays. Texts without words, null ones too, are copies of each other; very long
    texts are compared whole; other columns pass through; an empty table gives an empty one.
    """
    spark = df.sparkSession
    ws = Workspace(spark, "simhash-keep")
    rid = unique_name(df, "__row")
    # Written once with its row numbers, so they stay the same however often tasks run.
    base = ws.table(df.withColumn(rid, F.monotonically_increasing_id()), "rows")
    pick = base.select(F.col(rid).alias("r"), F.col(key).cast("long").alias("k"), F.col(text).alias("t")).filter(F.col("k").isNotNull())
    prints = ws.table(shingle_sets(pick, size), "prints")
    found = duplicate_groups(ws, prints, similarity)
    best = skew_join(prints.select("r", "k", "cid"), found, ["cid"], "inner").groupBy("component").agg(F.min(F.struct("k", "r")).alias("first")).select(F.col("first.r").alias(rid))
    kept = base.join(best, rid, "left_semi")
    return kept.unionByName(base.filter(F.col(key).isNull())).drop(rid)
