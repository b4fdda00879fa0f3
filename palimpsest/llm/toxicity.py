"""Toxicity by a factorization machine over hashed terms.

Terms are a text's lower-cased words and the first three to six characters of each longer word. A text is the set
of its terms that the training sample shows to be telling; the model adds a weight for each and, for each pair, the
inner product of their factors, so that an insult together with the mention of a group can weigh more, or less,
than the two apart.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import Workspace, frugal

#: Labelled rows that the model is fitted to, at most, half of either label if there are as many: those with the
#: smallest hashes. With MODEL_TERMS this bounds what the driver gathers, however long the texts are.
TRAIN_ROWS = 8_000
HASH_BITS = 24
PREFIXES = (3, 4, 5, 6)
#: Terms that the model keeps, at most, by their likelihood ratio statistic on the sample.
MODEL_TERMS = 4_096
#: Least statistic of a kept term; a random term passes about once in ten thousand times.
LEAST_STATISTIC = 15.0
FACTORS = 8
EPOCHS = 60
#: Start, decay and step of the factors: large enough that pairs decide what single terms leave open.
FACTOR_START = 0.1
FACTOR_DECAY = 1e-3
FACTOR_STEP = 0.1
WEIGHT_DECAY = 1e-3
WEIGHT_STEP = 0.5
FOLDS = 5
_WORD = re.compile(r"\w+")
#: Words that a worker remembers the terms of; and of which it remembers the model's terms alone, few for most.
CACHE = 50_000
TOLD = 200_000


def word_terms(word: str) -> tuple[int, ...]:
    """Hashed terms of a word."""
    mask = (1 << HASH_BITS) - 1
    made = [f"w:{word}", *(f"p:{word[:n]}" for n in PREFIXES if len(word) > n)]
    return tuple(xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass")) & mask for x in made)


def terms(text: str | None, cache: dict[str, tuple[int, ...]]) -> set[int]:
    """The set of hashed terms of a whole text."""
    out: set[int] = set()
    for word in set(_WORD.findall((text or "").lower())):
        got = cache.get(word)
        if got is None:
            if len(cache) >= CACHE:
                cache.clear()
            got = word_terms(word)
            if len(word) <= 64:
                cache[word] = got
        out.update(got)
    return out


class FactorizationMachine:
    """Score of a set of terms: sigmoid(bias + sum of weights + sum over pairs of the factors' inner products)."""

    def __init__(self, keys: np.ndarray, bias: float, weights: np.ndarray, factors: np.ndarray):
        self.keys, self.bias, self.weights, self.factors = keys, bias, weights, factors
        self.place = {int(k): i for i, k in enumerate(keys)}

    def score(self, found: set[int]) -> float:
        place = self.place
        at = sorted(place[t] for t in found if t in place)
        z = self.bias
        if at:
            v = self.factors[at]
            z += self.weights[at].sum() + 0.5 * float((v.sum(axis=0) ** 2 - (v * v).sum(axis=0)).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def held_out(key) -> F.Column:
    """True for ids whose crc32, as text, leaves 0 when divided by FOLDS; a null id is held out."""
    return F.coalesce(F.crc32(F.encode(key.cast("string"), "UTF-8")) % FOLDS == 0, F.lit(True))


def training_rows(df: DataFrame, labels: DataFrame, key: str, text: str, rows: int) -> DataFrame:
    """(k, t, toxic): the labelled rows that the model may learn from, `rows` at most. Of rows with the same key that
    with the smallest text counts; an id that is labelled in both ways is toxic."""
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("k"), F.col("toxic").cast("int").alias("toxic"))
    known = known.groupBy("k").agg(F.max("toxic").alias("toxic")).filter(~held_out(F.col("k")))
    # Two bounded samples; each is the rows with the smallest hashes.
    side = lambda label: known.filter(F.col("toxic") == label).orderBy(F.xxhash64("k"), "k").limit(rows // 2)
    picked = side(1).unionByName(side(0))
    found = df.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).join(F.broadcast(picked), "k", "inner")
    return found.groupBy("k", "toxic").agg(F.min("t").alias("t")).select("k", "t", "toxic")


def _likelihood(observed, expected):
    return np.where(observed > 0, observed * np.log(np.maximum(observed, 1e-12) / np.maximum(expected, 1e-12)), 0)


def statistics(df: np.ndarray, hit: np.ndarray, n: int, pos: int) -> np.ndarray:
    """Likelihood ratio statistic of terms in `df` of n rows and in `hit` of the pos toxic ones."""
    g = _likelihood
    return 2 * (g(hit, df * pos / n) + g(df - hit, df * (n - pos) / n) + g(pos - hit, (n - df) * pos / n) + g((n - df) - (pos - hit), (n - df) * (n - pos) / n))


def statistic_column(df: F.Column, hit: F.Column, n: int, pos: int) -> F.Column:
    """`statistics` in Spark."""
    def g(observed, expected):
        return F.when(observed > 0, observed * F.log(observed / F.greatest(expected, F.lit(1e-12)))).otherwise(0.0)

    total, toxic = F.lit(float(n)), F.lit(float(pos))
    return 2 * (g(hit, df * toxic / total) + g(df - hit, df * (total - toxic) / total) + g(toxic - hit, (total - df) * toxic / total)
                + g((total - df) - (toxic - hit), (total - df) * (total - toxic) / total))


def fit(sample: list[tuple[np.ndarray, int]]) -> FactorizationMachine:
    """Fit to (terms, label) pairs in memory: pick the telling terms, then `learn`."""
    y = np.array([t for _, t in sample], float)
    if len(sample) == 0 or y.min() == y.max():
        return learn(sample, np.zeros(0, np.int64))
    keys, inverse = np.unique(np.concatenate([x for x, _ in sample]), return_inverse=True)
    row = np.repeat(np.arange(len(sample)), [len(x) for x, _ in sample])
    df = np.bincount(inverse, minlength=len(keys)).astype(float)
    hit = np.bincount(inverse, weights=y[row], minlength=len(keys))
    statistic = statistics(df, hit, len(sample), y.sum())
    order = np.lexsort((keys, -statistic))[:MODEL_TERMS]
    return learn(sample, np.sort(keys[order[statistic[order] >= LEAST_STATISTIC]]).astype(np.int64))


def learn(sample: list[tuple[np.ndarray, int]], keys: np.ndarray) -> FactorizationMachine:
    """The machine over the terms `keys`, in order, fitted to (terms, label) pairs: logistic loss by Adagrad over all
    rows, in a fixed order and from a fixed start. Without rows of both labels, every text scores alike."""
    y = np.array([t for _, t in sample], float)
    if len(sample) == 0 or y.min() == y.max():
        return FactorizationMachine(np.zeros(0, np.int64), -30.0 if not y.sum() else 0.0, np.zeros(0), np.zeros((0, FACTORS)))
    n, m, pos = len(sample), len(keys), y.sum()
    place = {int(k): i for i, k in enumerate(keys)}
    found = [[place[t] for t in x.tolist() if t in place] for x, _ in sample]
    row, at = np.repeat(np.arange(n), [len(x) for x in found]), np.array([i for x in found for i in x], np.int64)
    rng = np.random.default_rng(7)
    w, v, bias = np.zeros(m), rng.normal(0, FACTOR_START, (m, FACTORS)), -1.0
    sw, sv, sb = np.full(m, 1e-2), np.full((m, FACTORS), 1e-2), 1e-2
    weight = np.where(y > 0, n / (2 * pos), n / (2 * (n - pos)))
    for _ in range(EPOCHS):
        s = np.stack([np.bincount(row, weights=v[at, f], minlength=n) for f in range(FACTORS)], axis=1)
        q = np.stack([np.bincount(row, weights=v[at, f] ** 2, minlength=n) for f in range(FACTORS)], axis=1)
        z = bias + np.bincount(row, weights=w[at], minlength=n) + 0.5 * (s**2 - q).sum(axis=1)
        d = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / n * 10
        gw = np.bincount(at, weights=d[row], minlength=m) + WEIGHT_DECAY * w
        gv = np.stack([np.bincount(at, weights=d[row] * (s[row, f] - v[at, f]), minlength=m) for f in range(FACTORS)], axis=1) + FACTOR_DECAY * v
        gb = d.sum()
        sw, sv, sb = sw + gw**2, sv + gv**2, sb + gb**2
        w, v, bias = w - WEIGHT_STEP * gw / np.sqrt(sw), v - FACTOR_STEP * gv / np.sqrt(sv), bias - WEIGHT_STEP * gb / np.sqrt(sb)
    return FactorizationMachine(keys.astype(np.int64), float(bias), w, v)


def train(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", rows: int = TRAIN_ROWS) -> FactorizationMachine:
    """The model of at most `rows` labelled rows that are not held out.

    Terms are made, counted and chosen on the executors; the driver gets the chosen ones, MODEL_TERMS at most, and of
    each row those among its own."""
    ws = Workspace(df.sparkSession, "toxicity")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, tuple[int, ...]] = {}
        for b in batches:
            found = pa.array([sorted(terms(t.as_py(), cache)) for t in b.column(1)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), found, b.column(2)], names=["k", "x", "toxic"])

    sample = ws.table(training_rows(df, labels, key, text, rows).mapInArrow(frugal(run), "k long, x array<int>, toxic int"), "sample")
    n, pos = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    chosen: list[int] = []
    if 0 < pos < n:
        counts = sample.select(F.explode("x").alias("term"), "toxic").groupBy("term").agg(F.count(F.lit(1)).cast("double").alias("df"), F.sum("toxic").cast("double").alias("hit"))
        told = counts.select("term", statistic_column(F.col("df"), F.col("hit"), n, pos).alias("s")).filter(F.col("s") >= LEAST_STATISTIC)
        chosen = sorted(r["term"] for r in told.orderBy(F.desc("s"), "term").limit(MODEL_TERMS).collect())
    keys = np.array(chosen, np.int64)
    own = F.array_intersect("x", F.lit(chosen or [-1]))
    got = sample.select("k", own.alias("x"), "toxic").toArrow()
    found = sorted(zip(got.column("k").to_pylist(), got.column("x").to_pylist(), got.column("toxic").to_pylist(), strict=True))
    return learn([(np.array(x, np.int64), y) for _, x, y in found], keys)


def scored(df: DataFrame, model: FactorizationMachine, text: str = "text", score: str = "score") -> DataFrame:
    """`df` with a score in 0..1 for every whole text; null counts as empty. A column of that name is replaced."""
    keep = df.select(*[c for c in df.columns if c.lower() != score.lower() or c == text])
    schema = keep.withColumn(score, F.lit(0.0)).schema
    parts = (model.keys, model.bias, model.weights, model.factors)
    at = keep.columns.index(text)
    names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = FactorizationMachine(*parts)
        cache: dict[str, tuple[int, ...]] = {}
        known = machine.place.keys()

        def told(word: str) -> tuple[int, ...]:
            got = cache.get(word)
            if got is None:
                if len(cache) >= TOLD:
                    cache.clear()
                got = tuple(t for t in word_terms(word) if t in known)
                if len(word) <= 64:
                    cache[word] = got
            return got

        for b in batches:
            out = []
            for t in b.column(at):
                found: set[int] = set()
                for word in set(_WORD.findall((t.as_py() or "").lower())):
                    found.update(told(word))
                out.append(machine.score(found))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.float64())], names=names)

    return keep.mapInArrow(frugal(run), schema)


def judge(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", rows: int = TRAIN_ROWS) -> DataFrame:
    """`df` with held_out, score and predicted (1 if score >= 0.5), fitted to the labelled rows of `df`.

    Null texts count as empty and score alike; very long texts are scored whole; repeated rows score alike (which of
    several texts of a labelled key is learnt from: see training_rows); a row with a null key is scored and counts as held out; an empty table, or labels of one kind only, give a model without terms. Columns of `df` named like
    a result are replaced.
    """
    model = train(df, labels, key, text, rows)
    base = df.select(*[c for c in df.columns if c.lower() not in ("held_out", "score", "predicted")])
    return scored(base, model, text).withColumn("held_out", held_out(F.col(key))).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def crc_held_out(doc_id: int) -> bool:
    """The fold rule for one id."""
    return zlib.crc32(str(doc_id).encode()) % FOLDS == 0
