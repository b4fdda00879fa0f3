"""Quality rules in DataFrame operations: counts of every whole text, then a hashed n-gram log-likelihood ratio.

The ratio compares two multinomials over hashed word unigrams and bigrams: one of trusted documents, one of the
whole corpus. A document's score is the mean log ratio of its n-grams, so length does not matter, and it is kept
if the score reaches a fixed threshold; there is no random draw.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import fenced, skew_join

#: Words are runs of anything but ASCII white space.
SPACE = "[ \\t-\\r]+"
SYMBOLS = "[^#*$%&|<>]+"
BUCKETS = 1 << 14
#: Trusted ids that are broadcast at most (8 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 2_000_000
#: Strength of the target's prior, which is the corpus itself: n-grams for each bucket, or this share of the target's
#: own where that is more. Where the trusted documents have seen little, the ratio stays near 0, so few of them do not
#: condemn clean text; and with more of them the ratios, and what the threshold asks for, stay alike at every size.
PRIOR = 16
PRIOR_SHARE = 0.1
#: Least mean log ratio of a kept document.
THRESHOLD = -0.06
MIN_WORDS = 20
REPEAT_PERCENT = 30
WINDOW = 8


def _pairs(a: str, step: int, length: Column) -> Column:
    """Hashes of the elements i and i + step of an array of hashes, `length` of them."""
    n = F.greatest(length, F.lit(0))
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(a, F.lit(1 + step), n), lambda x, y: F.xxhash64(x, y))


def with_words(df: DataFrame, text: str) -> DataFrame:
    """Adds __w (words), __n, __h1 and __h2 (hashes of words and of pairs of neighbours)."""
    d = df.withColumn("__w", F.filter(F.split(F.coalesce(F.col(text), F.lit("")), SPACE), lambda w: w != ""))
    d = d.withColumn("__n", F.size("__w")).withColumn("__h1", F.transform("__w", lambda w: F.xxhash64(w)))
    return d.withColumn("__h2", _pairs("__h1", 1, F.col("__n") - 1))


def buckets() -> Column:
    """The n-gram buckets of a row that has __h1 and __h2."""
    of = lambda c: F.transform(c, lambda h: F.pmod(h, F.lit(BUCKETS)).cast("int"))
    return F.concat(of("__h1"), of("__h2"))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """The ids of all documents labelled good."""
    return labels.filter((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("__id")).distinct()


def log_ratios(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> list[float]:
    """Log ratio of each bucket, BUCKETS of them: trusted documents against all rows.

    Every n-gram of every row is counted, and every trusted row. Without any trusted row, or without any n-gram, all
    ratios are 0.
    """
    good = trusted_ids(labels).withColumn("__good", F.lit(1))
    rows = df.select(F.col(key).cast("long").alias("__id"), F.col(text).alias("__t"))
    few = good.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    marked = rows.join(F.broadcast(good), "__id", "left") if few else skew_join(rows, good, ["__id"], "left")
    grams = fenced(with_words(marked, "__t").select("__good", "__h1", "__h2"), {"__b": buckets()}).select("__good", F.explode("__b").alias("b"))
    counts = grams.groupBy("b").agg(F.count(F.lit(1)).alias("raw"), F.count("__good").alias("good"))
    raw, good = [0] * BUCKETS, [0] * BUCKETS
    for r in counts.collect():  # BUCKETS rows at most
        raw[r["b"]], good[r["b"]] = r["raw"], r["good"]
    return ratios(raw, good)


def ratios(raw: list[int], good: list[int]) -> list[float]:
    from math import log

    n, m, k = sum(raw), sum(good), len(raw)
    if not n or not m:
        return [0.0] * k
    mu = max(float(PRIOR * k), PRIOR_SHARE * m)
    # log of ((g + mu * r / n) / (m + mu)) / (r / n); a bucket that the corpus never hits has ratio 0.
    return [round(log((g * n / r + mu) / (m + mu)), 9) if r else 0.0 for r, g in zip(raw, good, strict=True)]


def _literal(values: list[float]) -> Column:
    """The bounded table of ratios as one constant: Catalyst folds the cast once for the plan."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast("array<double>")


def scored(df: DataFrame, weights: list[float], text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """`df` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, llr and kept.

    Null texts count as empty: all counts 0, base_failed true, llr 0. Columns of `df` with these names are replaced.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", "kept"]
    own = [c for c in df.columns if c.lower() not in made or c == text]
    d = with_words(df.select(*own), text)
    # Hashes of 4 and 8 words by doubling; each window's hash and start are sorted only where a hash repeats.
    d = d.withColumn("__h4", _pairs("__h2", 2, F.col("__n") - 3))
    d = d.withColumn("__h8", _pairs("__h4", 4, F.col("__n") - 7))
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    d = d.withColumn("__s", F.when(F.size(F.array_distinct("__h8")) == F.size("__h8"), none).otherwise(F.sort_array(F.transform("__h8", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    m = F.greatest(F.size("__s") - 1, F.lit(0))
    same = F.zip_with(F.slice("__s", F.lit(1), m), F.slice("__s", F.lit(2), m), lambda x, y: F.when(x["h"] == y["h"], F.array(x["i"], y["i"])).otherwise(F.array().cast("array<int>")))
    d = d.withColumn("__at", F.sort_array(F.array_distinct(F.flatten(same))))
    covered = F.aggregate(
        "__at", F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("sum")),
        lambda a, i: F.struct(i.alias("last"), (a["sum"] + F.least(F.lit(WINDOW), i - a["last"])).alias("sum")), lambda a: a["sum"])
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike("[^ \\t-\\r]"))
    d = d.withColumn("__lines", lines)
    table = _literal(weights)
    d = d.withColumn("__b", buckets())
    total = F.aggregate("__b", F.lit(0.0), lambda a, b: a + F.element_at(table, b + 1))
    d = fenced(d, {
        "n_words": F.col("__n").cast("long"),
        "word_chars": F.length(F.regexp_replace(t, SPACE, "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace(t, SYMBOLS, "")).cast("long"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        "n_repeat_words": covered.cast("long"),
        "llr": F.when(F.size("__b") > 0, total / F.size("__b")).otherwise(0.0)}).select(*own, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "llr")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return d.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold))


def judge(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`scored` with ratios fitted to `df` itself and the trusted ids in `labels`.

    An empty table gives an empty one; repeated rows count as often as they occur; a null key is never trusted.
    """
    return scored(df, log_ratios(df, labels, key, text), text)
