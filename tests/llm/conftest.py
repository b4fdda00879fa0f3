"""Rows that operators must bear: nulls, empty and very long texts, repeated rows, clashing columns."""

import pytest
from pyspark.sql import functions as F

LONG = " ".join(f"word{i % 997} naïve" for i in range(40_000))
EDGE = [
    (None, "a row without an id, long enough to be read by anyone who comes across it in passing"),
    (1, None), (2, ""), (3, " \t\n\x0b "), (4, LONG), (5, "same words again"), (5, "same words again"), (6, "same words again"),
    (7, "Ünïcödé 東京 … \U0001f600 text\n\ntext İstanbul ſ"), (8, "<|endoftext|> a<|startoftext|>b tricks"), (9, "nul \x00 and \x1c separators   wide"), (-3, "a negative id"),
]
#: Names that operators use for themselves or return.
CLASHES = [
    "score", "kept", "llr", "fp", "k", "t", "rank", "shard", "at", "hub", "node", "piece", "start", "length", "tile", "u", "v", "component", "block", "e", "x", "n_entities",
    "__row", "__e", "__w", "__id", "__key", "__salt", "size", "b", "c", "q", "r", "toxic", "predicted", "held_out", "n_words", "row", "digest", "key", "name", "place", "dim", "ids"]


def crowded(df):
    """`df` with a column of text under each of the clashing names that it lacks."""
    have = {c.lower() for c in df.columns}
    return df.select("*", *[F.lit("clash").alias(c) for c in CLASHES if c not in have])


@pytest.fixture(scope="session")
def edge(spark):
    return crowded(spark.createDataFrame(EDGE, "doc_id long, text string"))


@pytest.fixture(scope="session")
def edge_rows():
    return EDGE


@pytest.fixture(scope="session")
def crowd():
    return crowded


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def document_rows(documents):
    return [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def labels(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], "doc_id long, text string, n_chars long")
