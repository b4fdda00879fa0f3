"""Packing: ids as the library makes them, places that hold together, and few sequences."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from palimpsest.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids_of(library, text):
    return [*library.encode(text or "", add_special_tokens=False).ids, 0]


def held(rows, texts, library, size=2048):
    """Check that `rows` place every piece of the texts without gap or overlap; how many sequences there are."""
    want = defaultdict(int)
    for key, text in texts:
        ids = ids_of(library, text)
        for p, s in enumerate(range(0, len(ids), size)):
            own = np.array(ids[s : s + size], "<u4").tobytes()
            want[key, p, s, len(own) // 4, zlib.crc32(own)] += 1
    have = defaultdict(int)
    for r in rows:
        have[r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]] += 1
    assert have == want
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= size
    return len(sequences)


def test_edges(edge, edge_rows, library):
    held(packing.pack(edge, PATH).collect(), edge_rows, library)


def test_query(spark, sf_dir, document_rows, library):
    from palimpsest.llm.queries import op3_packing

    df = op3_packing(spark, sf_dir)
    assert dict(df.dtypes) == {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"}
    rows = df.collect()
    n = held(rows, document_rows, library)
    assert n <= 1.01 * -(-sum(r["length"] for r in rows) // 2048) + 1


def test_ids_come_along(documents, document_rows, library):
    texts = dict(document_rows)
    got = packing.pack(documents.limit(50), PATH, with_ids=True).collect()
    for r in got:
        assert np.frombuffer(r["ids"], "<u4").tolist() == ids_of(library, texts[r["doc_id"]])[r["start"] : r["start"] + r["length"]]


def test_empty(no_documents):
    assert packing.pack(no_documents, PATH).count() == 0


@settings(max_examples=400, deadline=None)
@given(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from("  \t\n'sStTdD.,09_-<|>éÉßİıſŒœ²½́  \x1c\x85中")), max_size=60))
def test_chunks_are_independent(text):
    tokens = packing.loaded(PATH)
    want = tokens.tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(tokens.encode(text), "<u4").tolist() == want


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 6), st.integers(1, 9), st.integers(0, 10_000))
def test_nnls_is_optimal(m, n, seed):
    rng = np.random.default_rng(seed)
    a, b = rng.integers(0, 3, (m, n)).astype(float), rng.random(m)
    x = packing.nnls(a, b)
    gradient = a.T @ (a @ x - b)
    assert (x >= 0).all() and (gradient >= -1e-6).all() and abs(gradient @ x) < 1e-6


def test_patterns():
    got = packing.patterns(8, 3)
    assert sorted(got) == sorted((a, b, c)[: 3 - (b == 0) - (c == 0)] for a in range(1, 9) for b in range(a + 1) for c in range(b + 1) if a + b + c == 8)


@pytest.mark.parametrize("seed", range(6))
def test_plan_uses_every_length(seed):
    rng = np.random.default_rng(seed)
    size = 256
    lengths = np.minimum(size, rng.lognormal(3 + seed % 3, 1, 4000).astype(int) + 1)
    counts = np.bincount(lengths, minlength=size + 1)
    groups = packing.plan(counts, size, 32, 4)
    used = np.zeros(size + 1, int)
    for shape, times in groups:
        assert sum(shape) <= size and times > 0
        for n in shape:
            used[n] += times
    assert (used == counts).all()
    assert sum(t for _, t in groups) <= 1.02 * -(-lengths.sum() // size) + np.sum(lengths > size // 2) * 0.02 + 1


def test_lone_lengths():
    for lengths in ([1], [2048], [2048, 1], [1025] * 7, [700] * 5, [683, 683, 682]):
        counts = np.bincount(lengths, minlength=2049)
        groups = packing.plan(counts)
        assert sum(t * len(s) for s, t in groups) == len(lengths)
    assert packing.plan(np.bincount([683, 683, 682], minlength=2049)) == [((683, 683, 682), 1)]


@pytest.mark.parametrize("text", ["a <|ENDOFTEXT|> b", "A<|endoftext|>B", "<|EndOfText|>", "x<|startoftext|>Y", "<|STARTOFTEXT|> \u0130", "< |endoftext|>", "<|Endoftext|><|endoftext|>C"])
def test_special_tokens_are_sought_before_normalising(text, library):
    want = library.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(packing.loaded(PATH).encode(text), "<u4").tolist() == want


def test_patterns_place_most_pieces():
    rng = np.random.default_rng(4)
    counts = np.bincount(np.minimum(2048, rng.lognormal(6, 1, 20_000).astype(int) + 1), minlength=2049)
    report = {}
    groups = packing.plan(counts, report=report)
    assert report["pieces"] == counts.sum() and report["by_patterns"] > 0.8 * report["pieces"]
    assert report["sequences"] == sum(t for _, t in groups) <= report["least"] * 1.001 + 1


def test_memory_of_chunks_is_bounded(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_BYTES", 20_000)
    tokens = packing.ChunkTokenizer(PATH)
    text = " ".join(f"w{i}x{i % 7}" for i in range(3000))
    want = tokens.tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(tokens.encode(text), "<u4").tolist() == want
    assert tokens.held <= 10_000 and len(tokens.cache) + len(tokens.old[0]) < 200


def test_a_hot_length_is_split(spark, library):
    rows = [(i, "the same words") for i in range(3000)] + [(i, f"another {i} text") for i in range(3000, 3400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    held(packing.pack(df, PATH).collect(), rows, library)
