"""The factorization machine: its score against all pairs, what it learns, held-out accuracy."""

from itertools import combinations

import numpy as np
import pytest

from palimpsest.llm import toxicity


def test_score_is_the_sum_over_pairs():
    rng = np.random.default_rng(1)
    m = toxicity.FactorizationMachine(np.arange(10, 40), -0.3, rng.normal(size=30), rng.normal(size=(30, 8)) / 4)
    for n in range(12):
        found = set(rng.choice(60, n, replace=False).tolist())
        at = [k - 10 for k in found if 10 <= k < 40]
        z = -0.3 + sum(m.weights[i] for i in at) + sum(m.factors[i] @ m.factors[j] for i, j in combinations(at, 2))
        assert m.score(found) == pytest.approx(1 / (1 + np.exp(-z)))


def test_pairs_carry_what_weights_cannot():
    """Two kinds of term, toxic together or both absent but not alone: no additive score separates these."""
    cases = [((1, 2), 1), ((1,), 0), ((2,), 0), ((), 1)]
    rng = np.random.default_rng(5)
    sample = []
    for _ in range(400):
        for found, y in cases:
            sample.append((np.array(sorted({*found, *(100 + rng.choice(400, 3)).tolist()}), np.int32), y))
    # Marginally neither term tells; a little imbalance lets the choice of terms see them.
    sample += [(np.array([1, 2], np.int32), 1)] * 400
    m = toxicity.fit(sample)
    assert m.place.keys() >= {1, 2}
    assert m.factors[m.place[1]] @ m.factors[m.place[2]] > 0.2
    assert m.score({1, 2}) > 0.5 > max(m.score({1}), m.score({2}))


def test_terms():
    cache = {}
    got = toxicity.terms("Idiot, IDIOTS! été", cache)
    assert got == set(toxicity.word_terms("idiot")) | set(toxicity.word_terms("idiots")) | set(toxicity.word_terms("été"))
    assert toxicity.terms(None, cache) == toxicity.terms("", cache) == set()
    assert got == toxicity.terms("Idiot, IDIOTS! été", cache)


@pytest.mark.parametrize("labels", [[], [0, 0], [1, 1]])
def test_labels_of_one_kind(labels):
    m = toxicity.fit([(np.array([1, 2]), y) for y in labels])
    assert 0 <= m.score({1, 2}) <= 1 and m.score({1}) == m.score(set())


def test_fold_rule(spark):
    import zlib

    got = spark.range(-5, 400).withColumn("h", toxicity.held_out(toxicity.F.col("id"))).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 5 == 0) == toxicity.crc_held_out(r["id"]) for r in got)


def test_held_out_labels_are_not_learnt(spark, documents, labels):
    """Flipping every held-out label changes no score."""
    F = toxicity.F
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.train(documents, labels), toxicity.train(documents, flipped)
    assert a.bias == b.bias and (a.keys == b.keys).all() and (a.weights == b.weights).all() and (a.factors == b.factors).all()


def test_bounded_sample(documents, labels):
    got = toxicity.training_rows(documents, labels, "doc_id", "text", 20)
    assert got.count() <= 20 and not any(toxicity.crc_held_out(r["k"]) for r in got.collect())


def test_held_out_accuracy(spark):
    from palimpsest.llm.queries import op2_toxicity

    sf = "/root/testdata/sf0.1"
    df = op2_toxicity(spark, sf)
    assert df.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    got = df.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").collect()
    hit = {(p, y): sum(r["predicted"] == p and r["toxic"] == y for r in got) for p in (0, 1) for y in (0, 1)}
    assert (hit[0, 0] + hit[1, 1]) / len(got) >= 0.97
    assert hit[1, 1] / (hit[1, 1] + hit[0, 1]) >= 0.88 and hit[1, 0] / (hit[1, 0] + hit[0, 0]) <= 0.02


def test_edges(spark, edge, edge_rows):
    marks = spark.createDataFrame([(i, 1, i % 2) for i in range(1, 10)] + [(1, 0, 1), (2, None, None), (None, 1, 1), (77, 1, 7)], "doc_id long, quality int, toxic int")
    got = toxicity.judge(edge, marks)
    rows = got.collect()
    assert len(rows) == len(edge_rows) and set(got.columns) == set(edge.columns)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    by = {r["doc_id"]: r["score"] for r in rows}
    assert by[1] == by[2] == by[3] and len({r["score"] for r in rows if r["text"] == "same words again"}) == 1
    assert all(r["held_out"] for r in rows if r["doc_id"] is None)


def test_empty(no_documents, labels):
    assert toxicity.judge(no_documents, labels).count() == 0
    assert toxicity.judge(no_documents, labels.filter("false")).count() == 0


def test_repeated_keys_count_once(spark):
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (1, None), (2, "c")] * 30, "doc_id long, text string")
    marks = spark.createDataFrame([(1, 1, 0), (1, 1, 1), (2, 1, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    got = sorted(tuple(r) for r in toxicity.training_rows(docs, marks, "doc_id", "text", 10).collect())
    assert got == [(k, t, y) for k, t, y in [(1, "a", 1), (2, "c", 0)] if not toxicity.crc_held_out(k)]


def test_terms_are_chosen_alike_in_spark(spark, documents, labels):
    """The model of a table is that of its rows in memory."""
    rows = toxicity.training_rows(documents, labels, "doc_id", "text", 100).collect()
    cache = {}
    want = toxicity.fit([(np.array(sorted(toxicity.terms(r["t"], cache))), r["toxic"]) for r in sorted(rows)])
    got = toxicity.train(documents, labels, rows=100)
    assert got.keys.tolist() == want.keys.tolist() and np.allclose(got.weights, want.weights) and np.allclose(got.factors, want.factors)


def test_pairs_change_verdicts_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    docs, marks = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, marks)
    cache, changed = {}, 0
    for r in docs.join(marks, "doc_id").filter(toxicity.held_out(toxicity.F.col("doc_id"))).select("text").collect():
        found = toxicity.terms(r["text"], cache)
        alone = model.bias + sum(model.weights[model.place[t]] for t in found if t in model.place)
        changed += (model.score(found) >= 0.5) != (alone >= 0)
    assert changed > 5
