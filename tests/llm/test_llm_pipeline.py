"""The pipeline: each stage against its operator's rules, and the whole as the chain of its stages."""

from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_llm_packing import held
from test_llm_quality import brute
from test_llm_simhash import components_by_sets
from tokenizers import Tokenizer

import corpus_pipeline
from palimpsest.llm import toxicity
from palimpsest.llm.common import Workspace


@pytest.fixture(scope="module")
def stages(spark, documents, sf_dir):
    """(docs, result) of every stage."""
    ws, docs, out = Workspace(spark, "pipeline-test"), documents, []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        after = ws.table(stage(spark, docs, sf_dir), f"s{i}")
        out.append((docs, after))
        docs = after
    return out


def ids(df):
    return Counter(r["doc_id"] for r in df.select("doc_id").collect())


def test_columns_and_order(stages, documents):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "toxicity", "near-duplicates", "private data", "packing"]
    for _, after in stages[:-1]:
        assert after.dtypes == documents.dtypes


def test_quality_stage(stages, labels):
    docs, after = stages[0]
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    trusted = {r["doc_id"] for r in labels.filter("quality = 1").collect()}
    want = Counter(r[0] for r in brute(rows, trusted) if r[-1])
    assert ids(after) == want and 0 < sum(want.values()) < len(rows)


def test_toxicity_stage(stages, labels):
    docs, after = stages[1]
    judged = toxicity.judge(docs.select("doc_id", "text"), labels)
    assert ids(after) == ids(judged.filter("score < 0.5"))
    marked = labels.filter("toxic = 0").join(docs, "doc_id").select("doc_id")
    assert after.join(marked, "doc_id").count() >= 0.95 * marked.count()


def test_dedup_stage(stages):
    docs, after = stages[2]
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert ids(after) == Counter(set(components_by_sets(rows).values()))


def test_private_stage(stages):
    docs, after = stages[3]
    assert ids(docs) == ids(after)
    both = docs.select("doc_id", F.col("text").alias("old")).join(after, "doc_id")
    assert both.filter("old <> text").count() > 0
    assert both.filter(F.length("text") != F.col("n_chars")).count() == 0
    assert after.filter(F.col("text").rlike(r"[\w.]+@(?!mail\d|example)[a-z]+\.example\.com")).count() == 0


def test_packing_stage(stages):
    docs, after = stages[4]
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    held(after.collect(), rows, Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")))


def test_run_is_the_chain(spark, sf_dir, stages):
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).collect())) == sorted(map(tuple, stages[-1][1].collect()))


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_begin_with_heap_given_back(spark, sf_dir, documents, monkeypatch, name):
    """Heap that earlier stages filled is given back before a stage reads or starts anything."""
    class Asked(Exception):
        pass

    def asked(session):
        assert session is spark
        raise Asked

    monkeypatch.setattr(corpus_pipeline, "give_back", asked)
    with pytest.raises(Asked):
        dict(corpus_pipeline.STAGES)[name](spark, documents, sf_dir)


def test_edges(spark, edge_rows, sf_dir, documents, labels):
    """What every stage makes of nulls, empty and long texts and repeated rows."""
    odd = spark.createDataFrame([(k, t, None, "src1", None) for k, t in edge_rows], documents.schema)
    quality, toxic, near, private, packing = (stage for _, stage in corpus_pipeline.STAGES)
    trusted = {r["doc_id"] for r in labels.filter("quality = 1").collect()}
    assert ids(quality(spark, odd, sf_dir)) == Counter(r[0] for r in brute(edge_rows, trusted) if r[-1])
    assert ids(toxic(spark, odd, sf_dir)) == ids(toxicity.judge(odd.select("doc_id", "text"), labels).filter("predicted = 0"))
    # Texts without words are copies of each other, and equal ones too; of each the smallest key stays. A null key stays.
    assert ids(near(spark, odd, sf_dir)) == Counter([None, -3, 1, 4, 5, 7, 8, 9])
    after = private(spark, odd, sf_dir).collect()
    assert Counter((r["doc_id"], r["text"]) for r in after) == Counter(edge_rows)
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in after)
    held(packing(spark, odd, sf_dir).collect(), edge_rows, Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")))


def test_empty(spark, sf_dir, documents):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, documents.filter("false"), sf_dir).count() == 0


def test_entry():
    import __spark_entry__ as e

    names = [n for n in e.queries() if n.startswith("op") or n == "pipeline"]
    assert sorted(int(n[2:].split("_")[0]) for n in names if n != "pipeline") == list(range(1, 11)) and "pipeline" in names
