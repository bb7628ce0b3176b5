"""The pipeline's stages on a small table, each against its definition."""

import importlib
import sys

import public_tokenizers
import pytest
from test_jaccard import brute as near
from test_line_dedup import brute as lines
from test_native import measured
from tokenizers import Tokenizer

pipeline = importlib.import_module("corpus_pipeline")


@pytest.fixture(scope="module")
def stages(spark, data):
    from flowspark.llm.tables import stored

    tables = [spark.read.parquet(f"{data}/documents.parquet")]
    for name, stage in pipeline.STAGES:
        tables.append(stored(stage(spark, tables[-1], data), name))
    return tables


def texts(table):
    return [(r.doc_id, r.text) for r in table.select("doc_id", "text").collect()]


def test_shapes(stages):
    assert [n for n, _ in pipeline.STAGES] == ["quality_rules", "quality_classifier", "line_dedup", "near_copies", "packing"]
    for table in stages[:-1]:
        assert table.columns == pipeline.COLUMNS
    assert pipeline.ORACLE_SQL is None and "corpus_pipeline" in sys.modules


def test_rules(stages):
    kept = {i for i, _ in texts(stages[1])}
    for doc, text in texts(stages[0]):
        n, _, symbols, _, repeats = measured(text)
        if n < 20 or 100 * repeats > 30 * n or 10 * symbols > 2 * n:
            assert doc not in kept


def test_classifier_keeps_clean_documents(spark, data, stages):
    kept = {i for i, _ in texts(stages[2])}
    before = {i for i, _ in texts(stages[1])}
    assert kept <= before
    rows = spark.read.parquet(f"{data}/labels.parquet").collect()
    clean = [r.doc_id for r in rows if r.quality == 1 and r.toxic == 0 and r.doc_id in before]
    assert sum(i in kept for i in clean) >= 0.97 * len(clean)


def test_lines(stages):
    import hashlib

    got = sorted((i, hashlib.sha256(t.encode()).hexdigest()) for i, t in texts(stages[3]))
    assert got == sorted((i, s) for i, _, _, s in lines(texts(stages[2])))
    assert all(r.n_chars == len(r.text) for r in stages[3].collect())


def test_near_copies(stages):
    want = sorted(i for i, _, component in near(texts(stages[3]), 5, 80) if i == component)
    assert sorted(i for i, _ in texts(stages[4])) == want


def test_packing(stages):
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {i: len(whole.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in texts(stages[4])}
    got = {}
    for r in stages[5].collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
        assert r.doc_tokens == want[r.doc_id]
    assert got == want


def test_odd_rows(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (10**9, "", None, None, None), (None, "word " * 30, "en", None, 3)], docs.schema)
    table = docs.union(odd).union(docs.limit(3))
    from flowspark.llm.tables import stored

    for name, stage in pipeline.STAGES:
        table = stored(stage(spark, table, data), name)
    assert table.count() > 0
