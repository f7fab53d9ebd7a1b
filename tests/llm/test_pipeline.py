from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sensorquery.llm import registry
from sensorquery.llm.components import written

STAGES = dict(corpus_pipeline.STAGES)


def test_stages_in_order_keep_the_columns(spark, small):
    docs = registry.documents(spark, small)
    columns, before = docs.columns, docs.count()
    assert list(STAGES) == ["quality", "exact_dedup", "ngram_jaccard", "secret_scan", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, small), name)
        if name != "packing":
            assert docs.columns == columns and docs.count() <= before
            before = docs.count()
    assert docs.select("doc_id").distinct().count() == before
    direct = corpus_pipeline.run(spark, small)
    assert sorted(map(tuple, direct.collect())) == sorted(map(tuple, docs.collect()))


def test_quality_keeps_the_clean_and_rejects_the_bad(spark):
    folder = "/root/testdata/sf0.01"
    kept = {r.doc_id for r in STAGES["quality"](spark, registry.documents(spark, folder), folder).select("doc_id").collect()}
    told = registry.labels(spark, folder).collect()
    assert not [r for r in told if r.quality and r.doc_id not in kept]
    bad = [r for r in told if not r.quality]
    assert sum(r.doc_id in kept for r in bad) <= 0.1 * len(bad)


@pytest.mark.parametrize("name", ["quality", "exact_dedup", "ngram_jaccard", "secret_scan", "packing"])
def test_stages_take_awkward_and_empty_tables(spark, awkward_docs, no_docs, small, name):
    docs = awkward_docs.select("doc_id", "text", "lang", "source", "n_chars")
    out = STAGES[name](spark, docs, small)
    if name != "packing":
        assert out.columns == docs.columns
    assert out.count() > 0
    assert STAGES[name](spark, no_docs.select(*docs.columns), small).count() == 0


@pytest.mark.parametrize("name", [q for q in registry.oracle_sql()])
def test_queries_equal_their_sql(spark, small, name):
    import oracle

    df = registry.queries()[name](spark, small)
    cursor = oracle.connect(small).execute(registry.oracle_sql()[name])
    assert oracle.compare(df.columns, df.collect(), [d[0] for d in cursor.description], cursor.fetchall()) == ""


@pytest.mark.parametrize("name", ["quality", "exact_dedup", "ngram_jaccard", "secret_scan"])
def test_stages_return_other_columns_unchanged(spark, awkward_docs, small, name):
    extra = [c for c in awkward_docs.columns if c not in ("text", "n_chars")]
    out = STAGES[name](spark, awkward_docs, small)
    assert out.columns == awkward_docs.columns
    before = {tuple(r) for r in awkward_docs.select(*extra).collect()}
    assert {tuple(r) for r in out.select(*extra).collect()} <= before


def test_every_operator_has_a_query():
    names = list(registry.queries())
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14))
    assert F is not None
