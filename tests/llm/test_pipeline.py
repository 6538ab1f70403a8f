"""The pipeline, stage by stage and as a whole, and the registered queries."""

import oracle
import pytest
from conftest import SF_SMALL
from llm.odd import none, odd

import __spark_entry__ as entry
import corpus_pipeline
from harvestline.llm.queries import QUERIES


def test_every_stage_returns_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    before = docs.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.staged(stage(spark, docs, SF_SMALL), "stage")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert 0 < docs.select("doc_id").distinct().count() < before
    index = corpus_pipeline.STAGES[-1][1](spark, docs, SF_SMALL)
    assert index.count() == docs.count()
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF_SMALL).collect())) == sorted(map(tuple, index.collect()))


@pytest.mark.parametrize("make", [odd, none])
def test_stages_bear_odd_and_empty_documents(spark, make):
    docs = make(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF_SMALL)
        assert out.columns == docs.columns
        out.count()


@pytest.mark.parametrize("name", [name for name, (_, sql) in QUERIES.items() if sql])
def test_query_equals_sql(spark, name):
    run, sql = QUERIES[name]
    found = run(spark, SF_SMALL)
    ours = oracle.normalised(found.columns, [tuple(row) for row in found.collect()])
    cursor = oracle.connect(SF_SMALL).execute(sql)
    assert ours == oracle.normalised([c[0] for c in cursor.description], cursor.fetchall())


def test_all_are_registered():
    assert {"pipeline", *QUERIES} <= set(entry.queries())
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))
