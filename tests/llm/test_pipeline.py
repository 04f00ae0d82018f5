"""The stages one after the other against brute force, and the registered queries against their SQL."""

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from gatelake.llm import queries
from tests.compare import differences, duck
from tests.llm.test_ngram_join import brute

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = corpus_pipeline.materialize(stage(spark, docs, SF), name)
        seen[name] = docs.count()
        if name != "tokens":
            assert docs.columns == columns and 0 < seen[name] <= before.count()
        if name == "near_duplicates":
            groups = brute([(r.doc_id, r.text) for r in before.collect()])
            assert sorted(r.doc_id for r in docs.collect()) == sorted(i for i, _, c in groups if i == c)
        if name == "decontamination":
            items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            assert not any(i in r.text for r in docs.collect() for i in items)
            assert any(i in r.text for r in before.collect() for i in items)
    assert docs.where("not round_trip").count() == 0 and seen["tokens"] == seen["decontamination"]
    assert corpus_pipeline.run(spark, SF).count() == seen["tokens"]


def test_odd_rows(spark, odd_docs):
    docs = odd_docs
    for _, stage in corpus_pipeline.STAGES[1:]:
        docs = stage(spark, docs, SF)
    assert docs.count() > 0


def test_every_operator_is_registered():
    names = entry.queries()
    assert "pipeline" in names and {n.split("_")[0] for n in queries.REGISTRY} == {f"op{i}" for i in range(1, 14)}


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    assert differences(entry.queries()[name](spark, SF), duck(SF), queries.SQL[name]) == []


@pytest.mark.parametrize("name", sorted(set(queries.REGISTRY) - set(queries.SQL)))
def test_query_runs_over_its_whole_table(spark, name):
    table = {"op1": "pages", "op4": "embeddings", "op9": "pages"}.get(name.split("_")[0], "documents")
    result = queries.REGISTRY[name](spark, SF)
    if name != "op6_decontaminate":
        assert result.count() == spark.read.parquet(f"{SF}/{table}.parquet").count()
    else:
        assert result.count() > 0
