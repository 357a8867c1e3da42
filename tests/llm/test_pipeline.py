import pytest

import __spark_entry__ as entry
import corpus_pipeline
from clipledger.llm import queries
from check_oracle import compare, connect

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, con, name):
    diff, n = compare(spark, con, SF, queries.queries()[name], queries.oracle_sql()[name])
    assert diff == "" and n > 0


def test_every_operator_is_registered():
    names = entry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)) and "pipeline" in names


def test_stages_in_order(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    given = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == given.columns, name
        known = {r["doc_id"] for r in given.select("doc_id").collect()}
        docs = queries.stored(docs, "test-stage")
        assert {r["doc_id"] for r in docs.select("doc_id").collect()} <= known
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and out.count() == docs.count()


def test_stages_take_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0
