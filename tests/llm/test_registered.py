"""The numbered queries and the pipeline on the smallest tables."""

import os

import duckdb
import pytest

import corpus_pipeline
from trackloom.llm import registry
from tests.test_queries import SF, TABLES, same

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    same(registry.QUERIES[name](spark, SF).toPandas(), con.execute(registry.SQL[name]).fetchdf())


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == [*docs.columns, "shard", "slot"]
    rows = out.collect()
    assert {r.doc_id for r in rows} <= {r.doc_id for r in docs.collect()}
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))


def test_stages_return_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), SF).columns == docs.columns
