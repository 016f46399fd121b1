"""The queries that SQL can express, against that SQL on the smallest supplied data; the others give whole results."""

import pytest

from weirworks.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, sf_dir, name):
    pytest.importorskip("duckdb")
    from catalog.check import compare, oracle_connection
    ok, note = compare(spark, oracle_connection(sf_dir), name, QUERIES[name], ORACLES[name], sf_dir)
    assert ok, note


@pytest.mark.parametrize("name", ["op1_sharding", "op2_language", "op4_toxicity", "op5_surrogates", "op8_interpolation", "op10_fingerprints"])
def test_one_row_per_document(spark, sf_dir, name):
    rows = QUERIES[name](spark, sf_dir).select("doc_id").collect()
    docs = spark.read.parquet(sf_dir + "/documents.parquet").select("doc_id").collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in docs)
