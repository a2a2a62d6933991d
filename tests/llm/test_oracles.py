"""Corpus queries with SQL give DuckDB's rows on the smallest tables; all of them run and return a row per input row."""

import duckdb
import pytest
from termloom.llm.oracles import ORACLES
from termloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "embeddings"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    theirs = c.sql(ORACLES[name])
    columns = sorted(theirs.columns)
    ours = QUERIES[name](spark, SF)
    assert sorted(ours.columns) == columns
    assert sorted(map(str, ours.select(*columns).collect())) == sorted(str(r) for r in spark.createDataFrame(theirs.arrow().to_pylist() if hasattr(theirs.arrow(), "to_pylist") else theirs.arrow().read_all().to_pylist(), ours.select(*columns).schema).collect())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"op3_packing", "op4_warc", "op8_embeddings", "op11_whitening"}))
def test_a_row_for_each_document(spark, name):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    assert sorted(r[0] for r in QUERIES[name](spark, SF).select("doc_id").collect()) == sorted(r[0] for r in documents.select("doc_id").collect())
