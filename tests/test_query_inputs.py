"""Registered queries on inputs of their own, against their SQL."""

from collections import Counter

import duckdb

from strata.plans import queries


def test_chunks_of_texts_without_bytes(spark, tmp_path):
    path = str(tmp_path / "documents.parquet")
    docs = [(1, "a b"), (2, ""), (3, None), (None, "x" * 70000), (5, "é"), (5, "é"), (5, None), (None, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(path)
    found = queries.chunk_bytes(spark, str(tmp_path))
    want = duckdb.sql(queries.SQL["chunk_bytes"].replace("FROM documents", f"FROM '{path}/*.parquet'"))
    assert Counter(map(tuple, found.select(*want.columns).collect())) == Counter(want.fetchall())
