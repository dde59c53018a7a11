"""The registered queries over the smallest tables: SQL where there is any, one row per input row everywhere else."""

import os

import duckdb
import pytest

from tracewell.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_registered_query(spark, sf, name):
    got = QUERIES[name](spark, sf).toPandas()
    if name in SQL:
        con = duckdb.connect()
        for f in os.listdir(sf):
            con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{sf}/{f}')")
        want = con.sql(SQL[name]).df()
        columns = sorted(got.columns)
        assert columns == sorted(want.columns)
        texts = [sorted(map(tuple, t[columns].astype(str).values.tolist())) for t in (got, want)]
        assert texts[0] == texts[1]
    elif name != "op3_nearest":
        docs = spark.read.parquet(f"{sf}/documents.parquet")
        assert sorted(got["doc_id"]) == sorted(r.doc_id for r in docs.select("doc_id").collect())
