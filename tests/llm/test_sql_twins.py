"""Queries of this subpackage that SQL can express give the rows that DuckDB gives, on the smallest tables."""

import duckdb
import pytest

from strandweave.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_prefix_trie", "op12_importance", "op13_minhash"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    theirs = con.execute(queries.ORACLES[name])
    columns = [d[0] for d in theirs.description]
    ours = queries.QUERIES[name](spark, DATA)
    assert sorted(ours.columns) == sorted(columns)
    assert sorted(map(repr, map(tuple, ours.select(*columns).collect()))) == sorted(map(repr, theirs.fetchall()))
