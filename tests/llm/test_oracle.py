"""Corpus queries with an oracle give its rows."""

import duckdb
import pytest

from engram.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "benchmark", "labels"):
        duck.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    out = duck.execute(queries.ORACLES[name])
    names = [c[0] for c in out.description]
    want = sorted(tuple(r[names.index(c)] for c in cols) for r in out.fetchall())
    assert sorted(names) == cols
    assert sorted(tuple(r) for r in df.select(*cols).collect()) == want
