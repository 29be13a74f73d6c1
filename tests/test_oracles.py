"""Every query with an oracle gives the oracle's rows; every other query runs."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
OWN = entry.registry.QUERIES
ORACLES = entry.registry.ORACLES


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        c.execute(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c


def rows(values):
    def plain(x):
        return round(x, 4) if isinstance(x, float) else x if x is None or isinstance(x, (int, str, bool)) else str(x)

    return sorted((tuple(plain(x) for x in r) for r in values), key=repr)


@pytest.mark.parametrize("name", sorted(OWN))
def test_query(spark, duck, name):
    df = OWN[name](spark, SF)
    cols = sorted(df.columns)
    got = df.select(*cols).collect()
    if name in ORACLES:
        out = duck.execute(ORACLES[name])
        names = [c[0] for c in out.description]
        assert sorted(names) == cols
        want = [tuple(r[names.index(c)] for c in cols) for r in out.fetchall()]
        assert rows(got) == rows(want)
