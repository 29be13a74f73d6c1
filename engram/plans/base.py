"""Registration of queries."""

from __future__ import annotations

from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, longs: str = ""):
    """Register a query(spark, sf_dir) and the SQL that gives the same rows. Whole numbers are given as longs.

    longs: the columns that SQL gives as shorter whole numbers.
    """

    def put(f):
        def run(spark, sf_dir):
            df = f(spark, sf_dir)
            return df.select(*(F.col(c).cast("long").alias(c) if t in ("int", "smallint") else F.col(c) for c, t in df.dtypes))

        QUERIES[name] = run
        if sql:
            casts = ", ".join(f"{c}::BIGINT as {c}" for c in longs.split())
            ORACLES[name] = f"select * replace ({casts}) from ({sql})" if casts else sql
        return f

    return put
