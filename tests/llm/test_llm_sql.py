"""The training-data queries that SQL can express, against it, on the smallest tables."""

import duckdb
import pytest

from proselake.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_like_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    cols = sorted(df.columns)
    plain = lambda v: round(v, 9) if isinstance(v, float) else v
    got = sorted(str([plain(r[c]) for c in cols]) for r in df.collect())
    cur = con.execute(queries.oracle_sql()[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == cols
    assert got == sorted(str([plain(r[names.index(c)]) for c in cols]) for r in cur.fetchall())
