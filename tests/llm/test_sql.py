"""The queries that SQL can express give its rows at the smallest scale."""

import math

import duckdb
import pytest

from marketloom.llm import queries

D = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}") or 0.0
    return v


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS FROM '{D}/{t}.parquet'")
    df = queries.queries()[name](spark, D)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    out = con.execute(queries.oracle_sql()[name])
    names = [c[0] for c in out.description]
    assert sorted(names) == cols
    assert got == sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in out.fetchall()), key=repr)
