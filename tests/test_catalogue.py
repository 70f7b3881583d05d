"""Every catalogue query against its SQL, on a small scale; row order does not count."""

import decimal

import duckdb
import numpy as np
import pandas as pd
import pytest

from quillstream.plans import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return "NULL"
    if isinstance(v, (float, np.floating, decimal.Decimal)):
        return f"{float(v):.9g}"
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    if isinstance(v, (int, np.integer)):
        return str(int(v))
    return str(v)


def same(v, w):
    try:
        return v == w or abs(float(v) - float(w)) <= 1e-6 * max(1, abs(float(w)))
    except ValueError:
        return False


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sql, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name not in ORACLE:
        assert len(got) > 0
        return
    want = sql.sql(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    a, b = (sorted(tuple(plain(v) for v in r) for r in f[columns].itertuples(index=False)) for f in (got, want))
    assert len(a) == len(b)
    assert all(all(same(v, w) for v, w in zip(x, y, strict=True)) for x, y in zip(a, b, strict=True))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(ORACLE) <= set(QUERIES)
