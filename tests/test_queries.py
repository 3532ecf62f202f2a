"""Every registered query of the engine against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__
from gaugeline import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        c.execute(f"create view {t} as select * from '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return c


def plain(v):
    if v is None or isinstance(v, (bool, int, str)):
        return v
    if isinstance(v, float) or hasattr(v, "as_tuple"):
        return round(float(v), 6) if not math.isnan(float(v)) else "nan"
    return str(v)


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")
@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, sql, name):
    df = catalog.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    if name not in catalog.oracle_sql():
        assert got
        return
    result = sql.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = [tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall()]
    key = lambda row: tuple((x is None, str(x)) for x in row)
    assert sorted(got, key=key) == sorted(want, key=key)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 5
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
