"""Every registered query that SQL expresses gives the SQL's rows over the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_module

DATA = "/root/testdata/sf0.001"
NAMES = sorted(set(entry_module.oracle_sql()) - {n for n in entry_module.oracle_sql() if n.startswith("op") and n[2].isdigit()})


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else float(f"{v:.9g}")
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else v


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", NAMES)
def test_query_gives_the_rows_of_its_sql(spark, duck, name):
    df = entry_module.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    rel = duck.sql(entry_module.oracle_sql()[name])
    assert sorted(rel.columns) == columns
    want = [tuple(plain(r[rel.columns.index(c)]) for c in columns) for r in rel.fetchall()]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
