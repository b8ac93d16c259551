"""Every query of the catalogue against DuckDB, on the smallest tables; and the entry."""

import os

import duckdb
import pytest

from viewlark.plans import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def normal(v):
    if v is None or v != v:
        return "null"
    return repr(float(v)) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", catalogue.queries())
def test_query(spark, duck, name):
    df = catalogue.queries()[name](spark, DATA)
    got = [{k: normal(v) for k, v in r.asDict().items()} for r in df.collect()]
    found = duck.execute(catalogue.oracle_sql()[name])
    names = [c[0] for c in found.description]
    want = [dict(zip(names, map(normal, r))) for r in found.fetchall()]
    assert sorted(df.columns) == sorted(names)
    assert sorted(map(str, (sorted(r.items()) for r in got))) == sorted(map(str, (sorted(r.items()) for r in want)))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
