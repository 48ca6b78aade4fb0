import duckdb
import pytest

import __spark_entry__ as entry
from lipika.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = ("documents",)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    r = duck.execute(catalog.ORACLES[name])
    names = [c[0] for c in r.description]
    assert sorted(names) == sorted(df.columns)
    expected = sorted(map(repr, r.fetchall()))
    assert sorted(repr(tuple(x)) for x in df.select(names).collect()) == expected


def test_entry_and_registry(spark):
    assert entry.entry(spark).count() == 4
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship_reads_only_what_it_needs(spark):
    plan = entry.entry(spark)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<text:string,lang:string>" in plan and "Python" not in plan
