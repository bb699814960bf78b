"""Every registered query of the library against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from loamwork import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def cell(v):
    if v is None or v != v:
        return "null"
    return f"{v:.6g}" if isinstance(v, float) else str(v)


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    if name in catalog.ORACLES:
        res = duck.sql(catalog.ORACLES[name])
        assert normal(df.columns, rows) == normal(res.columns, res.fetchall())
    else:
        assert rows


def test_every_oracle_has_a_query():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)


def test_profile_reads_once_and_stays_in_the_jvm(spark):
    plan = catalog.QUERIES["profile_numeric"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 1 and "Python" not in plan


def test_filters_reach_the_scan(spark):
    plan = catalog.QUERIES["filter_select_rename"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_quantity,40.0)" in plan and "l_comment" not in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double,l_returnflag:string>" in plan
