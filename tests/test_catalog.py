"""Every catalog query against its SQL in DuckDB, and what the plans must look like."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from sparseframe import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def said(rows):
    return sorted(repr(tuple(float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v for v in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_is_its_sql(spark, db, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = df.select(*cols).collect()
    want = db.execute(catalog.ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == cols
    assert said(got) == said(tuple(r[names.index(c)] for c in cols) for r in want.fetchall())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["i", "j", "v"] and df.count() > 0
    assert set(catalog.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_prune_and_join_by_keys(spark):
    p = plan(catalog.spmv(spark, SF))
    assert "ReadSchema: struct<l_partkey:bigint,l_suppkey:bigint,l_quantity:double>" in p and "BroadcastHashJoin" in p
    assert p.count("HashAggregate(") == 2  # lines of one part and supplier aren't summed before the product
    p = plan(catalog.returns(spark, SF).entries)
    assert "PushedFilters: [IsNotNull(l_returnflag), EqualTo(l_returnflag,R)]" in p
    for name in ("spmm", "sddmm", "spadd", "spelmm", "export_dense", "sddmm_dense_rows"):
        p = plan(catalog.QUERIES[name](spark, SF))
        assert "Cartesian" not in p and "NestedLoop" not in p and "Python" not in p
    assert math.isfinite(catalog.norm_inf(spark, SF).first()[0])
