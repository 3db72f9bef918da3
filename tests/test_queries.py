"""Every registered query against its SQL in an independent engine, and the entry point's contract."""

import datetime
import decimal
import math
import subprocess
import sys

import duckdb
import pytest
from conftest import DATA, ROOT

from swathgrid.plans.queries import ORACLE, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/sf0.001/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, datetime.date) and not isinstance(v, datetime.datetime):
        return v.isoformat()
    return v


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, small, oracle, name):
    df = QUERIES[name](spark, small)
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=str)
    want = oracle.execute(ORACLE[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == names
    rows = sorted((tuple(plain(r[columns.index(c)]) for c in names) for r in want.fetchall()), key=str)
    assert got == rows


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_without_sql_runs(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["grid_id", "p90_days_between", "sample_count"] and df.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_without_the_optional_subpackage():
    code = "import sys; sys.modules['swathgrid.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert q and not [n for n in q if n[:2] == 'op' and n[2].isdigit()] and 'pipeline' not in q"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=60)


def test_filters_and_columns_reach_the_scan(spark, small):
    plan = QUERIES["q13_reach"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "l_extendedprice" not in plan and "l_tax" not in plan
    plan = QUERIES["q05_multi_capture_days"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "props" not in plan and "PushedFilters: [IsNotNull(ts)" in plan.replace("[IsNotNull(event_id), IsNotNull(ts)", "[IsNotNull(ts)")
