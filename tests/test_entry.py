"""Every registered report against the SQL it must agree with, on the smallest tables."""

import os

import pytest

import __spark_entry__ as E
from ledgerline.reports.catalogue import TABLES

DATA = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables are not here")


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def cell(v):
    return repr(float(v) + 0.0) if isinstance(v, (int, float)) and not isinstance(v, bool) else repr(v)


@pytest.mark.parametrize("name", sorted(E.REPORTS))
def test_report_agrees_with_sql(spark, oracle, name):
    df = E.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    cursor = oracle.execute(E.oracle_sql()[name])
    named = [d[0] for d in cursor.description]
    assert sorted(named) == columns
    order = [named.index(c) for c in columns]
    expected = sorted(tuple(cell(r[i]) for i in order) for r in cursor.fetchall())
    assert sorted(tuple(cell(r[c]) for c in columns) for r in df.collect()) == expected


def test_entry(spark):
    assert E.entry(spark).columns == ["region", "nation", "level", "summary_no", "amount", "n_orders", "label"]


def test_every_report_has_sql():
    assert set(E.REPORTS) <= set(E.queries()) & set(E.oracle_sql())
