"""Every query on the smallest tables against its SQL counterpart."""

import duckdb
import pytest

import __spark_entry__ as entry
from chainrisk.plans import catalog
from chainrisk.plans.inputs import BASE_TABLES
from tools.compare import canonical, same

FOLDER = "/root/testdata/sf0.001"
QUERIES = {name: build for name, build in entry.queries().items() if name in catalog.QUERIES}
SQL = {name: text for name, text in entry.oracle_sql().items() if name in catalog.QUERIES}
LONG = {"felm_quarterly_models", "felm_cumulative_models"}  # same code as the annual models


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in BASE_TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    return c


def test_entry_returns_scores(spark):
    df = entry.entry(spark)
    assert df.columns[0] == "transcriptid"
    assert df.count() > 0


def test_every_sql_belongs_to_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - LONG))
def test_query(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = canonical([tuple(r) for r in df.select(*columns).collect()])
    if name not in SQL:
        assert got
        return
    quoted = ", ".join(f'"{c}"' for c in columns)
    want = canonical(con.execute(f"SELECT {quoted} FROM ({SQL[name]})").fetchall())
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert all(same(x, y) for x, y in zip(g, w)), (columns, g, w)
