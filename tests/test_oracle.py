"""Every SQL-expressible query equals its DuckDB oracle (names, rows, values)."""

import pytest

import __spark_entry__ as E
from tests.conftest import SMOKE
from tests.helpers import table

SQL = E.oracle_sql()


@pytest.fixture(scope="module")
def con(duck):
    return duck(SMOKE)


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(E.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SMOKE)
    scols, srows = table(df.columns, [tuple(r) for r in df.collect()])
    res = con.execute(SQL[name])
    dcols, drows = table([d[0] for d in res.description], res.fetchall())
    assert scols == dcols
    assert srows == drows


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "customer_id" in df.columns
