"""Every query with SQL gives the rows that DuckDB gives for it."""

import math

import duckdb
import pytest

from quadrille.plans import catalog
from tests.conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def _value(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return "null"
    return repr(float(x)) if isinstance(x, float) else str(x)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(_value(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query(spark, sql, name):
    got = catalog.QUERIES[name](spark, SF)
    want = sql.execute(catalog.SQL[name])
    columns = [c[0] for c in want.description]
    assert _rows(got.columns, got.collect()) == _rows(columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_every_row_is_assigned_once(spark, name):
    rows = catalog.QUERIES[name](spark, SF).collect()
    assert len({r.id for r in rows}) == len(rows) and (name == "algg_round" or len(rows) == 500)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 499
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
