"""Every query of the catalog against its SQL in DuckDB, or for rows where it has none."""

import math
import os

import duckdb
import pytest

from motrac.plans import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


def _norm(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    return f"{v:.5f}".replace("-0.00000", "0.00000") if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted(tuple(_norm(r[c]) for c in cols) for r in df.collect())
    duck.execute(f"CREATE OR REPLACE TEMP VIEW q AS {SQL[name]}")
    kinds = dict(r[:2] for r in duck.execute("DESCRIBE q").fetchall())
    assert {c: KINDS[k] for c, k in df.dtypes} == kinds
    want = sorted(tuple(_norm(v) for v in r) for r in duck.execute("SELECT " + ", ".join(f'"{c}"' for c in cols) + " FROM q").fetchall())
    assert got == want and got


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_has_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark, monkeypatch, sf_dir):
    import __spark_entry__ as e

    monkeypatch.setattr(e, "SMOKE_DIR", sf_dir)
    rows = e.entry(spark).collect()
    assert len(rows) == 25 and set(e.oracle_sql()) <= set(e.queries())
