"""Every registered query of the engine against its SQL, at the smallest scale."""

import os

import duckdb
import pytest

from logloom.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for t in ("events", "documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(records):
    return sorted(repr([int(v) if isinstance(v, float) and v == int(v) else v for v in r]) for r in records)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_equals_sql(spark, tables, name):
    df = QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = tables.execute(ORACLE_SQL[name])
    assert sorted(d[0] for d in got.description) == names
    order = [[d[0] for d in got.description].index(n) for n in names]
    assert rows([r[n] for n in names] for r in df.collect()) == rows([r[i] for i in order] for r in got.fetchall())
