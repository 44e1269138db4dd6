"""Every registered query of the engine against DuckDB on the same tables."""

import decimal
import math
from pathlib import Path

import pytest

from quernstone import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()

pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_agrees_with_duckdb(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(*columns).collect()), key=repr)
    relation = duck.sql(ORACLES[name])
    names = list(relation.columns)
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in relation.fetchall()), key=repr)
    assert sorted(names) == columns
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0
