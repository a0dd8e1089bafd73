"""Every query of the catalogue against its SQL on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from ontoweave.plans import catalog, roundtrips

QUERIES, SQL = catalog.QUERIES | roundtrips.QUERIES, catalog.SQL | roundtrips.SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def rows(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)]
    cell = lambda v: None if v is None or v is pd.NA or (isinstance(v, float) and v != v) else f"{float(v):.9g}" if isinstance(v, (float, int)) and not isinstance(v, bool) else str(v)
    return sorted(tuple(str(cell(v)) for v in r) for r in df.astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, duck, sf, name):
    got, want = QUERIES[name](spark, sf).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - {"learned_matcher"}))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["entity1", "entity2"]
