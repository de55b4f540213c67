"""Every registered query with SQL against DuckDB on the small tables; the others give rows."""

import duckdb
import pandas as pd
import pytest

from talkgrid.plans import catalog

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


def clean(v):
    if pd.isna(v):
        return None
    return v if isinstance(v, str) else bool(v) if type(v).__name__ in ("bool", "bool_") else round(float(v), 6)


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted((tuple(map(clean, r)) for r in frame[columns].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, db, name):
    got = rows(catalog.QUERIES[name](spark, DIR).toPandas().convert_dtypes().astype(object))
    want = rows(db.sql(catalog.ORACLES[name]).df().convert_dtypes().astype(object))
    assert got[0] == want[0]
    assert got[1] and got[1] == want[1]


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_gives_rows(spark, name):
    assert not catalog.QUERIES[name](spark, DIR).isEmpty()
