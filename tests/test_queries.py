"""Every query with a SQL twin gives DuckDB's rows on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from learnmill import catalog

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df):
    def text(v):
        if v is None or (not hasattr(v, "__len__") and pd.isna(v)):
            return "null"
        return repr(round(float(v), 4) + 0.0) if isinstance(v, float) else str(v)

    return sorted(tuple(text(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    assert rows(catalog.QUERIES[name](spark, DATA).toPandas()) == rows(duck.sql(catalog.ORACLE_SQL[name]).df())
