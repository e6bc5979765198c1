"""Every core query with an oracle gives DuckDB's rows on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from kurvex.plans import catalog

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in "events embeddings".split():
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def rows(df, cols):
    cell = lambda v: "null" if pd.isna(v) else v if isinstance(v, str) else f"{float(v):.5f}".replace("-0.00000", "0.00000")
    return sorted(tuple(map(cell, r)) for r in df[cols].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_matches_oracle(spark, con, name):
    ours, theirs = catalog.QUERIES[name](spark, DIR).toPandas(), con.sql(catalog.ORACLE_SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours, sorted(ours.columns)) == rows(theirs, sorted(ours.columns))


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_has_rows(spark, name):
    assert catalog.QUERIES[name](spark, DIR).count() > 0
