"""Each query that has SQL gives DuckDB's rows on the smallest tables."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from tidewright.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def shown(value):
    if value is None or value is pd.NaT or value is pd.NA or isinstance(value, float) and value != value:
        return "null"
    if isinstance(value, (list, np.ndarray)):
        return str(list(value))
    return repr(float(value)) if isinstance(value, (int, float, np.number)) and not isinstance(value, bool) else str(value)


def rows(df):
    columns = sorted(df.columns)
    return columns, sorted(tuple(shown(v) for v in r) for r in df[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query(name, spark, duck, sf_dir):
    assert rows(catalog.QUERIES[name](spark, sf_dir).toPandas()) == rows(duck.sql(catalog.ORACLES[name]).df())


def test_every_oracle_has_a_query():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)
