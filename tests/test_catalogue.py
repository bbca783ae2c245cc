"""Every query of the catalogue against its SQL in DuckDB, on the smallest driver tables."""

import numbers
import os

import duckdb
import pandas as pd
import pytest

import tarnwick.plans.audits  # noqa: F401
import tarnwick.plans.chains  # noqa: F401
import tarnwick.plans.texts  # noqa: F401
from tarnwick.plans.catalogue import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no driver tables here")


def _rows(df):
    def text(v):
        if pd.isna(v):
            return None
        return f"{float(v):.6g}" if isinstance(v, numbers.Number) and not isinstance(v, bool) else str(v)

    df = df[sorted(df.columns)]
    return list(df.columns), sorted((tuple(map(text, r)) for r in df.itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, DIR).toPandas()
    if name in ORACLES:
        assert _rows(got) == _rows(duck.execute(ORACLES[name]).df())
    else:
        assert len(got)
