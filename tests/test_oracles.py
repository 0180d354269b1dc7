"""Every query with an oracle equals its DuckDB SQL on a small scale."""

import math

import duckdb
import pandas as pd
import pytest

from millrace import registry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def canonical(df):
    def one(v):
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
            return None
        if type(v).__name__ in ("bool", "bool_"):
            return bool(v)
        return v if isinstance(v, str) else float(v)

    return sorted((tuple(one(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, db, name):
    got, want = registry.QUERIES[name](spark, DIR).toPandas(), db.sql(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


def test_names():
    assert set(registry.ORACLES) <= set(registry.QUERIES)
