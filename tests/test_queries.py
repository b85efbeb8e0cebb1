"""Every registered query of the engine against its SQL, on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from wardline.plans import outcomes, queries

QUERIES, ORACLES = {**queries.QUERIES, **outcomes.QUERIES}, {**queries.ORACLES, **outcomes.ORACLES}
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


def shown(frame):
    columns = sorted(frame.columns)
    return sorted(tuple("" if pd.isna(v) else f"{v:.9g}" if isinstance(v, float) else str(v) for v in row) for row in frame[columns].itertuples(index=False)), columns


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sql, name):
    got = QUERIES[name](spark, DATA).toPandas()
    if name in ORACLES:
        assert shown(got) == shown(sql.sql(ORACLES[name]).df())
    else:
        assert len(got)
