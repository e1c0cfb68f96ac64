"""Every registered query with a SQL form gives the rows that DuckDB gives for it."""

from __future__ import annotations

import duckdb
import numpy as np
import pandas as pd
import pytest

from confabula import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = plans.queries(), plans.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(x):
    """A value as the same text from either engine: whole numbers without a fraction, any missing value as None."""
    if isinstance(x, list | dict) or (hasattr(x, "__len__") and not isinstance(x, str | bytes)):
        return [plain(y) for y in x] if not isinstance(x, dict) else x
    if pd.isna(x):
        return None
    x = x.item() if isinstance(x, np.generic) else x
    if isinstance(x, float):
        return int(x) if x.is_integer() else round(x, 6)
    return x


def normal(frame) -> list[str]:
    frame = frame[sorted(frame.columns)]
    return sorted(str([plain(x) for x in r]) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_gives_the_rows_of_its_sql(name, spark, sf_dir, duck):
    got, want = QUERIES[name](spark, sf_dir).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert normal(got) == normal(want)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
