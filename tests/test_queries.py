"""Every query with SQL gives DuckDB's rows; those without give some."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from tests.conftest import SMALL
from tidemark.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def rows(df: pd.DataFrame) -> list[str]:
    def plain(x):
        if x is None or x is pd.NA or (isinstance(x, (float, np.floating)) and np.isnan(x)):
            return None
        return round(float(x), 6) if isinstance(x, (int, float, np.number)) and not isinstance(x, (bool, np.bool_)) else str(x)

    return sorted(repr([plain(x) for x in r]) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    got = registry.queries()[name](spark, SMALL).toPandas()
    if name in registry.oracle_sql():
        want = duck.execute(registry.oracle_sql()[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got)
