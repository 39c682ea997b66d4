"""Every query of the engine against its SQL in DuckDB."""

from __future__ import annotations

import math

import pandas as pd
import pytest

from candlewick.plans import registry


def values(df: pd.DataFrame) -> list[tuple]:
    def one(x):
        if x is None or x is pd.NaT or (isinstance(x, float) and math.isnan(x)):
            return None
        return round(x, 9) if isinstance(x, float) else x if isinstance(x, (int, str, bool)) else str(x)

    df = df[sorted(df.columns)].astype(object)
    return sorted((tuple(map(one, r)) for r in df.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, duck, sf, name):
    got, want = registry.QUERIES[name](spark, sf).toPandas(), duck.sql(registry.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert values(got) == values(want)


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.SQL)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns[0] == "pair"
