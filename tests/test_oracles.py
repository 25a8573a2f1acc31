"""Every query of the core that SQL can express gives the SQL's rows; the others give some."""

import os

import duckdb
import pandas as pd
import pytest

from lodestrand.plans import registry


@pytest.fixture(scope="module")
def duck(folder):
    con = duckdb.connect()
    for f in os.listdir(folder):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{folder}/{f}')")
    return con


def plain(value):
    if pd.isna(value):
        return "-"
    if isinstance(value, float):
        return f"{value:.6g}"
    return str(pd.Timestamp(value)) if hasattr(value, "isoformat") else str(value)


def normal(df):
    df = df[sorted(df.columns)]
    return list(df.columns), sorted(tuple(plain(v) for v in r) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_against_sql(name, spark, folder, duck):
    assert normal(registry.QUERIES[name](spark, folder).toPandas()) == normal(duck.execute(registry.SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_runs(name, spark, folder):
    df = registry.QUERIES[name](spark, folder)
    assert len(set(df.columns)) == len(df.columns)
    df.collect()


def test_entry(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0
