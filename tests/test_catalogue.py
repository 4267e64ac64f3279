"""Every query of the library against its SQL."""

from __future__ import annotations

import duckdb
import pandas as pd
import pytest

from tidemark.plans import catalogue

from .conftest import DATA

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(df: pd.DataFrame, columns: list[str]) -> list[tuple]:
    text = lambda v: "" if v is None or v != v or v is pd.NA else repr(float(v)) if isinstance(v, float) else str(v)
    return sorted(tuple(text(v) for v in r) for r in df[columns].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_against_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, DATA).toPandas()
    want = duck.execute(catalogue.ORACLE_SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    number = lambda x: x.replace(".0", "") if x.endswith(".0") else x  # noqa: E731  a nullable integer may come as a double
    assert [tuple(map(number, r)) for r in plain(got, columns)] == [tuple(map(number, r)) for r in plain(want, columns)]


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_runs(spark, name):
    assert catalogue.QUERIES[name](spark, DATA).columns


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalogue.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
