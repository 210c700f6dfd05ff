"""Every registered query against its DuckDB SQL on the small tables."""

import numbers
import os

import duckdb
import pandas as pd
import pytest

from lodestone.plans import registry

FOLDER = os.environ.get("LODESTONE_TEST_DATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


def same(a: pd.DataFrame, b: pd.DataFrame) -> None:
    assert sorted(a.columns) == sorted(b.columns)
    columns = sorted(a.columns)
    assert len(a) == len(b)

    def rows(df):
        def cell(v):
            if v is None or (isinstance(v, float) and v != v) or v is pd.NA:
                return "null"
            if isinstance(v, numbers.Number) and not isinstance(v, bool):
                return repr(round(float(v), 7))
            return str(v)

        return sorted(tuple(cell(v) for v in r) for r in df[columns].itertuples(index=False))

    assert rows(a) == rows(b)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    got = registry.queries()[name](spark, FOLDER).toPandas()
    if sql := registry.oracle_sql().get(name):
        same(got, duck.execute(sql).df())
    else:
        assert len(got.columns)
