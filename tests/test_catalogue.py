"""Every registered query of the library against DuckDB: names, types and rows."""

import os
from collections import Counter

import duckdb
import pytest

from tessera.plans import catalogue

DIR = "/root/testdata/sf0.001"
TYPES = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean"}


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DIR):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{DIR}/{f}'")
    return c


@pytest.mark.parametrize("name", list(catalogue.SQL))
def test_query_equals_sql(spark, duck, name):
    got, want = catalogue.QUERIES[name](spark, DIR), duck.sql(catalogue.SQL[name])
    types = {n: TYPES.get(str(t), str(t)) for n, t in zip(want.columns, want.types)}
    assert dict(got.dtypes) == types
    cols = sorted(types)
    rows = Counter(tuple(r[c] for c in cols) for r in got.collect())
    assert rows == Counter(want.select(*[f'"{c}"' for c in cols]).fetchall()) and rows


def test_entry_is_the_flagship(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 50
    assert set(e.oracle_sql()) <= set(e.queries())
