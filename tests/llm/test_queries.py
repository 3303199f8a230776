"""The registered queries against their SQL: names, types and rows."""

import os
from collections import Counter

import duckdb
import pytest

from tessera.llm import queries

DIR = "/root/testdata/sf0.001"
TYPES = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean"}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DIR):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{DIR}/{f}'")
    return c


@pytest.mark.parametrize("name", list(queries.SQL))
def test_query_equals_sql(spark, duck, name):
    got, want = queries.QUERIES[name](spark, DIR), duck.sql(queries.SQL[name])
    assert dict(got.dtypes) == {n: TYPES.get(str(t), str(t)) for n, t in zip(want.columns, want.types)}
    cols = sorted(got.columns)
    assert Counter(tuple(r[c] for c in cols) for r in got.collect()) == Counter(want.select(*[f'"{c}"' for c in cols]).fetchall())


def test_contract_columns(spark):
    wanted = {
        "op2_secret_scan": ["doc_id bigint", "n_assign bigint", "n_access bigint", "n_hex bigint", "base_sha256 string", "spans string"],
        "op3_byte_bpe": ["doc_id bigint", "n_tokens bigint", "ids_sha256 string", "decoded_sha256 string"],
        "op8_toxicity": ["doc_id bigint", "held_out boolean", "score double", "predicted int"],
        "op10_html_text": ["page_id bigint", "url string", "text string", "n_chars bigint"],
    }
    for name, columns in wanted.items():
        assert set(columns) <= {f"{n} {t}" for n, t in queries.QUERIES[name](spark, DIR).dtypes}, name
    assert sorted(queries.QUERIES, key=lambda n: int(n[2:].split("_")[0])) == [n for n in queries.QUERIES]
