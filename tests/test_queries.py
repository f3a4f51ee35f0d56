"""Every query of the dataflow against its SQL in DuckDB, over the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__
from glyphflow.plans.queries import QUERIES, SQL


def plain(v):
    return "NaN" if isinstance(v, float) and math.isnan(v) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    c = duckdb.connect()
    for t in ("lineitem", "embeddings", "documents", "supplier"):
        c.sql(f"CREATE VIEW {t} AS FROM '{sf_dir}/{t}.parquet'")
    result = c.sql(SQL[name])
    assert sorted(result.columns) == sorted(df.columns)
    at = [result.columns.index(x) for x in df.columns]
    key = lambda r: tuple(map(str, r))
    expected = sorted((tuple(plain(r[i]) for i in at) for r in result.fetchall()), key=key)
    got = sorted((tuple(map(plain, r)) for r in df.collect()), key=key)
    assert len(got) == len(expected) and got == expected


def test_entry_and_registries(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
