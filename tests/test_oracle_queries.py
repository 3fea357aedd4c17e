"""Every registered query with an oracle: Spark result equals DuckDB on the smallest tables."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as E  # noqa: E402
from check_oracle import TABLES, kind, rows_of  # noqa: E402

ORACLES = E.oracle_sql()
QUERIES = E.queries()


@pytest.fixture(scope="module")
def duck(sf_small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_small}/{t}.parquet')")
    return con


def test_every_query_is_registered_with_callable():
    assert len(QUERIES) >= 60
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, duck, sf_small, name):
    sdf = QUERIES[name](spark, sf_small)
    s_cols = sdf.columns
    s_types = {f.name: kind(f.dataType.simpleString()) for f in sdf.schema.fields}
    s_rows = [tuple(r) for r in sdf.collect()]
    res = duck.execute(ORACLES[name])
    d_cols = [d[0] for d in res.description]
    d_types = {d[0]: kind(str(d[1])) for d in res.description}
    d_rows = res.fetchall()
    assert sorted(s_cols) == sorted(d_cols)
    assert s_types == d_types
    assert len(s_rows) == len(d_rows)
    assert rows_of(s_cols, s_rows) == rows_of(d_cols, d_rows)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["region", "quarter", "n_rows", "repay_rate", "avg_credit_score", "avg_balance"]
