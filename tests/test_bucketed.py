"""Bucketed loan tables: no exchange below join and keep-first, hot loans beside the buckets, the same rows."""

import pytest

from amortia.operators import clean
from amortia.sources import bucketed

PERF = "loan_sequence_num string, quarter string, monthly_reporting_period int, row_key string, cur_actual_UPB double"
ORIG = "loan_sequence_num string, quarter string, credit_score double"


@pytest.fixture
def tables(spark):
    rows = [(f"L{i % 400}", str(i % 4 + 1), 202000 + i % 12, f"k{i:06d}", float(i)) for i in range(8000)]
    rows += [("HOT", "1", 202000 + i % 12, f"h{i:06d}", 1.0) for i in range(12_000)] + [("NONE", "2", 202001, "n", 1.0), (None, "1", 202001, "m", 2.0)]
    orig = [(f"L{i}", str(q), float(i)) for i in range(400) for q in (1, 2, 3, 4)] + [("HOT", "1", 700.0)]
    perf, orig = spark.createDataFrame(rows, PERF), spark.createDataFrame(orig, ORIG)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    yield perf, orig, bucketed.LoanTables.write(perf, orig, 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before[0])
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", before[1])


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def same(a, b):
    cols = sorted(a.columns)
    return sorted(map(str, a.select(cols).collect())) == sorted(map(str, b.select(cols).collect()))


def test_join_and_keep_first_read_buckets_without_an_exchange(tables):
    _, _, t = tables
    main = clean.join_loans(t.performance, t.origination)
    firsts = clean.join_loans(clean.dedup_first(t.performance), t.origination)
    for df in (main, firsts):
        assert "SortMergeJoin" in plan(df) and "Exchange" not in plan(df)


def test_the_rows_are_those_of_the_plain_join(tables):
    perf, orig, t = tables
    assert t.hot.select("loan_sequence_num").distinct().collect()[0][0] == "HOT" and t.hot.count() == 12_000
    assert same(t.joined(), clean.join_loans(perf, orig))
    cols = ["monthly_reporting_period", "row_key"]
    assert same(t.first_months(cols), clean.join_loans(clean.dedup_first(perf.select(*bucketed.KEYS, *cols)), orig))


def test_hot_rows_are_not_in_a_bucket_and_join_by_broadcast(tables):
    _, _, t = tables
    assert t.performance.filter("loan_sequence_num = 'HOT'").isEmpty()
    hot = clean.join_loans(t.hot, t._hot_origination())
    assert "BroadcastHashJoin" in plan(hot) and "hashpartitioning" not in plan(hot)
