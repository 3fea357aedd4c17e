"""One key holding a third of all rows: operators stay correct (and aggregate-based)."""

import pytest
from pyspark.sql import functions as F

from amortia.operators import clean, features, profile


@pytest.fixture(scope="module")
def skewed(spark):
    # 6000 rows, loan 'HOT' holds 2000 of them.
    df = spark.range(6000).select(
        F.when(F.col("id") % 3 == 0, F.lit("HOT")).otherwise(F.concat(F.lit("L"), (F.col("id") % 500).cast("string")))
         .alias("loan_sequence_num"),
        F.lit("1").alias("quarter"),
        (202001 + F.col("id") % 24).cast("double").alias("monthly_reporting_period"),
        F.format_string("%06d", F.col("id")).alias("row_key"),
        (F.col("id") * 7 % 1000).cast("double").alias("v"),
        (F.col("id") % 3 == 0).alias("target"))
    return df.repartition(8)


def test_keyed_dedup_on_hot_key(skewed):
    got = {r.loan_sequence_num: (r.monthly_reporting_period, r.row_key) for r in clean.dedup_first(skewed).collect()}
    assert got["HOT"] == (202001.0, "000000")
    assert len(got) == 501


def test_plan_uses_partial_aggregation_not_window(skewed):
    import contextlib
    import io
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        clean.dedup_first(skewed).explain()
    plan = buf.getvalue()
    assert "Window" not in plan and "Aggregate" in plan


def test_quantiles_on_hot_group(skewed):
    import numpy as np
    rows = skewed.select("loan_sequence_num", "v").collect()
    hot = np.array([r.v for r in rows if r.loan_sequence_num == "HOT"])
    q = {r.loan_sequence_num: r.q for r in profile.exact_quantiles(skewed, "v", ["loan_sequence_num"], [0.5],
                                                                   partitions=4).collect()}
    assert q["HOT"][0] == pytest.approx(float(np.quantile(hot, 0.5)))


def test_undersample_with_hot_class(skewed):
    got = features.undersample(skewed, "target", "row_key")
    counts = {r.target: r["count"] for r in got.groupBy("target").count().collect()}
    assert counts[True] == counts[False] == 2000
