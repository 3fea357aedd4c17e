"""Queries: text drops, archives and Parquet sinks read back.

Each query first publishes the stand-in loan tables in the source format (pipe text drops,
ZIP archives, partitioned Parquet) under the session's shared folder, then reads them back
through the source code path, so the whole scan path runs on data derived from the tables.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from amortia.operators import clean, features
from amortia.plans.catalog import JOINED_CTE, register, standin, with_views
from amortia.plans.q_features import PREPARED_CTES, SPLIT_SQL, prepared
from amortia.schemas import PERFORMANCE_COLUMNS, PERFORMANCE_KEYWORD, PERFORMANCE_SCHEMA
from amortia.sources import archives, bucketed, sinks, text_drops

PO = ["performance", "origination"]


@register("path_quarter", with_views(PO, JOINED_CTE, """
SELECT quarter, count(*) AS n_rows, count(DISTINCT loan_sequence_num) AS n_loans,
       count(credit_score) AS n_matched, round(sum(cur_actual_UPB), 2) AS total_balance
FROM joined GROUP BY quarter"""))
def path_quarter(spark, sf_dir):
    """Publish both tables as quarterly text drops, list / classify / scan them back with the
    quarter taken from each file's path, left-join and summarise per quarter."""
    s = standin(spark, sf_dir)
    base = sinks.fresh_path(spark, "drops")
    text_drops.write_text_drop(s.performance, base, "performance")
    text_drops.write_text_drop(s.origination, base, "origination")
    perf, orig = text_drops.load_drop(spark, base)
    j = clean.join_loans(perf, orig)
    return j.groupBy("quarter").agg(F.count(F.lit(1)).alias("n_rows"),
                                    F.countDistinct("loan_sequence_num").alias("n_loans"),
                                    F.count("credit_score").alias("n_matched"),
                                    F.round(F.sum("cur_actual_UPB"), 2).alias("total_balance"))


def _loan_tables(spark, sf_dir):
    s = standin(spark, sf_dir)
    return bucketed.LoanTables.write(s.performance, s.origination, int(spark.conf.get("spark.sql.shuffle.partitions")))


@register("bucketed_join", with_views(PO, JOINED_CTE, """
SELECT quarter, count(*) AS n_rows, count(DISTINCT loan_sequence_num) AS n_loans,
       count(credit_score) AS n_matched, round(sum(cur_actual_UPB), 2) AS total_balance
FROM joined GROUP BY quarter"""))
def bucketed_join(spark, sf_dir):
    """Both tables written in buckets of (loan, quarter), joined bucket by bucket without a shuffle, summarised per quarter."""
    j = _loan_tables(spark, sf_dir).joined()
    return j.groupBy("quarter").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("loan_sequence_num").alias("n_loans"),
                                    F.count("credit_score").alias("n_matched"), F.round(F.sum("cur_actual_UPB"), 2).alias("total_balance"))


@register("bucketed_first_months", with_views(PO, JOINED_CTE, """
SELECT loan_sequence_num, quarter, monthly_reporting_period, row_key, credit_score FROM (
  SELECT *, row_number() OVER (PARTITION BY loan_sequence_num, quarter ORDER BY monthly_reporting_period NULLS FIRST, row_key NULLS FIRST) AS rn
  FROM joined) t WHERE rn = 1"""))
def bucketed_first_months(spark, sf_dir):
    """Keep-first per loan and quarter on the bucketed tables: no shuffle between scan and result."""
    firsts = _loan_tables(spark, sf_dir).first_months(["monthly_reporting_period", "row_key"])
    return firsts.select("loan_sequence_num", "quarter", "monthly_reporting_period", "row_key", "credit_score")


@register("zip_ingest", with_views(["performance"], "", """
SELECT quarter, count(*) AS n_rows, count(DISTINCT loan_sequence_num) AS n_loans,
       round(sum(cur_actual_UPB), 2) AS total_balance
FROM performance GROUP BY quarter"""))
def zip_ingest(spark, sf_dir):
    """Publish the performance table as ZIP archives (written by the executors), then read
    every archive's text entries and parse them with the explicit schema."""
    perf = standin(spark, sf_dir).performance
    out = sinks.fresh_path(spark, "zips")
    lines = perf.select(text_drops.to_pipe_lines(perf, PERFORMANCE_COLUMNS).alias("value"), "quarter")
    archives.write_zip_drops(lines, out, f"{PERFORMANCE_KEYWORD}_2020").collect()
    parsed = archives.parse_archive_entries(archives.archive_lines(spark, out), PERFORMANCE_SCHEMA,
                                            F.lower("entry").contains(PERFORMANCE_KEYWORD))
    return parsed.groupBy("quarter").agg(F.count(F.lit(1)).alias("n_rows"),
                                         F.countDistinct("loan_sequence_num").alias("n_loans"),
                                         F.round(F.sum("cur_actual_UPB"), 2).alias("total_balance"))


@register("prepared_sink", with_views(PO, PREPARED_CTES, f"""
SELECT quarter, CASE WHEN {SPLIT_SQL} < 6 THEN 'train' WHEN {SPLIT_SQL} < 8 THEN 'val' ELSE 'test' END AS split,
       count(*) AS n_rows, round(sum(credit_score), 2) AS sum_credit_score
FROM prepared GROUP BY 1, 2"""))
def prepared_sink(spark, sf_dir):
    """Write the prepared table partitioned by quarter, read it back, add the split and write
    it partitioned by split; read that back and count rows per (quarter, split)."""
    p1 = sinks.write_prepared(prepared(spark, sf_dir), sinks.fresh_path(spark, "prepared"))
    back = sinks.read_table(spark, p1)
    p2 = sinks.write_splits(features.with_split(back, "row_key"), sinks.fresh_path(spark, "splits"))
    final = sinks.read_table(spark, p2)
    return final.groupBy(F.col("quarter").cast("string").alias("quarter"), "split").agg(
        F.count(F.lit(1)).alias("n_rows"), F.round(F.sum("credit_score"), 2).alias("sum_credit_score"))
