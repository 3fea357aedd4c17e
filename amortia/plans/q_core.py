"""Queries: scan, join, label, clean, dedup."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from amortia.operators import clean
from amortia.plans.catalog import (JOINED_CTE, RANGE_WHERE, SENTINEL_WHERE, cleaned_ctes,
                                   region_case_sql, register, standin, with_views)
from amortia.schemas import FEATURES_RETRAIN, FEATURES_SCORING

PO = ["performance", "origination"]


def joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = standin(spark, sf_dir)
    return clean.join_loans(s.performance, s.origination)


def region_quarter_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: join -> label -> region -> sentinels, impute, ranges -> per region and quarter:
    loan-months, repay rate, average credit score and balance."""
    df = clean.with_region(clean.with_target(joined(spark, sf_dir)))
    df = clean.clean_loan_months(df)
    return (df.groupBy("region", "quarter")
              .agg(F.count(F.lit(1)).alias("n_rows"),
                   F.round(F.avg(F.col("target").cast("double")), 6).alias("repay_rate"),
                   F.round(F.avg("credit_score"), 6).alias("avg_credit_score"),
                   F.round(F.avg("cur_actual_UPB"), 6).alias("avg_balance")))


register("region_quarter_summary", with_views(PO, JOINED_CTE + ",\n" + f"""
labelled AS (SELECT *, coalesce(replace(cur_LDS, ' ', ''), 'nan') IN ('0', '1') AS target,
                    {region_case_sql()} AS region FROM joined),""" + cleaned_ctes("labelled"), """
SELECT region, quarter, count(*) AS n_rows,
       round(avg(CAST(target AS DOUBLE)), 6) AS repay_rate,
       round(avg(credit_score), 6) AS avg_credit_score,
       round(avg(cur_actual_UPB), 6) AS avg_balance
FROM cleaned GROUP BY region, quarter"""))(region_quarter_summary)


JOIN_COLS = ["loan_sequence_num", "quarter", "row_key", "monthly_reporting_period", "cur_actual_UPB",
             "cur_LDS", "loan_age", "ELTV", "credit_score", "ori_DTI", "channel", "property_state",
             "property_valuation_method"]


@register("scan_join_left", with_views(PO, JOINED_CTE, f"SELECT {', '.join(JOIN_COLS)} FROM joined"))
def scan_join_left(spark, sf_dir):
    return joined(spark, sf_dir).select(*JOIN_COLS)


@register("feature_projection", with_views(PO, JOINED_CTE, f"SELECT {', '.join(FEATURES_SCORING)} FROM joined"))
def feature_projection(spark, sf_dir):
    return joined(spark, sf_dir).select(*FEATURES_SCORING)


@register("sentinel_filter", with_views(PO, JOINED_CTE, f"""
SELECT row_key, credit_score, ori_DTI, property_valuation_method, channel FROM joined WHERE {SENTINEL_WHERE}"""))
def sentinel_filter(spark, sf_dir):
    return (clean.sentinel_filter(joined(spark, sf_dir))
            .select("row_key", "credit_score", "ori_DTI", "property_valuation_method", "channel"))


@register("range_filter", with_views(PO, JOINED_CTE, f"""
SELECT row_key, ori_DTI, credit_score, mi_pct, ELTV FROM joined WHERE {RANGE_WHERE}"""))
def range_filter(spark, sf_dir):
    return clean.range_filter(joined(spark, sf_dir)).select("row_key", "ori_DTI", "credit_score", "mi_pct", "ELTV")


@register("label_target", with_views(["performance"], "", """
SELECT row_key, coalesce(replace(cur_LDS, ' ', ''), 'nan') AS cur_LDS,
       coalesce(replace(cur_LDS, ' ', ''), 'nan') IN ('0', '1') AS target
FROM performance"""))
def label_target(spark, sf_dir):
    return clean.with_target(standin(spark, sf_dir).performance).select("row_key", "cur_LDS", "target")


@register("region_map", with_views(["origination"], "", f"""
SELECT loan_sequence_num, property_state, {region_case_sql()} AS region FROM origination"""))
def region_map(spark, sf_dir):
    return clean.with_region(standin(spark, sf_dir).origination).select("loan_sequence_num", "property_state", "region")


@register("impute_mean", with_views(PO, JOINED_CTE + ",\n" + f"""
b5 AS (SELECT * FROM joined WHERE {SENTINEL_WHERE}),
m AS (SELECT round_even(avg(CASE WHEN ELTV <> 999 THEN ELTV END) * 10, 0) / 10 AS eltv_mean FROM b5)""", """
SELECT row_key, CASE WHEN ELTV = 999 THEN (SELECT eltv_mean FROM m) ELSE ELTV END AS ELTV,
       (SELECT eltv_mean FROM m) AS eltv_mean
FROM b5"""))
def impute_mean(spark, sf_dir):
    b5 = clean.sentinel_filter(joined(spark, sf_dir))
    mean = clean.sentinel_mean(b5).scalar()
    return clean.impute_sentinel(b5, mean=mean).select("row_key", "ELTV", mean.alias("eltv_mean"))


# Whole rows of the joined table (the row id is the stand-in's own and would make every row unique).
@register("dedup_full", with_views(PO, JOINED_CTE, "SELECT DISTINCT * EXCLUDE (row_key) FROM joined"))
def dedup_full(spark, sf_dir):
    rows = standin(spark, sf_dir).performance.count()  # the join's left side: an origination row per loan and quarter
    return clean.dedup_rows(joined(spark, sf_dir).drop("row_key"), rows)


@register("dedup_features", with_views(PO, JOINED_CTE, f"""
SELECT DISTINCT {', '.join(c for c in FEATURES_RETRAIN if c != 'cur_LDS')},
       coalesce(replace(cur_LDS, ' ', ''), 'nan') AS cur_LDS,
       coalesce(replace(cur_LDS, ' ', ''), 'nan') IN ('0', '1') AS target
FROM joined"""))
def dedup_features(spark, sf_dir):
    df = clean.with_target(joined(spark, sf_dir).select(*FEATURES_RETRAIN))
    return clean.dedup_rows(df, standin(spark, sf_dir).performance.count())


@register("dedup_first", with_views(PO, JOINED_CTE, """
SELECT loan_sequence_num, quarter, monthly_reporting_period, row_key, cur_actual_UPB, credit_score
FROM (SELECT *, row_number() OVER (PARTITION BY loan_sequence_num, quarter
                                   ORDER BY monthly_reporting_period NULLS FIRST, row_key NULLS FIRST) AS rn
      FROM joined) t WHERE rn = 1"""))
def dedup_first(spark, sf_dir):
    df = joined(spark, sf_dir).select("loan_sequence_num", "quarter", "monthly_reporting_period",
                                      "row_key", "cur_actual_UPB", "credit_score")
    return clean.dedup_first(df)


@register("distinct_pairs", with_views(["performance"], "", "SELECT DISTINCT loan_sequence_num, quarter FROM performance"))
def distinct_pairs(spark, sf_dir):
    return clean.distinct_pairs(standin(spark, sf_dir).performance)


@register("union_quarters", with_views(["performance"], "", """
SELECT quarter, count(*) AS n_rows, count(DISTINCT loan_sequence_num) AS n_loans,
       round(sum(cur_actual_UPB), 2) AS total_balance
FROM performance GROUP BY quarter"""))
def union_quarters(spark, sf_dir):
    """Per-quarter tables unioned by name. The performance table is published once,
    partitioned by quarter; each quarter's read prunes to its own partition."""
    parts = _quarter_tables(spark, sf_dir, "performance")
    allq = parts[0]
    for p in parts[1:]:
        allq = allq.unionByName(p)
    return (allq.groupBy("quarter")
                .agg(F.count(F.lit(1)).alias("n_rows"),
                     F.countDistinct("loan_sequence_num").alias("n_loans"),
                     F.round(F.sum("cur_actual_UPB"), 2).alias("total_balance")))


def _quarter_tables(spark, sf_dir, name: str, quarters=("1", "2", "3", "4")):
    """Publish a stand-in table partitioned by quarter (one write) and return one frame per
    quarter, each reading only its partition."""
    from amortia.sources import sinks
    path = sinks.write_prepared(standin(spark, sf_dir).table(name), sinks.fresh_path(spark, f"{name}_by_quarter"))
    tab = sinks.read_table(spark, path)
    return [tab.filter(F.col("quarter") == int(q)).withColumn("quarter", F.col("quarter").cast("string"))
            for q in quarters]


@register("reattach_quarter", with_views(PO, JOINED_CTE + """,
firsts AS (SELECT loan_sequence_num, quarter, row_key, cur_actual_UPB
           FROM (SELECT *, row_number() OVER (PARTITION BY loan_sequence_num, quarter
                                              ORDER BY monthly_reporting_period NULLS FIRST, row_key NULLS FIRST) AS rn
                 FROM joined) t WHERE rn = 1),
pairs AS (SELECT DISTINCT loan_sequence_num, quarter FROM performance)""", """
SELECT f.loan_sequence_num, f.row_key, f.cur_actual_UPB, p.quarter
FROM (SELECT loan_sequence_num, row_key, cur_actual_UPB FROM firsts) f
LEFT JOIN pairs p ON f.loan_sequence_num = p.loan_sequence_num"""))
def reattach_quarter(spark, sf_dir):
    """Faithful re-attach: processed rows joined back to (loan, quarter) pairs on loan only."""
    j = joined(spark, sf_dir)
    firsts = clean.dedup_first(j.select("loan_sequence_num", "quarter", "monthly_reporting_period",
                                        "row_key", "cur_actual_UPB"))
    pairs = clean.distinct_pairs(standin(spark, sf_dir).performance)
    return (firsts.drop("quarter", "monthly_reporting_period")
                  .join(pairs, "loan_sequence_num", "left")
                  .select("loan_sequence_num", "row_key", "cur_actual_UPB", "quarter"))


@register("notebook_quarters", with_views(PO, JOINED_CTE, """
SELECT quarter, count(*) AS n_rows, count(DISTINCT loan_sequence_num) AS n_loans,
       count(credit_score) AS n_matched, round(sum(cur_actual_UPB), 2) AS total_balance
FROM joined GROUP BY quarter"""))
def notebook_quarters(spark, sf_dir):
    """Notebook form: per quarter, the performance file left-joined with that quarter's
    origination file on the loan id alone, tagged with a constant quarter, then all
    quarters unioned."""
    from amortia.sources.text_drops import with_constant_quarter
    perf = _quarter_tables(spark, sf_dir, "performance")
    orig = _quarter_tables(spark, sf_dir, "origination")
    parts = []
    for q, perf_q, orig_q in zip(("1", "2", "3", "4"), perf, orig):
        j = clean.join_loans(perf_q.drop("quarter"), orig_q.drop("quarter"), ["loan_sequence_num"])
        parts.append(with_constant_quarter(j, q))
    allq = parts[0]
    for p in parts[1:]:
        allq = allq.unionByName(p)
    return allq.groupBy("quarter").agg(F.count(F.lit(1)).alias("n_rows"),
                                       F.countDistinct("loan_sequence_num").alias("n_loans"),
                                       F.count("credit_score").alias("n_matched"),
                                       F.round(F.sum("cur_actual_UPB"), 2).alias("total_balance"))


@register("sentinel_filter_strict", with_views(PO, JOINED_CTE, """
SELECT row_key, credit_score, ori_DTI, property_valuation_method, channel FROM joined
WHERE credit_score IS DISTINCT FROM 9999 AND ori_DTI IS DISTINCT FROM 999 AND property_valuation_method IS DISTINCT FROM 9"""))
def sentinel_filter_strict(spark, sf_dir):
    """Faithful mode of the sentinel filter: channel '9' rows are kept, as the published
    comparison of the text channel with the number 9 removes nothing."""
    return (clean.sentinel_filter(joined(spark, sf_dir), strict_reference=True)
            .select("row_key", "credit_score", "ori_DTI", "property_valuation_method", "channel"))
