"""Queries on the extraction's wide table."""

from __future__ import annotations

from pyspark.sql import functions as F

from amortia.functions.expressions import postal_text
from amortia.operators import association, profile
from amortia.plans.catalog import register, standin, with_views
from amortia.schemas import EXTRACT_COLUMNS, EXTRACT_COLUMNS_PRUNED

EXTRACT = ["extract"]
# Numeric columns in the order of the extraction's list.
EXTRACT_NUMERIC = ["monthly_reporting_period", "cur_actual_UPB", "loan_age", "remaining_mths_to_legal_maturity", "cur_int_rate",
                   "cur_deferred_UPB", "ELTV", "int_bearing_UPB", "credit_score", "first_payment_date", "maturity_date", "mi_pct",
                   "num_of_units", "ori_CLTV", "ori_DTI", "ori_UPB", "ori_LTV", "ori_int_rate", "ori_loan_term", "num_borrowers"]


def extract(spark, sf_dir):
    return standin(spark, sf_dir).extract


@register("extract_projection", with_views(EXTRACT, "", f"SELECT row_key, {', '.join(EXTRACT_COLUMNS)} FROM extract"))
def extract_projection(spark, sf_dir):
    """The 39 columns of high coverage (and the row id)."""
    return extract(spark, sf_dir).select("row_key", *EXTRACT_COLUMNS)


@register("extract_projection_pruned", with_views(EXTRACT, "", f"SELECT row_key, {', '.join(EXTRACT_COLUMNS_PRUNED)} FROM extract"))
def extract_projection_pruned(spark, sf_dir):
    """The 32 columns left after pruning (and the row id)."""
    return extract(spark, sf_dir).select("row_key", *EXTRACT_COLUMNS_PRUNED)


@register("coverage_pruned_extract", with_views(EXTRACT, "", f"SELECT row_key, {', '.join(EXTRACT_COLUMNS)} FROM extract"))
def coverage_pruned_extract(spark, sf_dir):
    """The wide table without its columns of coverage under 0.7: the three that are mostly empty go."""
    return profile.prune_low_coverage(extract(spark, sf_dir), 0.7)


def _pairs_sql() -> str:
    """Correlation of every later column with every earlier one, on the rows where both are present."""
    parts = [f"SELECT '{a}' AS col_a, corr({a}, {b}) AS r FROM extract WHERE {a} IS NOT NULL AND {b} IS NOT NULL"
             for i, a in enumerate(EXTRACT_NUMERIC) for b in EXTRACT_NUMERIC[:i]]
    return "\nUNION ALL\n".join(parts)


@register("pearson_prune_extract", with_views(EXTRACT, "", f"""
SELECT col_a AS column_name, max(abs(round(r, 6))) AS max_abs_r FROM ({_pairs_sql()}) p WHERE abs(round(r, 6)) > 0.7 GROUP BY col_a"""))
def pearson_prune_extract(spark, sf_dir):
    """Columns that the walk drops: those that correlate by more than 0.7 with an earlier one."""
    return association.prune_walk(association.pearson_long(extract(spark, sf_dir), EXTRACT_NUMERIC), "r", 0.7)


@register("postal_code_text", with_views(EXTRACT, "", """
SELECT CAST(CAST(postal_code AS BIGINT) AS VARCHAR) AS postal_code, count(*) AS n, count(DISTINCT seller_name) AS n_sellers
FROM extract WHERE postal_code IS NOT NULL GROUP BY 1"""))
def postal_code_text(spark, sf_dir):
    """Loan-months and sellers per postal code, read as a category: a whole number as text."""
    df = extract(spark, sf_dir).withColumn("postal_code", postal_text("postal_code")).filter(F.col("postal_code").isNotNull())
    return df.groupBy("postal_code").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("seller_name").alias("n_sellers"))
