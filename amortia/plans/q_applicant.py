"""Queries: applicant expressions and validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from amortia.functions import expressions as X
from amortia.operators import applicant
from amortia.plans.catalog import register, standin, with_views

PAY = "{L} * ({r} * power(1 + {r}, {n})) / (power(1 + {r}, {n}) - 1)"


def _dti_sql() -> str:
    inc = "CASE WHEN monthly_income <= 0 THEN 1000.0 ELSE CAST(monthly_income AS DOUBLE) END"
    rate = "greatest(least(cur_int_rate, 10.0), 0.1)"
    r = f"({rate} / 100.0 / 12.0)"
    y0 = "greatest(term_years, 5)"
    last = f"CAST(greatest({y0}, 30) AS DOUBLE)"

    def ratio(loan, years):
        return f"({PAY.format(L=loan, r=r, n=f'({years}) * 12.0')} / ({inc}) * 100.0)"

    first = f"list_filter(range({y0}, greatest({y0}, 30) + 1), lambda y: {ratio('CAST(cur_actual_UPB AS DOUBLE)', 'CAST(y AS DOUBLE)')} <= 65.0)[1]"
    g = f"power(1 + {r}, {last} * 12.0)"
    scaled = f"(0.65 * ({inc}) * ({g} - 1.0) / ({r} * {g}))"
    return (f"round_even(CASE WHEN {first} IS NOT NULL THEN {ratio('CAST(cur_actual_UPB AS DOUBLE)', f'CAST({first} AS DOUBLE)')} "
            f"ELSE {ratio(scaled, last)} END, 5)")


@register("monthly_payment", with_views(["applicant"], "", """
SELECT applicant_id,
       round(CASE WHEN cur_int_rate / 100.0 / 12.0 = 0 THEN cur_actual_UPB / (term_years * 12.0)
                  ELSE cur_actual_UPB * ((cur_int_rate / 100.0 / 12.0) * power(1 + cur_int_rate / 100.0 / 12.0, term_years * 12.0))
                       / (power(1 + cur_int_rate / 100.0 / 12.0, term_years * 12.0) - 1) END, 6) AS monthly_payment
FROM applicant"""))
def monthly_payment(spark, sf_dir):
    a = standin(spark, sf_dir).applicant
    return a.select("applicant_id",
                    F.round(X.monthly_payment("cur_actual_UPB", "cur_int_rate", "term_years"), 6).alias("monthly_payment"))


@register("dti", with_views(["applicant"], "", f"SELECT applicant_id, {_dti_sql()} AS ori_DTI FROM applicant"))
def dti(spark, sf_dir):
    a = standin(spark, sf_dir).applicant
    return a.select("applicant_id",
                    X.debt_to_income("monthly_income", "cur_actual_UPB", "cur_int_rate", "term_years").alias("ori_DTI"))


@register("quarter_of_date", with_views(["applicant"], "", """
SELECT applicant_id, CAST(quarter(loan_start_date) AS VARCHAR) AS quarter,
       strftime(loan_start_date, '%Y-%m-%d') AS loan_start_text,
       CAST(strftime(loan_start_date, '%Y-%m-%d') AS DATE) AS parsed_back
FROM applicant"""))
def quarter_of_date(spark, sf_dir):
    a = standin(spark, sf_dir).applicant
    text = F.date_format("loan_start_date", "yyyy-MM-dd")
    return a.select("applicant_id", X.quarter_text("loan_start_date").alias("quarter"), text.alias("loan_start_text"),
                    F.try_to_date(text, "yyyy-MM-dd").alias("parsed_back"))


@register("default_fill", with_views(["applicant"], "", """
SELECT applicant_id, CAST(71.67837 AS DOUBLE) AS ELTV, CAST(0.0 AS DOUBLE) AS cur_deferred_UPB,
       CAST(2.0 AS DOUBLE) AS property_valuation_method,
       coalesce(loan_purpose, 'P') AS loan_purpose, 'R' AS channel, 'Y' AS first_time_homebuyer,
       'SF' AS property_type, 'P' AS occupancy_status, 1 AS num_of_units
FROM applicant"""))
def default_fill(spark, sf_dir):
    a = applicant.with_defaults(standin(spark, sf_dir).applicant)
    return a.select("applicant_id", "ELTV", "cur_deferred_UPB", "property_valuation_method", "loan_purpose",
                    "channel", "first_time_homebuyer", "property_type", "occupancy_status", "num_of_units")


@register("applicant_validation", with_views(["applicant"], "", """
SELECT applicant_id, errors, len(errors) = 0 AS is_valid FROM (
  SELECT applicant_id, list_filter([
    CASE WHEN monthly_income IS NULL THEN 'missing:monthly_income' END,
    CASE WHEN term_years IS NULL THEN 'missing:term_years' END,
    CASE WHEN cur_actual_UPB IS NULL THEN 'missing:cur_actual_UPB' END,
    CASE WHEN cur_int_rate IS NULL THEN 'missing:cur_int_rate' END,
    CASE WHEN mi_pct IS NULL THEN 'missing:mi_pct' END,
    CASE WHEN loan_start_date IS NULL THEN 'missing:loan_start_date' END,
    CASE WHEN credit_score IS NULL THEN 'missing:credit_score' END,
    CASE WHEN num_borrowers IS NULL THEN 'missing:num_borrowers' END,
    CASE WHEN property_state IS NULL THEN 'missing:property_state' END,
    CASE WHEN NOT (term_years BETWEEN 1 AND 30) THEN 'range:term_years' END,
    CASE WHEN NOT (mi_pct BETWEEN 0 AND 55) THEN 'range:mi_pct' END,
    CASE WHEN NOT (credit_score BETWEEN 300 AND 850) THEN 'range:credit_score' END], lambda e: e IS NOT NULL) AS errors
  FROM applicant) t"""))
def applicant_validation(spark, sf_dir):
    return applicant.validation_errors(standin(spark, sf_dir).applicant).select("applicant_id", "errors", "is_valid")


@register("applicant_features", with_views(["applicant"], "", f"""
SELECT applicant_id, {_dti_sql()} AS ori_DTI, CAST(quarter(loan_start_date) AS VARCHAR) AS quarter,
       strftime(loan_start_date, '%Y-%m-%d') AS loan_start_text, CAST(term_years AS DOUBLE) AS loan_age,
       CAST(71.67837 AS DOUBLE) AS ELTV, coalesce(loan_purpose, 'P') AS loan_purpose, 1 AS num_of_units
FROM applicant"""))
def applicant_features(spark, sf_dir):
    a = applicant.applicant_features(standin(spark, sf_dir).applicant)
    return a.select("applicant_id", "ori_DTI", "quarter", "loan_start_text", "loan_age", "ELTV", "loan_purpose",
                    "num_of_units")


@register("credit_score", with_views(["credit_form"], "", """
SELECT form_id, payment_points, owed_points, history_points, new_credit_points, mix_points, raw_points,
       CAST(floor(300 + raw_points / 100.0 * 550.0) AS INT) AS credit_score_estimate
FROM (SELECT *, payment_points + owed_points + history_points + new_credit_points + mix_points AS raw_points FROM (
  SELECT form_id,
    greatest(35 - CASE WHEN late_payments_last_2_years = 1 THEN 5 WHEN late_payments_last_2_years = 2 THEN 10
                       WHEN late_payments_last_2_years >= 3 THEN 15 ELSE 0 END
                - CASE WHEN ever_defaulted_or_collected = 'Y' THEN 10 ELSE 0 END
                - CASE WHEN ever_declared_bankruptcy = 'Y' THEN 10 ELSE 0 END, 0) AS payment_points,
    CASE WHEN estimated_total_credit_limit = 0 THEN NULL ELSE
      greatest(30 - CASE WHEN estimated_total_debt / estimated_total_credit_limit < 0.3 THEN 0
                         WHEN estimated_total_debt / estimated_total_credit_limit < 0.5 THEN 5 ELSE 10 END
                  - CASE WHEN number_of_credit_accounts = 0 THEN 5 ELSE 0 END, 0) END AS owed_points,
    CASE oldest_credit_years WHEN 0 THEN 2 WHEN 1 THEN 7 WHEN 2 THEN 12 WHEN 3 THEN 15 END AS history_points,
    greatest(10 - CASE WHEN opened_new_accounts_past_year = 'Y' THEN 3 ELSE 0 END
                - CASE WHEN recent_credit_inquiries = 2 THEN 3 WHEN recent_credit_inquiries >= 3 THEN 5 ELSE 0 END, 0)
      AS new_credit_points,
    CASE WHEN len(list_filter(string_split(credit_types_text, ','), lambda t: t <> '')) > 0 THEN 10 ELSE 5 END AS mix_points
  FROM credit_form) p) q"""))
def credit_score(spark, sf_dir):
    f = applicant.credit_points(standin(spark, sf_dir).credit_form)
    return f.select("form_id", "payment_points", "owed_points", "history_points", "new_credit_points",
                    "mix_points", "raw_points", "credit_score_estimate")
