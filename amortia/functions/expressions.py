"""Column expressions. Every function returns a native ``Column``: no Python runs per row,
so all of them stay inside whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from amortia.schemas import REGION_GROUPS


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# --- labels ----------------------------------------------------------------

def delinquency_text(status="cur_LDS") -> Column:
    """Delinquency status with every blank removed; a missing status reads ``'nan'``."""
    return F.coalesce(F.replace(_c(status), F.lit(" "), F.lit("")), F.lit("nan"))


def repays(status="cur_LDS") -> Column:
    """Target: current or 30 days late ('0' / '1') is a repaying loan-month; anything else,
    including 'RA' and a missing status, is not."""
    return delinquency_text(status).isin("0", "1")


# --- geography ---------------------------------------------------------------

def region_of(state="property_state", substring_match: bool = False) -> Column:
    """Map a state code to West / Midwest / South / Northeast / Other.

    Default: exact two-letter code (case-blind). ``substring_match=True`` reproduces the
    published behaviour of matching any code as a case-blind substring of the text, the
    first group in order winning (so full names like 'Florida' can land in West)."""
    s = _c(state)
    expr = None
    for region, codes in REGION_GROUPS.items():
        if substring_match:
            cond = F.lower(s).rlike("|".join(c.lower() for c in dict.fromkeys(codes)))
        else:
            cond = F.upper(F.trim(s)).isin(*dict.fromkeys(codes))
        expr = F.when(cond, F.lit(region)) if expr is None else expr.when(cond, F.lit(region))
    return expr.otherwise(F.lit("Other"))


# --- affordability -----------------------------------------------------------

def monthly_payment(amount, annual_rate, years) -> Column:
    """Level payment of an amortising loan; a zero rate spreads the amount evenly."""
    amount, annual_rate, years = _c(amount), _c(annual_rate), _c(years)
    r = annual_rate / 100.0 / 12.0
    n = years * 12.0
    growth = F.pow(1.0 + r, n)
    return F.when(r == 0, amount / n).otherwise(amount * (r * growth) / (growth - 1.0))


def debt_to_income(monthly_income, amount, annual_rate, years) -> Column:
    """Debt-to-income in percent for an applicant, 5 decimals.

    Income at or below zero is read as 1000; the rate is clamped to 0.1-10 %; the term is
    at least 5 years and is extended a year at a time up to 30 while the ratio exceeds
    65 %; if it still exceeds 65 % the loan is scaled down to meet 65 % exactly.

    The first fitting term is found in closed form — payment <= 0.65 * income holds from
    n = ln(P / (P - L r)) / ln(1 + r) months on — and then confirmed against its neighbours
    with the same payment formula the year-by-year search evaluates, so the result equals
    the search while staying a handful of native expressions (no per-row loop)."""
    income = F.when(_c(monthly_income) <= 0, F.lit(1000.0)).otherwise(_c(monthly_income).cast("double"))
    rate = F.greatest(F.least(_c(annual_rate).cast("double"), F.lit(10.0)), F.lit(0.1))
    y0 = F.greatest(_c(years).cast("int"), F.lit(5))
    y_max = F.greatest(y0, F.lit(30))
    amount = _c(amount).cast("double")
    r = rate / 100.0 / 12.0

    def ratio(loan: Column, y: Column) -> Column:
        return monthly_payment(loan, rate, y.cast("double")) / income * 100.0

    def fits(y: Column) -> Column:
        return (y >= y0) & (y <= y_max) & (ratio(amount, y) <= 65.0)

    cap = 0.65 * income
    months = F.log(cap / (cap - amount * r)) / F.log(1.0 + r)
    guess = F.when(amount * r < cap, F.ceil(months / 12.0).cast("int"))
    cand = F.greatest(F.least(guess, y_max + 1), y0)
    first_fit = (F.when(fits(cand - 1), cand - 1).when(fits(cand), cand).when(fits(cand + 1), cand + 1))
    last_term = y_max.cast("double")
    growth = F.pow(1.0 + r, last_term * 12.0)
    scaled_loan = 0.65 * income * (growth - 1.0) / (r * growth)
    value = F.when(first_fit.isNotNull(), ratio(amount, first_fit)).otherwise(ratio(scaled_loan, last_term))
    return F.bround(value, 5)


# --- dates -------------------------------------------------------------------

def quarter_text(d) -> Column:
    """Calendar quarter of a date as text '1'..'4'."""
    return F.quarter(_c(d)).cast("string")


def version_name(ts) -> Column:
    """Run version name from a timestamp, e.g. 20250701_134501."""
    return F.date_format(_c(ts), "yyyyMMdd_HHmmss")


# --- credit-score estimate ------------------------------------------------------

def payment_history_points(late_payments, ever_defaulted, ever_bankrupt) -> Column:
    late = _c(late_payments)
    pts = (F.lit(35)
           - F.when(late == 1, 5).when(late == 2, 10).when(late >= 3, 15).otherwise(0)
           - F.when(_c(ever_defaulted) == "Y", 10).otherwise(0)
           - F.when(_c(ever_bankrupt) == "Y", 10).otherwise(0))
    return F.greatest(pts, F.lit(0))


def amounts_owed_points(total_debt, total_limit, n_accounts) -> Column:
    """Utilisation points; a zero credit limit has no utilisation and gives null (invalid form)."""
    util = F.try_divide(_c(total_debt).cast("double"), F.nullif(_c(total_limit).cast("double"), F.lit(0.0)))
    pts = (F.lit(30)
           - F.when(util < 0.3, 0).when(util < 0.5, 5).otherwise(10)
           - F.when(_c(n_accounts) == 0, 5).otherwise(0))
    return F.when(util.isNotNull(), F.greatest(pts, F.lit(0)))


def history_length_points(code) -> Column:
    """Points for the age of the oldest account, code 0-3; other codes are invalid (null)."""
    c = _c(code)
    return F.when(c == 0, 2).when(c == 1, 7).when(c == 2, 12).when(c == 3, 15)


def new_credit_points(opened_new, inquiries) -> Column:
    q = _c(inquiries)
    pts = (F.lit(10)
           - F.when(_c(opened_new) == "Y", 3).otherwise(0)
           - F.when(q == 2, 3).when(q >= 3, 5).otherwise(0))
    return F.greatest(pts, F.lit(0))


def credit_mix_points(credit_types) -> Column:
    """10 points with any credit type, else 5. ``credit_types`` is an array column."""
    return F.when(F.coalesce(F.size(_c(credit_types)), F.lit(0)) > 0, 10).otherwise(5)


def estimated_credit_score(raw_points) -> Column:
    """300 + raw/100 * 550, truncated toward zero."""
    return F.floor(F.lit(300) + _c(raw_points) / 100.0 * 550.0).cast("int")


# --- scaling and messages ------------------------------------------------------

def min_max(x, lo, hi) -> Column:
    """Min-max transform while fitting: a constant column (hi == lo) maps to 0, as the
    fitted scaler does."""
    span = _c(hi) - _c(lo)
    return F.when(span == 0, F.lit(0.0)).otherwise((_c(x) - _c(lo)) / span)


def scale_with_bounds(x, lo, hi) -> Column:
    """Min-max transform of new data with stored bounds, no clipping; equal bounds give null."""
    return F.try_divide(_c(x) - _c(lo), _c(hi) - _c(lo))


def eligibility_message(prediction) -> Column:
    return F.when(_c(prediction), F.lit("You are eligible to repay.")).otherwise(
        F.lit("You are not eligible to repay."))


def pass_fail(flag) -> Column:
    return F.when(_c(flag), F.lit("PASS")).otherwise(F.lit("FAIL"))


def postal_text(col: str) -> Column:
    """A postal code that was read as a number, as a category: its whole number as text."""
    return F.col(col).cast("bigint").cast("string")
