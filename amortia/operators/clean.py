"""Joining, labelling, cleaning and de-duplication of loan-months.

Scale notes
-----------
* ``join_loans`` is an equi left join on (loan, quarter). The performance side holds many
  months per loan, the origination side one row per loan; Spark plans a sort-merge join and
  AQE turns it into a broadcast join only when the measured origination side is under the
  broadcast threshold, and splits skewed performance partitions (one hot loan) otherwise.
* The imputation mean is a scalar subquery (``DataFrame.scalar()``): one partial
  aggregate, no join and no driver round trip.
* Keyed keep-first dedup is an aggregate (``min_by`` over a struct) rather than a window:
  partial aggregation collapses a hot key on the map side, so no task ever holds all
  rows of one key.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from amortia.functions.expressions import delinquency_text, region_of, repays
from amortia.schemas import SENTINELS, VALID_RANGES
from amortia.session import durable, sized_shuffles

LOAN_KEYS = ["loan_sequence_num", "quarter"]


def require_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Fail early when an input lacks a required column (schema check, no data read)."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"some required columns are not found in the input: {missing}")
    return df


def join_loans(performance: DataFrame, origination: DataFrame,
               keys: list[str] | None = None) -> DataFrame:
    """Monthly performance left-joined with origination on loan id and quarter."""
    return performance.join(origination, keys or LOAN_KEYS, "left")


def with_target(df: DataFrame, status: str = "cur_LDS", clean_status: bool = True) -> DataFrame:
    """Add the boolean ``target``; optionally replace the status by its blank-free text."""
    out = df.withColumn("target", repays(status))
    if clean_status:
        out = out.withColumn(status, delinquency_text(status))
    return out


def with_region(df: DataFrame, state: str = "property_state", drop_state: bool = False,
                substring_match: bool = False) -> DataFrame:
    out = df.withColumn("region", region_of(state, substring_match))
    return out.drop(state) if drop_state else out


def _not_equal_keep_null(c: str, v) -> Column:
    # pandas ``x != v`` keeps missing values; SQL ``<>`` would drop them.
    return ~F.col(c).eqNullSafe(F.lit(v))


def sentinel_filter(df: DataFrame, strict_reference: bool = False) -> DataFrame:
    """Drop rows whose credit score, DTI, valuation method or channel holds the
    "missing" code. Null values are kept (they fall later, at the range filter).

    ``strict_reference=True`` keeps channel '9' rows, as comparing the text channel with
    the number 9 removes nothing in the published code."""
    cond = (_not_equal_keep_null("credit_score", SENTINELS["credit_score"])
            & _not_equal_keep_null("ori_DTI", SENTINELS["ori_DTI"])
            & _not_equal_keep_null("property_valuation_method", SENTINELS["property_valuation_method"]))
    if not strict_reference:
        cond = cond & _not_equal_keep_null("channel", SENTINELS["channel"])
    return df.filter(cond)


def sentinel_mean(df: DataFrame, column: str = "ELTV", sentinel: float = SENTINELS["ELTV"]) -> DataFrame:
    """One-row table: mean of the values that are not the sentinel, rounded half-even to 1 decimal."""
    m = F.avg(F.when(F.col(column) != sentinel, F.col(column)))
    return df.agg(F.rint(m * 10.0) / 10.0).toDF(f"{column}_mean")


def impute_sentinel(df: DataFrame, column: str = "ELTV", sentinel: float = SENTINELS["ELTV"],
                    mean: Column | float | None = None) -> DataFrame:
    """Replace the sentinel by the (stored or batch) mean. With no stored mean, the batch
    mean enters as a scalar subquery computed once."""
    if mean is None:
        mean = sentinel_mean(df, column, sentinel).scalar()
    elif not isinstance(mean, Column):
        mean = F.lit(float(mean))
    return df.withColumn(column, F.when(F.col(column) == sentinel, mean).otherwise(F.col(column)))


def range_filter(df: DataFrame, ranges: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Keep rows with every listed column inside its inclusive range; null fails."""
    cond = None
    for c, (lo, hi) in (ranges or VALID_RANGES).items():
        k = F.col(c).between(lo, hi)
        cond = k if cond is None else cond & k
    return df.filter(cond)


def valid_score_filter(df: DataFrame, column: str = "credit_score") -> DataFrame:
    return df.filter(F.col(column).between(300.0, 850.0))


def clean_loan_months(df: DataFrame, strict_reference: bool = False,
                      eltv_mean: Column | float | None = None) -> DataFrame:
    """Sentinels -> imputation -> ranges, in the published order."""
    kept = sentinel_filter(df, strict_reference)
    return range_filter(impute_sentinel(kept, "ELTV", SENTINELS["ELTV"], eltv_mean))


def dedup_rows(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Full-row de-duplication; null equals null. With the number of ``rows`` the result is written to the shared folder, by
    shuffles whose tasks hold a bounded number of rows; else it is lazy, with the session's partitions."""
    if rows is None:
        return df.dropDuplicates()
    with sized_shuffles(df.sparkSession, rows):
        return durable(df.dropDuplicates(), "distinct-rows")


def dedup_first(df: DataFrame, keys: Iterable[str] = LOAN_KEYS,
                order: Iterable[str] = ("monthly_reporting_period", "row_key")) -> DataFrame:
    """Keep, per key, the row that is first in ``order`` (earliest period, then row key).

    Written as an aggregate: ``min_by`` keeps one candidate per key and partition before
    the shuffle, so a hot key costs one row per map task, not all its rows in one task."""
    keys = list(keys)
    order = [c for c in order if c in df.columns]
    rest = [c for c in df.columns if c not in keys]
    # Remaining columns complete the order, so the pick is deterministic even without a row id.
    tie = [c for c in rest if c not in order]
    picked = F.min_by(F.struct(*[F.col(c) for c in rest]), F.struct(*[F.col(c) for c in order + tie]))
    return df.groupBy(*keys).agg(picked.alias("_first")).select(*keys, "_first.*")


def distinct_pairs(df: DataFrame, cols: Iterable[str] = LOAN_KEYS) -> DataFrame:
    return df.select(*cols).distinct()
