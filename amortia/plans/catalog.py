"""Registry of named queries: each has a Spark builder ``fn(spark, sf_dir) -> DataFrame``
and, where SQL can express it, an independent DuckDB oracle over the same base tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from amortia.schemas import REGION_GROUPS
from amortia.sources.standin import StandIn, oracle_views

QueryFn = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, QueryFn] = {}
_ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in _QUERIES:
            raise ValueError(f"duplicate query {name}")
        _QUERIES[name] = fn
        if oracle is not None:
            _ORACLES[name] = oracle
        return fn
    return deco


def standin(spark: SparkSession, sf_dir: str) -> StandIn:
    return StandIn(spark, sf_dir)


def with_views(views: list[str], ctes: str = "", body: str = "") -> str:
    """``WITH`` stand-in views [, extra CTEs] then the final SELECT."""
    head = oracle_views(*views).rstrip()
    if ctes.strip():
        head = head + ",\n" + ctes.strip()
    return head + "\n" + body.strip()


def region_case_sql(col: str = "property_state") -> str:
    parts = [f"WHEN upper(trim({col})) IN ({', '.join(repr(c) for c in dict.fromkeys(codes))}) THEN '{name}'"
             for name, codes in REGION_GROUPS.items()]
    return "CASE " + " ".join(parts) + " ELSE 'Other' END"


# Oracle building blocks shared by many queries.
JOINED_CTE = ("joined AS (SELECT * FROM performance LEFT JOIN origination "
              "USING (loan_sequence_num, quarter))")

SENTINEL_WHERE = ("credit_score IS DISTINCT FROM 9999 AND ori_DTI IS DISTINCT FROM 999 "
                  "AND property_valuation_method IS DISTINCT FROM 9 AND channel IS DISTINCT FROM '9'")

RANGE_WHERE = ("ori_DTI BETWEEN 0 AND 65 AND credit_score BETWEEN 300 AND 850 "
               "AND mi_pct BETWEEN 0 AND 55 AND ELTV BETWEEN 1 AND 998")


def cleaned_ctes(source: str = "joined", name: str = "cleaned") -> str:
    """CTEs: sentinel filter -> half-even 1-decimal mean of non-999 ELTV -> impute -> ranges."""
    return f"""
{name}_b5 AS (SELECT * FROM {source} WHERE {SENTINEL_WHERE}),
{name}_mean AS (SELECT round_even(avg(CASE WHEN ELTV <> 999 THEN ELTV END) * 10, 0) / 10 AS m FROM {name}_b5),
{name}_imp AS (SELECT {name}_b5.* REPLACE (CASE WHEN ELTV = 999 THEN (SELECT m FROM {name}_mean) ELSE ELTV END AS ELTV)
               FROM {name}_b5),
{name} AS (SELECT * FROM {name}_imp WHERE {RANGE_WHERE})"""


def queries() -> dict[str, QueryFn]:
    _load_all()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load_all()
    return dict(_ORACLES)


def _load_all() -> None:
    # Importing the modules registers their queries.
    from amortia.plans import (q_core, q_profile, q_association, q_applicant,  # noqa: F401
                               q_features, q_metrics, q_ledger, q_learning, q_sources, q_extract)
