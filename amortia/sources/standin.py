"""Stand-in loan views over the driver's TPC-H-like tables.

The real quarterly loan drops are not shipped with the tests, so the performance and
origination tables (and the metric / applicant / credit-form / ledger inputs) are
derived from ``lineitem``, ``orders``, ``customer`` and ``events``. The SQL below is
written once and runs unchanged in Spark SQL and DuckDB, so the Spark queries and
their DuckDB oracles read identical inputs.

In Spark the base tables are bound as DataFrame parameters (``{lineitem}``), so no
session-wide temp view is created. Every view reads its whole base table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PERFORMANCE_SQL = """
SELECT CAST(l_orderkey AS VARCHAR(20)) AS loan_sequence_num,
       CAST(l_orderkey % 4 + 1 AS VARCHAR(1)) AS quarter,
       CAST(year(l_shipdate) * 100 + month(l_shipdate) AS INT) AS monthly_reporting_period,
       concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT)) AS row_key,
       l_extendedprice AS cur_actual_UPB,
       CASE WHEN l_returnflag = 'R' AND l_linenumber <= 2 THEN CAST(2 + l_partkey % 8 AS VARCHAR(4))
            WHEN l_returnflag = 'R' AND l_linenumber = 3 THEN 'RA'
            WHEN l_returnflag = 'N' AND l_linenumber = 7 THEN ' 1'
            WHEN l_partkey % 61 = 0 THEN CAST(NULL AS VARCHAR(4))
            ELSE '0' END AS cur_LDS,
       CAST(l_partkey % 120 AS DOUBLE) AS loan_age,
       CAST(2 + l_discount * 50 AS DOUBLE) AS cur_int_rate,
       CASE WHEN l_suppkey % 19 = 0 THEN l_quantity * 100 ELSE CAST(0 AS DOUBLE) END AS cur_deferred_UPB,
       CASE WHEN l_partkey % 11 = 0 THEN CAST(999 AS DOUBLE)
            WHEN l_partkey % 53 = 0 THEN CAST(NULL AS DOUBLE)
            ELSE 40 + l_quantity END AS ELTV
FROM {lineitem}
"""

ORIGINATION_SQL = """
SELECT CASE WHEN o_orderkey % 97 = 0 THEN concat('x', o_orderkey) ELSE CAST(o_orderkey AS VARCHAR(20)) END AS loan_sequence_num,
       CAST(o_orderkey % 4 + 1 AS VARCHAR(1)) AS quarter,
       CASE WHEN o_orderkey % 101 = 0 THEN CAST(9999 AS DOUBLE) ELSE CAST(550 + o_orderkey * 7 % 301 AS DOUBLE) END AS credit_score,
       CASE WHEN o_orderkey % 3 = 0 THEN 'Y' ELSE 'N' END AS first_time_homebuyer,
       CAST(o_orderkey % 13 * 5 AS DOUBLE) AS mi_pct,
       CAST(1 + o_custkey % 4 AS DOUBLE) AS num_of_units,
       CASE o_orderstatus WHEN 'P' THEN 'S' WHEN 'F' THEN 'P' ELSE 'I' END AS occupancy_status,
       CASE WHEN o_orderkey % 103 = 0 THEN CAST(999 AS DOUBLE) ELSE CAST(10 + o_orderkey % 60 AS DOUBLE) END AS ori_DTI,
       o_totalprice AS ori_UPB,
       CASE o_orderkey % 5 WHEN 0 THEN 'B' WHEN 1 THEN 'C' WHEN 2 THEN '9' ELSE 'R' END AS channel,
       CASE c_nationkey % 9 WHEN 0 THEN 'CA' WHEN 1 THEN 'WA' WHEN 2 THEN 'OH' WHEN 3 THEN 'MN' WHEN 4 THEN 'TX'
            WHEN 5 THEN 'FL' WHEN 6 THEN 'NY' WHEN 7 THEN 'PA' ELSE 'PR' END AS property_state,
       CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'SF' WHEN 'MACHINERY' THEN 'PU' WHEN 'FURNITURE' THEN 'CO' ELSE 'MH' END AS property_type,
       CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'P' WHEN '2' THEN 'C' ELSE 'N' END AS loan_purpose,
       CAST(1 + o_orderkey % 2 AS DOUBLE) AS num_borrowers,
       CASE WHEN o_orderkey % 29 = 0 THEN CAST(9 AS DOUBLE)
            WHEN o_orderkey % 31 = 0 THEN CAST(NULL AS DOUBLE)
            ELSE CAST(1 + o_orderkey % 3 AS DOUBLE) END AS property_valuation_method
FROM {orders} JOIN {customer} ON o_custkey = c_custkey
"""

# The joined loan-months as the extraction notebook has them: all columns of high coverage, and three that are mostly empty.
EXTRACT_SQL = """
SELECT j.*,
       360 - loan_age AS remaining_mths_to_legal_maturity,
       cur_actual_UPB - cur_deferred_UPB AS int_bearing_UPB,
       CAST(201501 + CAST(credit_score AS BIGINT) % 12 AS INT) AS first_payment_date,
       CAST(204501 + CAST(credit_score AS BIGINT) % 12 AS INT) AS maturity_date,
       40 + CAST(CAST(credit_score AS BIGINT) * 3 % 50 AS DOUBLE) AS ori_CLTV,
       38 + CAST(CAST(credit_score AS BIGINT) * 3 % 50 AS DOUBLE) + mi_pct / 100 AS ori_LTV,
       cur_int_rate + CAST(loan_age AS DOUBLE) / 1000 AS ori_int_rate,
       CASE WHEN ori_DTI > 60 THEN 'Y' ELSE 'N' END AS PPM_flag,
       'FRM' AS amorisation_type,
       CAST(10000 + CAST(floor(ori_UPB) AS BIGINT) % 300 * 100 AS DOUBLE) AS postal_code,
       CAST(120 + CAST(ori_DTI AS BIGINT) % 3 * 120 AS DOUBLE) AS ori_loan_term,
       'seller ' || CAST(CAST(ori_DTI AS BIGINT) % 7 AS VARCHAR(4)) AS seller_name,
       'servicer ' || CAST(CAST(mi_pct AS BIGINT) % 5 AS VARCHAR(4)) AS servicer_name,
       CASE WHEN CAST(floor(ori_UPB) AS BIGINT) % 10 = 0 THEN 'H' ELSE '9' END AS program_indicator,
       CASE WHEN CAST(floor(ori_UPB) AS BIGINT) % 11 = 0 THEN 'Y' ELSE 'N' END AS io_indicator,
       CASE WHEN CAST(floor(ori_UPB) AS BIGINT) % 5 < 3 THEN '7' ELSE 'Y' END AS MICI,
       CASE WHEN CAST(floor(ori_UPB) AS BIGINT) % 9 = 0 THEN CAST(NULL AS DOUBLE) ELSE CAST(10180 + CAST(floor(ori_UPB) AS BIGINT) % 40 AS DOUBLE) END AS MSA,
       CASE WHEN CAST(loan_age AS BIGINT) % 10 = 0 THEN CAST(1 AS DOUBLE) END AS zero_bal_code,
       CASE WHEN CAST(loan_age AS BIGINT) % 5 = 0 THEN cur_deferred_UPB END AS MI_recover,
       CASE WHEN CAST(loan_age AS BIGINT) % 2 = 0 THEN 'Y' END AS super_conforming_flag
FROM (SELECT * FROM {performance} LEFT JOIN {origination} USING (loan_sequence_num, quarter)) j
"""

SCORED_SQL = """
SELECT p.row_key, target, score, score >= 0.5 AS prediction, region,
       CASE WHEN bucket < 6 THEN 'train' WHEN bucket < 8 THEN 'val' ELSE 'test' END AS split
FROM (SELECT row_key,
             coalesce(replace(cur_LDS, ' ', ''), 'nan') IN ('0', '1') AS target,
             CASE WHEN property_state IN ('CA', 'WA') THEN 'West' WHEN property_state IN ('OH', 'MN') THEN 'Midwest'
                  WHEN property_state IN ('TX', 'FL') THEN 'South' WHEN property_state IN ('NY', 'PA') THEN 'Northeast'
                  ELSE 'Other' END AS region,
             CAST(CASE WHEN coalesce(replace(cur_LDS, ' ', ''), 'nan') IN ('0', '1') THEN 300 ELSE 0 END
                  + (CAST(round(cur_actual_UPB * 100) AS BIGINT) * 31) % 700 AS DOUBLE) / 1000 AS score,
             CAST(loan_age AS BIGINT) % 10 AS bucket
      FROM {performance} JOIN {origination} USING (loan_sequence_num, quarter)) p
"""

APPLICANT_SQL = """
SELECT o_orderkey AS applicant_id,
       CASE WHEN o_orderkey % 41 = 0 THEN 0 ELSE CAST(1000 + o_custkey % 9000 AS INT) END AS monthly_income,
       CAST(floor(o_totalprice) AS INT) AS cur_actual_UPB,
       CAST(o_orderkey % 130 AS DOUBLE) / 10 AS cur_int_rate,
       CAST(1 + o_orderkey % 32 AS INT) AS term_years,
       CAST(o_orderkey % 13 * 5 AS DOUBLE) AS mi_pct,
       CAST(280 + o_orderkey % 600 AS INT) AS credit_score,
       CAST(o_orderdate AS DATE) AS loan_start_date,
       CASE WHEN o_orderkey % 6 = 0 THEN CAST(NULL AS VARCHAR(1)) ELSE 'C' END AS loan_purpose,
       CASE WHEN o_orderkey % 37 = 0 THEN CAST(NULL AS DOUBLE) ELSE CAST(1 + o_orderkey % 2 AS DOUBLE) END AS num_borrowers,
       CASE WHEN o_orderkey % 43 = 0 THEN CAST(NULL AS VARCHAR(2)) WHEN o_orderkey % 2 = 0 THEN 'CA' ELSE 'TX' END AS property_state
FROM {orders}
"""

CREDIT_FORM_SQL = """
SELECT c_custkey AS form_id,
       CAST(c_custkey % 5 AS INT) AS late_payments_last_2_years,
       CASE WHEN c_custkey % 7 = 0 THEN 'Y' ELSE 'N' END AS ever_defaulted_or_collected,
       CASE WHEN c_custkey % 11 = 0 THEN 'Y' ELSE 'N' END AS ever_declared_bankruptcy,
       CAST(c_custkey % 100 * 100 AS DOUBLE) AS estimated_total_debt,
       CASE WHEN c_custkey % 89 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(10000 AS DOUBLE) END AS estimated_total_credit_limit,
       CAST(c_custkey % 4 AS INT) AS number_of_credit_accounts,
       CAST(c_custkey % 5 AS INT) AS oldest_credit_years,
       CASE WHEN c_custkey % 3 = 0 THEN 'Y' ELSE 'N' END AS opened_new_accounts_past_year,
       CAST(c_custkey % 5 AS INT) AS recent_credit_inquiries,
       CASE WHEN c_custkey % 6 = 0 THEN '' ELSE 'CC,M' END AS credit_types_text
FROM {customer}
"""

LEDGER_EVENTS_SQL = """
SELECT concat('v', user_id) AS version, ts AS event_time, event_id,
       CASE event_type WHEN 'error' THEN 'failed' WHEN 'click' THEN 'in_progress' ELSE 'completed' END AS status
FROM {events}
"""

# view name -> (sql, the names it reads)
VIEWS = {
    "performance": (PERFORMANCE_SQL, ["lineitem"]),
    "origination": (ORIGINATION_SQL, ["orders", "customer"]),
    "extract": (EXTRACT_SQL, ["performance", "origination"]),
    "scored": (SCORED_SQL, ["performance", "origination"]),
    "applicant": (APPLICANT_SQL, ["orders"]),
    "credit_form": (CREDIT_FORM_SQL, ["customer"]),
    "ledger_events": (LEDGER_EVENTS_SQL, ["events"]),
}

BASE_TABLES = ["lineitem", "orders", "customer", "events", "nation", "region", "part", "supplier"]


class StandIn:
    """Lazily built stand-in views for one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._cache: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._cache:
            if name in VIEWS:
                sql, deps = VIEWS[name]
                self._cache[name] = self.spark.sql(sql, **{d: self.table(d) for d in deps})
            else:
                self._cache[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._cache[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.table(name)


def oracle_views(*names: str) -> str:
    """A DuckDB ``WITH`` prefix defining the named stand-in views (and what they read)."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order or n not in VIEWS:
            return
        for d in VIEWS[n][1]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    parts = []
    for n in order:
        sql, deps = VIEWS[n]
        parts.append(f"{n} AS ({sql.format(**{d: d for d in deps}).strip()})")
    return "WITH " + ",\n".join(parts) + "\n"
