"""Schemas, column lists and fixed values of the loan-level data.

Column names with special characters in the published file layout (``MI(%)``,
``I/O_indicator``, ``pre-HARP_LSN``) are renamed at the source to ``mi_pct``,
``io_indicator`` and ``pre_harp_lsn``; ``SOURCE_NAMES`` maps them back for sinks.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values (must equal the published data layout and model settings).
# ---------------------------------------------------------------------------

# Monthly performance file, 32 columns in file order.
PERFORMANCE_COLUMNS = [
    "loan_sequence_num", "monthly_reporting_period", "cur_actual_UPB", "cur_LDS", "loan_age",
    "remaining_mths_to_legal_maturity", "defect_settlement_date", "modification_flag", "zero_bal_code",
    "zero_bal_effective_date", "cur_int_rate", "cur_deferred_UPB", "DDLPI", "MI_recover",
    "net_sales_proceeds", "non_MI_recover", "expenses", "legal_costs", "MPC", "taxes_and_insurance",
    "miscel_expenses", "actual_loss_calculation", "modification_cost", "step_mod_flag", "deferred_pay_plan",
    "ELTV", "zero_bal_removal_UPB", "del_accrued_int", "del_due_to_disaster", "BASC", "cur_mth_mod_cost",
    "int_bearing_UPB",
]

# Origination file, 32 columns in file order (source names).
ORIGINATION_COLUMNS_SOURCE = [
    "credit_score", "first_payment_date", "first_time_homebuyer", "maturity_date",
    "MSA", "MI(%)", "num_of_units", "occupancy_status", "ori_CLTV", "ori_DTI", "ori_UPB",
    "ori_LTV", "ori_int_rate", "channel", "PPM_flag", "amorisation_type", "property_state",
    "property_type", "postal_code", "loan_sequence_num", "loan_purpose", "ori_loan_term",
    "num_borrowers", "seller_name", "servicer_name", "super_conforming_flag", "pre-HARP_LSN",
    "program_indicator", "HARP_indicator", "property_valuation_method", "I/O_indicator", "MICI",
]

# Columns kept as text even when they look numeric.
FORCED_TEXT = [
    "del_due_to_disaster", "modification_flag", "step_mod_flag", "super_conforming_flag",
    "program_indicator", "BASC", "cur_LDS", "deferred_pay_plan",
]

# Other text columns of the two layouts.
OTHER_TEXT = [
    "loan_sequence_num", "net_sales_proceeds", "first_time_homebuyer", "occupancy_status", "channel",
    "PPM_flag", "amorisation_type", "property_state", "property_type", "loan_purpose", "seller_name",
    "servicer_name", "pre-HARP_LSN", "HARP_indicator", "I/O_indicator", "MICI",
]

# Renames applied at the source; inverse used by sinks.
RENAMES = {"MI(%)": "mi_pct", "I/O_indicator": "io_indicator", "pre-HARP_LSN": "pre_harp_lsn"}
SOURCE_NAMES = {v: k for k, v in RENAMES.items()}

# File-name keywords separating the two kinds of drop.
ORIGINATION_KEYWORD = "historical_data"
PERFORMANCE_KEYWORD = "historical_data_time"

# The extraction's columns of high coverage (39), and those left after pruning correlated ones (32).
EXTRACT_COLUMNS = [
    "loan_sequence_num", "monthly_reporting_period", "cur_actual_UPB", "cur_LDS", "loan_age",
    "remaining_mths_to_legal_maturity", "cur_int_rate", "cur_deferred_UPB", "ELTV", "int_bearing_UPB",
    "credit_score", "first_payment_date", "first_time_homebuyer", "maturity_date", "mi_pct", "num_of_units",
    "occupancy_status", "ori_CLTV", "ori_DTI", "ori_UPB", "ori_LTV", "ori_int_rate", "channel", "PPM_flag",
    "amorisation_type", "property_state", "property_type", "postal_code", "loan_purpose", "ori_loan_term",
    "num_borrowers", "seller_name", "servicer_name", "program_indicator", "property_valuation_method",
    "io_indicator", "MICI", "MSA", "quarter",
]
EXTRACT_COLUMNS_PRUNED = [
    "loan_sequence_num", "monthly_reporting_period", "cur_actual_UPB", "cur_LDS",
    "remaining_mths_to_legal_maturity", "cur_int_rate", "cur_deferred_UPB", "ELTV", "credit_score",
    "first_payment_date", "first_time_homebuyer", "mi_pct", "num_of_units", "occupancy_status", "ori_DTI",
    "channel", "PPM_flag", "amorisation_type", "property_state", "property_type", "postal_code",
    "loan_purpose", "num_borrowers", "seller_name", "program_indicator", "property_valuation_method",
    "io_indicator", "MICI", "MSA", "loan_age", "ori_UPB", "quarter",
]

# Feature lists (in our names).
FEATURES_SCORING = [
    "loan_sequence_num", "cur_actual_UPB", "cur_int_rate", "cur_deferred_UPB",
    "ELTV", "credit_score", "first_time_homebuyer", "mi_pct", "num_of_units",
    "occupancy_status", "ori_DTI", "channel", "property_state", "property_type",
    "loan_purpose", "num_borrowers", "property_valuation_method",
    "loan_age", "quarter",
]
FEATURES_RETRAIN = [
    "cur_actual_UPB", "cur_int_rate", "cur_deferred_UPB",
    "ELTV", "credit_score", "first_time_homebuyer", "mi_pct", "num_of_units",
    "occupancy_status", "ori_DTI", "channel", "property_state", "property_type",
    "loan_purpose", "num_borrowers", "property_valuation_method",
    "loan_age", "quarter", "cur_LDS",
]
FEATURES_APPLICANT = [
    "cur_actual_UPB", "cur_int_rate", "cur_deferred_UPB",
    "ELTV", "credit_score", "first_time_homebuyer", "mi_pct", "num_of_units",
    "occupancy_status", "ori_DTI", "channel", "property_state", "property_type",
    "loan_purpose", "num_borrowers", "property_valuation_method",
    "loan_age", "quarter",
]

# One-hot columns of the region that are protected (Midwest is the dropped base level).
PROTECTED_ATTRIBUTES = ["region_Northeast", "region_South", "region_West", "region_Other"]

# Columns min-max scaled with stored bounds.
SCALED_COLUMNS = [
    "cur_actual_UPB", "cur_int_rate", "cur_deferred_UPB", "ELTV", "credit_score",
    "mi_pct", "num_of_units", "ori_DTI", "num_borrowers", "loan_age",
]

TARGET = "target"
RANDOM_STATE = 42

# Release gate thresholds.
THRESHOLDS = {"acc": 0.80, "auc": 0.85, "f1": 0.85, "fairness": 0.20}

# State -> region groups; the first group holding a match wins, anything else is Other.
REGION_GROUPS = {
    "West": ["WA", "OR", "CA", "MT", "ID", "WY", "NV", "UT", "CO", "AZ", "NM", "HI", "AK"],
    "Midwest": ["ND", "SD", "MN", "NE", "KS", "MN", "IA", "MO", "WI", "IL", "MI", "IN", "OH"],
    "South": ["TX", "OK", "AR", "LA", "MS", "AL", "TN", "KY", "GA", "FL", "SC", "NC", "VA", "WV", "DC", "MD", "DE"],
    "Northeast": ["PA", "NY", "NJ", "RI", "CT", "MA", "VT", "NH", "ME"],
}

# Sentinels meaning "missing".
SENTINELS = {"credit_score": 9999.0, "ori_DTI": 999.0, "ELTV": 999.0,
             "property_valuation_method": 9.0, "channel": "9"}

# Inclusive valid ranges; a null value fails.
VALID_RANGES = {"ori_DTI": (0.0, 65.0), "credit_score": (300.0, 850.0),
                "mi_pct": (0.0, 55.0), "ELTV": (1.0, 998.0)}

# Defaults for fields an applicant may leave out.
DEFAULTS_NUMERIC = {"ELTV": 71.67837, "cur_deferred_UPB": 0.0, "property_valuation_method": 2.0}
DEFAULTS_TEXT = {"loan_purpose": "P", "channel": "R", "first_time_homebuyer": "Y",
                 "property_type": "SF", "occupancy_status": "P"}
DEFAULT_NUM_OF_UNITS = 1

# Code -> label tables for reports.
LABELS_OCCUPANCY = {"P": "Primary Residence", "I": "Investment Property", "S": "Second Home", "9": "Not Available"}
LABELS_HOMEBUYER = {"Y": "First Time Homebuyer", "N": "Not First Time Homebuyer"}
LABELS_PROPERTY = {"CO": "Condo", "PU": "PUD", "MH": "Manufactured Housing", "SF": "Single-Family",
                   "CP": "Co-op", "99": "Not Available"}
LABELS_PURPOSE = {"P": "Purchase", "C": "Refinance - Cash Out", "N": "Refinance - No Cash Out",
                  "R": "Refinance - Not Specified", "9": "Not Available"}

# Coverage threshold for keeping a column, and association cut-off for pruning.
COVERAGE_THRESHOLD = 0.7
ASSOCIATION_CUTOFF = 0.7

# ---------------------------------------------------------------------------
# Schemas built from the lists above.
# ---------------------------------------------------------------------------


def _field(name: str) -> T.StructField:
    kind = T.StringType() if (name in FORCED_TEXT or name in OTHER_TEXT) else T.DoubleType()
    return T.StructField(RENAMES.get(name, name), kind, True)


PERFORMANCE_SCHEMA = T.StructType([_field(c) for c in PERFORMANCE_COLUMNS])
ORIGINATION_SCHEMA = T.StructType([_field(c) for c in ORIGINATION_COLUMNS_SOURCE])
ORIGINATION_COLUMNS = [f.name for f in ORIGINATION_SCHEMA.fields]
