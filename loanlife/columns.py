"""Column names, code sets and storage types of the loan files."""

from __future__ import annotations

# Field order of the raw origination text file.
ORIGINATION_RAW = [
    "fico", "first_payment_date_raw", "first_time_homebuyer", "maturity_date_raw", "msa", "mi_pct",
    "n_units", "occupancy", "cltv", "dti", "orig_upb", "ltv", "orig_rate", "channel", "ppm_flag",
    "amort_type", "state", "prop_type", "zip3", "loan_seq_num", "loan_purpose", "term_months",
    "n_borrowers", "seller_name", "servicer_name", "super_conforming", "preharp_loan_seq_num",
    "program", "harp", "prop_valuation_method", "io_indicator", "mi_cancel",
]

# Field order of the raw monthly text file.
MONTHLY_RAW = [
    "loan_seq_num", "month_raw", "actual_upb", "dq_status", "loan_age", "rem_months",
    "defect_date_raw", "mod_flag", "zb_code", "zb_date_raw", "current_rate", "deferred_upb",
    "ddlpi_raw", "mi_recoveries", "net_sales_proceeds", "non_mi_recoveries", "expenses",
    "legal_costs", "maint_costs", "taxes_insurance", "misc_expenses", "actual_loss", "mod_cost",
    "step_mod_flag", "deferred_payment_plan", "eltv", "zb_removal_upb", "dq_accrued_interest",
    "disaster_dq", "borrower_assistance", "current_mod_cost", "interest_bearing_upb",
]

# Codes that stand for "not available", by column.
ORIGINATION_SENTINELS = {
    "fico": ["9999"], "first_time_homebuyer": ["9"], "mi_pct": ["999"], "n_units": ["99"],
    "occupancy": ["9"], "cltv": ["999"], "dti": ["999"], "ltv": ["999"], "channel": ["9"],
    "prop_type": ["99"], "loan_purpose": ["9"], "n_borrowers": ["99"],
    "prop_valuation_method": ["9"],
}
MONTHLY_SENTINELS = {"eltv": ["999"]}

# YYYYMM text column -> date column.
ORIGINATION_DATES = {
    "first_payment_date_raw": "first_payment_date",
    "maturity_date_raw": "maturity_date",
}
MONTHLY_DATES = {
    "month_raw": "month", "defect_date_raw": "defect_date", "zb_date_raw": "zb_date",
    "ddlpi_raw": "ddlpi",
}

# Storage kinds: Spark type and, for unsigned integers, the bits a value may use. Spark has no
# unsigned type, so each is kept in the next wider signed one.
U8 = ("short", 8)
U16 = ("int", 16)
U32 = ("bigint", 32)
F32 = ("float", None)

# Storage types by column.
ORIGINATION_TYPES = {
    "fico": U16, "msa": U32, "mi_pct": U8, "n_units": U8, "cltv": U8, "dti": U8, "orig_upb": F32,
    "ltv": U8, "orig_rate": F32, "zip3": U32, "term_months": U16, "n_borrowers": U8,
    "prop_valuation_method": U8,
}
# Storage types of the monthly columns.
MONTHLY_TYPES = {
    "actual_upb": F32, "loan_age": U16, "rem_months": U16, "current_rate": F32,
    "deferred_upb": F32, "mi_recoveries": F32, "non_mi_recoveries": F32, "expenses": F32,
    "legal_costs": F32, "maint_costs": F32, "taxes_insurance": F32, "misc_expenses": F32,
    "actual_loss": F32, "mod_cost": F32, "eltv": U16, "zb_removal_upb": F32,
    "dq_accrued_interest": F32, "current_mod_cost": F32, "interest_bearing_upb": F32,
}

MONTHLY_OUTPUT = [MONTHLY_DATES.get(c, c) for c in MONTHLY_RAW]
# Columns of the outcome table, in order.
OUTCOME_OUTPUT = [
    "loan_seq_num", "vintage_year", "vintage_quarter", "first_obs_date", "last_obs_date",
    "event_time_months", "event_type", "final_zero_balance_code", "max_dq_status",
    "final_delinquency_status",
]

# Termination codes and the delinquency level that count as default.
PREPAID_CODE = "01"
DEFAULT_CODES = ["03", "06", "09", "15"]
DEFAULT_DQ_MONTHS = 6

# Macro series.
MACRO_SERIES = ["MORTGAGE30US", "GS10", "UNRATE", "CPIAUCSL", "CSUSHPISA"]

# Modelling columns.
ID, TIME, EVENT = "loan_seq_num", "event_time_months", "prepay_observed"
STATIC_FEATURES = [
    "fico", "ltv", "dti", "orig_rate", "orig_upb", "loan_purpose", "channel", "n_borrowers",
    "n_units", "mi_pct", "occupancy", "prop_type", "first_time_homebuyer", "state", "vintage_year",
]
MACRO_FEATURES = [
    "GS10", "UNRATE", "rate_incentive_orig", "mort_treasury_spread", "log_hpi", "log_cpi",
]
CATEGORICAL_FEATURES = [
    "loan_purpose", "channel", "occupancy", "prop_type", "first_time_homebuyer", "state",
]

# Cut points and labels of the stratified curves.
BINS = {
    "fico": ([660, 700, 740, 780], ["<660", "660-700", "700-740", "740-780", "780+"]),
    "ltv": ([60, 80, 90, 95], ["<=60", "60-80", "80-90", "90-95", "95+"]),
    "dti": ([30, 40, 45], ["<=30", "30-40", "40-45", "45+"]),
    "orig_rate": ([3.5, 4.5, 5.5, 6.5],
                  ["<3.5%", "3.5-4.5%", "4.5-5.5%", "5.5-6.5%", "6.5%+"]),
}
PURPOSE_LABELS = {"P": "Purchase (P)", "N": "No-cash refi (N)", "C": "Cash-out refi (C)"}
CHANNEL_LABELS = {
    "R": "Retail (R)", "B": "Broker (B)", "T": "Correspondent (T)", "C": "TPO/Other (C)",
}
AGE_BREAKS, AGE_LABELS = [12, 36, 72, 120], ["0-12", "12-36", "36-72", "72-120", "120+"]

# Camel-case names and sentinels of the yearly loan-level variant.
VARIANT_NUMERIC_SENTINELS = {
    "CreditScore": [9999], "MortgageInsurancePercentage": [999], "NumberofUnits": [99],
    "OriginalCombinedLoantoValueCLTV": [999], "OriginalDebttoIncomeRatio": [999],
    "OriginalLoantoValueLTV": [999], "OriginalLoanTerm": [-8, 0], "NumberofBorrowers": [99],
}
VARIANT_POSITIVE = ["OriginalInterestRate", "OriginalUPB"]
VARIANT_TEXT = [
    "FirstTimeHomebuyerFlag", "OccupancyStatus", "Channel", "PropertyState", "PropertyType",
    "LoanPurpose",
]
VARIANT_TEXT_SENTINELS = ["", "9", "99", "999", "9999"]
VARIANT_FEATURES = [
    "CreditScore", "FirstTimeHomebuyerFlag", "MortgageInsurancePercentage", "NumberofUnits",
    "OccupancyStatus", "OriginalCombinedLoantoValueCLTV", "OriginalDebttoIncomeRatio",
    "OriginalUPB", "OriginalLoantoValueLTV", "OriginalInterestRate", "Channel", "PropertyState",
    "PropertyType", "LoanPurpose", "OriginalLoanTerm", "NumberofBorrowers",
]

# Leading columns of the yearly loan-level table, in order.
VARIANT_OUTCOME = ["LoanSequenceNumber", "duration_months", "event", "zero_balance_code",
                   "event_loan_age", "event_reporting_period", "last_observed_loan_age",
                   "last_reporting_period", "origination_year"]

# Label columns of the horizon data sets.
HORIZON_LABELS = ("y_prepay_60m", "y_prepay_24m", "y_prepay_12m")
