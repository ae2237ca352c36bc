"""Loan-domain views over the given star-schema tables, as SQL projections both engines read.

Loans are orders, loan-months are line items. Every view is a row-by-row projection, like reading
the stored tables; nothing is joined, ordered or grouped to build one, except the month-grain
macro table, which is an aggregate of the panel.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanlife.operators.outcomes import outcomes
from loanlife.sources.tables import loans_wide
from loanlife.support import small_table

TRAIN_YEARS, LATE_YEARS = list(range(1995, 2000)), [2000, 2001]
SPLIT_YEARS = {"train": [1995, 1996, 1997], "test": [1998, 1999], "backtest_a": [2000],
               "backtest_b": [2001]}
HORIZONS = {"train": 60, "test": 60, "backtest_a": 24, "backtest_b": 12}
VINTAGE_GROUPS = {"1995-1996": [1995, 1996], "1997-1998": [1997, 1998],
                  "1999-2001": [1999, 2000, 2001]}
AT_RISK_FLOOR, MIN_ACTIVE = 500, 50
CAL_YEARS, AGE_YEARS, SNAPSHOT_YEARS = list(range(1995, 2002)), list(range(7)), [1996, 1998, 2000]
ORDER = ["month", "seq"]

_month = "CAST(date_trunc('month', {0}) AS DATE)"
_ym = "CAST(year({0}) * 100 + month({0}) + {1} AS STRING)"
_age = ("CAST(greatest(0, year(l_shipdate) * 12 + month(l_shipdate) - 23941 - "
        "CAST(floor((l_orderkey % 600) / CAST(10 AS DOUBLE)) AS INT)) AS INT)")
_dq = ("CASE WHEN l_suppkey % 17 = 0 THEN NULL WHEN l_tax >= 0.075 THEN 'RA' "
       "WHEN l_linenumber = 1 AND l_tax < 0.015 THEN 'XX' "
       "ELSE CAST(CAST(floor(l_quantity / 8) AS INT) AS STRING) END")
_zb = ("CASE WHEN l_partkey % 4 <> 0 THEN NULL WHEN l_returnflag = 'A' THEN '01' "
       "WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN '03' WHEN l_returnflag = 'R' THEN '01' "
       "WHEN l_linestatus = 'F' THEN '02' ELSE NULL END")
_proceeds = ("CASE WHEN l_suppkey % 5 = 0 THEN 'U' WHEN l_suppkey % 5 = 1 THEN 'C' "
             "WHEN l_suppkey % 5 = 2 THEN NULL "
             "ELSE CAST(CAST(floor(l_extendedprice) AS BIGINT) AS STRING) END")
_whole = "CAST(CAST(floor({0}) AS BIGINT) AS STRING)"


def _pick(number: str, values: list[str | None]) -> str:
    arms = " ".join(f"WHEN {i} THEN {'NULL' if v is None else repr(v)}"
                    for i, v in enumerate(values))
    return f"CASE {number} % {len(values)} {arms} END"


_purpose = "CASE o_orderstatus WHEN 'F' THEN 'P' WHEN 'O' THEN 'N' WHEN 'P' THEN 'C' END"
_channel = ("CASE WHEN o_orderkey % 41 = 0 THEN NULL ELSE CASE substr(o_orderpriority, 1, 1) "
            "WHEN '1' THEN 'R' WHEN '2' THEN 'B' WHEN '3' THEN 'T' WHEN '4' THEN 'C' "
            "ELSE 'R' END END")
_state = "concat('S', CAST(10 + o_custkey % 25 AS STRING))"

VIEWS: dict[str, tuple[str, dict[str, str]]] = {
    "fx_origination": ("orders", {
        "loan_seq_num": "o_orderkey",
        "first_payment_date": _month.format("o_orderdate"),
        "vintage_year": "CAST(year(o_orderdate) AS INT)",
        "vintage_quarter": "CAST(quarter(o_orderdate) AS INT)",
        "fico": "CASE WHEN o_orderkey % 37 = 0 THEN NULL "
                "ELSE CAST(300 + (o_custkey * 7 + o_orderkey) % 550 AS INT) END",
        "ltv": "CAST(40 + o_custkey % 60 AS INT)",
        "dti": "CAST(10 + o_orderkey % 45 AS INT)",
        "orig_rate": "2 + (o_orderkey % 600) / CAST(100 AS DOUBLE)",
        "orig_upb": "o_totalprice",
        "loan_purpose": _purpose,
        "channel": _channel,
        "n_borrowers": "CAST(1 + o_orderkey % 2 AS INT)",
        "n_units": "CAST(1 + o_orderkey % 4 AS INT)",
        "mi_pct": "CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE CAST(o_custkey % 35 AS INT) END",
        "occupancy": _pick("o_custkey", ["P", "I", "S"]),
        "prop_type": _pick("o_orderkey", ["SF", "CO", "PU", "MH", "CP"]),
        "first_time_homebuyer": _pick("o_orderkey", ["Y", "N", "N", None]),
        "state": _state,
    }),
    "fx_panel": ("lineitem", {
        "loan_seq_num": "l_orderkey",
        "month": _month.format("l_shipdate"),
        "seq": "CAST(l_linenumber AS BIGINT) * 100000 + l_partkey % 100000",
        "loan_age": _age,
        "dq_status": _dq,
        "zb_code": _zb,
        "current_rate": "2 + l_discount * 50",
        "actual_upb": "l_extendedprice",
        "net_sales_proceeds": _proceeds,
    }),
    "fx_raw_origination": ("orders", {
        "fico": "CASE WHEN o_orderkey % 37 = 0 THEN '9999' WHEN o_orderkey % 53 = 0 THEN '  ' "
                "WHEN o_orderkey % 59 = 0 THEN '70000' WHEN o_orderkey % 61 = 0 THEN 'abc' "
                "ELSE CAST(300 + (o_custkey * 7 + o_orderkey) % 550 AS STRING) END",
        "first_payment_date_raw":
            "CASE WHEN o_orderkey % 43 = 0 THEN '200613' WHEN o_orderkey % 47 = 0 THEN '' "
            f"WHEN o_orderkey % 71 = 0 THEN '2006' ELSE {_ym.format('o_orderdate', 0)} END",
        "first_time_homebuyer": _pick("o_orderkey", ["Y", "N", "9"]),
        "maturity_date_raw": _ym.format("o_orderdate", 3000),
        "msa": "CASE WHEN o_orderkey % 5 = 0 THEN '' "
               "ELSE CAST(10000 + o_custkey % 900 AS STRING) END",
        "mi_pct": "CASE WHEN o_orderkey % 6 = 0 THEN '999' "
                  "ELSE CAST(o_custkey % 35 AS STRING) END",
        "n_units": "CASE WHEN o_orderkey % 19 = 0 THEN '99' "
                   "ELSE CAST(1 + o_orderkey % 4 AS STRING) END",
        "occupancy": _pick("o_custkey", ["P", "I", "S", "9"]),
        "cltv": "CASE WHEN o_orderkey % 29 = 0 THEN '999' "
                "ELSE CAST(40 + o_custkey % 300 AS STRING) END",
        "dti": "CASE WHEN o_orderkey % 31 = 0 THEN '999' "
               "ELSE CAST(10 + o_orderkey % 45 AS STRING) END",
        "orig_upb": _whole.format("o_totalprice"),
        "ltv": "CAST(40 + o_custkey % 60 AS STRING)",
        "orig_rate": "concat(CAST(2 + o_orderkey % 6 AS STRING), '.', "
                     "CAST(100 + o_orderkey % 900 AS STRING))",
        "channel": f"coalesce({_channel}, '9')",
        "ppm_flag": _pick("o_orderkey", ["N", "Y"]),
        "amort_type": "CASE WHEN o_orderkey % 7 = 0 THEN 'ARM' ELSE 'FRM' END",
        "state": _state,
        "prop_type": _pick("o_orderkey", ["SF", "CO", "PU", "MH", "99"]),
        "zip3": "CAST((o_custkey % 900 + 100) * 100 AS STRING)",
        "loan_seq_num": "concat('F', CAST(100000000 + o_orderkey AS STRING))",
        "loan_purpose": f"coalesce({_purpose}, '9')",
        "term_months": "CASE WHEN o_orderkey % 5 = 0 THEN '180' ELSE '360' END",
        "n_borrowers": "CASE WHEN o_orderkey % 67 = 0 THEN '99' "
                       "ELSE CAST(1 + o_orderkey % 2 AS STRING) END",
        "seller_name": "concat('Seller ', CAST(o_custkey % 40 AS STRING))",
        "servicer_name": "concat('Servicer ', CAST(o_custkey % 30 AS STRING))",
        "super_conforming": _pick("o_orderkey", ["", "Y"]),
        "preharp_loan_seq_num": "''",
        "program": _pick("o_orderkey", ["9", "H", "F"]),
        "harp": _pick("o_orderkey", ["", "", "Y"]),
        "prop_valuation_method": _pick("o_orderkey", ["1", "2", "9", "3"]),
        "io_indicator": _pick("o_custkey", ["N", "Y"]),
        "mi_cancel": _pick("o_custkey", ["7", " ", "N"]),
    }),
    "fx_raw_monthly": ("lineitem", {
        "loan_seq_num": "concat('F', CAST(100000000 + l_orderkey AS STRING))",
        "month_raw": _ym.format("l_shipdate", 0),
        "actual_upb": _whole.format("l_extendedprice"),
        "dq_status": f"coalesce({_dq}, '')",
        "loan_age": f"CAST({_age} AS STRING)",
        "rem_months": f"CAST(360 - {_age} AS STRING)",
        "defect_date_raw": f"CASE WHEN l_partkey % 97 = 0 THEN {_ym.format('l_shipdate', 0)} "
                           "ELSE ' ' END",
        "mod_flag": _pick("l_partkey", ["", "", "Y", "P"]),
        "zb_code": f"coalesce({_zb}, '')",
        "zb_date_raw": f"CASE WHEN ({_zb}) IS NULL THEN '' ELSE {_ym.format('l_shipdate', 0)} END",
        "current_rate": "concat(CAST(2 + l_partkey % 6 AS STRING), '.5')",
        "deferred_upb": _pick("l_partkey", ["0", "12500", ""]),
        "ddlpi_raw": _ym.format("l_shipdate", 0),
        "mi_recoveries": _pick("l_partkey", ["", "150", "-20.5"]),
        "net_sales_proceeds": f"coalesce({_proceeds}, '')",
        "non_mi_recoveries": _pick("l_partkey", ["", "75"]),
        "expenses": _pick("l_partkey", ["", "-310.25"]),
        "legal_costs": _pick("l_partkey", ["", "-11"]),
        "maint_costs": _pick("l_partkey", ["", "-12"]),
        "taxes_insurance": _pick("l_partkey", ["", "-13"]),
        "misc_expenses": _pick("l_partkey", ["", "-14"]),
        "actual_loss": _pick("l_partkey", ["", "-1500", "bad"]),
        "mod_cost": _pick("l_partkey", ["", "3.25"]),
        "step_mod_flag": _pick("l_partkey", ["", "N"]),
        "deferred_payment_plan": _pick("l_partkey", ["", "Y"]),
        "eltv": "CASE WHEN l_partkey % 11 = 0 THEN '999' "
                "ELSE CAST(20 + l_partkey % 90 AS STRING) END",
        "zb_removal_upb": f"CASE WHEN ({_zb}) IS NULL THEN '' "
                          f"ELSE {_whole.format('l_extendedprice')} END",
        "dq_accrued_interest": _pick("l_suppkey", ["", "44.5"]),
        "disaster_dq": _pick("l_suppkey", ["", "Y"]),
        "borrower_assistance": _pick("l_suppkey", ["", "F", "R"]),
        "current_mod_cost": _pick("l_suppkey", ["", "1.5"]),
        "interest_bearing_upb": _whole.format("l_extendedprice"),
    }),
    "fx_variant_origination": ("orders", {
        "LoanSequenceNumber": "CAST(o_orderkey AS STRING)",
        "CreditScore": "CASE WHEN o_orderkey % 37 = 0 THEN '9999' "
                       "ELSE CAST(300 + (o_custkey * 7 + o_orderkey) % 550 AS STRING) END",
        "FirstTimeHomebuyerFlag": _pick("o_orderkey", ["Y", " N ", "9", ""]),
        "MortgageInsurancePercentage": "CASE WHEN o_orderkey % 6 = 0 THEN '999' "
                                       "ELSE CAST(o_custkey % 35 AS STRING) END",
        "NumberofUnits": _pick("o_orderkey", ["1", "2", "99"]),
        "OccupancyStatus": _pick("o_custkey", ["P", "I", "S", "9"]),
        "OriginalCombinedLoantoValueCLTV": "CAST(40 + o_custkey % 60 AS STRING)",
        "OriginalDebttoIncomeRatio": _pick("o_orderkey", ["20", "30", "999", "x"]),
        "OriginalUPB": "CASE WHEN o_orderkey % 13 = 0 THEN '0' ELSE "
                       + _whole.format("o_totalprice") + " END",
        "OriginalLoantoValueLTV": "CAST(40 + o_custkey % 60 AS STRING)",
        "OriginalInterestRate": _pick("o_orderkey", ["5.5", "0", "-1", "6.25"]),
        "Channel": _pick("o_orderkey", ["R", "B", "9", "T"]),
        "PropertyState": _state,
        "PropertyType": _pick("o_orderkey", ["SF", "99", "CO"]),
        "LoanPurpose": _pick("o_custkey", ["P", "C", "N"]),
        "OriginalLoanTerm": _pick("o_orderkey", ["360", "-8", "0"]),
        "NumberofBorrowers": _pick("o_orderkey", ["1", "2", "99"]),
    }),
    "fx_variant_panel": ("lineitem", {
        "LoanSequenceNumber": "CAST(l_orderkey AS STRING)",
        "MonthlyReportingPeriod": _ym.format("l_shipdate", 0),
        "LoanAge": f"CAST({_age} AS STRING)",
        "ZeroBalanceCode": f"({_zb})",
    }),
}

MACRO_MONTH = _month.format("l_shipdate")
MACRO = {
    "MORTGAGE30US": "round(3 + avg(l_discount) * 40, 6)",
    "GS10": "round(1 + avg(l_tax) * 50, 6)",
    "UNRATE": "round(avg(l_quantity) / 5, 6)",
    "CPIAUCSL": "round(200 + avg(l_extendedprice) / 1000, 6)",
    "CSUSHPISA": "round(100 + avg(l_extendedprice) / 500, 6)",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, exprs = VIEWS[name]
    return table(spark, sf_dir, source).selectExpr(*[f"{e} AS `{a}`" for a, e in exprs.items()])


class Data:
    """The views of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return table(self.spark, self.dir, name)

    def view(self, name: str) -> DataFrame:
        return view(self.spark, self.dir, name)

    @property
    def orig(self) -> DataFrame:
        return self.view("fx_origination")

    @property
    def panel(self) -> DataFrame:
        return self.view("fx_panel")

    @property
    def macro(self) -> DataFrame:
        """Aggregated once; its month-grain rows then live in the plan as a small relation."""
        by_month = self.table("lineitem").groupBy(F.expr(MACRO_MONTH).alias("month"))
        return small_table(by_month.agg(*[F.expr(e).alias(a) for a, e in MACRO.items()]))[0]

    @property
    def outcomes(self) -> DataFrame:
        return outcomes(self.orig, self.panel, ORDER)

    @property
    def loans(self) -> DataFrame:
        """Origination with outcome: one row per loan."""
        return loans_wide(self.orig, self.outcomes)


# ---- the same views as SQL ------------------------------------------------------------------

def view_sql(name: str) -> str:
    source, exprs = VIEWS[name]
    return "SELECT " + ", ".join(f'{e} AS "{a}"' for a, e in exprs.items()) + f" FROM {source}"


_OUTCOME_SQL = f"""
SELECT o.loan_seq_num, o.vintage_year, o.vintage_quarter, a.first_obs_date, a.last_obs_date,
  a.event_time_months,
  CASE WHEN z.zb_code = '01' THEN 'prepaid' WHEN z.zb_code IN ('03','06','09','15') THEN 'defaulted'
       WHEN a.max_dq_status >= 6 THEN 'defaulted' WHEN z.zb_code IS NOT NULL THEN 'other_termination'
       ELSE 'censored' END AS event_type,
  z.zb_code AS final_zero_balance_code, a.max_dq_status, q.dq_status AS final_delinquency_status
FROM fx_origination o
LEFT JOIN (SELECT loan_seq_num, min(month) AS first_obs_date, max(month) AS last_obs_date,
    max(loan_age) AS event_time_months, max(TRY_CAST(dq_status AS SMALLINT)) AS max_dq_status
    FROM fx_panel GROUP BY 1) a ON a.loan_seq_num = o.loan_seq_num
LEFT JOIN (SELECT loan_seq_num, zb_code, row_number() OVER (PARTITION BY loan_seq_num
    ORDER BY month DESC, seq DESC, zb_code DESC) AS rn FROM fx_panel WHERE zb_code IS NOT NULL) z
  ON z.loan_seq_num = o.loan_seq_num AND z.rn = 1
LEFT JOIN (SELECT loan_seq_num, dq_status, row_number() OVER (PARTITION BY loan_seq_num
    ORDER BY month DESC, seq DESC, coalesce(dq_status, '') DESC) AS rn FROM fx_panel) q
  ON q.loan_seq_num = o.loan_seq_num AND q.rn = 1
"""

_DERIVED = {
    "fx_macro": ([], f"SELECT {MACRO_MONTH} AS month, " + ", ".join(
        f'{e} AS "{a}"' for a, e in MACRO.items()) + " FROM lineitem GROUP BY 1"),
    "fx_outcomes": (["fx_origination", "fx_panel"], _OUTCOME_SQL),
    "fx_loans": (["fx_outcomes"], """
SELECT o.*, e.first_obs_date, e.last_obs_date, e.event_time_months, e.event_type,
  e.final_zero_balance_code, e.max_dq_status, e.final_delinquency_status
FROM fx_origination o LEFT JOIN fx_outcomes e ON e.loan_seq_num = o.loan_seq_num"""),
    "fx_surv": (["fx_loans"], """
SELECT *, CAST(event_type = 'prepaid' AS INT) AS prepay_observed FROM fx_loans
WHERE event_time_months IS NOT NULL"""),
    "fx_cox": (["fx_surv"], "SELECT * FROM fx_surv WHERE event_time_months >= 1"),
}


def with_views(body: str, *names: str) -> str:
    """``body`` preceded by the CTEs it needs, in dependency order."""
    done: list[str] = []

    def need(name: str) -> None:
        if name in done or (name not in VIEWS and name not in _DERIVED):
            return
        for dep in _DERIVED.get(name, ([], ""))[0]:
            need(dep)
        done.append(name)

    for n in names:
        need(n)
    text = [f"{n} AS MATERIALIZED ({_DERIVED[n][1] if n in _DERIVED else view_sql(n)})"
            for n in done]
    body = body.strip()
    if body.upper().startswith("WITH "):
        body = body[5:]
        return f"WITH {', '.join(text)}, {body}"
    return f"WITH {', '.join(text)} {body}"
