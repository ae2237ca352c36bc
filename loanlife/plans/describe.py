"""Queries over outcomes, cohorts, life tables and tests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanlife import columns as K
from loanlife.functions import binning as B
from loanlife.functions.cleaning import event_flag
from loanlife.operators import cohort, life
from loanlife.operators import outcomes as O
from loanlife.operators import summaries as S
from loanlife.operators.ranks import hash_sample
from loanlife.plans.fixtures import (AGE_YEARS, AT_RISK_FLOOR, CAL_YEARS, MIN_ACTIVE, ORDER,
                                     SNAPSHOT_YEARS, VINTAGE_GROUPS, Data)
from loanlife.plans.ingest import VARIANT_SQL
from loanlife.plans.registry import query, rounded
from loanlife.sources.tables import attach_macro
from loanlife.support import materialize

OUT, SURV = ["fx_outcomes"], ["fx_surv"]


def prepay(d: Data) -> DataFrame:
    return event_flag(d.loans)


def prepay_outcomes(d: Data) -> DataFrame:
    return event_flag(d.outcomes)


def _values(items) -> str:
    return ", ".join(f"({v})" for v in items)


def cut_sql(column: str, breaks, labels) -> str:
    arms = " ".join(f"WHEN {column} <= {b} THEN '{l}'" for b, l in zip(breaks, labels))
    return f"CASE WHEN {column} IS NULL THEN NULL {arms} ELSE '{labels[-1]}' END"


def case_sql(column: str, labels: dict) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in labels.items()) \
        + " END"


# ---- outcomes --------------------------------------------------------------------------------

@query("panel_summary", """SELECT loan_seq_num, first_obs_date, last_obs_date, event_time_months,
final_zero_balance_code, max_dq_status, final_delinquency_status
FROM fx_outcomes WHERE first_obs_date IS NOT NULL""", OUT)
def panel_summary(d: Data) -> DataFrame:
    return O.panel_summary(d.panel, ORDER)


@query("outcomes", "SELECT * FROM fx_outcomes", OUT)
def outcomes(d: Data) -> DataFrame:
    return d.outcomes


@query("outcome_stats", """SELECT vintage_year, vintage_quarter, CAST(count(*) AS BIGINT) AS n_loans,
CAST(count(*) FILTER (WHERE event_type = 'prepaid') AS BIGINT) AS n_prepaid,
CAST(count(*) FILTER (WHERE event_type = 'defaulted') AS BIGINT) AS n_defaulted,
CAST(count(*) FILTER (WHERE event_type = 'other_termination') AS BIGINT) AS n_other,
CAST(count(*) FILTER (WHERE event_type = 'censored') AS BIGINT) AS n_censored
FROM fx_outcomes GROUP BY 1, 2""", OUT)
def outcome_stats(d: Data) -> DataFrame:
    return O.outcome_stats(d.outcomes)


FIRST_SQL = """p AS (SELECT "LoanSequenceNumber" AS id,
  TRY_CAST("MonthlyReportingPeriod" AS INTEGER) AS period, TRY_CAST("LoanAge" AS INTEGER) AS age,
  TRY_CAST("ZeroBalanceCode" AS INTEGER) AS code FROM fx_variant_panel),
f AS (SELECT id, age, period, code, row_number() OVER (PARTITION BY id ORDER BY age, period, code)
  AS rn FROM p WHERE code IS NOT NULL),
g AS (SELECT id, max(age) AS last_age, max(period) AS last_period FROM p GROUP BY 1),
ft AS (SELECT g.id AS "LoanSequenceNumber", g.last_age AS last_observed_loan_age,
  g.last_period AS last_reporting_period, CAST(coalesce(f.code = 1, false) AS INTEGER) AS event,
  f.age AS event_loan_age, f.period AS event_reporting_period, f.code AS zero_balance_code,
  coalesce(f.age, g.last_age) AS duration_months
  FROM g LEFT JOIN f ON f.id = g.id AND f.rn = 1)"""


@query("first_termination", f"WITH {FIRST_SQL} SELECT * FROM ft", ["fx_variant_panel"])
def first_termination(d: Data) -> DataFrame:
    return O.first_termination(d.view("fx_variant_panel"))


@query("deepcox_dataset", f"""WITH {FIRST_SQL},
o AS (SELECT {VARIANT_SQL} FROM fx_variant_origination)
SELECT o.*, ft.* EXCLUDE ("LoanSequenceNumber")
FROM o JOIN ft ON ft."LoanSequenceNumber" = o."LoanSequenceNumber" """,
       ["fx_variant_origination", "fx_variant_panel"])
def survival_dataset(d: Data) -> DataFrame:
    return O.survival_dataset(d.view("fx_variant_origination"), d.view("fx_variant_panel"), 1995)


# ---- summaries -------------------------------------------------------------------------------

@query("event_counts", """SELECT vintage_year, event_type, CAST(count(*) AS BIGINT) AS n
FROM fx_outcomes GROUP BY 1, 2""", OUT)
def event_counts(d: Data) -> DataFrame:
    return O.event_counts(d.outcomes, ["vintage_year"])


@query("vintage_means", """SELECT vintage_year, CAST(count(*) AS BIGINT) AS n_loans,
round(avg(CAST(fico AS DOUBLE)), 0) AS fico_mean, round(avg(CAST(ltv AS DOUBLE)), 1) AS ltv_mean,
round(avg(CAST(dti AS DOUBLE)), 1) AS dti_mean, round(avg(orig_rate), 2) AS orig_rate_mean
FROM fx_origination GROUP BY 1""", ["fx_origination"])
def vintage_means(d: Data) -> DataFrame:
    return S.vintage_means(d.orig, {"fico": 0, "ltv": 1, "dti": 1, "orig_rate": 2})


RATES = {"prepay_rate": "prepaid", "default_rate": "defaulted", "censored_rate": "censored"}
RATES_SQL = ", ".join(f"round(avg(CASE WHEN event_type = '{v}' THEN 1.0::DOUBLE ELSE 0 END), 6) "
                      f"AS {k}" for k, v in RATES.items())


@query("vintage_event_rates", f"""SELECT vintage_year, CAST(count(*) AS BIGINT) AS n, {RATES_SQL}
FROM fx_outcomes GROUP BY 1""", OUT)
def vintage_event_rates(d: Data) -> DataFrame:
    return rounded(S.event_rates(d.outcomes, ["vintage_year"], RATES))


FICO_BREAKS = [620, 660, 700, 740, 780]
FICO_BANDS = B.interval_labels(FICO_BREAKS)


@query("fico_band_default", f"""SELECT vintage_year,
{cut_sql('fico', FICO_BREAKS, FICO_BANDS)} AS fico_band, CAST(count(*) AS BIGINT) AS n,
round(avg(CASE WHEN event_type = 'defaulted' THEN 1.0::DOUBLE ELSE 0 END), 6) AS default_rate
FROM fx_loans GROUP BY 1, 2""", ["fx_loans"])
def fico_band_default(d: Data) -> DataFrame:
    banded = d.loans.withColumn("fico_band", B.cut(F.col("fico"), FICO_BREAKS))
    return rounded(S.event_rates(banded, ["vintage_year", "fico_band"],
                                 {"default_rate": "defaulted"}))


@query("rate_incentive_monthly", """SELECT p.month, round(avg(p.current_rate), 6) AS borrower_rate,
max(m.MORTGAGE30US) AS market_rate, round(avg(p.current_rate - m.MORTGAGE30US), 6) AS rate_incentive
FROM fx_panel p LEFT JOIN fx_macro m ON m.month = p.month GROUP BY 1""", ["fx_panel", "fx_macro"])
def rate_incentive_monthly(d: Data) -> DataFrame:
    return rounded(S.rate_incentive(attach_macro(d.panel, d.macro)))


@query("monthly_resample", """WITH a AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS m,
  avg(l_discount) AS v FROM lineitem WHERE month(l_shipdate) <> 7 GROUP BY 1),
b AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS m, avg(o_totalprice) AS v
  FROM orders WHERE month(o_orderdate) <> 7 GROUP BY 1),
x AS (SELECT min(m) AS lo, max(m) AS hi FROM (SELECT m FROM a UNION ALL SELECT m FROM b)),
s AS (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS DATE) AS month FROM x)
SELECT s.month, round(a.v, 6) AS discount, round(b.v, 6) AS price
FROM s LEFT JOIN a ON a.m = s.month LEFT JOIN b ON b.m = s.month""")
def monthly_resample(d: Data) -> DataFrame:
    discount = d.table("lineitem").where(F.month("l_shipdate") != 7).select(
        F.col("l_shipdate").alias("date"), F.col("l_discount").alias("value"))
    price = d.table("orders").where(F.month("o_orderdate") != 7).select(
        F.col("o_orderdate").alias("date"), F.col("o_totalprice").alias("value"))
    return rounded(S.monthly_mean({"discount": discount, "price": price}))


@query("cut_bins", "SELECT loan_seq_num, " + ", ".join(
    f"{cut_sql(c, *spec)} AS {c}_band" for c, spec in K.BINS.items()) + " FROM fx_origination",
    ["fx_origination"])
def cut_bins(d: Data) -> DataFrame:
    return d.orig.select("loan_seq_num", *[
        B.cut(F.col(c), *spec).alias(f"{c}_band") for c, spec in K.BINS.items()])


@query("mask_groups", f"""SELECT loan_seq_num, channel_group FROM (SELECT loan_seq_num,
{case_sql('channel', K.CHANNEL_LABELS)} AS channel_group FROM fx_origination)
WHERE channel_group IS NOT NULL""", ["fx_origination"])
def mask_groups(d: Data) -> DataFrame:
    return B.code_groups(d.orig, "channel", K.CHANNEL_LABELS, "channel_group").select(
        "loan_seq_num", "channel_group")


@query("loan_history", """WITH x AS (SELECT min(loan_seq_num) AS id FROM fx_outcomes
  WHERE vintage_year = 1996 AND event_type = 'defaulted')
SELECT p.loan_seq_num, p.month, p.seq, p.actual_upb, p.dq_status, p.current_rate, p.zb_code,
CASE WHEN regexp_full_match(p.dq_status, '[0-9]+') THEN TRY_CAST(p.dq_status AS INTEGER) END
  AS dq_months FROM fx_panel p JOIN x ON x.id = p.loan_seq_num""", OUT)
def loan_history(d: Data) -> DataFrame:
    loan = cohort.first_loan(d.outcomes, 1996, "defaulted")
    cols = ["loan_seq_num", "month", "seq", "actual_upb", "dq_status", "current_rate", "zb_code"]
    return cohort.loan_history(d.panel.select(*cols), loan, ORDER)


@query("sample_per_group", """WITH g AS (SELECT loan_seq_num, loan_purpose,
row_number() OVER (PARTITION BY loan_purpose ORDER BY md5('7:' || CAST(loan_seq_num AS VARCHAR)))
AS rn FROM fx_origination) SELECT loan_seq_num, loan_purpose FROM g WHERE rn <= 300""",
       ["fx_origination"])
def sample_per_group(d: Data) -> DataFrame:
    return hash_sample(d.orig.select("loan_seq_num", "loan_purpose"), "loan_seq_num", 300, 7,
                       ["loan_purpose"])


@query("sample_exact", """WITH g AS (SELECT loan_seq_num,
row_number() OVER (ORDER BY md5('42:' || CAST(loan_seq_num AS VARCHAR))) AS rn FROM fx_cox)
SELECT loan_seq_num FROM g WHERE rn <= 1000""", ["fx_cox"])
def sample_exact(d: Data) -> DataFrame:
    ids = event_flag(d.outcomes, min_duration=1).select("loan_seq_num")
    return hash_sample(materialize(ids, "sample-rows"), "loan_seq_num", 1000, 42)


# ---- calendar --------------------------------------------------------------------------------

@query("calendar_hazard", """WITH o AS (SELECT * FROM fx_outcomes WHERE first_obs_date IS NOT NULL
  AND last_obs_date IS NOT NULL),
x AS (SELECT min(first_obs_date) AS lo, max(last_obs_date) AS hi FROM o),
s AS (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS DATE) AS month FROM x),
a AS (SELECT first_obs_date AS month, count(*) AS n FROM o GROUP BY 1),
b AS (SELECT last_obs_date AS month, count(*) AS n FROM o GROUP BY 1),
c AS (SELECT last_obs_date AS month, count(*) AS n FROM o WHERE event_type = 'prepaid' GROUP BY 1),
j AS (SELECT s.month, coalesce(a.n, 0) AS n_starts, coalesce(b.n, 0) AS n_ends,
  coalesce(c.n, 0) AS n_prepaid FROM s LEFT JOIN a USING (month) LEFT JOIN b USING (month)
  LEFT JOIN c USING (month)),
k AS (SELECT *, sum(n_starts) OVER (ORDER BY month) AS cum_starts,
  coalesce(sum(n_ends) OVER (ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
  AS cum_ended FROM j)
SELECT k.month, n_starts, n_ends, n_prepaid, CAST(cum_starts AS BIGINT) AS cum_starts,
  CAST(cum_ended AS BIGINT) AS cum_ended, CAST(cum_starts - cum_ended AS BIGINT) AS active,
  round(n_prepaid / NULLIF(cum_starts - cum_ended, 0) * 100, 6) AS cpr_pct,
  m.MORTGAGE30US, m.GS10, m.UNRATE, m.CPIAUCSL, m.CSUSHPISA
FROM k LEFT JOIN fx_macro m ON m.month = k.month""", ["fx_outcomes", "fx_macro"])
def calendar_hazard(d: Data) -> DataFrame:
    return rounded(cohort.calendar_hazard(d.outcomes, d.macro))


@query("snapshot_hazard", f"""WITH y(snap_year) AS (VALUES {_values(SNAPSHOT_YEARS)}),
o AS (SELECT *, CAST(year(first_obs_date) AS INT) AS oy, CAST(year(last_obs_date) AS INT) AS ey
  FROM fx_outcomes WHERE first_obs_date IS NOT NULL),
a AS (SELECT snap_year, (snap_year - oy) * 12 AS age,
  CASE WHEN event_type = 'prepaid' AND ey = snap_year THEN 1 ELSE 0 END AS pre
  FROM o JOIN y ON oy <= snap_year AND ey >= snap_year)
SELECT CAST(snap_year AS INT) AS snap_year, {cut_sql('age', K.AGE_BREAKS, K.AGE_LABELS)} AS
  age_bucket, CAST(count(*) AS BIGINT) AS n_loans, CAST(sum(pre) AS BIGINT) AS n_prepaid,
  round(sum(pre) / count(*) / 12 * 100, 6) AS monthly_prepay_pct FROM a GROUP BY 1, 2""", OUT)
def snapshot_hazard(d: Data) -> DataFrame:
    return rounded(cohort.snapshot_hazard(d.outcomes, SNAPSHOT_YEARS, K.AGE_BREAKS, K.AGE_LABELS))


@query("age_calendar_heatmap", f"""WITH g AS (SELECT CAST(cy AS INT) AS cal_year,
  CAST(ay AS INT) AS age_year FROM (VALUES {_values(CAL_YEARS)}) a(cy),
  (VALUES {_values(AGE_YEARS)}) b(ay)),
o AS (SELECT vintage_year, CAST(year(last_obs_date) AS INT) AS ey, event_type FROM fx_outcomes
  WHERE last_obs_date IS NOT NULL),
c AS (SELECT g.cal_year, g.age_year, count(*) AS n,
  count(*) FILTER (WHERE event_type = 'prepaid' AND ey = g.cal_year) AS p
  FROM g JOIN o ON o.vintage_year = g.cal_year - g.age_year AND o.ey >= g.cal_year GROUP BY 1, 2)
SELECT g.cal_year, g.age_year,
  CASE WHEN n >= {MIN_ACTIVE} THEN round(p / n / 12 * 100, 6) END AS monthly_prepay_pct
FROM g LEFT JOIN c USING (cal_year, age_year)""", OUT)
def age_calendar_heatmap(d: Data) -> DataFrame:
    return rounded(cohort.age_calendar(d.outcomes, CAL_YEARS, AGE_YEARS, MIN_ACTIVE,
                                       (CAL_YEARS[0], CAL_YEARS[-1])))


# ---- life tables -----------------------------------------------------------------------------

def life_sql(group: str | None, source: str = "fx_surv", where: str = "true") -> str:
    """CTE chain ending in ``km``: grp, t, removed, observed, at_risk, hazard, survival."""
    grp = group or "'all'"
    return f"""b AS (SELECT {grp} AS grp, event_time_months AS t, prepay_observed AS e
  FROM {source} WHERE {where}),
c0 AS (SELECT grp, t, count(*) AS removed, sum(e) AS observed FROM b WHERE grp IS NOT NULL
  GROUP BY 1, 2),
c1 AS (SELECT * FROM c0 UNION ALL SELECT grp, 0, 0, 0 FROM c0 GROUP BY grp HAVING min(t) > 0),
c2 AS (SELECT *, sum(removed) OVER (PARTITION BY grp ORDER BY t DESC) AS at_risk FROM c1),
km AS (SELECT grp, CAST(t AS INT) AS t, CAST(removed AS BIGINT) AS removed,
  CAST(observed AS BIGINT) AS observed, CAST(at_risk AS BIGINT) AS at_risk,
  observed / at_risk AS hazard,
  product(1 - observed / at_risk) OVER (PARTITION BY grp ORDER BY t) AS survival FROM c2)"""


KM_COLS = "t, removed, observed, at_risk, round(hazard, 6) AS hazard"


@query("life_table", f"WITH {life_sql(None)} SELECT {KM_COLS} FROM km", SURV)
def life_table(d: Data) -> DataFrame:
    return rounded(life.life_table(prepay_outcomes(d)))


@query("km_overall", f"""WITH {life_sql(None)} SELECT {KM_COLS}, round(survival, 6) AS survival
FROM km WHERE t <= 72""", SURV)
def km_overall(d: Data) -> DataFrame:
    return rounded(life.kaplan_meier(prepay_outcomes(d), max_t=72))


@query("km_by_vintage", f"""WITH {life_sql('vintage_year')} SELECT grp AS vintage_year, {KM_COLS},
round(survival, 6) AS survival FROM km""", SURV)
def km_by_vintage(d: Data) -> DataFrame:
    return rounded(life.kaplan_meier(prepay_outcomes(d), by=["vintage_year"]))


@query("hazard_smoothed", f"""WITH {life_sql(None)} SELECT {KM_COLS},
round(avg(hazard) OVER (ORDER BY t ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 6) AS smoothed
FROM km""", SURV)
def hazard_smoothed(d: Data) -> DataFrame:
    return rounded(life.smooth(life.life_table(prepay_outcomes(d)), 3))


READ_AT = [6, 12, 24, 36, 60, 120]


@query("km_readouts", f"""WITH {life_sql(None)}, h(at_month) AS (VALUES {_values(READ_AT)}),
p AS (SELECT max(hazard) AS peak, arg_max(t, (hazard, -t)) AS pm,
  max(t) FILTER (WHERE at_risk >= {AT_RISK_FLOOR}) AS hz, max(t) AS mt FROM km)
SELECT CAST(h.at_month AS INT) AS at_month, round(arg_max(km.survival, km.t), 6) AS survival,
  round(max(p.peak), 6) AS peak_hazard, CAST(max(p.pm) AS INT) AS peak_month,
  CAST(max(coalesce(p.hz, p.mt)) AS INT) AS horizon
FROM h JOIN km ON km.t <= h.at_month, p GROUP BY 1""", SURV)
def km_readouts(d: Data) -> DataFrame:
    table = life.kaplan_meier(prepay_outcomes(d))
    marks = life.peak_and_horizon(table, AT_RISK_FLOOR).first()
    at = life.survival_at(table, READ_AT)
    return rounded(at.select("at_month", "survival", F.lit(marks["peak_hazard"]).alias("peak_hazard"),
                             F.lit(marks["peak_month"]).alias("peak_month"),
                             F.lit(marks["horizon"]).alias("horizon")))


def _strata_sql(group: str) -> str:
    return f"""WITH {life_sql(group)},
k AS (SELECT *, sum(removed) OVER (PARTITION BY grp) AS n_group FROM km)
SELECT grp, {KM_COLS}, round(survival, 6) AS survival, CAST(n_group AS BIGINT) AS n_group,
  round(avg(hazard) OVER (PARTITION BY grp ORDER BY t ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 6)
  AS smoothed FROM k WHERE n_group >= 100 AND t <= 72"""


def _vintage_sql() -> str:
    arms = " ".join(f"WHEN vintage_year IN ({', '.join(map(str, ys))}) THEN '{g}'"
                    for g, ys in VINTAGE_GROUPS.items())
    return f"CASE {arms} END"


STRATA = {
    **{f"km_by_{n}": (cut_sql(c, *K.BINS[c]), c)
       for n, c in (("fico_band", "fico"), ("ltv_band", "ltv"), ("dti_band", "dti"),
                    ("rate_band", "orig_rate"))},
    "km_by_vintage_group": (_vintage_sql(), "vintage"),
    "km_by_purpose": (case_sql("loan_purpose", K.PURPOSE_LABELS), "loan_purpose"),
    "km_by_channel": (case_sql("channel", K.CHANNEL_LABELS), "channel"),
}


def group_column(name: str):
    """Group expression of one stratification; NULL where no group takes the loan."""
    if name in K.BINS:
        return B.cut(F.col(name), *K.BINS[name])
    if name == "vintage":
        return F.coalesce(*[F.when(F.col("vintage_year").isin(*ys), F.lit(g))
                            for g, ys in VINTAGE_GROUPS.items()])
    labels = {"loan_purpose": K.PURPOSE_LABELS, "channel": K.CHANNEL_LABELS}[name]
    return F.coalesce(*[F.when(F.col(name) == code, F.lit(g)) for code, g in labels.items()])


def _register_strata() -> None:
    for name, (sql, column) in STRATA.items():
        @query(name, _strata_sql(sql), SURV)
        def curves(d: Data, column=column) -> DataFrame:
            return rounded(life.stratified_survival(
                prepay(d).withColumn("grp", group_column(column)), "grp", max_t=72))


_register_strata()


def _register_loglog() -> None:
    for name, column in (("loglog_survival", "fico"), ("loglog_ltv", "ltv"),
                         ("loglog_orig_rate", "orig_rate")):
        @query(name, f"""WITH {life_sql(cut_sql(column, *K.BINS[column]),
where='event_time_months > 0')},
k AS (SELECT *, sum(removed) OVER (PARTITION BY grp) AS n_group FROM km)
SELECT grp, t, round(ln(t), 6) AS log_t, round(ln(-ln(survival)), 6) AS loglog_s FROM k
WHERE n_group >= 200 AND t > 0 AND survival > 0 AND survival < 1""", SURV)
        def curves(d: Data, column=column) -> DataFrame:
            loans = event_flag(d.loans, min_duration=1).withColumn("grp", group_column(column))
            table = life.stratified_survival(loans, "grp", min_group=200)
            return rounded(life.loglog(table).select("grp", "t", "log_t", "loglog_s"))


_register_loglog()


def logrank_sql(group: str, source: str = "fx_surv") -> str:
    """CTE chain ending in ``lr``: grp, t, d_g, n_g, d, n with every group at every event month."""
    return f"""b AS (SELECT * FROM (SELECT {group} AS grp, event_time_months AS t,
  prepay_observed AS e FROM {source}) WHERE grp IS NOT NULL),
gs AS (SELECT DISTINCT grp FROM b), ts AS (SELECT DISTINCT t FROM b WHERE e = 1),
lr0 AS (SELECT gs.grp, ts.t, count(*) FILTER (WHERE b.t >= ts.t AND b.grp = gs.grp) AS n_g,
  count(*) FILTER (WHERE b.t = ts.t AND b.e = 1 AND b.grp = gs.grp) AS d_g
  FROM gs, ts JOIN b ON b.t >= ts.t GROUP BY 1, 2),
lr AS (SELECT *, sum(d_g) OVER (PARTITION BY t) AS d, sum(n_g) OVER (PARTITION BY t) AS n
  FROM lr0)"""


@query("logrank_fico", f"""WITH {logrank_sql(cut_sql('fico', *K.BINS['fico']))},
s AS (SELECT grp, count(*) AS n_loans FROM b GROUP BY 1)
SELECT lr.grp, CAST(max(s.n_loans) AS BIGINT) AS n_loans,
  round(CAST(sum(d_g) AS DOUBLE), 6) AS observed, round(sum(d * n_g / n), 6) AS expected
FROM lr JOIN s ON s.grp = lr.grp GROUP BY 1""", SURV)
def logrank_fico(d: Data) -> DataFrame:
    loans = prepay(d).withColumn("grp", group_column("fico"))
    return rounded(life.logrank_groups(loans, "grp"))


@query("logrank_two_groups", f"""WITH {logrank_sql("CASE WHEN orig_rate <= 5 THEN 'low' ELSE 'high' END")},
q AS (SELECT sum(d_g - d * n_g / n) AS z,
  sum(CASE WHEN n > 1 THEN d * (n - d) / (n - 1) * (n_g / n) * (1 - n_g / n) ELSE 0 END) AS v
  FROM lr WHERE grp = 'low')
SELECT 'rate_split' AS covariate, CAST(2 AS INT) AS n_groups,
  CAST((SELECT count(*) FROM b) AS BIGINT) AS n_loans, round(z * z / v, 6) AS chi2 FROM q""", SURV)
def logrank_two_groups(d: Data) -> DataFrame:
    split = F.when(F.col("orig_rate") <= 5, "low").otherwise("high")
    return rounded(life.rank_logrank(prepay(d), {"rate_split": split}).drop("p_value"))


def _covariance_sql(name: str, group: str) -> str:
    return f"""SELECT '{name}' AS covariate, a.grp AS grp_a, c.grp AS grp_b, round(sum(CASE WHEN a.n > 1
  THEN a.d * (a.n - a.d) / (a.n - 1) * (CASE WHEN a.grp = c.grp THEN a.n_g / a.n ELSE 0 END
    - (a.n_g / a.n) * (c.n_g / c.n)) ELSE 0 END), 6) AS covariance
FROM (WITH {logrank_sql(group)} SELECT * FROM lr) a JOIN (WITH {logrank_sql(group)} SELECT * FROM lr) c
  ON a.t = c.t GROUP BY 2, 3"""


@query("logrank_covariance", _covariance_sql("fico", cut_sql("fico", *K.BINS["fico"])) + " UNION ALL "
       + _covariance_sql("channel", "channel"), SURV)
def logrank_covariance(d: Data) -> DataFrame:
    groups = {"fico": group_column("fico"), "channel": F.col("channel")}
    return rounded(life.logrank_covariance(prepay(d), groups))


@query("logrank_rank")
def logrank_rank(d: Data) -> DataFrame:
    names = ["fico", "ltv", "dti", "orig_rate", "vintage", "loan_purpose", "channel"]
    columns = [K.TIME, K.EVENT, *K.BINS, "vintage_year", "loan_purpose", "channel"]
    loans = materialize(prepay(d).select(*columns), "logrank-rows")
    return rounded(life.rank_logrank(loans, {n: group_column(n) for n in names}))


CAUSES = {"prepaid": "prepaid", "defaulted": "defaulted", "other": "other_termination"}


@query("aalen_johansen", """WITH c0 AS (SELECT event_time_months AS t, count(*) AS removed,
  count(*) FILTER (WHERE event_type = 'prepaid') AS d1,
  count(*) FILTER (WHERE event_type = 'defaulted') AS d2,
  count(*) FILTER (WHERE event_type = 'other_termination') AS d3
  FROM fx_outcomes WHERE event_time_months IS NOT NULL GROUP BY 1),
c1 AS (SELECT * FROM c0 UNION ALL SELECT 0, 0, 0, 0, 0 FROM c0 HAVING min(t) > 0),
c2 AS (SELECT *, sum(removed) OVER (ORDER BY t DESC) AS n FROM c1),
c3 AS (SELECT *, product(1 - (d1 + d2 + d3) / n) OVER (ORDER BY t) AS s FROM c2),
c4 AS (SELECT *, lag(s, 1, 1.0) OVER (ORDER BY t) AS sb FROM c3)
SELECT CAST(t AS INT) AS t, removed, d1 AS d_prepaid, d2 AS d_defaulted, d3 AS d_other,
  CAST(n AS BIGINT) AS at_risk, round(s, 6) AS survival,
  round(sum(sb * d1 / n) OVER (ORDER BY t), 6) AS cif_prepaid,
  round(sum(sb * d2 / n) OVER (ORDER BY t), 6) AS cif_defaulted,
  round(sum(sb * d3 / n) OVER (ORDER BY t), 6) AS cif_other,
  round(1 - product(1 - d1 / n) OVER (ORDER BY t), 6) AS one_minus_km_prepaid,
  round(1 - product(1 - d2 / n) OVER (ORDER BY t), 6) AS one_minus_km_defaulted,
  round(1 - product(1 - d3 / n) OVER (ORDER BY t), 6) AS one_minus_km_other FROM c4""", OUT)
def aalen_johansen(d: Data) -> DataFrame:
    return rounded(life.aalen_johansen(d.outcomes, CAUSES))


@query("cumulative_hazard", f"""WITH {life_sql(None)} SELECT {KM_COLS},
round(sum(hazard) OVER (ORDER BY t), 6) AS cumulative_hazard FROM km""", SURV)
def cumulative_hazard(d: Data) -> DataFrame:
    return rounded(life.cumulative_hazard(prepay_outcomes(d)))
