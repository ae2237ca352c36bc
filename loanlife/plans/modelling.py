"""Queries over features, splits, Cox models and scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanlife import columns as K
from loanlife.functions.cleaning import event_flag
from loanlife.operators import continuous
from loanlife.operators import coxscore as X
from loanlife.operators import features as T
from loanlife.operators.concordance import concordance_table
from loanlife.operators.cox import CoxModel, compare_models, cox_fit, cox_univariate
from loanlife.operators.life import rank_logrank
from loanlife.operators.ranks import medians
from loanlife.operators.summaries import score_summary, split_summary
from loanlife.plans.describe import group_column
from loanlife.plans.fixtures import HORIZONS, SPLIT_YEARS, Data
from loanlife.plans.registry import query, rounded
from loanlife.plans.sensitivity import sensitivity_grid
from loanlife.support import materialize, scratch_path

COX = ["fx_cox"]
NUMERIC = ["fico", "ltv", "dti", "orig_rate"]

# Given coefficients of the SQL-exact scoring queries.
BETA = {"orig_rate": 0.35, "ltv": -0.01, "dti": 0.004}
CENTRE = {"orig_rate": 5.0, "ltv": 69.0, "dti": 32.0}
ETA_SQL = " + ".join(f"{b} * (CAST({c} AS DOUBLE) - {CENTRE[c]})" for c, b in BETA.items())
SCORED = f"s AS (SELECT *, 0.0::DOUBLE + {ETA_SQL} AS eta FROM fx_cox)"


def cox_rows(d: Data) -> DataFrame:
    """Loans with a positive duration and the event flag."""
    return event_flag(d.loans, min_duration=1)


def scored_rows(d: Data) -> DataFrame:
    return cox_rows(d).withColumn("eta", X.linear_log_risk(BETA, CENTRE))


MODEL_COLUMNS = [K.ID, K.TIME, K.EVENT, *K.STATIC_FEATURES]


def stored_rows(d: Data) -> DataFrame:
    """The loans a model is fitted on, written once because fitting reads them many times."""
    return materialize(cox_rows(d).select(*MODEL_COLUMNS), "model-rows")


def stored_macro_rows(d: Data) -> DataFrame:
    rows = cox_rows(d).select(*MODEL_COLUMNS, "first_payment_date")
    rows = T.macro_features(rows, d.macro).select(*MODEL_COLUMNS, *K.MACRO_FEATURES)
    return materialize(rows, "model-macro-rows")


def modelling_rows(d: Data) -> DataFrame:
    """Static and macro features with duration, event and split tag."""
    return T.tag_splits(stored_macro_rows(d), SPLIT_YEARS)


# ---- labels and splits -----------------------------------------------------------------------

def _label_sql(h: int, source: str = "fx_cox") -> str:
    return f"""SELECT loan_seq_num, vintage_year, event_time_months, prepay_observed,
CAST(CASE WHEN prepay_observed = 1 AND event_time_months <= {h} THEN 1 ELSE 0 END AS INT)
  AS y_prepay_{h}m FROM {source}
WHERE (prepay_observed = 1 AND event_time_months <= {h}) OR event_time_months >= {h}"""


def _register_labels() -> None:
    for h in (60, 24, 12):
        @query(f"horizon_label_{h}", _label_sql(h), COX)
        def label(d: Data, h=h) -> DataFrame:
            return T.horizon_label(cox_rows(d), h).select(
                "loan_seq_num", "vintage_year", K.TIME, K.EVENT, f"y_prepay_{h}m")


_register_labels()


def _splits_sql() -> str:
    parts = []
    for name, years in SPLIT_YEARS.items():
        h = HORIZONS[name]
        parts.append(f"SELECT loan_seq_num, vintage_year, '{name}' AS split, "
                     f"y_prepay_{h}m AS label FROM ({_label_sql(h)}) "
                     f"WHERE vintage_year IN ({', '.join(map(str, years))})")
    return " UNION ALL ".join(parts)


def labelled_splits(d: Data, rows: DataFrame | None = None) -> DataFrame:
    """Every split with its own horizon label as ``label``, in one pass over the loans."""
    tagged = T.tag_splits(rows if rows is not None else cox_rows(d), SPLIT_YEARS)
    horizon = F.coalesce(*[F.when(F.col("split") == s, F.lit(h)) for s, h in HORIZONS.items()])
    hit = (F.col(K.EVENT) == 1) & (F.col(K.TIME) <= horizon)
    label = F.when(hit, 1).when(F.col(K.TIME) >= horizon, 0).cast("int")
    return tagged.withColumn("label", label).where(F.col("label").isNotNull())


@query("union_splits", _splits_sql(), COX)
def union_splits(d: Data) -> DataFrame:
    loans = cox_rows(d)
    parts = {
        name: T.horizon_label(loans.where(F.col("vintage_year").isin(*years)), HORIZONS[name],
                              out="label").select("loan_seq_num", "vintage_year", "label")
        for name, years in SPLIT_YEARS.items()}
    return T.union_splits(parts)


@query("split_summary", f"""SELECT split, vintage_year, CAST(count(label) AS BIGINT) AS n,
CAST(sum(label) AS BIGINT) AS positives, round(avg(CAST(label AS DOUBLE)), 6) AS prepay_rate
FROM ({_splits_sql()}) GROUP BY 1, 2""", COX)
def split_summary_query(d: Data) -> DataFrame:
    return rounded(split_summary(labelled_splits(d), "label"))


@query("chrono_split", """WITH c AS (SELECT first_payment_date AS m, count(*) AS n FROM fx_cox
  GROUP BY 1), k AS (SELECT m, sum(n) OVER (ORDER BY m) AS cum, sum(n) OVER () AS total,
  row_number() OVER (ORDER BY m) - 1 AS i, count(*) OVER () AS np FROM c),
a AS (SELECT least(min(i) FILTER (WHERE cum >= total * (1.0::DOUBLE - 0.15 - 0.15)), max(np) - 3)
  AS tl FROM k),
b AS (SELECT least(greatest(min(i) FILTER (WHERE cum >= total * (1.0::DOUBLE - 0.15)), max(tl) + 1),
  max(np) - 2) AS vl FROM k, a),
e AS (SELECT max(m) FILTER (WHERE i = tl + 1) AS v, max(m) FILTER (WHERE i = vl + 1) AS t
  FROM k, a, b)
SELECT loan_seq_num, first_payment_date, CASE WHEN first_payment_date < v THEN 'train'
  WHEN first_payment_date < t THEN 'val' ELSE 'test' END AS split FROM fx_cox, e""", COX)
def chrono_split(d: Data) -> DataFrame:
    rows = cox_rows(d).select("loan_seq_num", "first_payment_date")
    return T.chrono_split(rows, "first_payment_date")


@query("stratified_split", """WITH h AS (SELECT loan_seq_num, prepay_observed,
  row_number() OVER (PARTITION BY prepay_observed ORDER BY md5('42:' || CAST(loan_seq_num AS VARCHAR)))
  AS r, count(*) OVER (PARTITION BY prepay_observed) AS n FROM fx_cox)
SELECT loan_seq_num, prepay_observed, CASE WHEN r <= round(n * 0.7::DOUBLE) THEN 'train'
  WHEN r <= round(n * 0.85::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM h""", COX)
def stratified_split(d: Data) -> DataFrame:
    rows = event_flag(d.outcomes, min_duration=1).select("loan_seq_num", K.EVENT)
    rows = materialize(rows, "split-rows")
    return T.stratified_split(rows, "loan_seq_num", K.EVENT,
                              {"train": 0.7, "val": 0.15, "test": 0.15})


# ---- encoders --------------------------------------------------------------------------------

def _dummies(column: str, values: list[str], text: str | None = None) -> str:
    c = text or column
    return ", ".join(f"CAST(CASE WHEN {c} = '{v}' THEN 1 ELSE 0 END AS DOUBLE) AS \"{column}_{v}\""
                     for v in values)


@query("one_hot", f"""SELECT loan_seq_num, {_dummies('loan_purpose', ['N', 'P'])},
{_dummies('channel', ['C', 'R', 'T'])}, {_dummies('first_time_homebuyer', ['Y'])},
{_dummies('prop_type', ['CP', 'MH', 'PU', 'SF'])} FROM fx_origination""", ["fx_origination"])
def one_hot(d: Data) -> DataFrame:
    cats = ["loan_purpose", "channel", "first_time_homebuyer", "prop_type"]
    return T.one_hot(d.orig.select("loan_seq_num", *cats), cats)[0]


@query("one_hot_aligned", f"""SELECT loan_seq_num,
{_dummies('channel', ['C', 'None', 'R', 'T'], "coalesce(channel, 'None')")},
{_dummies('first_time_homebuyer', ['None', 'Y'], "coalesce(first_time_homebuyer, 'None')")},
{_dummies('occupancy', ['S'])} FROM fx_origination WHERE vintage_year >= 2000""",
       ["fx_origination"])
def one_hot_aligned(d: Data) -> DataFrame:
    cats = ["channel", "first_time_homebuyer", "occupancy"]
    rows = d.orig.select("loan_seq_num", "vintage_year", *cats)
    train = rows.where("vintage_year < 2000 AND (occupancy IS NULL OR occupancy <> 'P')")
    enc = T.Encoder.fit(train, cats, null_text="None")
    return enc.transform(rows.where("vintage_year >= 2000").drop("vintage_year"))


@query("median_impute", """WITH m AS (SELECT median(CAST(fico AS DOUBLE)) AS f,
  median(CAST(mi_pct AS DOUBLE)) AS p FROM fx_origination WHERE vintage_year < 2000)
SELECT loan_seq_num, coalesce(CAST(fico AS DOUBLE), f) AS fico,
  coalesce(CAST(mi_pct AS DOUBLE), p) AS mi_pct, CAST(ltv AS DOUBLE) AS ltv
FROM fx_origination, m WHERE vintage_year >= 2000""", ["fx_origination"])
def median_impute(d: Data) -> DataFrame:
    rows = d.orig.select("loan_seq_num", "vintage_year", "fico", "mi_pct", "ltv")
    imp = T.Imputer.fit(rows.where("vintage_year < 2000"), ["fico", "mi_pct", "ltv"])
    return imp.transform(rows.where("vintage_year >= 2000")).drop("vintage_year")


@query("exact_medians", """SELECT median(CAST(fico AS DOUBLE)) AS fico, median(orig_upb) AS orig_upb,
median(orig_rate) AS orig_rate FROM fx_origination""", ["fx_origination"])
def exact_medians(d: Data) -> DataFrame:
    names = ["fico", "orig_upb", "orig_rate"]
    got = medians(d.orig, names)
    return d.spark.createDataFrame([tuple(got[c] for c in names)],
                                   ", ".join(f"{c} double" for c in names))


PREP_NUM = ["fico", "mi_pct", "orig_upb"]
PREP_SQL = ", ".join(f"round((coalesce(CAST(t.{c} AS DOUBLE), m.{c}) - z.m_{c}) / z.s_{c}, 6) AS {c}"
                     for c in PREP_NUM)


@query("preprocess_matrix", f"""WITH tr AS (SELECT * FROM fx_cox WHERE vintage_year < 2000),
m AS (SELECT {', '.join(f'median(CAST({c} AS DOUBLE)) AS {c}' for c in PREP_NUM)} FROM tr),
z AS (SELECT {', '.join(f'avg(coalesce(CAST(tr.{c} AS DOUBLE), m.{c})) AS m_{c}, stddev_pop(coalesce(CAST(tr.{c} AS DOUBLE), m.{c})) AS s_{c}' for c in PREP_NUM)} FROM tr, m)
SELECT t.loan_seq_num, {PREP_SQL},
{_dummies('channel', ['B', 'C', 'R', 'T', '__missing__'], "coalesce(t.channel, '__missing__')")},
{_dummies('loan_purpose', ['C', 'N', 'P'], 't.loan_purpose')}
FROM fx_cox t, m, z WHERE t.vintage_year >= 2000""", COX)
def preprocess_matrix(d: Data) -> DataFrame:
    rows = stored_rows(d)
    prep = T.Preprocessor.fit(rows.where("vintage_year < 2000"),
                              [*PREP_NUM, "channel", "loan_purpose"])
    return rounded(prep.transform(rows.where("vintage_year >= 2000"), ["loan_seq_num"]))


@query("dataset_overview", """SELECT CAST(count(*) AS BIGINT) AS n,
round(avg(CAST(prepay_observed AS DOUBLE)), 6) AS event_mean, min(event_time_months) AS min_time,
max(event_time_months) AS max_time FROM fx_cox""", COX)
def dataset_overview(d: Data) -> DataFrame:
    from loanlife.operators.summaries import dataset_overview as overview
    return rounded(overview(cox_rows(d), K.TIME, K.EVENT))


# ---- scoring with given coefficients ---------------------------------------------------------

RISK_SQL = f"""{SCORED},
g AS (SELECT event_time_months AS t, sum(exp(eta)) AS w, sum(exp(eta) * prepay_observed) AS we,
  sum(eta * prepay_observed) AS se, sum(prepay_observed) AS d FROM s GROUP BY 1),
r AS (SELECT *, sum(w) OVER (ORDER BY t DESC) AS s0 FROM g)"""
BASE_SQL = f"""{RISK_SQL},
bl AS (SELECT t, d / s0 AS h, sum(d / s0) OVER (ORDER BY t) AS ch FROM r WHERE d > 0)"""


@query("linear_log_risk", f"WITH {SCORED} SELECT loan_seq_num, round(eta, 6) AS log_risk FROM s",
       COX)
def linear_log_risk(d: Data) -> DataFrame:
    return rounded(scored_rows(d).select("loan_seq_num", F.col("eta").alias("log_risk")))


@query("breslow_baseline", f"""WITH {BASE_SQL} SELECT CAST(t AS INT) AS time,
round(h, 6) AS baseline_hazard, round(ch, 6) AS baseline_cumulative_hazard,
round(exp(-ch), 6) AS baseline_survival FROM bl""", COX)
def breslow_baseline(d: Data) -> DataFrame:
    return rounded(X.breslow(scored_rows(d), "eta"))


@query("prob_at_horizon", f"""WITH {BASE_SQL}, h AS (SELECT coalesce(max(ch) FILTER (WHERE t <= 24), 0)
AS c FROM bl) SELECT loan_seq_num, round(1 - exp(-c * exp(eta)), 6) AS prob FROM s, h""", COX)
def prob_at_horizon(d: Data) -> DataFrame:
    rows = scored_rows(d)
    return rounded(X.prob_at_horizon(rows, X.breslow(rows, "eta"), "eta", 24).select(
        "loan_seq_num", "prob"))


@query("asof_cumhaz", f"""WITH {BASE_SQL} SELECT s.loan_seq_num,
round(coalesce(max(bl.ch), 0), 6) AS cumhaz_at_exit FROM s
LEFT JOIN bl ON bl.t <= s.event_time_months GROUP BY 1""", COX)
def asof_cumhaz(d: Data) -> DataFrame:
    rows = scored_rows(d)
    got = X.step_lookup(rows.select("loan_seq_num", K.TIME), X.breslow(rows, "eta"), K.TIME,
                        out="cumhaz_at_exit")
    return rounded(got.select("loan_seq_num", "cumhaz_at_exit"))


@query("survival_curves", f"""WITH {BASE_SQL} SELECT s.loan_seq_num, CAST(bl.t AS INT) AS time,
round(exp(-bl.ch * exp(s.eta)), 6) AS survival FROM s, bl
WHERE s.loan_seq_num IN (1, 7, 20, 33, 601)""", COX)
def survival_curves(d: Data) -> DataFrame:
    rows = scored_rows(d)
    return rounded(X.survival_curves(rows, X.breslow(rows, "eta"), [1, 7, 20, 33, 601],
                                     "loan_seq_num", "eta"))


def _loss(d: Data, ties: str) -> DataFrame:
    return rounded(d.spark.createDataFrame([(X.cox_loss(scored_rows(d), "eta", ties=ties),)],
                                           "loss double"))


@query("cox_loss_breslow", f"""WITH {RISK_SQL}
SELECT round(-sum(CASE WHEN d > 0 THEN se - d * ln(s0) ELSE 0 END) / sum(d), 6) AS loss FROM r""",
       COX)
def cox_loss_breslow(d: Data) -> DataFrame:
    return _loss(d, "breslow")


@query("cox_loss_efron", f"""WITH {RISK_SQL},
l AS (SELECT t, sum(ln(s0 - k / d * we)) AS lg
  FROM (SELECT t, s0, we, d, unnest(range(CAST(d AS BIGINT))) AS k FROM r WHERE d > 0) GROUP BY 1)
SELECT round(-sum(r.se - l.lg) / sum(r.d), 6) AS loss FROM r JOIN l ON l.t = r.t""", COX)
def cox_loss_efron(d: Data) -> DataFrame:
    return _loss(d, "efron")


@query("concordance_index", f"""WITH {SCORED},
q AS (SELECT event_time_months AS t, prepay_observed AS e, round(eta, 2) AS r, count(*) AS n
  FROM s GROUP BY 1, 2, 3),
p AS (SELECT a.n * b.n AS n, CASE WHEN a.r > b.r THEN 1.0 WHEN a.r = b.r THEN 0.5 ELSE 0 END AS c,
  b.t > a.t AS strict FROM q a JOIN q b ON a.e = 1 AND (b.t > a.t OR (b.t = a.t AND b.e = 0)))
SELECT 'censored_later' AS rule, round(CAST(sum(n * c) / sum(n) AS DOUBLE), 6) AS c_index FROM p
UNION ALL SELECT 'skip', round(CAST(sum(n * c) / sum(n) AS DOUBLE), 6) FROM p WHERE strict""", COX)
def concordance_index(d: Data) -> DataFrame:
    from loanlife.operators.concordance import concordance
    rows = materialize(scored_rows(d).select(K.TIME, K.EVENT, F.round("eta", 2).alias("eta")),
                       "scored")
    out = [(rule, concordance(rows, "eta", ties=rule)) for rule in ("censored_later", "skip")]
    return rounded(d.spark.createDataFrame(out, "rule string, c_index double"))


@query("score_summary", f"""WITH {BASE_SQL}, h AS (SELECT max(ch) FILTER (WHERE t <= 24) AS c
FROM bl), p AS (SELECT 1 - exp(-c * exp(eta)) AS prob FROM s, h)
SELECT CAST(count(*) AS BIGINT) AS n, round(avg(prob), 6) AS mean,
round(quantile_cont(prob, 0.1), 6) AS p10, round(quantile_cont(prob, 0.5), 6) AS p50,
round(quantile_cont(prob, 0.9), 6) AS p90 FROM p""", COX)
def score_summary_query(d: Data) -> DataFrame:
    rows = materialize(scored_rows(d).select(K.TIME, K.EVENT, "eta"), "scored")
    return rounded(score_summary(X.prob_at_horizon(rows, X.breslow(rows, "eta"), "eta", 24),
                                 "prob"))


# ---- fitted Cox models -----------------------------------------------------------------------

def newton_sql(column: str, steps: int = 7) -> str:
    """CTE chain of one-covariate Efron Newton steps; ends in ``f<column>`` (beta, ll, ll0)."""
    c = column
    out = [f"x{c} AS (SELECT event_time_months AS t, CAST(prepay_observed AS DOUBLE) AS e, "
           f"(CAST({c} AS DOUBLE) - (SELECT avg(CAST({c} AS DOUBLE)) FROM fx_cox)) / "
           f"(SELECT stddev_samp(CAST({c} AS DOUBLE)) FROM fx_cox) AS x FROM fx_cox "
           f"WHERE {c} IS NOT NULL)", f"b{c}0 AS (SELECT 0.0::DOUBLE AS beta)"]
    for i in range(steps):
        out += [
            f"g{c}{i} AS (SELECT t, sum(w) AS w, sum(w*x) AS wx, sum(w*x*x) AS wxx, "
            f"sum(w*e) AS v, sum(w*x*e) AS vx, sum(w*x*x*e) AS vxx, sum(e) AS d, sum(x*e) AS u, "
            f"sum(beta*x*e) AS eb FROM (SELECT t, e, x, beta, exp(beta * x) AS w "
            f"FROM x{c}, b{c}{i}) GROUP BY 1)",
            f"r{c}{i} AS (SELECT *, sum(w) OVER o AS s0, sum(wx) OVER o AS s1, "
            f"sum(wxx) OVER o AS s2 FROM g{c}{i} WINDOW o AS (ORDER BY t DESC))",
            f"k{c}{i} AS (SELECT t, u, d, eb, s0, s1, s2, v, vx, vxx, "
            f"unnest(range(CAST(d AS BIGINT))) / d AS q FROM r{c}{i} WHERE d > 0)",
            f"z{c}{i} AS (SELECT sum((s1 - q*vx) / (s0 - q*v)) AS ez, "
            f"sum((s2 - q*vxx) / (s0 - q*v) - ((s1 - q*vx) / (s0 - q*v)) ** 2) AS info, "
            f"sum(ln(s0 - q*v)) AS lg FROM k{c}{i})",
            f"b{c}{i + 1} AS (SELECT b.beta + ((SELECT sum(u) FROM g{c}{i}) - z.ez) / z.info "
            f"AS beta, (SELECT sum(eb) FROM g{c}{i}) - z.lg AS ll FROM b{c}{i} b, z{c}{i} z)",
        ]
    out.append(f"f{c} AS (SELECT '{c}' AS covariate, (SELECT count(*) FROM x{c}) AS n, "
               f"b.beta / (SELECT stddev_samp(CAST({c} AS DOUBLE)) FROM fx_cox) AS coef, "
               f"2 * (b.ll - (SELECT ll FROM b{c}1)) AS chi2 FROM b{c}{steps} b)")
    return ", ".join(out)


UNI_SQL = "WITH " + ", ".join(newton_sql(c) for c in NUMERIC) + " " + " UNION ALL ".join(
    f"SELECT covariate, CAST(n AS BIGINT) AS n, round(coef, 6) AS coef, "
    f"round(exp(coef), 6) AS hazard_ratio, round(chi2, 3) AS cox_lr_chi2 FROM f{c}"
    for c in NUMERIC)


@query("cox_univariate_rank", UNI_SQL, COX)
def cox_univariate_rank(d: Data) -> DataFrame:
    fits = cox_univariate(cox_rows(d), NUMERIC)
    out = d.spark.createDataFrame(
        [(f["covariate"], f["n"], f["coef"], f["hazard_ratio"], f["cox_lr_chi2"]) for f in fits],
        "covariate string, n bigint, coef double, hazard_ratio double, cox_lr_chi2 double")
    out = rounded(out).withColumn("cox_lr_chi2", F.round("cox_lr_chi2", 3))
    return out.orderBy(F.desc("cox_lr_chi2"))


@query("cox_vs_logrank")
def cox_vs_logrank(d: Data) -> DataFrame:
    """Bin-free likelihood-ratio statistic beside the binned log-rank one."""
    loans = stored_rows(d)
    fits = cox_univariate(loans, NUMERIC)
    ranked = rank_logrank(loans, {c: group_column(c) for c in NUMERIC})
    mine = d.spark.createDataFrame([(f["covariate"], f["cox_lr_chi2"]) for f in fits],
                                   "covariate string, cox_lr_chi2 double")
    return rounded(mine.join(ranked.select("covariate", F.col("chi2").alias("logrank_chi2")),
                             "covariate"))


# Newton steps in SQL need a closed form of the matrix inverse; two covariates have one.
PAIR = ["orig_rate", "ltv"]


def pair_steps(penalizer: float = 0.01, steps: int = 7) -> str:
    """CTE chain of Newton steps; ``b7`` holds the coefficients, ``r6`` and ``k6`` the last sums."""
    a, b = PAIR
    z = lambda c: (f"(CAST({c} AS DOUBLE) - (SELECT avg(CAST({c} AS DOUBLE)) FROM fx_cox)) / "
                   f"(SELECT stddev_samp(CAST({c} AS DOUBLE)) FROM fx_cox)")
    out = [f"x AS (SELECT event_time_months AS t, CAST(prepay_observed AS DOUBLE) AS e, "
           f"{z(a)} AS x, {z(b)} AS y FROM fx_cox)",
           f"p AS (SELECT count(*) * {penalizer}::DOUBLE AS r FROM fx_cox)",
           "b0 AS (SELECT 0.0::DOUBLE AS b1, 0.0::DOUBLE AS b2, 0.0::DOUBLE AS i11, "
           "0.0::DOUBLE AS i12, 0.0::DOUBLE AS i22)"]
    terms = {"w": "1", "wx": "x", "wy": "y", "wxx": "x*x", "wxy": "x*y", "wyy": "y*y"}
    for i in range(steps):
        sums = ", ".join(f"sum(w*({v})) AS {k}, sum(w*e*({v})) AS e{k}" for k, v in terms.items())
        suffix = ", ".join(f"sum({k}) OVER o AS s{k}" for k in terms)
        f = {k: f"(s{k} - q*e{k})" for k in terms}
        out += [
            f"g{i} AS (SELECT t, {sums}, sum(e) AS d, sum(x*e) AS ux, sum(y*e) AS uy FROM "
            f"(SELECT x.*, exp(b1*x + b2*y) AS w FROM x, b{i}) GROUP BY 1)",
            f"r{i} AS (SELECT *, {suffix} FROM g{i} WINDOW o AS (ORDER BY t DESC))",
            f"k{i} AS (SELECT *, unnest(range(CAST(d AS BIGINT))) / d AS q FROM r{i} WHERE d > 0)",
            f"z{i} AS (SELECT sum({f['wx']}/{f['w']}) AS zx, sum({f['wy']}/{f['w']}) AS zy, "
            f"sum({f['wxx']}/{f['w']} - ({f['wx']}/{f['w']})**2) AS a11, "
            f"sum({f['wxy']}/{f['w']} - {f['wx']}*{f['wy']}/{f['w']}**2) AS a12, "
            f"sum({f['wyy']}/{f['w']} - ({f['wy']}/{f['w']})**2) AS a22 FROM k{i})",
            f"n{i} AS (SELECT b1, b2, (SELECT sum(ux) FROM g{i}) - zx - r*b1 AS u1, "
            f"(SELECT sum(uy) FROM g{i}) - zy - r*b2 AS u2, a11 + r AS i11, a12 AS i12, "
            f"a22 + r AS i22 FROM z{i}, p, b{i})",
            f"b{i + 1} AS (SELECT b1 + (i22*u1 - i12*u2)/(i11*i22 - i12*i12) AS b1, "
            f"b2 + (i11*u2 - i12*u1)/(i11*i22 - i12*i12) AS b2, i11, i12, i22 FROM n{i})"]
    return "WITH " + ", ".join(out)


def pair_sql(penalizer: float = 0.01, steps: int = 7) -> str:
    a, b = PAIR
    sd = lambda c: f"(SELECT stddev_samp(CAST({c} AS DOUBLE)) FROM fx_cox)"
    last = f"b{steps}"
    return pair_steps(penalizer, steps) + (
        f" SELECT '{a}' AS feature, round(b1/{sd(a)}, 6) AS coef, round(exp(b1/{sd(a)}), 6) AS "
        f"hazard_ratio, round(sqrt(i22/(i11*i22 - i12*i12))/{sd(a)}, 6) AS se FROM {last} "
        f"UNION ALL SELECT '{b}', round(b2/{sd(b)}, 6), round(exp(b2/{sd(b)}), 6), "
        f"round(sqrt(i11/(i11*i22 - i12*i12))/{sd(b)}, 6) FROM {last}")


# Scaled residuals against the mean rank of the event time; the scale of a feature cancels out.
PAIR_PH_SQL = pair_steps() + f""", res AS (SELECT t, max(d) AS d,
  max(ux) - sum((swx - q*ewx)/(sw - q*ew)) AS rx, max(uy) - sum((swy - q*ewy)/(sw - q*ew)) AS ry
  FROM k6 GROUP BY t),
rk AS (SELECT *, sum(d) OVER (ORDER BY t) - (d - 1) / 2 AS rank FROM res),
m AS (SELECT sum(rank * d) / sum(d) AS mid, sum(d) AS n FROM rk),
v AS (SELECT i22/(i11*i22 - i12*i12) AS v11, -i12/(i11*i22 - i12*i12) AS v12,
  i11/(i11*i22 - i12*i12) AS v22 FROM b7),
ph AS (SELECT sum((rank - mid) * n * (rx*v11 + ry*v12)) AS sx,
  sum((rank - mid) * n * (rx*v12 + ry*v22)) AS sy, sum(d * (rank - mid)**2) AS spread, max(n) AS n
  FROM rk, m, v)
SELECT '{PAIR[0]}' AS feature, round(sx*sx / (n*v11*spread), 4) AS test_statistic FROM ph, v
UNION ALL SELECT '{PAIR[1]}', round(sy*sy / (n*v22*spread), 4) FROM ph, v"""
PAIR_BASE_SQL = pair_steps() + """ SELECT t AS time, round(d / sw, 6) AS baseline_hazard,
round(sum(d / sw) OVER (ORDER BY t), 6) AS baseline_cumulative_hazard,
round(exp(-sum(d / sw) OVER (ORDER BY t)), 6) AS baseline_survival FROM r6 WHERE d > 0"""


def _ph_rows(d: Data, model: CoxModel) -> DataFrame:
    return rounded(model.ph_test(d.spark).select("feature", "test_statistic"), 4)


@query("schoenfeld_pair", PAIR_PH_SQL, COX)
def schoenfeld_pair(d: Data) -> DataFrame:
    return _ph_rows(d, cox_fit(cox_rows(d).select(K.TIME, K.EVENT, *PAIR), PAIR))


@query("cox_baseline_pair", PAIR_BASE_SQL.replace("t AS time", "CAST(t AS INT) AS time"), COX)
def cox_baseline_pair(d: Data) -> DataFrame:
    return rounded(cox_fit(cox_rows(d).select(K.TIME, K.EVENT, *PAIR), PAIR).baseline(d.spark))


@query("cox_fit_pair", pair_sql(), COX)
def cox_fit_pair(d: Data) -> DataFrame:
    model = cox_fit(cox_rows(d).select(K.TIME, K.EVENT, *PAIR), PAIR)
    return rounded(model.summary(d.spark).select("feature", "coef", "hazard_ratio", "se"))


# ---- fractional durations --------------------------------------------------------------------

# Exits inside a month; exact in binary, so that ties are the same everywhere.
FRACTION_SQL = "(event_time_months + (loan_seq_num % 64) / 64.0::DOUBLE)"
FRACTION_BASE_SQL = BASE_SQL.replace("event_time_months", FRACTION_SQL)


def fractional_rows(d: Data) -> DataFrame:
    return scored_rows(d).withColumn("exit", F.col(K.TIME) + F.pmod("loan_seq_num", F.lit(64)) / 64.0)


@query("cox_fit_fractional", pair_sql().replace("event_time_months", FRACTION_SQL), COX)
def cox_fit_fractional(d: Data) -> DataFrame:
    model = continuous.cox_fit_continuous(fractional_rows(d), PAIR, "exit", K.EVENT)
    return rounded(model.summary(d.spark).select("feature", "coef", "hazard_ratio", "se"))


@query("schoenfeld_fractional", PAIR_PH_SQL.replace("event_time_months", FRACTION_SQL), COX)
def schoenfeld_fractional(d: Data) -> DataFrame:
    return _ph_rows(d, continuous.cox_fit_continuous(fractional_rows(d), PAIR, "exit", K.EVENT))


@query("cox_loss_fractional", f"""WITH {FRACTION_BASE_SQL},
l AS (SELECT t, sum(ln(s0 - k / d * we)) AS lg
  FROM (SELECT t, s0, we, d, unnest(range(CAST(d AS BIGINT))) AS k FROM r WHERE d > 0) GROUP BY 1)
SELECT 'efron' AS ties, round(-sum(r.se - l.lg) / sum(r.d), 6) AS loss FROM r JOIN l ON l.t = r.t
UNION ALL
SELECT 'breslow', round(-sum(CASE WHEN d > 0 THEN se - d * ln(s0) ELSE 0 END) / sum(d), 6) FROM r""", COX)
def cox_loss_fractional(d: Data) -> DataFrame:
    rows = materialize(fractional_rows(d).select("exit", K.EVENT, "eta"), "fraction-rows")
    return rounded(d.spark.createDataFrame(
        [(ties, continuous.continuous_loss(rows, "eta", "exit", ties=ties))
         for ties in ("efron", "breslow")], "ties string, loss double"))


@query("breslow_fractional", f"""WITH {FRACTION_BASE_SQL} SELECT t AS time, round(h, 6) AS baseline_hazard,
round(ch, 6) AS baseline_cumulative_hazard, round(exp(-ch), 6) AS baseline_survival FROM bl""", COX)
def breslow_fractional(d: Data) -> DataFrame:
    return rounded(continuous.continuous_breslow(fractional_rows(d), "eta", "exit"))


@query("asof_fractional", f"""WITH {FRACTION_BASE_SQL},
q AS (SELECT loan_seq_num, eta, event_time_months * 0.75::DOUBLE + (loan_seq_num % 7) / 8.0::DOUBLE AS horizon
  FROM s)
SELECT q.loan_seq_num, q.horizon, round(coalesce(bl.ch, 0), 6) AS cumhaz,
  round(1 - exp(-coalesce(bl.ch, 0) * exp(q.eta)), 6) AS prob
FROM q ASOF LEFT JOIN bl ON q.horizon >= bl.t""", COX)
def asof_fractional(d: Data) -> DataFrame:
    """Event probability of each loan at a horizon of its own, between the steps of the baseline."""
    rows = fractional_rows(d)
    steps = continuous.continuous_breslow(rows, "eta", "exit")
    asked = rows.select("loan_seq_num", "eta", (
        F.col(K.TIME) * 0.75 + F.pmod("loan_seq_num", F.lit(7)) / 8.0).alias("horizon"))
    got = continuous.asof_lookup(asked, steps, "horizon", out="cumhaz")
    return rounded(got.select("loan_seq_num", "horizon", "cumhaz", (
        1 - F.exp(-F.col("cumhaz") * F.exp("eta"))).alias("prob")))


STATIC = list(K.STATIC_FEATURES)


def static_design(d: Data, stored: DataFrame | None = None) -> tuple[DataFrame, list[str]]:
    """Complete static rows with indicators for the categories; ``stored`` rows may hold more columns."""
    cats = [c for c in K.CATEGORICAL_FEATURES if c in STATIC]
    rows = (stored_rows(d) if stored is None else stored).select(K.ID, K.TIME, K.EVENT, *STATIC)
    encoded, names = T.one_hot(rows, cats)
    features = [c for c in STATIC if c not in cats] + names
    return materialize(encoded.dropna(subset=features), "design"), features


def macro_design(d: Data, stored: DataFrame | None = None) -> tuple[DataFrame, list[str]]:
    cats = [c for c in K.CATEGORICAL_FEATURES if c in STATIC]
    rows = stored_macro_rows(d) if stored is None else stored
    encoded, names = T.one_hot(rows, cats)
    features = [c for c in STATIC if c not in cats] + names + K.MACRO_FEATURES
    return materialize(encoded.dropna(subset=features), "design"), features


@query("cox_fit_coefs")
def cox_fit_coefs(d: Data) -> DataFrame:
    rows, features = static_design(d)
    model = cox_fit(rows, features)
    return rounded(model.summary(d.spark).select("feature", "mean", "sd", "coef", "se"))


@query("cox_summary")
def cox_summary(d: Data) -> DataFrame:
    rows, features = macro_design(d)
    return rounded(cox_fit(rows, features).summary(d.spark))


@query("schoenfeld_test")
def schoenfeld_test(d: Data) -> DataFrame:
    rows, features = static_design(d)
    return rounded(cox_fit(rows, features).ph_test(d.spark))


@query("cox_baseline")
def cox_baseline(d: Data) -> DataFrame:
    rows, features = static_design(d)
    return rounded(cox_fit(rows, features).baseline(d.spark))


@query("score_from_saved")
def score_from_saved(d: Data) -> DataFrame:
    """Fit on the early vintages, store, load again and score the late ones at three horizons."""
    rows = stored_rows(d)
    train = rows.where("vintage_year < 2000")
    prep = T.Preprocessor.fit(train, STATIC).dropping_references()
    model = cox_fit(train, dict(prep.items()))
    path = scratch_path(d.spark, "cox")
    model.save(d.spark, path)
    d.spark.createDataFrame(prep.rows(), T.Preprocessor.ROWS).coalesce(1).write.parquet(
        f"{path}/prep")
    loaded = CoxModel.load(d.spark, path)
    again = T.Preprocessor.from_rows(d.spark.read.parquet(f"{path}/prep").collect())
    risk = loaded.log_risk(dict(again.items()))
    late = rows.where("vintage_year >= 2000")
    return rounded(late.select("loan_seq_num", *[
        loaded.prob_at(h, risk).alias(f"cox_prob_prepay_{h}mo") for h in (60, 24, 12)]))


@query("model_comparison")
def model_comparison(d: Data) -> DataFrame:
    stored = stored_macro_rows(d)        # the loans of both models, joined and written once
    static_rows, static_names = static_design(d, stored)
    macro_rows, macro_names = macro_design(d, stored)
    return rounded(compare_models(d.spark, {
        "static": cox_fit(static_rows, static_names), "macro": cox_fit(macro_rows, macro_names)}))


# Sample sizes of the grid; two long, overlapping windows, early and late.
SAMPLES = [None, 200_000, 500_000, 2_000_000]
WINDOWS = {"all": None, "1995-1999": list(range(1995, 2000)), "1997-2001": list(range(1997, 2002))}


@query("sensitivity_grid")
def sensitivity(d: Data) -> DataFrame:
    """Static and macro models over penalties, sample sizes and vintage windows."""
    stored = stored_macro_rows(d)        # the loans of both models, joined and written once
    static_rows, static_names = static_design(d, stored)
    macro_rows, macro_names = macro_design(d, stored)
    return rounded(sensitivity_grid(
        {"static": static_rows, "macro": macro_rows},
        {"static": static_names, "macro": macro_names}, samples=SAMPLES, windows=WINDOWS))


@query("concordance_models")
def concordance_models(d: Data) -> DataFrame:
    """Index of a one-covariate and a static fit on the early and the late vintages."""
    rows, features = static_design(d)
    train = rows.where("vintage_year < 2000")
    fits = {"rate": cox_fit(train, ["orig_rate"]), "static": cox_fit(train, features)}
    scored = rows.withColumns({f"r_{n}": m.log_risk() for n, m in fits.items()})
    parts = {"train": "vintage_year < 2000", "test": "vintage_year >= 2000"}
    tables = [concordance_table(scored.where(w), {n: f"r_{n}" for n in fits}).withColumn(
        "split", F.lit(s)) for s, w in parts.items()]
    return rounded(tables[0].unionByName(tables[1]))
