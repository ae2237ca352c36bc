"""Values outside the usual: infinities, fractions, long codes, fits that do not end."""

import datetime
import math

import pytest
from pyspark.sql import functions as F

from loanlife.functions.cleaning import whole_number
from pyspark.ml.functions import vector_to_array

from loanlife.operators import classify, outcomes
from loanlife.operators.cox import cox_fit
from loanlife.operators.features import Preprocessor, validate_survival
from loanlife.operators.neural import StoppingRule
from loanlife.operators.ranks import exact_quantiles, medians


def test_quantiles_with_infinities_and_nan(spark):
    inf, nan = math.inf, math.nan
    df = spark.createDataFrame([(1.0, inf), (2.0, 5.0), (3.0, -inf), (inf, inf), (-inf, 7.0), (nan, nan),
                                (None, inf)], "a double, b double")
    got = exact_quantiles(df, ["a", "b"], [0.0, 0.5, 1.0])[()]
    assert got["a"] == [-inf, 2.0, inf]
    assert got["b"] == [-inf, inf, inf]
    wide = spark.createDataFrame([(-1.7e308,), (1.7e308,), (0.5,)], "a double")
    assert medians(wide, ["a"]) == {"a": 0.5}
    assert medians(df.where("a = 'NaN' or a is null"), ["a"]) == {"a": None}


def test_preprocessor_treats_nan_text_as_missing(spark):
    df = spark.createDataFrame([("1",), ("NaN",), ("3",), ("5",)], "x string")
    prep = Preprocessor.fit(df, ["x"], [])
    assert prep.fill["x"] == 3.0 and prep.mean["x"] == 3.0


def test_fractions_are_refused(spark):
    df = spark.createDataFrame([(3.0, 1), (3.7, 0)], "event_time_months double, prepay_observed int")
    with pytest.raises(Exception, match="fraction"):
        df.select(whole_number(df, "event_time_months")).collect()
    assert df.limit(1).select(whole_number(df, "event_time_months")).first()[0] == 3
    with pytest.raises(ValueError):
        validate_survival(df.withColumn("x", F.lit(1)), "event_time_months", "prepay_observed")


def test_a_fit_says_whether_it_converged(spark):
    rows = [(t, int(t % 3 > 0), float((t * 7) % 5)) for t in range(1, 40)]
    df = spark.createDataFrame(rows, "event_time_months int, prepay_observed int, x double")
    assert cox_fit(df, ["x"]).converged
    assert not cox_fit(df, ["x"], max_iter=1, tol=0.0).converged


def test_last_codes_of_a_loan(spark):
    d = datetime.date
    rows = [("a", d(2020, 1, 1), 3, "01", "0"), ("a", d(2020, 2, 1), 4, None, "RA"),
            ("a", d(2020, 2, 1), 4, None, "12"), ("b", d(2020, 1, 1), -1, None, None),
            ("b", d(2019, 12, 1), 9, "", "XX"), ("c", None, None, "9", "")]
    panel = spark.createDataFrame(
        rows, "loan_seq_num string, month date, loan_age int, zb_code string, dq_status string")
    got = {r.loan_seq_num: (r.final_zero_balance_code, r.final_delinquency_status)
           for r in outcomes.panel_summary(panel, ["month", "loan_age"]).collect()}
    assert got == {"a": ("01", "RA"), "b": ("", None), "c": ("9", "")}
    plan = outcomes.panel_summary(panel)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "Sort" not in plan
    with pytest.raises(Exception, match="three characters"):
        outcomes.panel_summary(panel.withColumn("zb_code", F.lit("long"))).collect()


def test_first_termination_takes_the_earliest_code(spark):
    rows = [("a", 202001, 5, 3), ("a", 202003, 4, 1), ("a", 202002, 9, None), ("b", 202001, 1, None)]
    panel = spark.createDataFrame(rows, "LoanSequenceNumber string, MonthlyReportingPeriod int,"
                                        " LoanAge int, ZeroBalanceCode int")
    got = {r.LoanSequenceNumber: (r.event, r.event_loan_age, r.event_reporting_period,
                                  r.duration_months) for r in
           outcomes.first_termination(panel).collect()}
    assert got == {"a": (1, 4, 202003, 4), "b": (0, None, None, 1)}
    plan = outcomes.first_termination(panel)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan


def test_stopping_rule():
    rule = StoppingRule("cindex", None, 2)
    assert rule.see(1, 5.0, 0.6) and not rule.see(2, 4.0, None) and not rule.see(3, 3.0, 0.60001)
    assert rule.exhausted(3, True) and not rule.exhausted(3, False)
    assert rule.state(3) == (3.0, 0.6, 1, 2)
    loss = StoppingRule("loss", 0.1, 1)
    assert loss.see(1, 5.0, None) and not loss.see(2, 4.95, 0.7) and loss.exhausted(2, False)
    with pytest.raises(ValueError):
        StoppingRule("auc", None, 1)


def test_stored_classifiers_score_as_before(spark, tmp_path):
    df = spark.createDataFrame([(float(i % 7), float(i % 3), int(i % 7 > 3)) for i in range(200)],
                               "a double, b double, y int")
    data, names = classify.assemble(df, ["a", "b"]), ["a", "b"]
    for k, model in enumerate((classify.fit_logistic(data, "y"),
                               classify.fit_forest(data, "y", trees=3, depth=3, min_leaf=5))):
        path = str(tmp_path / str(k))
        classify.save_model(model, path)
        again = classify.load_model(path)
        assert type(again) is type(model)
        a, b, c = (scored.select("a", "b", "p").distinct().collect() for scored in (
            classify.score(model, df, names), classify.score(again, df, names),
            model.transform(data).withColumn("p", vector_to_array("probability")[1])))
        assert sorted(a) == sorted(b)
        assert [r.p for r in sorted(a)] == pytest.approx([r.p for r in sorted(c)], abs=1e-12)
