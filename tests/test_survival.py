"""Numeric checks of curves, tests, ranks and metrics against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loanlife.operators import life, metrics, ranks
from loanlife.operators.concordance import concordance
from loanlife.operators.features import (Encoder, Imputer, Preprocessor, chrono_split,
                                         chrono_split, stratified_split)
from loanlife.operators.outcomes import first_termination, join_one_to_one, outcomes


def people(spark, n=400, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(i, int(rng.integers(0, 15)), int(rng.integers(0, 2)), "abc"[int(rng.integers(0, 3))],
             float(np.round(rng.normal(), 1))) for i in range(n)]
    return spark.createDataFrame(
        rows, "loan_seq_num int, event_time_months int, prepay_observed int, g string, r double"), rows


def test_hot_loan_and_ties_in_outcomes(spark):
    orig = spark.createDataFrame([(1, 2006, 1), (2, 2006, 1), (3, 2006, 1)],
                                 "loan_seq_num int, vintage_year int, vintage_quarter int")
    rows = [(1, "2006-01-01", m % 50, "0", None) for m in range(5000)]
    rows += [(1, "2007-01-01", 60, "XX", "01"), (1, "2007-02-01", 61, None, None),
             (2, "2006-03-01", 3, "6", "02")]
    panel = spark.createDataFrame(rows, "loan_seq_num int, month string, loan_age int, dq_status "
                                        "string, zb_code string").withColumn(
        "month", F.to_date("month"))
    got = {r["loan_seq_num"]: r for r in outcomes(orig, panel).collect()}
    assert got[1]["event_type"] == "prepaid" and got[1]["event_time_months"] == 61
    assert got[1]["final_delinquency_status"] is None
    assert got[2]["event_type"] == "defaulted"
    assert got[3]["event_type"] == "censored" and got[3]["event_time_months"] is None


def test_first_termination_takes_first_code(spark):
    panel = spark.createDataFrame(
        [("a", "200601", "1", None), ("a", "200603", "3", "03"), ("a", "200604", "4", "01"),
         ("b", "200601", "0", None)],
        "LoanSequenceNumber string, MonthlyReportingPeriod string, LoanAge string, "
        "ZeroBalanceCode string")
    got = {r[0]: r for r in first_termination(panel).collect()}
    assert (got["a"]["event"], got["a"]["duration_months"], got["a"]["zero_balance_code"]) == (0, 3, 3)
    assert (got["b"]["event"], got["b"]["duration_months"]) == (0, 0)


def test_one_to_one_refuses_duplicates(spark):
    a = spark.createDataFrame([(1, 2), (1, 3)], "k int, v int")
    with pytest.raises(ValueError):
        join_one_to_one(a, a.limit(1), "k")


def test_km_equals_one_minus_cif_with_one_cause(spark):
    df, _ = people(spark)
    df = df.withColumn("event_type", F.when(F.col("prepay_observed") == 1, "p").otherwise("c"))
    km = {r["t"]: r["survival"] for r in life.kaplan_meier(df).collect()}
    for r in life.aalen_johansen(df, {"p": "p"}).collect():
        assert abs(r["cif_p"] + r["survival"] - 1) < 1e-12
        assert abs(r["survival"] - km[r["t"]]) < 1e-12


def test_life_table_zero_row(spark):
    df = spark.createDataFrame([(5, 1), (7, 0)], "event_time_months int, prepay_observed int")
    rows = life.life_table(df).orderBy("t").collect()
    assert [(r["t"], r["removed"], r["at_risk"]) for r in rows] == [(0, 0, 2), (5, 1, 2), (7, 1, 1)]


def test_logrank_brute_force(spark):
    df, rows = people(spark)
    res = life.logrank(df, "g")
    t = np.array([r[1] for r in rows]); e = np.array([r[2] for r in rows])
    g = np.array([r[3] for r in rows])
    expected = np.zeros(3)
    cov = np.zeros((3, 3))
    for u in np.unique(t[e == 1]):
        n = np.array([((t >= u) & (g == k)).sum() for k in "abc"], float)
        d = ((t == u) & (e == 1)).sum()
        share = n / n.sum()
        expected += d * share
        if n.sum() > 1:
            cov += d * (n.sum() - d) / (n.sum() - 1) * (np.diag(share) - np.outer(share, share))
    assert np.allclose(res.expected, expected)
    z = (res.observed - expected)[:2]
    assert abs(res.chi2 - z @ np.linalg.solve(cov[:2, :2], z)) < 1e-9
    assert np.allclose(res.covariance, cov)
    assert life.logrank(df.where("g = 'a'"), "g").p_value == 1.0


def test_logrank_no_events_missing_groups_and_no_rows(spark):
    df, _ = people(spark)
    both = life.logrank_tests(df, {"g": F.col("g"), "none": F.lit(None).cast("string"),
                                   "some": F.when(F.col("g") != "b", F.col("g"))})
    assert both["none"].groups == [] and both["none"].p_value == 1.0
    assert both["some"].groups == ["a", "c"]
    alone = life.logrank(df.where("g <> 'b'"), "g")
    assert np.isclose(both["some"].chi2, alone.chi2)
    still = life.logrank(df.withColumn("prepay_observed", F.lit(0)), "g")
    assert still.chi2 == 0 and not still.expected.any()
    assert life.logrank(df.limit(0), "g").groups == []
    with pytest.raises(ValueError):
        life.logrank(df, "g", max_groups=2)


@pytest.mark.parametrize("ties", ["censored_later", "skip"])
def test_concordance_brute_force(spark, ties):
    df, rows = people(spark, 300)
    good = pairs = 0.0
    for _, t, e, _, r in rows:
        for _, t2, e2, _, r2 in rows:
            if e == 1 and (t2 > t or (ties == "censored_later" and t2 == t and e2 == 0)):
                pairs += 1
                good += 1.0 if r > r2 else 0.5 if r == r2 else 0.0
    assert abs(concordance(df, "r", ties=ties, buckets=7) - good / pairs) < 1e-12


def test_concordance_hot_score_and_no_pairs(spark):
    df, _ = people(spark)
    assert concordance(df.withColumn("r", F.lit(1.0)), "r") == 0.5
    assert np.isnan(concordance(df.withColumn("prepay_observed", F.lit(0)), "r"))


def test_exact_quantiles_with_hot_value(spark):
    rng = np.random.default_rng(0)
    v = np.concatenate([np.full(500, 3.25), rng.normal(size=700), rng.exponential(1e6, 301)])
    df = spark.createDataFrame([("ab"[i % 2], float(x)) for i, x in enumerate(v)], "g string, x double")
    probs = [0.0, 0.1, 0.5, 0.9, 1.0]
    got = ranks.exact_quantiles(df, ["x"], probs, bins=16)[()]["x"]
    assert np.allclose(got, np.quantile(v, probs), rtol=0, atol=1e-9)
    by = ranks.exact_quantiles(df, ["x"], [0.3], ["g"])
    assert np.isclose(by[("a",)]["x"][0], np.quantile(v[::2], 0.3))


def test_hash_sample_is_exact(spark):
    df, _ = people(spark, 1000)
    got = ranks.hash_sample(df, "loan_seq_num", 40, 3, ["g"]).groupBy("g").count().collect()
    assert {r["count"] for r in got} == {40}
    assert ranks.hash_sample(df, "loan_seq_num", 123, 3).count() == 123
    assert ranks.hash_sample(df, "loan_seq_num", 5000, 3).count() == 1000


def test_stratified_split_shares(spark):
    df, _ = people(spark, 1000)
    got = stratified_split(df, "loan_seq_num", "prepay_observed",
                           {"train": 0.7, "val": 0.15, "test": 0.15})
    n = {(r[0], r[1]): r[2] for r in got.groupBy("prepay_observed", "split").count().collect()}
    for e in (0, 1):
        total = sum(v for k, v in n.items() if k[0] == e)
        assert abs(n[(e, "train")] - 0.7 * total) <= 1
    lone = df.withColumn("prepay_observed", F.when(F.col("loan_seq_num") == 5, 2).otherwise(
        F.col("prepay_observed")))
    assert stratified_split(lone, "loan_seq_num", "prepay_observed", {"a": 0.5, "b": 0.5}).where(
        "split = 'a'").count() == 500


def test_period_boundaries(spark):
    def ends(counts):
        rows = spark.createDataFrame([(k,) for k, n in counts for _ in range(n)], "p int")
        got = chrono_split(rows, "p").groupBy("split").max("p").collect()
        top = {r[0]: r[1] for r in got}
        return top["train"], top["val"]
    assert ends([(1, 10), (2, 10), (3, 10)]) == (1, 2)
    assert ends([(k, 1) for k in range(100)]) == (69, 84)
    with pytest.raises(ValueError):
        ends([(1, 5), (2, 5)])
    bad = spark.createDataFrame([(1,), (None,)], "p int")
    with pytest.raises(ValueError):
        chrono_split(bad, "p")


def test_null_category_policies(spark):
    train = spark.createDataFrame([("b", 1.0), ("a", None), (None, 3.0)], "c string, x double")
    new = spark.createDataFrame([("z", None), (None, 5.0)], "c string, x double")
    assert Encoder.fit(train, ["c"]).names == ["c_b"]
    own = Encoder.fit(train, ["c"], null_text="None")
    assert own.names == ["c_a", "c_b"]
    prep = Preprocessor.fit(train, ["x", "c"])
    assert prep.names == ["x", "c___missing__", "c_a", "c_b"]
    rows = prep.transform(new, []).collect()
    assert tuple(rows[0])[1:] == (0.0, 0.0, 0.0) and tuple(rows[1])[1:] == (1.0, 0.0, 0.0)
    assert prep.dropping_references().names == ["x", "c_a", "c_b"]
    assert Preprocessor.from_rows(
        spark.createDataFrame(prep.rows(), Preprocessor.ROWS).collect()).names == prep.names
    assert Imputer.fit(train, ["x"]).fill == {"x": 2.0}


def test_constant_column_keeps_unit_scale(spark):
    df = spark.createDataFrame([(4.0,), (4.0,)], "x double")
    assert [r[0] for r in Preprocessor.fit(df, ["x"]).transform(df, []).collect()] == [0.0, 0.0]


def test_metrics_brute_force(spark):
    rng = np.random.default_rng(4)
    y = rng.integers(0, 2, 500)
    p = np.round(rng.uniform(size=500), 2)
    p[:170] = 0.4
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, p)], "y int, p double")
    row = metrics.binary_metrics(df, "y", "p").first()
    wins = [(a > b) + 0.5 * (a == b) for a in p[y == 1] for b in p[y == 0]]
    assert abs(row["auc"] - np.mean(wins)) < 1e-12
    ap, prev = 0.0, 0.0
    for s in np.unique(p)[::-1]:
        hit = p >= s
        recall = y[hit].sum() / y.sum()
        ap, prev = ap + (recall - prev) * y[hit].mean(), recall
    assert abs(row["ap"] - ap) < 1e-12
    assert abs(row["brier"] - np.mean((p - y) ** 2)) < 1e-12
    same = metrics.binary_metrics(df.withColumn("p", F.lit(0.3)), "y", "p").first()
    assert same["auc"] == 0.5


@pytest.mark.parametrize("ties", ["censored_later", "skip"])
def test_concordance_of_few_rows_needs_no_buckets(spark, monkeypatch, ties):
    from loanlife.operators import concordance as module
    rows = [(float(i * 7 % 11) / 4 if i % 13 else None, 1 + i * 5 % 9, i % 3 % 2) for i in range(150)] * 2
    df = spark.createDataFrame(rows, "r double, event_time_months int, prepay_observed int").repartition(5)
    want = concordance(df, "r", ties=ties, buckets=8)
    monkeypatch.setattr(module, "bucket_edges", lambda *a: pytest.fail("edges were looked for"))
    assert concordance(df, "r", ties=ties) == want
    assert np.isnan(concordance(df.where("r > 99"), "r", ties=ties))
