"""Fractional durations against direct computation, with blocks so small that durations span several."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_cox import direct_fit, direct_loglik, frame, sample

from loanlife.operators.continuous import (Blocks, asof_lookup, continuous_breslow, continuous_loss,
                                           cox_fit_continuous)
from loanlife.operators.cox import cox_fit


def fractional(spark, seed=3, hot=0):
    """Rows with many distinct fractions, some ties, and ``hot`` rows of one duration."""
    x, t, e = sample(seed=seed)
    t = t + np.random.default_rng(seed).integers(0, 6, len(t)) / 8
    t[:hot] = 5.375
    names = [f"x{i}" for i in range(x.shape[1])]
    rows = [(float(a), int(b), *map(float, r)) for a, b, r in zip(t, e, x)]
    df = spark.createDataFrame(rows, "t double, e int, " + ", ".join(f"{n} double" for n in names))
    return df.repartition(4), names, x, t, e


@pytest.mark.parametrize("block_values", [6, 30, 1 << 21])
@pytest.mark.parametrize("hot", [0, 90])
def test_fit_matches_direct_optimum(spark, block_values, hot):
    df, names, x, t, e = fractional(spark, hot=hot)
    model = cox_fit_continuous(df, names, "t", "e", penalizer=0.02, block_values=block_values)
    want = direct_fit(x, t, e, 0.02)
    assert model.converged
    np.testing.assert_allclose(model.beta, want[0], rtol=1e-4, atol=1e-6)
    z = (x - x.mean(axis=0))
    assert model.loglik == pytest.approx(direct_loglik(z, t, e, model.beta), rel=1e-10)


@pytest.mark.parametrize("ties", ["efron", "breslow"])
def test_whole_months_agree_with_the_month_fit(spark, ties):
    x, t, e = sample()
    df, names = frame(spark, x, t, e)
    a = cox_fit(df, names, ties=ties)
    b = cox_fit_continuous(df, names, ties=ties, block_values=60)
    np.testing.assert_allclose(b.beta, a.beta, rtol=1e-8)
    np.testing.assert_allclose(b.covariance, a.covariance, rtol=1e-6)
    assert b.loglik_null == pytest.approx(a.loglik_null, rel=1e-10)
    for one, two in zip(b.ph_test_rows(), a.ph_test_rows()):
        assert one[0] == two[0]
        assert one[1:] == pytest.approx(two[1:], rel=1e-6)
    whole = sorted(map(tuple, a.baseline(spark).collect()))
    fractions = sorted(map(tuple, b.baseline(spark).collect()))
    np.testing.assert_allclose(fractions, whole, rtol=1e-8)
    assert b.cumulative_at(7.5) == pytest.approx(a.cumulative_at(7.5), rel=1e-8)


@pytest.mark.parametrize("ties", ["efron", "breslow"])
def test_loss_and_baseline(spark, ties):
    df, names, x, t, e = fractional(spark, hot=60)
    beta = np.array([0.4, -0.2, 0.1])
    rows = df.withColumn("eta", sum((F.col(n) * float(b) for n, b in zip(names, beta)), F.lit(0.0)))
    want = -direct_loglik(x, t, e, beta, ties == "efron") / e.sum()
    assert continuous_loss(rows, "eta", "t", "e", ties) == pytest.approx(want, rel=1e-10)
    w, total = np.exp(x @ beta), 0.0
    got = {r["time"]: r for r in continuous_breslow(rows, "eta", "t", "e").collect()}
    assert sorted(got) == sorted(set(t[e == 1]))
    for u in sorted(got):
        total += ((t == u) & (e == 1)).sum() / w[t >= u].sum()
        assert got[u]["baseline_cumulative_hazard"] == pytest.approx(total, rel=1e-9)
        assert got[u]["baseline_survival"] == pytest.approx(math.exp(-total), rel=1e-9)


def test_asof_lookup(spark):
    rng = np.random.default_rng(5)
    times = np.unique(rng.integers(1, 4000, 300) / 16)
    steps = spark.createDataFrame([(float(u), float(i + 1)) for i, u in enumerate(times)],
                                  "time double, baseline_cumulative_hazard double")
    asked = [*map(float, rng.uniform(-5, 300, 400)), *map(float, times[:40]), *[12.25] * 100,
             None, float("nan")]
    df = spark.createDataFrame([(i, h, "x") for i, h in enumerate(asked)], "id int, h double, b string")
    got = asof_lookup(df, steps, "h", out="v")
    assert got.columns == ["id", "h", "b", "v"]
    found = {r["id"]: r["v"] for r in got.collect()}
    assert len(found) == len(asked)
    for i, h in enumerate(asked):
        known = h is not None and not math.isnan(h)
        assert found[i] == (float((times <= h).sum()) if known else 0.0)
    assert {r["v"] for r in asof_lookup(df, steps.limit(0), "h", out="v", default=-1.0).collect()} == {-1.0}
    assert asof_lookup(df.limit(0), steps, "h", out="v").count() == 0
    with pytest.raises(ValueError):
        asof_lookup(df, steps, "h", out="b")


def test_missing_values_repeats_and_no_rows(spark):
    df, names, *_ = fractional(spark)
    holes = spark.createDataFrame([(None, 1, 0.0, 0.0, 0.0), (2.5, None, 0.0, 0.0, 0.0),
                                   (2.5, 1, None, 0.0, 0.0), (float("nan"), 1, 0.0, 0.0, 0.0)], df.schema)
    plain = cox_fit_continuous(df, names, "t", "e")
    np.testing.assert_allclose(
        cox_fit_continuous(df.unionByName(holes).withColumn("w", F.lit("extra")), names, "t", "e").beta,
        plain.beta, rtol=1e-9)
    twice = Blocks(df.unionByName(df), "t", "e", [F.col(n) for n in names])
    assert twice.moments()[0] == 2 * plain.n
    twice.close()
    for nothing in (df.limit(0), df.withColumn("e", F.lit(0))):
        with pytest.raises(ValueError):
            cox_fit_continuous(nothing, names, "t", "e")
        with pytest.raises(ValueError):
            continuous_loss(nothing, "x0", "t", "e")
        assert continuous_breslow(nothing, "x0", "t", "e").count() == 0
