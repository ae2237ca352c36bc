"""Cox and neural Cox against direct computation on small tied data."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loanlife.operators import coxscore as X
from loanlife.operators.cox import CoxModel, cox_fit, cox_univariate, tie_sums
from loanlife.operators.cox import Design
from loanlife.operators import resident
from loanlife.operators.resident import ResidentRows
from loanlife.operators.neural import MlpWeights, Trainer, mlp_cox_fit, mlp_log_risk, row_key


def sample(n=240, p=3, seed=7):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, p)), 3)
    t = np.clip(np.round(rng.exponential(np.exp(-0.5 * x[:, 0] + 0.2 * x[:, 1])) * 8), 1, 20)
    e = (rng.uniform(size=n) < 0.7).astype(int)
    return x, t.astype(int), e


def frame(spark, x, t, e):
    names = [f"x{i}" for i in range(x.shape[1])]
    rows = [(i, int(a), int(b), *map(float, r)) for i, (a, b, r) in enumerate(zip(t, e, x))]
    schema = "loan_seq_num int, event_time_months int, prepay_observed int, " + ", ".join(
        f"{n} double" for n in names)
    return spark.createDataFrame(rows, schema).repartition(4), names


def direct_loglik(x, t, e, beta, efron=True):
    eta = x @ beta
    w = np.exp(eta)
    total = 0.0
    for u in np.unique(t[e == 1]):
        dead = (t == u) & (e == 1)
        d = dead.sum()
        s0, t0 = w[t >= u].sum(), w[dead].sum()
        total += eta[dead].sum() - sum(
            math.log(s0 - (k / d * t0 if efron else 0.0)) for k in range(d))
    return total


def direct_fit(x, t, e, penalizer, efron=True):
    sd = x.std(axis=0, ddof=1)
    z = (x - x.mean(axis=0)) / sd
    n, p = z.shape

    def f(b):
        return direct_loglik(z, t, e, b, efron) - n * penalizer / 2 * b @ b

    def hessian(b, h=1e-4):
        out = np.zeros((p, p))
        for i in range(p):
            for j in range(p):
                a = np.eye(p)[i] * h
                c = np.eye(p)[j] * h
                out[i, j] = (f(b + a + c) - f(b + a - c) - f(b - a + c) + f(b - a - c)) / (4 * h * h)
        return out

    b = np.zeros(p)
    for _ in range(12):
        g = np.array([(f(b + d) - f(b - d)) / 2e-5 for d in np.eye(p) * 1e-5])
        b = b - np.linalg.solve(hessian(b), g)
    return b / sd, np.sqrt(np.diag(np.linalg.inv(-hessian(b)))) / sd


@pytest.mark.parametrize("ties", ["efron", "breslow"])
def test_fit_matches_direct_optimum(spark, ties):
    x, t, e = sample()
    df, names = frame(spark, x, t, e)
    model = cox_fit(df, names, penalizer=0.01, ties=ties)
    beta, se = direct_fit(x, t, e, 0.01, ties == "efron")
    assert np.allclose(model.beta, beta, atol=1e-5)
    assert np.allclose(model.se, se, rtol=1e-3)
    assert abs(model.loglik_null - direct_loglik(x, t, e, np.zeros(3), ties == "efron")) < 1e-8
    assert np.allclose(model.residuals.sum(axis=0),
                       model.n * 0.01 * model.beta * model.sd ** 2, atol=1e-3)


def test_schoenfeld_matches_direct(spark):
    x, t, e = sample()
    df, names = frame(spark, x, t, e)
    model = cox_fit(df, names, penalizer=0.0, ties="breslow")
    order = np.argsort(t[e == 1], kind="stable")
    xe, te = x[e == 1][order], t[e == 1][order]
    w = np.exp(x @ model.beta)
    resid = np.array([xi - (w[t >= u, None] * x[t >= u]).sum(0) / w[t >= u].sum()
                      for xi, u in zip(xe, te)])
    pos = np.arange(1, len(te) + 1)
    rank = np.array([pos[te == u].mean() for u in te])
    g = rank - rank.mean()
    scaled = len(te) * resid @ model.covariance
    stat = (g @ scaled) ** 2 / (len(te) * np.diag(model.covariance) * (g ** 2).sum())
    assert np.allclose([r[1] for r in model.ph_test_rows()], stat, rtol=1e-6)


def test_univariate_equals_single_fits(spark):
    x, t, e = sample()
    df, names = frame(spark, x, t, e)
    df = df.withColumn("x1", F.when(F.col("loan_seq_num") % 10 != 0, F.col("x1")))
    for got in cox_univariate(df, names):
        one = cox_fit(df.where(F.col(got["covariate"]).isNotNull()), [got["covariate"]], penalizer=0.0)
        assert abs(got["coef"] - one.beta[0]) < 1e-6
        assert abs(got["cox_lr_chi2"] - 2 * (one.loglik - one.loglik_null)) < 1e-6


def test_long_ties_match_the_plain_sum():
    for s0, t0, d in [(5e4, 3e4, 20_000), (2.0001e4, 2e4, 20_000), (9e9, 1e4, 15_000)]:
        u = np.arange(d) / d
        phi = s0 - u * t0
        plain = [np.log(phi).sum(), (1 / phi).sum(), (u / phi).sum(), (phi ** -2.0).sum(),
                 (u * phi ** -2.0).sum(), (u * u * phi ** -2.0).sum()]
        assert np.allclose(tie_sums(s0, t0, d, True), plain, rtol=1e-7)


def test_no_events_and_bad_options(spark):
    x, t, e = sample(40)
    df, names = frame(spark, x, t, 0 * e)
    with pytest.raises(ValueError):
        cox_fit(df, names)
    with pytest.raises(ValueError):
        X.cox_loss(df.withColumn("eta", F.lit(0.0)), "eta")
    with pytest.raises(ValueError):
        cox_fit(df, names, l1_ratio=1.5)


def test_collinear_columns_and_constant(spark):
    x, t, e = sample()
    x = np.concatenate([x, x[:, :1], np.ones((len(x), 1))], axis=1)
    df, names = frame(spark, x, t, e)
    model = cox_fit(df, names, penalizer=0.01)
    assert np.isfinite(model.beta).all() and abs(model.beta[0] - model.beta[3]) < 1e-8


def test_save_load_and_score(spark, tmp_path):
    x, t, e = sample()
    df, names = frame(spark, x, t, e)
    model = cox_fit(df, names)
    model.save(spark, str(tmp_path / "m"))
    again = CoxModel.load(spark, str(tmp_path / "m"))
    row = df.select(model.prob_at(6).alias("a"), again.prob_at(6).alias("b")).first()
    assert abs(row["a"] - row["b"]) < 1e-12
    assert model.cumulative_at(0) == 0.0
    base = X.breslow(df.withColumn("eta", model.log_risk()), "eta").orderBy("time").collect()
    assert np.allclose([r["baseline_hazard"] for r in base], model.hazard)
    assert [r[:2] for r in again.ph_test_rows()] == [r[:2] for r in model.ph_test_rows()]


def test_step_lookup_edges(spark):
    steps = spark.createDataFrame([(3, 0.1), (5, 0.4)], "time int, baseline_cumulative_hazard double")
    df = spark.createDataFrame([(0,), (3,), (4,), (5,), (99,)], "h int")
    got = {r["h"]: r["step_value"] for r in X.step_lookup(df, steps, "h").collect()}
    assert got == {0: 0.0, 3: 0.1, 4: 0.1, 5: 0.4, 99: 0.4}
    assert X.step_at(steps, 2) == 0.0 and X.step_at(steps, 4) == 0.1


def test_cox_loss_matches_direct(spark):
    x, t, e = sample()
    df, names = frame(spark, x, t, e)
    df = df.withColumn("eta", F.col("x0") * 0.4 - F.col("x1") * 0.3)
    beta = np.array([0.4, -0.3, 0.0])
    for ties in ("efron", "breslow"):
        want = -direct_loglik(x, t, e, beta, ties == "efron") / e.sum()
        assert abs(X.cox_loss(df, "eta", ties=ties) - want) < 1e-9


@pytest.mark.parametrize("l1_ratio", [0.3, 1.0])
def test_lasso_meets_the_optimality_conditions(spark, l1_ratio):
    """Slopes of the plain likelihood at the optimum; weak features end at exactly zero."""
    x, t, e = sample(240, 5)
    df, names = frame(spark, x, t, e)
    model = cox_fit(df, names, penalizer=0.1, l1_ratio=l1_ratio)
    sd = x.std(axis=0, ddof=1)
    z, beta, n = (x - x.mean(axis=0)) / sd, model.beta * sd, len(x)
    ridge, lasso, h = n * 0.1 * (1 - l1_ratio), n * 0.1 * l1_ratio, 1e-5
    slope = np.array([(direct_loglik(z, t, e, beta + h * u) - direct_loglik(z, t, e, beta - h * u))
                      / (2 * h) for u in np.eye(5)]) - ridge * beta
    zero = model.beta == 0
    assert zero.any() and not zero.all() and model.converged
    assert np.allclose(slope[~zero], lasso * np.sign(beta[~zero]), atol=1e-3)
    assert (np.abs(slope[zero]) <= lasso + 1e-3).all()


@pytest.mark.parametrize("batch_norm,dropout", [(False, 0.0), (True, 0.25)])
def test_neural_gradient_is_the_slope(spark, monkeypatch, batch_norm, dropout):
    x, t, e = sample(120)
    df, names = frame(spark, x, t, e)
    design = Design(df, "event_time_months", "prepay_observed",
                    [*[F.col(n) for n in names], row_key("loan_seq_num")])
    w = MlpWeights.init(3, (4, 3), "gelu", dropout, batch_norm, seed=3)
    rows = ResidentRows(design.rows, design.p)
    trainer = Trainer(rows, 3, w, "efron")
    _, grads, _, _ = trainer.gradient(1)
    for name, at in (("W0", (1, 2)), ("W1", (0, 1)), ("Wout", (2, 0)), ("b1", (1,))):
        keep, h = w.arrays[name][at], 1e-4
        losses = []
        for step in (h, -h):
            w.arrays[name][at] = keep + step
            losses.append(trainer.gradient(1)[0])
        w.arrays[name][at] = keep
        slope = (losses[0] - losses[1]) / (2 * h)
        assert abs(grads[name][at] - slope) < 2e-5 + 1e-3 * abs(slope)
    loss = trainer.gradient(1)[0]
    rows.close()
    monkeypatch.setattr(resident, "LEAST_ROWS", 7)      # the same over several partitions
    monkeypatch.setattr(resident, "PARTITION_ROWS", 3)
    monkeypatch.setattr(resident, "DIRECT", 4)
    many = ResidentRows(design.rows, design.p)
    assert many.parts == 40
    other = Trainer(many, 3, w, "efron").gradient(1)
    assert abs(other[0] - loss) < 1e-12
    many.close()
    design.close()


def test_neural_training_and_scoring(spark, tmp_path):
    x, t, e = sample(200)
    df, names = frame(spark, x, t, e)
    xs = [F.col(n) for n in names]
    w, history = mlp_cox_fit(df.where("loan_seq_num < 150"), df.where("loan_seq_num >= 150"), xs,
                             hidden=(4,), epochs=4, batch_norm=False, dropout=0.0,
                             learning_rate=0.05, selection="loss")
    losses = [r["train_loss"] for r in history.orderBy("epoch").collect()]
    assert losses[-1] < losses[0]
    w.save(spark, str(tmp_path / "w"))
    again = MlpWeights.load(spark, str(tmp_path / "w"))
    got = {r[0]: r[1] for r in mlp_log_risk(df, again, xs, ["loan_seq_num"]).collect()}
    assert np.allclose([got[i] for i in range(200)], w.log_risk(x), atol=1e-12)
