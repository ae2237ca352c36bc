"""The registered long fits run with the full settings."""

import inspect

import pytest

import __spark_entry__ as entry
from loanlife.columns import EVENT, ID, MACRO_FEATURES, TIME
from loanlife.operators import boosting
from loanlife.plans import evaluation, modelling, protocol, sensitivity

SF = "/root/testdata/sf0.001"
QUERIES = entry.queries()


class Reached(Exception):
    pass


def _settings(monkeypatch, module, name, run):
    """Effective arguments of the first call of ``module.name``, which then ends the run."""
    real, seen = getattr(module, name), {}

    def stand_in(*args, **kwargs):
        bound = inspect.signature(real).bind(*args, **kwargs)
        bound.apply_defaults()
        seen.update(bound.arguments)
        raise Reached

    monkeypatch.setattr(module, name, stand_in)
    with pytest.raises(Reached):
        run()
    return seen


NEURAL = dict(hidden=(128, 64, 32), activation="gelu", dropout=0.05, batch_norm=True,
              learning_rate=1e-3, weight_decay=1e-4, cindex_every=5, selection="cindex")


@pytest.mark.parametrize("name, module, epochs, patience", [
    ("deep_cox_history", evaluation, 500, 50), ("protocol", protocol, 150, 20)])
def test_neural_queries_train_in_full(spark, monkeypatch, name, module, epochs, patience):
    seen = _settings(monkeypatch, module, "mlp_cox_fit", lambda: QUERIES[name](spark, SF))
    assert {k: seen[k] for k in NEURAL} == NEURAL
    assert (seen["epochs"], seen["patience"]) == (epochs, patience)
    assert seen["weights"] is None


@pytest.mark.parametrize("name, rule", [
    ("ml_gbt", dict(leaves=None, depth=6, min_rows=1, min_weight=200.0, ridge=1.0)),
    ("ml_gbt_leaf", dict(leaves=63, depth=None, min_rows=200, min_weight=1e-3, ridge=0.0))])
def test_boosting_queries_have_all_rounds(spark, monkeypatch, name, rule):
    seen = _settings(monkeypatch, evaluation, "fit_boosted", lambda: QUERIES[name](spark, SF))
    growth = boosting.PRESETS[seen["preset"]]
    assert {k: getattr(growth, k) for k in rule} == rule
    assert (growth.rounds, growth.rate, growth.row_share, growth.column_share) == (500, 0.05, 0.8, 0.8)


def test_sensitivity_axes(spark, monkeypatch):
    """Reference samples, two long windows and the macro model reach the grid."""
    seen = _settings(monkeypatch, modelling, "sensitivity_grid",
                     lambda: QUERIES["sensitivity_grid"](spark, SF))
    assert seen["samples"] == [None, 200_000, 500_000, 2_000_000]
    assert seen["penalizers"] == (0.001, 0.01, 0.05, 0.1)
    years = [w for w in seen["windows"].values() if w is not None]
    assert len(years) == 2 and all(len(w) == 5 for w in years)
    assert set(MACRO_FEATURES) <= set(seen["models"]["macro"])
    assert not set(MACRO_FEATURES) & set(seen["models"]["static"])
    assert set(seen["models"]["macro"]) <= set(seen["df"]["macro"].columns)


def test_grid_samples_at_or_above_all_rows_share_a_fit(spark, monkeypatch):
    rows = [(i, 1 + i % 7, i % 3 % 2, float(i * 37 % 11), 1995 + i % 2) for i in range(60)]
    df = spark.createDataFrame(
        rows, f"{ID} bigint, {TIME} int, {EVENT} int, a double, vintage_year int")
    calls = []
    fit = sensitivity.cox_fit
    monkeypatch.setattr(sensitivity, "cox_fit",
                        lambda *a, **k: calls.append(1) or fit(*a, **k))
    got = sensitivity.sensitivity_grid(
        {"m": df}, {"m": ["a"]}, penalizers=[0.1], samples=[None, 20, 60, 100]).collect()
    assert [(r["n_sample"], r["n"]) for r in got] == [(None, 60), (20, 20), (60, 60), (100, 60)]
    assert got[0]["coef"] == got[2]["coef"] == got[3]["coef"] != got[1]["coef"]
    assert len(calls) == 2
