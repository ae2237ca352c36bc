"""Queries over scores, binary models and the neural Cox model."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanlife import columns as K
from loanlife.operators import classify as M
from loanlife.operators import features as T
from loanlife.operators import metrics as E
from loanlife.operators.boosting import fit_boosted
from loanlife.operators.neural import MlpWeights, mlp_cox_fit, mlp_log_risk
from loanlife.operators.trees import Trees
from loanlife.plans.fixtures import Data
from loanlife.plans.modelling import (_splits_sql, cox_rows, labelled_splits,
                                      modelling_rows, stored_macro_rows, stored_rows)
from loanlife.plans.protocol import run_protocol
from loanlife.plans.registry import query, rounded
from loanlife.sources.sinks import write_handoff, write_predictions
from loanlife.sources.text import read_predictions
from loanlife.support import materialize, scratch_path

COX = ["fx_cox"]

# Given scores: two fixed formulas stand in for two models.
P_RATE = "round(1 / (1 + exp(-0.6 * (CAST(orig_rate AS DOUBLE) - 5))), 3)"
P_MIX = ("round(1 / (1 + exp(-0.3 * (CAST(orig_rate AS DOUBLE) - 5) "
         "+ 0.02 * (CAST(ltv AS DOUBLE) - 69))), 5)")
LONG_SQL = f"""sp AS ({_splits_sql()}),
w AS (SELECT sp.loan_seq_num, sp.split, sp.label AS y, {P_RATE} AS rate_prob, {P_MIX} AS mix_prob
  FROM sp JOIN fx_cox c ON c.loan_seq_num = sp.loan_seq_num),
l AS (SELECT loan_seq_num, split, 'Rate' AS model, y, rate_prob AS p FROM w UNION ALL
  SELECT loan_seq_num, split, 'Mix', y, mix_prob FROM w)"""
RANK_SQL = f"""{LONG_SQL},
sc AS (SELECT model, split, p, sum(y) AS pos, sum(1 - y) AS neg FROM l GROUP BY 1, 2, 3),
rk AS (SELECT *, sum(pos) OVER o AS cp, sum(neg) OVER o AS cn, sum(pos) OVER (PARTITION BY model,
  split) AS tp, sum(neg) OVER (PARTITION BY model, split) AS tn FROM sc
  WINDOW o AS (PARTITION BY model, split ORDER BY p DESC))"""
AUC_SQL = "sum(neg * (cp - pos + pos / 2)) / (max(tp) * max(tn))"
AP_SQL = "sum(pos * cp / (cp + cn)) / max(tp)"


def wide_scores(d: Data) -> DataFrame:
    """Label and scores per loan, stored once: the metrics read them several times."""
    scored = labelled_splits(d).select("loan_seq_num", "split", F.col("label").alias("y"),
                                       F.expr(P_RATE).alias("rate_prob"),
                                       F.expr(P_MIX).alias("mix_prob"))
    return materialize(scored, "scores")


def long_scores(d: Data) -> DataFrame:
    return E.long_predictions(wide_scores(d), {"Rate": "rate_prob", "Mix": "mix_prob"},
                              ["loan_seq_num", "split", "y"])


@query("auc", f"WITH {RANK_SQL} SELECT model, split, round({AUC_SQL}, 6) AS auc FROM rk "
              "GROUP BY 1, 2", COX)
def auc(d: Data) -> DataFrame:
    return rounded(E.model_metrics(long_scores(d)).select("model", "split", "auc"))


@query("average_precision", f"WITH {RANK_SQL} SELECT model, split, round({AP_SQL}, 6) AS ap "
                            "FROM rk GROUP BY 1, 2", COX)
def average_precision(d: Data) -> DataFrame:
    return rounded(E.model_metrics(long_scores(d)).select("model", "split", "ap"))


@query("brier", f"WITH {LONG_SQL} SELECT model, split, round(avg((p - y) * (p - y)), 6) AS brier "
                "FROM l GROUP BY 1, 2", COX)
def brier(d: Data) -> DataFrame:
    return rounded(E.model_metrics(long_scores(d)).select("model", "split", "brier"))


@query("model_metrics", f"""WITH {RANK_SQL} SELECT model, split,
CAST(max(tp) + max(tn) AS BIGINT) AS n, round(max(tp) / (max(tp) + max(tn)), 6) AS pos_rate,
round({AUC_SQL}, 6) AS auc, round({AP_SQL}, 6) AS ap,
round(sum(pos * (1 - p) * (1 - p) + neg * p * p) / (max(tp) + max(tn)), 6) AS brier
FROM rk GROUP BY 1, 2""", COX)
def model_metrics(d: Data) -> DataFrame:
    return rounded(E.model_metrics(long_scores(d)))


@query("roc_curve", f"""WITH {RANK_SQL} SELECT split, p AS threshold, round(cn / tn, 6) AS fpr,
round(cp / tp, 6) AS tpr FROM rk WHERE model = 'Rate'""", COX)
def roc_curve(d: Data) -> DataFrame:
    return rounded(E.roc_points(wide_scores(d), "y", "rate_prob", ["split"]))


@query("calibration", f"""WITH {LONG_SQL},
e AS (SELECT model, split, quantile_cont(p, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS q
  FROM l GROUP BY 1, 2),
b AS (SELECT l.*, len(list_filter(e.q, lambda v: v < l.p)) AS bin FROM l JOIN e
  ON e.model = l.model AND e.split = l.split)
SELECT model, split, CAST(bin AS INT) AS bin, CAST(count(*) AS BIGINT) AS n,
  round(avg(CAST(y AS DOUBLE)), 6) AS observed, round(avg(p), 6) AS predicted
FROM b GROUP BY 1, 2, 3""", COX)
def calibration(d: Data) -> DataFrame:
    return rounded(E.calibration(long_scores(d), "y", "p", by=["model", "split"]))


@query("predictions_wide", f"""WITH {LONG_SQL} SELECT loan_seq_num, split, rate_prob, mix_prob
FROM w""", COX)
def predictions_wide(d: Data) -> DataFrame:
    return E.predictions_wide(long_scores(d), ["Rate", "Mix"], ["loan_seq_num", "split"])


@query("align_predictions", f"""WITH {LONG_SQL} SELECT loan_seq_num, y, rate_prob FROM w
WHERE split = 'test' AND loan_seq_num % 9 <> 0""", COX)
def align_predictions(d: Data) -> DataFrame:
    """Scores written as text, with some loans missing, and aligned back to the labels."""
    test = wide_scores(d).where("split = 'test'")
    path = scratch_path(d.spark, "predictions")
    write_predictions(test.where("loan_seq_num % 9 <> 0"), path, "rate_prob")
    preds = read_predictions(d.spark, path, "rate_prob", id_type="bigint")
    return E.align_predictions(test.select("loan_seq_num", "y"), preds, "rate_prob")[0]


@query("handoff_tables", """SELECT loan_seq_num, event_time_months, prepay_observed, fico, state,
CAST(CASE WHEN prepay_observed = 1 AND event_time_months <= 60 THEN 1 ELSE 0 END AS INT)
  AS y_prepay_60m FROM fx_cox WHERE vintage_year IN (1998, 1999) AND
((prepay_observed = 1 AND event_time_months <= 60) OR event_time_months >= 60)""", COX)
def handoff_tables(d: Data) -> DataFrame:
    rows = T.horizon_label(modelling_rows(d).where("split = 'test'"), 60)
    path = scratch_path(d.spark, "handoff")
    write_handoff(rows, path, [K.ID, K.TIME, K.EVENT, *K.STATIC_FEATURES, *K.MACRO_FEATURES],
                  "y_prepay_60m")
    return d.spark.read.parquet(path).select(K.ID, K.TIME, K.EVENT, "fico", "state",
                                             "y_prepay_60m")


@query("replace_models", f"""WITH {LONG_SQL} SELECT model, split, CAST(count(*) AS BIGINT) AS n
FROM l GROUP BY 1, 2""", COX)
def replace_models(d: Data) -> DataFrame:
    """Results table after one model is evaluated again."""
    master = long_scores(d).groupBy("model", "split").agg((F.count(F.lit(1)) * 0).alias("n"))
    fresh = long_scores(d).groupBy("model", "split").agg(F.count(F.lit(1)).alias("n"))
    first = E.replace_models(master, fresh.where("model = 'Rate'"))
    return E.replace_models(first, fresh.where("model = 'Mix'"))


# ---- binary models ---------------------------------------------------------------------------

def binary_design(d: Data) -> tuple[DataFrame, list[str]]:
    """Encoded, complete rows of all splits with their labels; scaling is learnt on train."""
    rows, names = T.one_hot(
        labelled_splits(d, stored_macro_rows(d)),
        K.CATEGORICAL_FEATURES)
    features = sorted([c for c in K.STATIC_FEATURES + K.MACRO_FEATURES
                       if c not in K.CATEGORICAL_FEATURES] + names)
    rows = rows.dropna(subset=features).select(K.ID, "split", "label", *features)
    return materialize(rows, "design"), features


def scaled(rows: DataFrame, features: list[str]) -> DataFrame:
    prep = T.Preprocessor.fit(rows.where("split = 'train'"), features, [], fill_gaps=False)
    return prep.transform(rows, [K.ID, "split", "label"])


def _metrics(scored: DataFrame, name: str) -> DataFrame:
    """Scores are stored first: the metrics read them three times."""
    out = materialize(scored.select("split", F.col("label").alias("y"), "p"), "scores")
    return E.binary_metrics(out, "y", "p", ["split"]).select(F.lit(name).alias("model"), "*")


@query("ml_logistic")
def ml_logistic(d: Data) -> DataFrame:
    rows, features = binary_design(d)
    data = M.assemble(scaled(rows, features), features)
    model = M.fit_logistic(data.where("split = 'train'"), "label")
    return rounded(_metrics(M.score(model, data, features), "L1 logistic"))


@query("ml_logistic_coefs")
def ml_logistic_coefs(d: Data) -> DataFrame:
    rows, features = binary_design(d)
    train = M.assemble(scaled(rows, features), features).where("split = 'train'")
    model = M.fit_logistic(train, "label")
    return rounded(M.odds_table(model, features, d.spark))


@query("ml_random_forest")
def ml_random_forest(d: Data) -> DataFrame:
    rows, features = binary_design(d)
    model = M.fit_forest(M.assemble(rows, features).where("split = 'train'"), "label")
    return rounded(_metrics(M.score(model, rows, features), "Random Forest"))


@query("ml_forest_importance")
def ml_forest_importance(d: Data) -> DataFrame:
    rows, features = binary_design(d)
    train = M.assemble(rows, features).where("split = 'train'")
    model = M.fit_forest(train, "label")
    return rounded(M.importance_table(model, features, d.spark))


def _boosted(d: Data, preset: str) -> DataFrame:
    """Fitted, stored, loaded again and scored on all splits."""
    rows, features = binary_design(d)
    path = scratch_path(d.spark, "boosted")
    fit_boosted(rows.where("split = 'train'"), "label", features, preset).save(d.spark, path)
    scored = M.score(Trees.load(d.spark, path), rows, features)
    return rounded(_metrics(scored, f"Boosted trees, {preset}"))


@query("ml_gbt")
def ml_gbt(d: Data) -> DataFrame:
    return _boosted(d, "depth")


@query("ml_gbt_leaf")
def ml_gbt_leaf(d: Data) -> DataFrame:
    return _boosted(d, "leaf")


# ---- neural Cox ------------------------------------------------------------------------------

def fixed_weights(inputs: int) -> MlpWeights:
    """Weights from a formula, so that the forward pass has an exact SQL counterpart."""
    wave = lambda shape, k: np.array(
        [((7 * i + k) % 11 - 5) / 20.0 for i in range(int(np.prod(shape)))]).reshape(shape)
    return MlpWeights({"W0": wave((inputs, 3), 1), "b0": wave((3,), 2), "Wout": wave((3, 1), 3),
                       "bout": wave((1,), 4)}, 1, "relu")


def _forward_sql() -> str:
    w = fixed_weights(2).arrays
    x = ["(CAST(orig_rate AS DOUBLE) - 5)", "(CAST(ltv AS DOUBLE) - 69) / 17"]
    units = [" + ".join([str(w["b0"][j]), *[f"{w['W0'][i][j]} * ({v})" for i, v in enumerate(x)]])
             for j in range(3)]
    total = " + ".join([str(w["bout"][0]), *[f"{w['Wout'][j][0]} * greatest({u}, 0)"
                                             for j, u in enumerate(units)]])
    return f"SELECT loan_seq_num, round({total}, 6) AS log_risk FROM fx_cox"


@query("mlp_log_risk", _forward_sql(), COX)
def mlp_log_risk_query(d: Data) -> DataFrame:
    xs = [F.col("orig_rate") - 5, (F.col("ltv") - 69) / 17]
    return rounded(mlp_log_risk(cox_rows(d), fixed_weights(2), xs, ["loan_seq_num"]))


@query("deep_cox_history")
def deep_cox_history(d: Data) -> DataFrame:
    rows = stored_rows(d).select(K.ID, K.TIME, K.EVENT, *K.STATIC_FEATURES)
    tagged = T.stratified_split(rows, K.ID, K.EVENT, {"train": 0.85, "val": 0.15})
    train, val = tagged.where("split = 'train'"), tagged.where("split = 'val'")
    prep = T.Preprocessor.fit(train, K.STATIC_FEATURES)
    _, history = mlp_cox_fit(train, val, [e for _, e in prep.items()])
    return history.drop("epoch_seconds", "elapsed_seconds")


@query("protocol")
def protocol(d: Data) -> DataFrame:
    """Both models from the early vintages, scored on the three later evaluation sets."""
    rows = modelling_rows(d)
    features = [*K.STATIC_FEATURES, *K.MACRO_FEATURES]
    part = lambda s: rows.where(F.col("split") == s).select(K.ID, K.TIME, K.EVENT, *features)
    horizons = {"test": 60, "backtest_a": 24, "backtest_b": 12}
    result = run_protocol(part("train"), {n: (part(n), h) for n, h in horizons.items()}, features)
    parts = [df.select(F.lit(n).alias("split"), K.ID,
                       F.col(f"cox_prob_prepay_{horizons[n]}mo").alias("cox_prob"),
                       F.col(f"deep_cox_prob_prepay_{horizons[n]}mo").alias("deep_prob"))
             for n, df in result.predictions.items()]
    return rounded(parts[0].unionByName(parts[1]).unionByName(parts[2]))
