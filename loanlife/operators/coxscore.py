"""Scoring with a given log risk: loss, baseline hazard, horizon probabilities, curves."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loanlife.columns import EVENT, TIME
from loanlife.functions.cleaning import whole_number
from loanlife.operators.cox import MAX_MONTHS, tie_sums
from loanlife.operators.ranks import running_sum, suffix_sum
from loanlife.support import bounded_collect, small_table


def linear_log_risk(coef: Mapping[str, float], mean: Mapping[str, float]) -> Column:
    """Sum of beta * (x - mean) as one expression."""
    total = F.lit(0.0)
    for name, b in coef.items():
        total = total + F.lit(b) * (F.col(name).cast("double") - F.lit(mean[name]))
    return total


def _risk_by_month(df: DataFrame, log_risk: str, time: str, event: str) -> DataFrame:
    w = F.exp(F.col(log_risk))
    e = F.col(event).cast("double")
    return df.groupBy(whole_number(df, time).alias("time")).agg(
        F.sum(w).alias("w"), F.sum(w * e).alias("we"), F.sum(F.col(log_risk) * e).alias("eta"),
        F.sum(e).alias("d"))


def cox_loss(df: DataFrame, log_risk: str, time: str = TIME, event: str = EVENT,
             ties: str = "efron") -> float:
    """Negative partial log-likelihood per event. Only per-month sums reach the driver."""
    if ties not in {"breslow", "efron"}:
        raise ValueError(f"unknown handling of ties: {ties!r}")
    rows = sorted(bounded_collect(_risk_by_month(df, log_risk, time, event), MAX_MONTHS,
                                  "durations"))
    events = sum(r["d"] for r in rows)
    if not events:
        raise ValueError("the loss is per event, and there are no events")
    total, at_risk = 0.0, 0.0
    for r in reversed(rows):
        at_risk += r["w"]
        if r["d"]:
            total += r["eta"] - tie_sums(at_risk, r["we"], int(r["d"]), ties == "efron")[0]
    return -total / events


def breslow(df: DataFrame, log_risk: str, time: str = TIME, event: str = EVENT) -> DataFrame:
    """Baseline hazard, cumulative hazard and survival at the event months."""
    months = _risk_by_month(df, log_risk, time, event)
    risk = months.withColumn("s0", suffix_sum(F.col("w"), "time")).where("d > 0")
    out = risk.select("time", (F.col("d") / F.col("s0")).alias("baseline_hazard"))
    out = out.withColumn("baseline_cumulative_hazard",
                         running_sum(F.col("baseline_hazard"), "time"))
    return out.withColumn("baseline_survival", F.exp(-F.col("baseline_cumulative_hazard")))


def step_at(steps: DataFrame, horizon: float, t: str = "time",
            value: str = "baseline_cumulative_hazard", default: float = 0.0) -> float:
    """Last step value not after the horizon, or the default before the first step."""
    got = steps.where(F.col(t) <= horizon).agg(F.max_by(value, t)).first()[0]
    return default if got is None else got


def step_lookup(df: DataFrame, steps: DataFrame, horizon: str, t: str = "time",
                value: str = "baseline_cumulative_hazard", default: float = 0.0,
                out: str = "step_value") -> DataFrame:
    """Per-row as-of lookup. Whole-month horizons turn it into an equality join.

    The step function is spread onto every month of its range, so no row is compared with more
    than one step; months after the last step take its value.
    """
    w = Window.partitionBy(F.lit(1)).orderBy(t)
    spans = steps.select(F.col(t).cast("int").alias("__from"), F.col(value).alias(out),
                         (F.lead(t).over(w) - 1).cast("int").alias("__to"))
    last = spans.agg(F.max("__from").alias("m"), F.max_by(out, "__from").alias("v")).first()
    months = spans.select(out, F.explode(F.sequence("__from", F.coalesce("__to", "__from")))
                          .alias("__m"))
    small, ok = small_table(months)
    key = F.floor(F.least(F.col(horizon), F.lit(last["m"]))).cast("int")
    return df.withColumn("__m", key).join(F.broadcast(small) if ok else small, "__m", "left") \
        .withColumn(out, F.coalesce(F.col(out), F.lit(default))).drop("__m")


def event_probability(log_risk: Column, cumulative: float) -> Column:
    return 1 - F.exp(-F.lit(float(cumulative)) * F.exp(log_risk))


def prob_at_horizon(df: DataFrame, baseline: DataFrame, log_risk: str, horizon: float,
                    out: str = "prob") -> DataFrame:
    return df.withColumn(out, event_probability(F.col(log_risk), step_at(baseline, horizon)))


def survival_curves(df: DataFrame, baseline: DataFrame, ids: Sequence, key: str, log_risk: str
                    ) -> DataFrame:
    """Survival over the baseline months for chosen rows, in long form."""
    chosen = df.where(F.col(key).isin(*ids)).select(key, log_risk)
    steps = [(r["time"], r["baseline_cumulative_hazard"])
             for r in bounded_collect(baseline, MAX_MONTHS, "baseline months")]
    axis = F.explode(F.array(*[
        F.struct(F.lit(t).alias("time"), F.lit(h).alias("h")) for t, h in sorted(steps)]))
    return chosen.withColumn("__s", axis).select(
        key, F.col("__s.time").alias("time"),
        F.exp(-F.col("__s.h") * F.exp(F.col(log_risk))).alias("survival"))
