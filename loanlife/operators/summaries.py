"""Descriptive aggregates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanlife.operators.ranks import exact_quantiles


def vintage_means(orig: DataFrame, digits: Mapping[str, int], by: str = "vintage_year"
                  ) -> DataFrame:
    """Loan count and rounded feature means per vintage."""
    return orig.groupBy(by).agg(F.count(F.lit(1)).alias("n_loans"), *[
        F.round(F.avg(F.col(c).cast("double")), d).alias(f"{c}_mean") for c, d in digits.items()])


def event_rates(df: DataFrame, by: Sequence[str], kinds: Mapping[str, str]) -> DataFrame:
    """Share of each event type per group: ``{"prepay_rate": "prepaid", ...}``."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[
        F.avg((F.col("event_type") == v).cast("double")).alias(k) for k, v in kinds.items()])


def rate_incentive(panel_macro: DataFrame) -> DataFrame:
    """Mean borrower rate, market rate and their gap per month."""
    rate, market = F.col("current_rate").cast("double"), F.col("MORTGAGE30US")
    return panel_macro.groupBy("month").agg(
        F.avg(rate).alias("borrower_rate"), F.max(market).alias("market_rate"),
        F.avg(rate - market).alias("rate_incentive"))


def split_summary(df: DataFrame, label: str, by: Sequence[str] = ("split", "vintage_year")
                  ) -> DataFrame:
    return df.groupBy(*by).agg(
        F.count(label).alias("n"), F.sum(F.col(label).cast("bigint")).alias("positives"),
        F.avg(F.col(label).cast("double")).alias("prepay_rate"))


def dataset_overview(df: DataFrame, time: str, event: str, label: str | None = None) -> DataFrame:
    extra = [F.avg(F.col(label).cast("double")).alias("label_mean")] if label else []
    return df.agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(event).cast("double"))
                  .alias("event_mean"), F.min(time).alias("min_time"),
                  F.max(time).alias("max_time"), *extra)


def score_summary(df: DataFrame, score: str, probs: Sequence[float] = (0.1, 0.5, 0.9)
                  ) -> DataFrame:
    """Mean and exact percentiles of a score as one row."""
    got = exact_quantiles(df, [score], probs).get((), {score: [None] * len(probs)})[score]
    return df.agg(F.count(score).alias("n"), F.avg(score).alias("mean")).select(
        "n", "mean", *[F.lit(v).cast("double").alias(f"p{round(100 * p)}")
                       for p, v in zip(probs, got)])


def monthly_mean(series: Mapping[str, DataFrame], date: str = "date", value: str = "value"
                 ) -> DataFrame:
    """Calendar-month means of several series on one gap-free month axis; gaps stay NULL."""
    parts = [df.select(F.trunc(F.col(date).cast("date"), "MM").alias("month"),
                       F.lit(name).alias("series"), F.col(value).cast("double").alias("v"))
             for name, df in series.items()]
    long = parts[0]
    for p in parts[1:]:
        long = long.unionByName(p)
    wide = long.groupBy("month").agg(*[
        F.avg(F.when(F.col("series") == s, F.col("v"))).alias(s) for s in series])
    axis = wide.agg(F.explode(F.sequence(F.min("month"), F.max("month"),
                                         F.expr("interval 1 month"))).alias("month"))
    return axis.join(wide, "month", "left")
