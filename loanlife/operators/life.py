"""Non-parametric survival: life tables, Kaplan-Meier, smoothed hazard, log-rank, incidence.

Durations are whole months, so loans collapse to one row per stratum and month before any
ordering; windows only see those rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loanlife.columns import EVENT, TIME
from loanlife.functions.cleaning import whole_number
from loanlife.functions.tails import chi2_tail
from loanlife.operators.cox import sum_arrays
from loanlife.operators.ranks import running_sum, suffix_sum
from loanlife.support import bounded_collect, discard, keyed, materialize


def _by_time(by: Sequence[str]):
    return Window.partitionBy(*keyed(by)).orderBy("t")


def _with_zero(counts: DataFrame, by: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Add a month-0 row to strata that have none."""
    zero = F.struct(F.lit(0).alias("t"), *[F.lit(0).cast("bigint").alias(v) for v in values])
    own = F.struct("t", *values)
    counts = counts.withColumn("__first", F.row_number().over(_by_time(by)) == 1)
    fill = F.when(F.col("__first") & (F.col("t") > 0), F.array(zero, own)).otherwise(F.array(own))
    return counts.select(*by, F.explode(fill).alias("__r")).select(*by, "__r.*")


def life_table(df: DataFrame, time: str = TIME, event: str = EVENT, by: Sequence[str] = (),
               max_t: int | None = None) -> DataFrame:
    """Removed, observed and at-risk counts with the hazard, per stratum and month from 0."""
    by = list(by)
    rows = df.where(F.col(time).isNotNull())
    counts = rows.groupBy(*by, whole_number(rows, time).alias("t")).agg(
        F.count(F.lit(1)).alias("removed"), F.sum(F.col(event).cast("bigint")).alias("observed"))
    table = _with_zero(counts, by, ["removed", "observed"])
    table = table.withColumn("at_risk", suffix_sum(F.col("removed"), "t", by))
    table = table.withColumn("hazard", F.col("observed") / F.col("at_risk"))
    return table.where(F.col("t") <= max_t) if max_t is not None else table


def kaplan_meier(df: DataFrame, time: str = TIME, event: str = EVENT, by: Sequence[str] = (),
                 max_t: int | None = None) -> DataFrame:
    table = life_table(df, time, event, by, max_t)
    return table.withColumn("survival", F.product(1 - F.col("hazard")).over(_by_time(by)))


def smooth(table: DataFrame, half_width: int = 3, by: Sequence[str] = ()) -> DataFrame:
    """Centred rolling mean of the hazard over table rows (not over months)."""
    w = _by_time(by).rowsBetween(-half_width, half_width)
    return table.withColumn("smoothed", F.avg("hazard").over(w))


def stratified_survival(df: DataFrame, group: str, time: str = TIME, event: str = EVENT,
                        max_t: int | None = None, half_width: int = 3, min_group: int = 100
                        ) -> DataFrame:
    """Curves and smoothed hazard per group; groups under ``min_group`` loans are not drawn."""
    table = kaplan_meier(df.where(F.col(group).isNotNull()), time, event, [group], max_t=None)
    size = F.sum("removed").over(Window.partitionBy(group))
    table = table.withColumn("n_group", size).where(F.col("n_group") >= min_group)
    if max_t is not None:
        table = table.where(F.col("t") <= max_t)
    return smooth(table, half_width, [group])


def survival_at(table: DataFrame, times: Sequence[int], by: Sequence[str] = (),
                value: str = "survival") -> DataFrame:
    """Step value at the last table month not after each given month."""
    marks = F.explode(F.array(*[F.lit(t) for t in times]))
    return table.withColumn("at_month", marks).where("t <= at_month").groupBy(*by, "at_month").agg(
        F.max_by(value, "t").alias(value))


def peak_and_horizon(table: DataFrame, floor: int, by: Sequence[str] = ()) -> DataFrame:
    """Peak hazard, its first month, and the last month with enough loans at risk."""
    keep = (F.col("at_risk") >= floor) if floor > 0 else F.lit(True)
    grouped = table.groupBy(*by) if by else table.groupBy()
    return grouped.agg(
        F.max("hazard").alias("peak_hazard"),
        F.max_by("t", F.struct(F.col("hazard"), -F.col("t"))).alias("peak_month"),
        F.coalesce(F.max(F.when(keep, F.col("t"))), F.max("t")).alias("horizon"))


def loglog(table: DataFrame) -> DataFrame:
    """ln t against ln(-ln S), where both exist."""
    ok = (F.col("t") > 0) & (F.col("survival") > 0) & (F.col("survival") < 1)
    return table.where(ok).withColumns({"log_t": F.ln("t"),
                                        "loglog_s": F.ln(-F.ln("survival"))})


def cumulative_hazard(df: DataFrame, time: str = TIME, event: str = EVENT,
                      by: Sequence[str] = ()) -> DataFrame:
    table = life_table(df, time, event, by)
    return table.withColumn("cumulative_hazard", running_sum(F.col("hazard"), "t", by))


def aalen_johansen(df: DataFrame, causes: Mapping[str, str], time: str = TIME,
                   cause: str = "event_type", by: Sequence[str] = (),
                   max_t: int | None = None) -> DataFrame:
    """Cumulative incidence per cause with exact ties, all-cause survival, and 1-KM of each.

    ``causes`` maps the column suffix to the value of the cause column; any other value censors.
    """
    by = list(by)
    rows = df.where(F.col(time).isNotNull())
    counts = rows.groupBy(*by, whole_number(rows, time).alias("t")).agg(
        F.count(F.lit(1)).alias("removed"),
        *[F.count_if(F.col(cause) == v).alias(f"d_{k}") for k, v in causes.items()])
    table = _with_zero(counts, by, ["removed", *[f"d_{k}" for k in causes]])
    table = table.withColumn("at_risk", suffix_sum(F.col("removed"), "t", by))
    all_d = sum((F.col(f"d_{k}") for k in causes), F.lit(0))
    w = _by_time(by)
    table = table.withColumn("survival", F.product(1 - all_d / F.col("at_risk")).over(w))
    table = table.withColumn("__before", F.lag("survival", 1, 1.0).over(w))
    share = lambda k: F.col("__before") * F.col(f"d_{k}") / F.col("at_risk")
    table = table.withColumns({f"cif_{k}": F.sum(share(k)).over(w) for k in causes})
    table = table.withColumns({
        f"one_minus_km_{k}": 1 - F.product(1 - F.col(f"d_{k}") / F.col("at_risk")).over(w)
        for k in causes}).drop("__before")
    return table.where(F.col("t") <= max_t) if max_t is not None else table


def _group_rows(df: DataFrame, groups: Mapping[str, Column], time: str, event: str) -> DataFrame:
    """Exits and events per (name, group, month), in one scan for all groupings; loans without group,
    duration or flag are left out."""
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), g.cast("string").alias("grp"))
                                for n, g in groups.items()])).alias("p")
    rows = df.where(F.col(time).isNotNull() & F.col(event).isNotNull())
    long = rows.select(whole_number(rows, time).alias("t"), F.col(event).cast("bigint").alias("e"),
                       pairs).where("p.grp is not null")
    return long.groupBy("p.name", "p.grp", "t").agg(
        F.count(F.lit(1)).alias("removed"), F.sum("e").alias("observed"))


def _risk_vectors(cells: DataFrame) -> DataFrame:
    """One row per (name, month with events): ``events`` of all groups and ``risk``, the loans at risk
    of each group, in the order of the groups' names."""
    own = cells.select("name", "grp").distinct()
    months = cells.where("observed > 0").groupBy("name").agg(F.collect_set("t").alias("ts"))
    asked = own.join(months, "name").select("name", "grp", F.explode("ts").alias("t"))
    # A group's exits between two event months count at the earlier one's risk set and before.
    every = cells.select("name", "grp", "t", "removed", "observed", F.lit(0).alias("asked")).unionByName(
        asked.selectExpr("name", "grp", "t", "0L AS removed", "0L AS observed", "1 AS asked"))
    merged = every.groupBy("name", "grp", "t").agg(
        F.sum("removed").alias("removed"), F.sum("observed").alias("observed"),
        F.max("asked").alias("asked"))
    risk = merged.withColumn("risk", suffix_sum(F.col("removed"), "t", ["name", "grp"])).where("asked = 1")
    ordered = F.array_sort(F.collect_list(F.struct("grp", "risk")))
    return risk.groupBy("name", "t").agg(
        F.sum("observed").alias("events"),
        F.transform(ordered, lambda r: r["risk"].cast("double")).alias("risk"))


def _outer_sums(names: Sequence[str]):
    """Expected events (g numbers) and covariance (g x g) of a task's months, by grouping."""
    number = {n: i for i, n in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            name, events = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            for i, (n, d) in enumerate(zip(name, events)):
                risk = batch.column(2)[i].values.to_numpy()
                at_risk = risk.sum()
                share = risk / at_risk
                scale = d * (at_risk - d) / (at_risk - 1) if at_risk > 1 else 0.0
                spread = np.diag(scale * share) - scale * np.outer(share, share)
                old = total.setdefault(number[n], [np.zeros(len(risk)), np.zeros(spread.shape)])
                old[0] += d * share
                old[1] += spread
        if total:
            rows = [np.concatenate([e, c.ravel()]) for e, c in total.values()]
            ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(total), pa.int32()),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows)))], ["k", "v"])
    return run


class LogrankResult:
    """Observed and expected events per group, their covariance and the test."""

    def __init__(self, groups: list[str], n: np.ndarray, observed: np.ndarray,
                 expected: np.ndarray, covariance: np.ndarray):
        self.groups, self.n = groups, n
        self.observed, self.expected, self.covariance = observed, expected, covariance
        diff = observed - expected
        self.df = len(groups) - 1
        if self.df > 0:
            head = diff[:-1]
            self.chi2 = float(head @ np.linalg.pinv(covariance[:-1, :-1]) @ head)
        else:
            self.chi2 = 0.0
        self.p_value = chi2_tail(self.chi2, self.df) if self.df > 0 else 1.0


def logrank_tests(df: DataFrame, groups: Mapping[str, Column], time: str = TIME, event: str = EVENT,
                  max_groups: int = 2_000) -> dict[str, LogrankResult]:
    """A log-rank test for every grouping, all from one scan.

    Each (month, grouping) is a row with the loans at risk of every group; expected events and the
    covariance are sums over these rows, added on the executors. The driver gets the groups' totals and
    one matrix per grouping, which is what the test inverts; months and cells stay in Spark.
    """
    names = list(groups)
    cells = materialize(_group_rows(df, groups, time, event), "logrank-cells")
    totals = bounded_collect(cells.groupBy("name", "grp").agg(
        F.sum("removed").alias("n"), F.sum("observed").alias("o")), max_groups, "log-rank groups")
    sums = _risk_vectors(cells).select("name", "events", "risk").mapInArrow(
        _outer_sums(names), "k int, v array<double>")
    keys, block = sum_arrays(sums, len(names))
    discard(cells)
    found = dict(zip(keys.tolist(), block))
    out = {}
    for i, name in enumerate(names):
        own = sorted((r for r in totals if r["name"] == name), key=lambda r: r["grp"].encode())
        g = len(own)
        v = found.get(i, np.zeros(g + g * g))
        out[name] = LogrankResult([r["grp"] for r in own], np.array([float(r["n"]) for r in own]),
                                  np.array([float(r["o"]) for r in own]), v[:g],
                                  v[g:g + g * g].reshape(g, g))
    return out


def logrank(df: DataFrame, group: str, time: str = TIME, event: str = EVENT,
            max_groups: int = 2_000) -> LogrankResult:
    """Log-rank test over any number of groups and months."""
    return logrank_tests(df, {"g": F.col(group)}, time, event, max_groups)["g"]


def logrank_groups(df: DataFrame, group: str, time: str = TIME, event: str = EVENT) -> DataFrame:
    res = logrank(df, group, time, event)
    rows = [(g, int(n), float(o), float(e)) for g, n, o, e in
            zip(res.groups, res.n, res.observed, res.expected)]
    return df.sparkSession.createDataFrame(
        rows, "grp string, n_loans bigint, observed double, expected double")


def rank_logrank(df: DataFrame, groups: Mapping[str, Column], time: str = TIME,
                 event: str = EVENT, max_groups: int = 2_000) -> DataFrame:
    """One log-rank test per covariate, strongest first."""
    out = [(name, len(res.groups), int(res.n.sum()), res.chi2, res.p_value)
           for name, res in logrank_tests(df, groups, time, event, max_groups).items()]
    return df.sparkSession.createDataFrame(
        out, "covariate string, n_groups int, n_loans bigint, chi2 double, p_value double"
    ).orderBy(F.desc("chi2"))


def logrank_covariance(df: DataFrame, groups: Mapping[str, Column], time: str = TIME,
                       event: str = EVENT, max_groups: int = 2_000) -> DataFrame:
    """Covariance of observed less expected events, a row per grouping and pair of groups."""
    out = [(name, a, b, float(v)) for name, res in
           logrank_tests(df, groups, time, event, max_groups).items()
           for a, row in zip(res.groups, res.covariance) for b, v in zip(res.groups, row)]
    return df.sparkSession.createDataFrame(
        out, "covariate string, grp_a string, grp_b string, covariance double")
