"""Cox models, baselines and as-of lookups over fractional durations.

Whole-month operators send one row per month to the driver. Fractional durations may all differ, so
nothing here keeps a value per duration outside the executors. Risk sets are suffix sums in two levels:
inside a bounded range of durations, plus the totals of all later ranges.

- Scoring with a given log risk merges equal durations first and runs windows inside buckets.
- Fitting stores the rows once as blocks of consecutive durations. Every pass is a map over blocks; the
  driver sees a few vectors per block (at most ``MAX_BLOCKS``). A duration that spans several blocks is
  settled in its last block, which receives the sums of the others, so a duration shared by a third of
  all rows is spread over blocks like any other.

Rows in which the duration, the event flag, the log risk or a feature is NULL or NaN take no part, as a
missing duration has no place in any risk set. Further columns are ignored. Repeated rows count each
time. Without any row, or without any event, fits and losses raise ``ValueError``; baselines are empty.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loanlife.columns import EVENT, TIME
from loanlife.operators.cox import (CoxModel, _array_rows, _by_month, _newton, _suffix, sum_arrays,
                                    tie_sums)
from loanlife.operators.coxscore import step_at
from loanlife.operators.ranks import bucket_edges, default_buckets, running_totals, with_bucket
from loanlife.support import broadcast_if_small, discard, materialize

BLOCK_VALUES = 1 << 21    # numbers in a block
MAX_BLOCKS = 500_000


def _known(df: DataFrame, *columns: str) -> DataFrame:
    for c in columns:
        df = df.where(F.col(c).isNotNull() & ~F.isnan(c))
    return df


def _ties(s0: np.ndarray, t0: np.ndarray, d: np.ndarray, efron: bool) -> np.ndarray:
    """``tie_sums`` of every duration, as rows; single events and Breslow ties in closed form."""
    out = np.zeros((len(d), 6))
    plain = (d > 0) & ((d == 1) | (not efron))
    s = np.maximum(s0[plain], 1e-12)
    out[plain, 0], out[plain, 1], out[plain, 3] = d[plain] * np.log(s), d[plain] / s, d[plain] / s ** 2
    for i in np.flatnonzero((d > 0) & ~plain):
        out[i] = tie_sums(s0[i], t0[i], int(d[i]), efron)
    return out


# ---- scoring with a given log risk -----------------------------------------------------------

def _risk_sets(df: DataFrame, log_risk: str, time: str, event: str) -> DataFrame:
    """One row per duration ``t`` with its sums and ``cum_w``, the weight still at risk."""
    rows = _known(df.select(F.col(time).cast("double").alias("t"), F.col(event).cast("double").alias("e"),
                            F.col(log_risk).cast("double").alias("eta")), "t", "e", "eta")
    w = F.exp("eta")
    sums = materialize(rows.groupBy("t").agg(
        F.sum(w).alias("w"), F.sum(w * F.col("e")).alias("we"),
        F.sum(F.col("eta") * F.col("e")).alias("eta"), F.sum("e").alias("d")), "risk-sums")
    return running_totals(sums, "t", ["w", "we", "eta", "d"])


def continuous_loss(df: DataFrame, log_risk: str, time: str = TIME, event: str = EVENT,
                    ties: str = "efron") -> float:
    """Negative partial log-likelihood per event, over durations of any number and fraction."""
    if ties not in {"breslow", "efron"}:
        raise ValueError(f"unknown handling of ties: {ties!r}")
    efron = ties == "efron"

    def terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            d = np.rint(b["d"].to_numpy())
            logs = _ties(b["cum_w"].to_numpy(), b["we"].to_numpy(), d, efron)[:, 0]
            yield pd.DataFrame({"like": [float((b["eta"].to_numpy() - logs).sum())],
                                "events": [float(d.sum())]})

    sets = _risk_sets(df, log_risk, time, event).where("d > 0")
    like, events = sets.select("cum_w", "we", "eta", "d").mapInPandas(
        terms, "like double, events double").agg(F.sum("like"), F.sum("events")).first()
    discard(sets)
    if not events:
        raise ValueError("the loss is per event, and there are no events")
    return -like / events


def continuous_breslow(df: DataFrame, log_risk: str, time: str = TIME, event: str = EVENT) -> DataFrame:
    """Baseline hazard, cumulative hazard and survival at every duration with an event."""
    sets = _risk_sets(df, log_risk, time, event)
    steps = materialize(sets.where("d > 0").select(
        (-F.col("t")).alias("back"), (F.col("d") / F.col("cum_w")).alias("h")), "baseline-steps")
    discard(sets)
    return running_totals(steps, "back", ["h"]).select(
        (-F.col("back")).alias("time"), F.col("h").alias("baseline_hazard"),
        F.col("cum_h").alias("baseline_cumulative_hazard"),
        F.exp(-F.col("cum_h")).alias("baseline_survival"))


def asof_lookup(df: DataFrame, steps: DataFrame, horizon: str, t: str = "time",
                value: str = "baseline_cumulative_hazard", default: float = 0.0,
                out: str = "step_value") -> DataFrame:
    """The last step value not after each row's own horizon, which may be any fraction.

    Distinct horizons and steps are merged by time: inside a range bucket a window carries the last step
    on, and each bucket starts with the last step of the buckets before it. Rows find their value by an
    equality join on the horizon. Rows before the first step, and those with a NULL or NaN horizon, get
    ``default``. Of several steps at one time the greatest value counts; those without a time or value take
    no part. ``df`` keeps its columns; ``out``
    must not be one of them.
    """
    if out in df.columns:
        raise ValueError(f"the rows have a column {out!r} already")
    asked = _known(df.select(F.col(horizon).cast("double").alias("at")), "at").distinct()
    known = _known(steps.select(F.col(t).cast("double").alias("at"),
                                F.col(value).cast("double").alias("v")), "at", "v").groupBy("at").agg(
        F.max("v").alias("v"))
    merged = materialize(
        asked.select("at", F.lit(None).cast("double").alias("v"), F.lit(True).alias("asked"))
        .unionByName(known.select("at", "v", F.lit(False).alias("asked"))), "asof")
    merged = with_bucket(merged, "at", bucket_edges(merged, "at", default_buckets(merged)), "b")
    ends = merged.groupBy("b").agg(F.max_by("v", F.when(~F.col("asked"), F.col("at"))).alias("end"))
    # A row per bucket, 4,096 at most.
    before = Window.partitionBy(F.lit(1)).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("b", F.last("end", ignorenulls=True).over(before).alias("carry"))
    inside = Window.partitionBy("b").orderBy("at", "asked").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    found = merged.withColumn("own", F.last("v", ignorenulls=True).over(inside)).where("asked")
    found = found.join(F.broadcast(carried), "b").select(
        F.col("at").alias("__at"), F.coalesce("own", "carry").alias(out))
    return (df.withColumn("__at", F.col(horizon).cast("double"))
            .join(broadcast_if_small(found), "__at", "left")
            .withColumn(out, F.coalesce(F.col(out), F.lit(float(default)))).drop("__at"))


# ---- fitting ---------------------------------------------------------------------------------

_BLOCK = ("block long, t0 double, t1 double, t array<double>, e array<double>, n array<double>, "
          "x array<double>")


def _pack(p: int, size: int) -> Callable:
    rows_of_block = max(1, size // (p + 3))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []
        count = 0

        def emit() -> pa.RecordBatch:
            nonlocal number
            t, e, n = (np.concatenate([b.column(i).to_numpy() for b in held]).astype(float)
                       for i in range(3))
            x = np.concatenate([b.column(3).flatten().to_numpy(zero_copy_only=False) for b in held])
            number += 1
            return pa.record_batch([pa.array([v]) for v in (number - 1, t[0], t[-1], t, e, n, x)],
                                   names=["block", "t0", "t1", "t", "e", "n", "x"])

        for b in batches:
            at = 0
            while at < b.num_rows:
                part = b.slice(at, rows_of_block - count)
                held.append(part)
                count += part.num_rows
                at += part.num_rows
                if count == rows_of_block:
                    yield emit()
                    held, count = [], 0
        if count:
            yield emit()
    return run


@dataclass
class _Layout:
    """Blocks in the order of their durations. ``open_[i]``: the last duration of i goes on in i + 1."""

    place: dict[int, int]
    single: np.ndarray
    open_: np.ndarray
    owner: np.ndarray

    @classmethod
    def of(cls, rows: Sequence) -> "_Layout":
        rows = sorted(rows, key=lambda r: (r["t0"], r["t1"], r["block"]))
        first, last = (np.array([r[k] for r in rows], dtype=float) for k in ("t0", "t1"))
        open_ = np.zeros(len(rows), dtype=bool)
        open_[:-1] = last[:-1] == first[1:]
        single = first == last
        owner = np.arange(len(rows))
        for i in reversed(range(len(rows) - 1)):
            if open_[i]:
                owner[i] = owner[i + 1] if single[i + 1] else i + 1
        return cls({r["block"]: i for i, r in enumerate(rows)}, single, open_, owner)


class Blocks:
    """The stored design; offers the passes that a Newton fit asks for."""

    def __init__(self, df: DataFrame, time: str, event: str, features: Sequence[Column],
                 block_values: int = BLOCK_VALUES):
        self.p = len(features)
        self.null_loglik: dict[bool, float] = {}
        # 0.0 is added so that both zeros are one duration.
        rows = df.select((F.col(time).cast("double") + F.lit(0.0)).alias("t"),
                         F.col(event).cast("double").alias("e"),
                         F.array(*[f.cast("double") for f in features]).alias("x"))
        rows = _known(rows, "t", "e").where(~F.exists("x", lambda v: v.isNull() | F.isnan(v)))
        merged = rows.groupBy("t", "e", "x").agg(F.count(F.lit(1)).cast("double").alias("n"))
        # The hash splits a duration that very many rows share over several ranges.
        ranged = merged.repartitionByRange("t", F.xxhash64("e", "x")).sortWithinPartitions("t")
        stored = materialize(ranged.select("t", "e", "n", "x").mapInArrow(
            _pack(self.p, block_values), _BLOCK), "duration-blocks")
        index = stored.select("block", "t0", "t1").limit(MAX_BLOCKS + 1).collect()
        if len(index) > MAX_BLOCKS:
            raise ValueError(f"more than {MAX_BLOCKS} blocks of rows")
        self.layout = _Layout.of(index)
        self._stored = stored
        self.rows = stored.drop("t0", "t1").persist(StorageLevel.MEMORY_AND_DISK)

    def close(self) -> None:
        self.rows.unpersist()
        discard(self._stored)

    def _each(self, work: Callable[..., np.ndarray], summed: bool) -> np.ndarray:
        """``work(i, t, e, n, x)`` of every block: a row each, or their sum."""
        place, p = self.layout.place, self.p

        def part(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for r in range(b.num_rows):
                    t, e, n, x = (b.column(c)[r].values.to_numpy() for c in range(1, 5))
                    i = place[b.column(0)[r].as_py()]
                    yield _array_rows([0 if summed else i], [work(i, t, e, n, x.reshape(-1, p))])

        done = self.rows.mapInArrow(part, "k int, v array<double>")
        if summed:
            return sum_arrays(done)[1][0]
        got = done.toArrow().sort_by("k").column("v").combine_chunks()
        return got.flatten().to_numpy().reshape(len(place), -1)

    def moments(self) -> tuple[int, int, np.ndarray, np.ndarray]:
        """Row count, events, mean and sample standard deviation of every feature."""
        if not self.layout.place:
            raise ValueError("no complete rows to fit on")
        s = self._each(lambda i, t, e, n, x: np.concatenate([[n.sum(), n @ e], n @ x]), True)
        mean = s[2:] / s[0]
        square = self._each(lambda i, t, e, n, x: n @ (x - mean) ** 2, True)
        return int(s[0]), int(s[1]), mean, np.sqrt(square / max(s[0] - 1, 1))

    def month_sums(self, score: Callable, q: int) -> "BlockSums":
        return BlockSums(self, score, q)

    def gram(self, score: Callable, q: int, sums: "BlockSums") -> np.ndarray:
        return sums.gram()


def _by_duration(score: Callable) -> Callable:
    """Sums per duration of a block; columns w, w*e, eta*e, e, then w*z, w*e*z and e*z."""
    def run(t, e, n, x):
        z, eta = score(x)
        w = n * np.exp(eta)
        wz = z * w[:, None]
        stats = np.concatenate([np.stack([w, w * e, n * eta * e, n * e], axis=1), wz, wz * e[:, None],
                                z * (n * e)[:, None]], axis=1)
        times, (sums,) = _by_month(t, stats)
        return times, sums, z, w
    return run


class BlockSums:
    """Likelihood, gradient and curvature at one set of coefficients."""

    def __init__(self, blocks: Blocks, score: Callable, q: int):
        self.blocks, self.score, self.q = blocks, score, q
        lay, one = blocks.layout, _by_duration(score)

        def ends(i, t, e, n, x):
            _, sums, _, _ = one(t, e, n, x)
            return np.concatenate([sums[:, 0].sum(keepdims=True), sums[:, 4:4 + q].sum(axis=0),
                                   sums[0], sums[-1]])

        got = blocks._each(ends, False)
        total, last = got[:, :1 + q], got[:, -(4 + 3 * q):]
        self.later = np.zeros_like(total)
        self.later[:-1] = _suffix(total)[1:]
        # What earlier blocks hold of the duration a block begins with.
        self.extra = np.zeros((len(got), 4 + 3 * q))
        for i in np.flatnonzero(lay.open_):
            self.extra[i + 1] = last[i] + (self.extra[i] if lay.single[i] else 0)

    def _settled(self, efron: bool) -> Callable:
        """Durations of block i with whole risk sets; those settled in a later block have no events."""
        q, later, extra, open_, one = (self.q, self.later, self.extra, self.blocks.layout.open_,
                                       _by_duration(self.score))

        def run(i, t, e, n, x):
            times, sums, z, w = one(t, e, n, x)
            sums[0] += extra[i]
            s0, s1 = _suffix(sums[:, 0]) + later[i, 0], _suffix(sums[:, 4:4 + q]) + later[i, 1:]
            d = np.rint(sums[:, 3])
            if open_[i]:
                d[-1] = 0
            return times, sums, s0, s1, d, _ties(s0, sums[:, 1], d, efron), z, w
        return run

    def solve_ties(self, efron: bool) -> None:
        q, settled = self.q, self._settled(efron)

        def slopes(i, t, e, n, x):
            _, sums, s0, s1, d, ties, _, _ = settled(i, t, e, n, x)
            at = d > 0
            seen = sums[at, 4 + 2 * q:].sum(axis=0)
            due = (s1 * ties[:, 1:2] - sums[:, 4 + q:4 + 2 * q] * ties[:, 2:3]).sum(axis=0)
            return np.concatenate([[sums[at, 2].sum() - ties[:, 0].sum(), d.sum(), ties[:, 1].sum(),
                                    ties[0, 1], ties[0, 2]], seen, due])

        got = self.blocks._each(slopes, False)
        self.efron, self.like = efron, float(got[:, 0].sum())
        before = lambda v: np.cumsum(v) - v
        self.events_before, self.hazard_before = before(got[:, 1]), before(got[:, 2])
        own = self.blocks.layout.owner
        self.last_a, self.last_b = self.hazard_before[own] + got[own, 3], got[own, 4]
        self.event_x = got[:, 5:5 + q].sum(axis=0, keepdims=True)
        self._due = got[:, 5 + q:].sum(axis=0, keepdims=True)

    def loglik(self) -> float:
        return self.like

    def expected_x(self) -> np.ndarray:
        return self._due

    def outer(self) -> np.ndarray:
        return self._outer

    def gram(self) -> np.ndarray:
        q, settled, open_ = self.q, self._settled(self.efron), self.blocks.layout.open_
        hazard, last_a, last_b = self.hazard_before, self.last_a, self.last_b

        def squares(i, t, e, n, x):
            times, sums, _, s1, _, ties, z, w = settled(i, t, e, n, x)
            a, b = hazard[i] + np.cumsum(ties[:, 1]), ties[:, 2].copy()
            if open_[i]:
                a[-1], b[-1] = last_a[i], last_b[i]
            at = np.searchsorted(times, t)
            rows = (z * (w * (a[at] - e * b[at]))[:, None]).T @ z
            t1 = sums[:, 4 + q:4 + 2 * q]
            cross = (s1 * ties[:, 4:5]).T @ t1
            outer = (s1 * ties[:, 3:4]).T @ s1 - cross - cross.T + (t1 * ties[:, 5:6]).T @ t1
            return np.concatenate([rows.ravel(), outer.ravel()])

        got = self.blocks._each(squares, True).reshape(2, q, q)
        self._outer = got[1]
        return got[0]

    def residual_trend(self) -> tuple[np.ndarray, float, float]:
        """Sums over event times of rank * residual, events * rank and events * rank^2."""
        q, settled, before = self.q, self._settled(self.efron), self.events_before

        def ranked(i, t, e, n, x):
            _, sums, _, s1, d, ties, _, _ = settled(i, t, e, n, x)
            at = d > 0
            rank = (before[i] + np.cumsum(d) - (d - 1) / 2)[at]
            left = (sums[:, 4 + 2 * q:] - s1 * ties[:, 1:2] + sums[:, 4 + q:4 + 2 * q] * ties[:, 2:3])[at]
            return np.concatenate([rank @ left, [d[at] @ rank, d[at] @ rank ** 2]])

        got = self.blocks._each(ranked, True)
        return got[:q], float(got[q]), float(got[q + 1])


@dataclass
class ContinuousCox(CoxModel):
    """A fit over fractional durations; its baseline is a table, one row per event time."""

    steps: DataFrame | None = None
    trend: tuple[np.ndarray, float, float] | None = None

    def baseline(self, spark: SparkSession) -> DataFrame:
        return self.steps

    def baseline_rows(self) -> list:
        raise ValueError("the baseline may have as many rows as the data; use baseline()")

    def cumulative_at(self, horizon: float) -> float:
        return step_at(self.steps, horizon)

    def ph_test_rows(self) -> list[tuple[str, float, float, float]]:
        """Scaled Schoenfeld residuals against the mean rank of the event time."""
        from loanlife.functions.tails import chi2_tail
        ranked, first, second = self.trend
        mean = first / self.events
        spread = second - first * mean
        score = (ranked - mean * self.residuals.sum(axis=0)) @ self.covariance * self.events
        out = []
        for f, s, var in zip(self.features, score, np.diag(self.covariance)):
            stat = float(s ** 2 / (self.events * var * spread)) if var > 0 and spread > 0 else 0.0
            p = chi2_tail(stat, 1)
            out.append((f, stat, p, -float(np.log10(max(p, 1e-300)))))
        return out

    def save(self, spark: SparkSession, path: str) -> None:
        raise ValueError("write summary() and baseline() instead; the baseline is a table")


def cox_fit_continuous(df: DataFrame, features: Sequence[str] | Mapping[str, Column], time: str = TIME,
                       event: str = EVENT, penalizer: float = 0.01, ties: str = "efron",
                       l1_ratio: float = 0.0, max_iter: int = 30, tol: float = 1e-13,
                       block_values: int = BLOCK_VALUES) -> ContinuousCox:
    """Penalised Cox fit over durations that may be fractions, as many as there are rows.

    Penalty, ties and ``converged`` are those of ``cox_fit``; on whole months the two agree. Each step
    costs two passes over the blocks, plus one for the curvature.
    """
    if not 0 <= l1_ratio <= 1:
        raise ValueError("l1_ratio is a share, from 0 to 1")
    if ties not in {"breslow", "efron"}:
        raise ValueError(f"unknown handling of ties: {ties!r}")
    named = dict(features) if isinstance(features, Mapping) else {
        f: F.col(f"`{f}`") for f in features}
    blocks = Blocks(df, time, event, list(named.values()), block_values)
    try:
        n, events, mean, sd = blocks.moments()
        if events == 0:
            raise ValueError("no row has an event, so nothing can be fitted")
        scale = np.where(sd > 0, sd, 1.0)
        beta, sums, info, null, done, converged = _newton(
            blocks, mean, scale, n, penalizer, ties == "efron", max_iter, tol, None, l1_ratio)
        ranked, first, second = sums.residual_trend()
    finally:
        blocks.close()
    nothing = np.zeros(0)
    model = ContinuousCox(
        features=list(named), mean=mean, sd=sd, beta=beta / scale,
        covariance=np.linalg.pinv(info, hermitian=True) / np.outer(scale, scale),
        loglik=sums.loglik(), loglik_null=null, n=n, events=events, penalizer=penalizer, ties=ties,
        months=nothing, hazard=nothing, iterations=done,
        residuals=(sums.event_x - sums.expected_x()) * scale, month_events=nothing,
        converged=converged, trend=(ranked * scale, first, second))
    scored = df.select(F.col(time).alias("t"), F.col(event).alias("e"),
                       model.log_risk(named).alias("eta"))
    steps = continuous_breslow(scored, "eta", "t", "e")
    model.steps = materialize(steps, "baseline")
    discard(steps)
    return model
