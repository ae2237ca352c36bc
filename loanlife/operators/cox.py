"""Cox proportional hazards by distributed Newton steps.

Durations are whole months. With eta = x.beta and w = exp(eta), everything the partial likelihood
needs is a handful of sums per month: of w and w*x over the rows leaving in that month, and the
same over its events. Suffix sums over the (few hundred) months give the risk sets. The
information matrix is one weighted Gram matrix whose row weights depend on the row's month only,
so a step costs two passes over the design, kept in the executors as arrays (``resident``), and moves
months x p plus p x p numbers.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loanlife.columns import EVENT, TIME
from loanlife.functions.cleaning import whole_number
from loanlife.functions.tails import chi2_tail, normal_two_sided
from loanlife.operators.resident import PRODUCT_ROWS, ResidentRows
from loanlife.support import bounded_collect

MAX_MONTHS = 100_000


# ---- tied-event sums ------------------------------------------------------------------------

_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(16)
_EXPLICIT = 4096


def _tie_points(c: float, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Points v and weights so that sum(f(c - l), l = 0..d-1) is sum(weight * f(v)).

    Short ties are summed term by term. In a long one only the last terms, where f bends, are;
    the smooth head is a midpoint-shifted integral on log-spaced Gauss panels.
    """
    if d <= 2 * _EXPLICIT:
        v = c - np.arange(d)
        return v, np.ones(d)
    tail = c - np.arange(d - _EXPLICIT, d)
    low, high = c - (d - _EXPLICIT) + 0.5, c + 0.5
    edges = np.exp(np.linspace(math.log(low), math.log(high), 41))
    half, mid = np.diff(edges) / 2, (edges[1:] + edges[:-1]) / 2
    v = (mid[:, None] + half[:, None] * _NODES).ravel()
    return np.concatenate([v, tail]), np.concatenate(
        [(half[:, None] * _WEIGHTS).ravel(), np.ones(_EXPLICIT)])


def tie_sums(s0: float, t0: float, d: int, efron: bool) -> tuple[float, ...]:
    """Sums over the d tied events of ln(phi), 1/phi, u/phi, 1/phi^2, u/phi^2, u^2/phi^2.

    phi = s0 - u*t0 with u = l/d for Efron and u = 0 for Breslow ties.
    """
    if not efron or d == 1:
        s0 = max(s0, 1e-12)
        return d * math.log(s0), d / s0, 0.0, d / s0 ** 2, 0.0, 0.0
    unit = t0 / d
    c = s0 / unit
    v, k = _tie_points(c, d)
    phi, u = np.maximum(v * unit, 1e-12), (c - v) / d
    inv = 1.0 / phi
    return tuple(float(k @ f) for f in (np.log(phi), inv, u * inv, inv ** 2, u * inv ** 2,
                                        (u * inv) ** 2))


# ---- per-month sums -------------------------------------------------------------------------

@dataclass
class MonthSums:
    """Months in order, with suffix sums over the risk set already taken."""

    t: np.ndarray
    d: np.ndarray
    s0: np.ndarray
    t0: np.ndarray
    event_eta: np.ndarray
    s1: np.ndarray
    t1: np.ndarray
    event_x: np.ndarray
    shift: float = 0.0
    ties: list[tuple[float, ...]] = field(default_factory=list)

    def solve_ties(self, efron: bool) -> None:
        self.ties = [tie_sums(s, t, int(d), efron) if d else (0.0,) * 6
                     for s, t, d in zip(self.s0, self.t0, self.d)]

    def loglik(self) -> float:
        return float(self.event_eta.sum() - sum(q[0] for q in self.ties)
                     - self.shift * self.d.sum())

    def row_weights(self) -> tuple[np.ndarray, np.ndarray]:
        """A(t), B(t): a row's expected events are w * (A - e * B)."""
        a = np.cumsum([q[1] for q in self.ties])
        return a, np.array([q[2] for q in self.ties])

    def expected_x(self) -> np.ndarray:
        a = np.array([q[1] for q in self.ties])[:, None]
        b = np.array([q[2] for q in self.ties])[:, None]
        return self.s1 * a - self.t1 * b

    def outer(self) -> np.ndarray:
        a2, ab, b2 = (np.array([q[i] for q in self.ties]) for i in (3, 4, 5))
        cross = (self.s1 * ab[:, None]).T @ self.t1
        return ((self.s1 * a2[:, None]).T @ self.s1 - cross - cross.T
                + (self.t1 * b2[:, None]).T @ self.t1)


def _suffix(x: np.ndarray) -> np.ndarray:
    return x[::-1].cumsum(axis=0)[::-1]


def _matrix(batch: pa.RecordBatch, i: int, p: int) -> np.ndarray:
    return batch.column(i).flatten().to_numpy(zero_copy_only=False).reshape(-1, p)


def _by_month(t: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    order = np.argsort(t, kind="stable")
    months, first = np.unique(t[order], return_index=True)
    return months, [np.add.reduceat(v[order], first, axis=0) for v in values]


def _array_rows(keys: Sequence[int], values: Sequence[np.ndarray]) -> pa.RecordBatch:
    """(k, v) rows, v a list column."""
    ends = np.cumsum([0, *[len(v) for v in values]]).astype(np.int32)
    return pa.RecordBatch.from_arrays(
        [pa.array(keys, pa.int32()),
         pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(values)))], ["k", "v"])


SALTS = 8


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Element-wise sums per key of the (k, v) rows of one task."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            row = v.values.to_numpy()
            old = total.get(k)
            if old is None:
                total[k] = row.astype(float)
            elif len(old) >= len(row):
                old[:len(row)] += row
            else:
                total[k] = row + np.pad(old, (0, len(row) - len(old)))
    if total:
        yield _array_rows(list(total), list(total.values()))


def sum_arrays(parts: DataFrame, max_keys: int = MAX_MONTHS) -> tuple[np.ndarray, np.ndarray]:
    """Element-wise sums per key of the partition results, as (sorted keys, matrix).

    Tasks add whole arrays per key and one of ``SALTS`` groups of tasks; the driver adds the groups.
    The rows shuffled are keys x tasks, those collected keys x ``SALTS``, whatever the arrays' length.
    """
    groups = (parts.select("k", "v", (F.spark_partition_id() % SALTS).alias("s"))
              .repartition("k", "s").select("k", "v").mapInArrow(_add_up, "k int, v array<double>"))
    table = groups.limit(max_keys * SALTS + 1).toArrow()
    if table.num_rows > max_keys * SALTS:
        raise ValueError(f"more than {max_keys} distinct durations")
    batches = table.combine_chunks().to_batches()
    got = next(_add_up(batches), None)
    if got is None:
        return np.zeros(0, dtype=np.int32), np.zeros((0, 0))
    keys, column = got.column(0).to_numpy(), got.column(1).to_pylist()
    if len(keys) > max_keys:
        raise ValueError(f"more than {max_keys} distinct durations")
    order = np.argsort(keys)
    out = np.zeros((len(keys), max(map(len, column))))
    for i, j in enumerate(order):
        out[i, :len(column[j])] = column[j]
    return keys[order], out


class Design:
    """(t, e, x) rows, ``x`` one array column; fits pass over them as arrays kept in the executors."""

    def __init__(self, df: DataFrame, time: str, event: str, features: Sequence[Column]):
        self.p = len(features)
        self._moments: tuple | None = None
        self._held: ResidentRows | None = None
        self.null_loglik: dict[bool, float] = {}
        self.rows = df.select(
            whole_number(df, time).alias("t"), F.col(event).cast("double").alias("e"),
            F.array(*[f.cast("double") for f in features]).alias("x"),
        )

    def close(self) -> None:
        if self._held is not None:
            self._held.close()

    @property
    def held(self) -> ResidentRows:
        if self._held is None:
            self._held = ResidentRows(self.rows, self.p)
        return self._held

    def moments(self) -> tuple[int, int, np.ndarray, np.ndarray]:
        """Row count, events, mean and sample standard deviation of every feature."""
        if self._moments is not None:
            return self._moments
        rows = self.held.count
        if not rows:
            raise ValueError("no complete rows to fit on")
        events, n, mean, square = self.held.moments(self.p)
        if (n == 0).any():
            raise ValueError("a feature has no values")
        self._moments = rows, int(events), mean, np.sqrt(square / np.maximum(n - 1, 1))
        return self._moments

    def month_sums(self, score: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], q: int,
                   shift: float = 0.0) -> MonthSums:
        """One pass: ``score`` maps the raw x matrix to (z, eta) with ``q`` columns in z."""
        def parts(x: np.ndarray, t: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, ...]:
            z, eta = score(x)
            w = np.exp(eta - shift)
            v = np.stack([w, w * e, eta * e, e], axis=1)
            return v, v[:, [0, 1, 3]], z

        months, block = self.held.month_products(parts)
        if len(months) > MAX_MONTHS:
            raise ValueError(f"more than {MAX_MONTHS} distinct durations")
        s, v = block[:, :4], block[:, 4:]
        return MonthSums(
            t=months, d=np.rint(s[:, 3]), s0=_suffix(s[:, 0]), t0=s[:, 1], event_eta=s[:, 2],
            s1=_suffix(v[:, :q]), t1=v[:, q:2 * q], event_x=v[:, 2 * q:], shift=shift)

    def gram(self, score: Callable, q: int, sums: MonthSums) -> np.ndarray:
        """Second pass: sum of w*(A(t) - e*B(t)) * z z' over all rows."""
        months, shift = sums.t, sums.shift
        a, b_t = sums.row_weights()

        def block(x: np.ndarray, t: np.ndarray, e: np.ndarray) -> np.ndarray:
            z, eta = score(x)
            at = np.searchsorted(months, t)
            # Not negative, as a risk set holds its own tied events; the product of one matrix with
            # itself takes half the work.
            c = np.maximum(np.exp(eta - shift) * (a[at] - e * b_t[at]), 0.0)
            root = z * np.sqrt(c)[:, None]
            return root.T @ root

        return self.held.total(block, PRODUCT_ROWS)


# ---- model ----------------------------------------------------------------------------------

SUMMARY = ("feature string, mean double, sd double, coef double, hazard_ratio double, "
           "se double, coef_lower double, coef_upper double, hr_lower double, hr_upper double, "
           "z double, p_value double")


@dataclass
class CoxModel:
    """Coefficients on the raw feature scale; log risk is centred at the training means."""

    features: list[str]
    mean: np.ndarray
    sd: np.ndarray
    beta: np.ndarray
    covariance: np.ndarray
    loglik: float
    loglik_null: float
    n: int
    events: int
    penalizer: float
    ties: str
    months: np.ndarray
    hazard: np.ndarray
    iterations: int
    residuals: np.ndarray
    month_events: np.ndarray
    converged: bool = True

    @property
    def se(self) -> np.ndarray:
        return np.sqrt(np.maximum(np.diag(self.covariance), 0.0))

    def log_risk(self, columns: Mapping[str, Column] | None = None) -> Column:
        """(x - mean) . beta as a plain SQL expression."""
        pick = lambda f: columns[f] if columns is not None else F.col(f"`{f}`")
        terms = [(pick(f).cast("double") - F.lit(float(m))) * F.lit(float(b))
                 for f, m, b in zip(self.features, self.mean, self.beta)]
        total = terms[0]
        for term in terms[1:]:
            total = total + term
        return total

    def summary_rows(self) -> list[tuple]:
        out = []
        for f, m, s, b, se in zip(self.features, self.mean, self.sd, self.beta, self.se):
            lo, hi = b - 1.959963984540054 * se, b + 1.959963984540054 * se
            z = b / se if se > 0 else 0.0
            out.append(tuple([f] + [float(v) for v in (
                m, s, b, math.exp(b), se, lo, hi, math.exp(lo), math.exp(hi), z,
                normal_two_sided(z))]))
        return out

    def summary(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.summary_rows(), SUMMARY)

    def baseline_rows(self) -> list[tuple[int, float, float, float]]:
        cum = np.cumsum(self.hazard)
        return [(int(t), float(h), float(c), float(math.exp(-c)))
                for t, h, c in zip(self.months, self.hazard, cum)]

    def baseline(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(
            self.baseline_rows(), "time int, baseline_hazard double, "
            "baseline_cumulative_hazard double, baseline_survival double")

    def cumulative_at(self, horizon: float) -> float:
        """Baseline cumulative hazard at the last event month not after the horizon."""
        return float(self.hazard[self.months <= horizon].sum())

    def prob_at(self, horizon: float, log_risk: Column | None = None) -> Column:
        risk = log_risk if log_risk is not None else self.log_risk()
        return 1 - F.exp(-F.lit(self.cumulative_at(horizon)) * F.exp(risk))

    def ph_test_rows(self) -> list[tuple[str, float, float, float]]:
        """Scaled Schoenfeld residuals against the mean rank of the event month."""
        d = self.month_events
        rank = np.cumsum(d) - (d - 1) / 2.0
        g = rank - (rank * d).sum() / d.sum()
        spread = float((d * g ** 2).sum())
        scaled = self.events * (self.residuals @ self.covariance)
        score = (g[:, None] * scaled).sum(axis=0)
        out = []
        for f, s, var in zip(self.features, score, np.diag(self.covariance)):
            stat = float(s ** 2 / (self.events * var * spread)) if var > 0 and spread > 0 else 0.0
            p = chi2_tail(stat, 1)
            out.append((f, stat, p, -math.log10(max(p, 1e-300))))
        return out

    def ph_test(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(
            self.ph_test_rows(),
            "feature string, test_statistic double, p double, minus_log10_p double")

    def save(self, spark: SparkSession, path: str) -> None:
        """Coefficient, covariance, baseline and fit tables as Parquet."""
        path = path.rstrip("/")
        write = lambda rows, schema, name: spark.createDataFrame(rows, schema).coalesce(
            1).write.mode("overwrite").parquet(f"{path}/{name}")
        write([(i, f, float(m), float(s), float(b), [float(v) for v in row])
               for i, (f, m, s, b, row) in enumerate(zip(
                   self.features, self.mean, self.sd, self.beta, self.covariance))],
              "position int, feature string, mean double, sd double, beta double, "
              "covariance array<double>", "coef")
        write([(int(t), float(h), float(d), [float(v) for v in r]) for t, h, d, r in zip(
            self.months, self.hazard, self.month_events, self.residuals)],
            "time int, hazard double, events double, residuals array<double>", "baseline")
        write([(json.dumps({"loglik": self.loglik, "loglik_null": self.loglik_null, "n": self.n,
                            "events": self.events, "penalizer": self.penalizer, "ties": self.ties,
                            "iterations": self.iterations,
                            "converged": self.converged}),)], "fit string", "fit")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "CoxModel":
        path = path.rstrip("/")
        coef = spark.read.parquet(f"{path}/coef").orderBy("position").collect()
        base = spark.read.parquet(f"{path}/baseline").orderBy("time").collect()
        fit = json.loads(spark.read.parquet(f"{path}/fit").first()["fit"])
        arr = lambda rows, c: np.array([r[c] for r in rows], dtype=float)
        return cls(features=[r["feature"] for r in coef], mean=arr(coef, "mean"),
                   sd=arr(coef, "sd"), beta=arr(coef, "beta"),
                   covariance=arr(coef, "covariance"), months=arr(base, "time"),
                   hazard=arr(base, "hazard"), residuals=arr(base, "residuals"),
                   month_events=arr(base, "events"), **fit)


def _lasso_step(beta: np.ndarray, grad: np.ndarray, info: np.ndarray, weight: float,
                sweeps: int = 10_000) -> np.ndarray:
    """The move to the optimum of the quadratic model plus ``weight * |beta|_1``.

    Coordinate descent on the information matrix; a coordinate whose slope stays within the weight ends
    at exactly zero.
    """
    to, slope = beta.copy(), grad.astype(float)      # slope of the model at ``to``
    for _ in range(sweeps):
        largest = 0.0
        for j in range(len(to)):
            curve = info[j, j]
            if curve <= 0:
                continue
            pull = slope[j] + curve * to[j]
            new = np.sign(pull) * max(abs(pull) - weight, 0.0) / curve
            change = new - to[j]
            if change:
                slope -= info[:, j] * change
                to[j] = new
                largest = max(largest, abs(change) * math.sqrt(curve))
        if largest < 1e-12:
            break
    return to - beta


def _newton(design: Design, mean: np.ndarray, sd: np.ndarray, n: int, penalizer: float,
            efron: bool, max_iter: int, tol: float, start: np.ndarray | None,
            l1_ratio: float = 0.0):
    q, scale = len(mean), 1.0 / sd
    ridge, lasso = n * penalizer * (1 - l1_ratio), n * penalizer * l1_ratio

    def scored(beta: np.ndarray):
        def score(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            z = x - mean
            z *= scale
            return z, z @ beta
        return score

    def evaluate(beta: np.ndarray) -> tuple[MonthSums, float]:
        sums = design.month_sums(scored(beta), q)
        sums.solve_ties(efron)
        return sums, (sums.loglik() - ridge / 2 * float(beta @ beta)
                      - lasso * float(np.abs(beta).sum()))

    def curvature(beta: np.ndarray, sums: MonthSums) -> np.ndarray:
        return design.gram(scored(beta), q, sums) - sums.outer() + ridge * np.eye(q)

    beta = np.zeros(q)
    if start is None or efron not in design.null_loglik:
        sums, value = evaluate(beta)
        design.null_loglik[efron] = sums.loglik()
    if start is not None:
        beta = start
        sums, value = evaluate(beta)
    null = design.null_loglik[efron]
    info = np.eye(q)
    done = 0
    for done in range(1, max_iter + 1):
        info = curvature(beta, sums)
        grad = (sums.event_x - sums.expected_x()).sum(axis=0) - ridge * beta
        if lasso:
            step = _lasso_step(beta, grad, info, lasso)
            rise = grad @ step - step @ info @ step / 2 - lasso * (
                np.abs(beta + step).sum() - np.abs(beta).sum())
        else:
            step = np.linalg.pinv(info, hermitian=True) @ grad
            rise = grad @ step / 2
        if float(rise) < tol:
            break
        size = 1.0
        while True:
            trial = beta + size * step
            with np.errstate(over="ignore", invalid="ignore"):
                new_sums, new_value = evaluate(trial)
            if np.isfinite(new_value) and new_value >= value - 1e-9 * abs(value):
                break
            size /= 2
            if size < 1e-4:
                return beta, sums, info, null, done, False
        beta, sums, value = trial, new_sums, new_value
    else:
        return beta, sums, curvature(beta, sums), null, done, False
    return beta, sums, info, null, done, True


def cox_fit(df: DataFrame, features: Sequence[str] | Mapping[str, Column], time: str = TIME,
            event: str = EVENT, penalizer: float = 0.01, ties: str = "efron",
            l1_ratio: float = 0.0, max_iter: int = 30, tol: float = 1e-13,
            design: Design | None = None, start: CoxModel | None = None) -> CoxModel:
    """Penalised Cox fit on every row given.

    The penalty is ``n * penalizer * ((1 - l1_ratio) / 2 * |beta|^2 + l1_ratio * |beta|_1)`` on
    standardised features. With an L1 share each Newton step minimises the quadratic model by coordinate
    descent, and coefficients can be exactly zero; standard errors are those of the smooth part. Rows
    with NULLs must have been dropped or filled. ``design`` reuses a cached matrix and ``start`` begins at
    another fit's coefficients; neither changes the optimum. ``converged`` of the result is false
    when ``max_iter`` ran out or no step raised the likelihood; after ``max_iter`` the curvature is
    that of the last coefficients.
    """
    if not 0 <= l1_ratio <= 1:
        raise ValueError("l1_ratio is a share, from 0 to 1")
    if ties not in {"breslow", "efron"}:
        raise ValueError(f"unknown handling of ties: {ties!r}")
    named = dict(features) if isinstance(features, Mapping) else {
        f: F.col(f"`{f}`") for f in features}
    own = design is None
    design = design or Design(df, time, event, list(named.values()))
    try:
        n, events, mean, sd = design.moments()
        if events == 0:
            raise ValueError("no row has an event, so nothing can be fitted")
        scale = np.where(sd > 0, sd, 1.0)
        beta, sums, info, null, done, converged = _newton(
            design, mean, scale, n, penalizer, ties == "efron", max_iter, tol,
            None if start is None else start.beta * scale, l1_ratio)
    finally:
        if own:
            design.close()
    at = sums.d > 0
    resid = (sums.event_x - sums.expected_x())[at] * scale
    return CoxModel(
        features=list(named), mean=mean, sd=sd, beta=beta / scale,
        covariance=np.linalg.pinv(info, hermitian=True) / np.outer(scale, scale),
        loglik=sums.loglik(), loglik_null=null, n=n, events=events, penalizer=penalizer,
        ties=ties, months=sums.t[at], hazard=sums.d[at] / sums.s0[at], iterations=done,
        residuals=resid, month_events=sums.d[at], converged=converged)


def cox_univariate(df: DataFrame, features: Sequence[str], time: str = TIME, event: str = EVENT,
                   max_iter: int = 30, tol: float = 1e-10) -> list[dict]:
    """A separate one-covariate fit per feature, all in the same aggregation.

    Each feature uses the rows where it is not NULL. With one covariate the second moments are
    just more sums per month, so a step is a single built-in aggregation. ``converged`` tells
    whether the steps became small enough before ``max_iter``.
    """
    stats = df.where(F.col(time).isNotNull() & F.col(event).isNotNull()).agg(*[
        g(F.col(f).cast("double")).alias(f"{n}{i}") for i, f in enumerate(features)
        for n, g in (("n", F.count), ("m", F.avg), ("s", F.stddev_samp))]).first()
    mean = [stats[f"m{i}"] for i in range(len(features))]
    sd = [stats[f"s{i}"] or 1.0 for i in range(len(features))]
    rows = df.where(F.col(time).isNotNull() & F.col(event).isNotNull()).select(
        whole_number(df, time).alias("t"), F.col(event).cast("double").alias("e"),
        *[((F.col(f).cast("double") - m) / s).alias(f"x{i}")
          for i, (f, m, s) in enumerate(zip(features, mean, sd))],
    ).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        p = len(features)
        beta, null, like = [0.0] * p, [0.0] * p, [0.0] * p
        moving = set(range(p))
        for it in range(max_iter):
            aggs = []
            for i in moving:
                x = F.col(f"x{i}")
                e = F.when(x.isNotNull(), F.col("e"))
                w = F.exp(x * beta[i])
                for k, v in enumerate((w, w * x, w * x * x)):
                    aggs += [F.sum(v).alias(f"s{k}_{i}"), F.sum(v * e).alias(f"t{k}_{i}")]
                aggs += [F.sum(e).alias(f"d_{i}"), F.sum(x * e).alias(f"u_{i}")]
            got = sorted(bounded_collect(rows.groupBy("t").agg(*aggs), MAX_MONTHS, "durations"),
                         key=lambda r: r["t"])
            for i in sorted(moving):
                col = lambda c: np.array([r[f"{c}_{i}"] or 0.0 for r in got])
                s0, s1, s2 = (_suffix(col(f"s{k}")) for k in range(3))
                t0, t1, t2 = (col(f"t{k}") for k in range(3))
                d, u = np.rint(col("d")), col("u")
                q = np.array([tie_sums(a, b, int(k), True) if k else (0.0,) * 6
                              for a, b, k in zip(s0, t0, d)])
                like[i] = float(beta[i] * u.sum() - q[:, 0].sum())
                if it == 0:
                    null[i] = like[i]
                grad = float((u - s1 * q[:, 1] + t1 * q[:, 2]).sum())
                info = float((s2 * q[:, 1] - t2 * q[:, 2] - s1 ** 2 * q[:, 3]
                              + 2 * s1 * t1 * q[:, 4] - t1 ** 2 * q[:, 5]).sum())
                step = grad / info if info > 0 else 0.0
                if abs(grad * step) / 2 < tol:
                    moving.discard(i)
                    like[i] += grad * step / 2
                beta[i] += max(-2.0, min(2.0, step))
            if not moving:
                break
    finally:
        rows.unpersist()
    return [{"covariate": f, "n": int(stats[f"n{i}"]), "coef": beta[i] / sd[i],
             "hazard_ratio": math.exp(beta[i] / sd[i]),
             "cox_lr_chi2": 2 * (like[i] - null[i]),
             "converged": i not in moving} for i, f in enumerate(features)]


def compare_models(spark: SparkSession, models: Mapping[str, CoxModel]) -> DataFrame:
    """Coefficients of several fits, stacked with the model name."""
    rows = [(name, *r) for name, m in models.items() for r in m.summary_rows()]
    return spark.createDataFrame(rows, f"model string, {SUMMARY}")
